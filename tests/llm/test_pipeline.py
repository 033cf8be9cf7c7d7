"""The pipeline against stage-wise brute force on a small corpus."""

from collections import Counter

import public_tokenizers
import pytest
from helpers import make, odd_rows, sentence
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    rows = [(i, t, "a", "en") for i, t in odd_rows()]
    rows += [(100 + i, sentence(500 + i, 60) + (" scum idiot" if i % 3 == 0 else " kind friend"), "ab"[i % 2], "en") for i in range(90)]
    docs = make(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in kept.collect()}
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert {r["doc_id"] for r in kept.collect()} <= before
    want = {1, 7, 9} | {100 + i for i in range(90) if i % 3}
    assert {r["doc_id"] for r in kept.collect()} == want
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == want
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    times = Counter(r["doc_id"] for r in out if r["piece"] == 0)
    tokens = sum((len(library.encode(t, add_special_tokens=False).ids) + 1) * times[i] for i, t, *_ in rows if i in want)
    assert sum(r["length"] for r in out) == tokens


def test_rows_without_an_id_and_empty_tables(spark, tmp_path):
    """Null and repeated ids, a further column that clashes, and an empty table, through the whole pipeline."""
    x, y, z = sentence(1, 80), sentence(2, 80), sentence(3, 80)
    rows = [(1, x, "a", "en"), (5, x, "a", "en"), (5, y, "a", "en"), (None, x, None, "en"), (None, z, None, None), (None, None, None, None), (7, "", "a", "en")]
    docs = make(spark, rows).withColumnRenamed("extra", "row")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(1, x), (5, y), (None, z)}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 5, None}
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
