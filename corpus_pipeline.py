"""The corpus pipeline: quality rules, toxicity, near duplicates, mixing and packing, each stage written and read again.

This file belongs to fieldledger.llm and can't be imported without it; __spark_entry__.py alone looks whether it is there.

In every stage a row is known by itself, not by its doc_id: rows with a null or a repeated id stay or go by their own
texts. A null text is empty, a null source is a source of its own. Tables may be empty and may have further columns, of
whatever names; all stages but the last return the columns that they are given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldledger.llm.mixing import mix
from fieldledger.llm.ngramjoin import one_of_each
from fieldledger.llm.packing import pack
from fieldledger.llm.quality import keep_documents
from fieldledger.llm.toxicity import drop_toxic
from fieldledger.session import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the frequent lines of a host from the texts; documents that the rules reject go.

    Rejected are texts of less than 20 words (null and empty ones among them), texts that repeat themselves, and those of
    which too little is left without the frequent lines. Copies of one text count once in a line's documents, so they
    all stay or go together. An empty table stays empty.
    """
    return keep_documents(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more go; learnt from the labels of documents that came this far.

    Without labels of both classes nothing is known to be toxic, and all documents stay. Equal texts score alike.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the least doc_id, a null one last.

    Of equal ids the row that comes first stays. Documents without a word are no duplicates of each other and stay.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document once at least, those of small sources again.

    Which documents come once more is drawn by a hash of id and text, so equal rows come equally often.
    """
    return mix(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids: a row a piece. Each row of the input is packed, repeated ones each; none gives no sequence."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("toxicity", toxicity),
    ("ngram_join", near_duplicates),
    ("mixing", mixing),
    ("best_fit_packing", packing),
]

#: Hashes, a learnt model and tokens: SQL can't express the stages. The test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
