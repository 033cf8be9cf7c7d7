"""Encoding, the id store, packing and token counts against the library and brute force."""

import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from helpers import make, odd_rows, sentence
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldledger import session
from fieldledger.llm import bpe, idstore, packing, tokencount
from fieldledger.llm.bpe import Encoder
from fieldledger.llm.tokencount import Counter as TokenCounter
from fieldledger.llm.tokencount import Exit

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = ["", " ", "a  b", " a", "a ", "a\n b", "x\n\n y", "it's 'll don't  I'LL", "a<|endoftext|>b<|startoftext|>", "Ünïcödé ß µ ² ½ ª", "日本語", "á e", "12345 1,234.5", "!!'s ''s 'r 've", "İstanbul ΣΑΣ", "a\x1cb\x85c\xa0d"]


def odd_texts(n=400):
    rng = random.Random(1)
    return ODD + ["".join(rng.choice(" abcthe'.!1\nÉé-_rvlsm日") for _ in range(60)) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_the_library(path):
    e, library = Encoder(path), Tokenizer.from_file(path)
    for text in odd_texts():
        assert e.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_batches_are_the_library(path, monkeypatch):
    """Whole tables and odd texts, many at a time, in slices and parts of any size."""
    library, docs = Tokenizer.from_file(path), pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    texts = [*odd_texts(3000), None, *docs, "x" * 3000 + " y", "word " * 5000, "a\n \n b  c\n", "don't 's 're re's'd ''s"]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    e = Encoder(path)
    assert e.known and [x.tolist() for x in e.encode_many(texts)] == want
    monkeypatch.setattr(bpe, "SLICE", 50)
    assert [x.tolist() for x in e.encode_many(texts[:3100])] == want[:3100]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe.Powers, "inverse", lambda self, at, n: np.zeros(len(at), np.uint64))
    e, library = Encoder(BYTE), Tokenizer.from_file(BYTE)
    assert e.encode("one two, two three").tolist() == library.encode("one two, two three", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_are_merged_once_a_worker(path, monkeypatch):
    """A second slice merges new words alone, and a table with few places forgets words without mistaking them."""
    e, library, text = Encoder(path), Tokenizer.from_file(path), sentence(3, 300)
    want = library.encode(text, add_special_tokens=False).ids
    assert e.encode(text).tolist() == want
    merged, encode = [], bpe.Batched.encode
    monkeypatch.setattr(bpe.Batched, "encode", lambda self, raw, starts, sizes: merged.append(len(starts)) or encode(self, raw, starts, sizes))
    assert e.encode(text).tolist() == want and merged == [0]
    monkeypatch.setattr(bpe, "PLACES", 8)
    e = Encoder(path)
    for text in odd_texts():
        assert e.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_remembered_words_are_not_sorted(path, monkeypatch):
    """Words that are remembered are found by their bytes alone; longer ones with the same beginning are others."""
    e, library = Encoder(path), Tokenizer.from_file(path)
    short, long = "one two two" + " abcdefghijklmno" * 2, " abcdefghijklmnop abcdefghijklmnoé abcdefghijklmno"
    texts = [short, short + long, "é " + short, short, long + " é"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [e.encode(t).tolist() for t in texts] == want and [x.tolist() for x in e.encode_many(texts)] == want
    seen, distinct = [], Encoder._distinct
    monkeypatch.setattr(Encoder, "_distinct", staticmethod(lambda raw, at, sizes: seen.append(len(at)) or distinct(raw, at, sizes)))
    assert e.encode(short).tolist() == want[0] and seen == [0]
    assert e.encode(texts[1]).tolist() == want[1] and 0 < seen[1] <= 3


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_table_of_pairs(path):
    merges = bpe.Merges(path)
    b, ids, pairs = bpe.Batched(merges), merges.vocab, list(merges.ranks)
    left, right = (np.array([ids[p[k]] for p in pairs], np.int32) for k in (0, 1))
    assert b.ranks(left, right).tolist() == list(merges.ranks.values()) and len(b.keys) == 0
    other = [merges.ranks.get((p[0], q[1]), b.none) for p, q in zip(pairs, pairs[1:], strict=False)]
    assert b.ranks(left[:-1], right[1:]).tolist() == other


def test_unknown_forms_go_to_the_library(tmp_path):
    spec = json.load(open(BYTE, encoding="utf-8"))
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "other.json").write_text(json.dumps(spec))
    e = Encoder(str(tmp_path / "other.json"))
    assert not e.known and e.encode("Some Text").tolist() == Tokenizer.from_file(BYTE).encode("some text", add_special_tokens=False).ids


@pytest.mark.parametrize("chunk", [3, 7, 1 << 16])
def test_transducer_is_the_library(chunk, monkeypatch):
    monkeypatch.setattr(tokencount, "CHUNK", chunk)
    c, library = TokenCounter(WORD), Tokenizer.from_file(WORD)
    for text in odd_texts():
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert c.tokens(text) == want, repr(text)
        lowered, extra = c.normalise(text)
        maps = [c.map(lowered[k : k + chunk]) for k in range(0, len(lowered), chunk)]
        if maps:  # the scan's last map is the whole text's
            whole = c.scan(maps)[-1]
            at, n = c.read(Exit(), whole.head)
            n += c.close(at) + (0 if whole.exit is None else whole.count + c.close(whole.exit))
            assert n + extra == want


def test_maps_of_texts_without_white_space_are_small():
    c = TokenCounter(WORD)
    for text in ("日本語、" * 1000, "a1" * 2000, "x-y'" * 1000):
        assert len(c.map(text).head) < 8
        assert c.total([c.map(text[k : k + 11]) for k in range(0, len(text), 11)]) == len(Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids)


def test_null_and_repeated_ids_and_further_columns(spark):
    rows = [(None, "one two"), (3, "one"), (3, "one two three"), (3, "one")]
    docs = make(spark, rows).withColumn("row", F.lit(1)).withColumn("part", F.lit(2)).withColumn("length", F.lit(3))
    for long in (1 << 20, 2):
        got = sorted(((r["doc_id"], r["n_tokens"]) for r in tokencount.count_tokens(docs, WORD, long=long).collect()), key=repr)
        assert got == sorted([(None, 2), (3, 1), (3, 3), (3, 1)], key=repr)
    packed = packing.pack(docs, WORD).collect()
    assert sorted(((r["doc_id"], r["length"]) for r in packed), key=repr) == sorted([(None, 3), (3, 2), (3, 4), (3, 2)], key=repr)
    stored = idstore.read_store(spark, idstore.write_store(docs, BYTE)).collect()
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in stored) == [(False, 2), (False, 2), (False, 4), (True, 3)]
    empty = idstore.write_store(docs.limit(0), BYTE)
    assert idstore.read_store(spark, empty).count() == 0


def test_count_tokens(spark):
    docs = make(spark, odd_rows())
    library = Tokenizer.from_file(WORD)
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    for long in (1 << 20, 40):  # the second sends most texts the distributed way
        got = {r["doc_id"]: r for r in tokencount.count_tokens(docs, WORD, long=long).collect()}
        assert len(got) == len(texts)
        for i, t in texts.items():
            n = len(library.encode(t, add_special_tokens=False).ids)
            assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(t.encode()), n, n > 2048)
    assert tokencount.count_tokens(docs.limit(0), WORD).count() == 0


def test_id_store(spark):
    rows = [*odd_rows(), (2, "another text of a repeated id"), (None, "no id")]
    target = idstore.write_store(make(spark, rows), BYTE)
    got = idstore.read_store(spark, target).collect()
    library, at = Tokenizer.from_file(BYTE), 0
    order = sorted(got, key=lambda r: r["start"])
    assert sorted(Counter(r["doc_id"] for r in got).items(), key=repr) == sorted(Counter(r[0] for r in rows).items(), key=repr)
    assert [r["doc_id"] for r in order] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x or 0))
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    for r in order:
        ids = bytes(r["ids"])
        assert ids in texts[r["doc_id"]] and (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    stored = sum(len(r["pack"]) // 2 for r in spark.read.parquet(f"{target}/store").collect())
    assert stored < at  # copies are kept once
    parts = spark.read.parquet(f"{target}/manifest").collect()
    assert sum(p["n_docs"] for p in parts) == len(rows) and sum(p["n_tokens"] for p in parts) == at


def test_chunks_are_content_defined():
    ids = np.random.default_rng(1).integers(0, 50000, 5000).astype("<u2")
    ends = idstore.cut_points(ids)
    sizes = np.diff(np.concatenate([[0], ends]))
    assert ends[-1] == 5000 and (sizes[:-1] >= idstore.LEAST).all() and (sizes <= idstore.MOST).all()
    moved = idstore.cut_points(np.concatenate([ids[:10], ids]))
    assert len(set((ends[3:]).tolist()) & set((moved - 10).tolist())) >= len(ends) - 6
    assert len(idstore.cut_points(ids[:0])) == 0 and idstore.cut_points(ids[:3]).tolist() == [3]


def test_streams_are_cut_as_each_alone(monkeypatch):
    """Cuts of streams behind one another, hashed in blocks of any size."""
    rng = np.random.default_rng(3)
    streams = [rng.integers(0, 50000, n).astype("<u2") for n in (5000, 1, 64, 65, 0, 3000, 17)]
    want = [idstore.cut_points(x).tolist() for x in streams]
    assert [x[-1:] for x in want] == [[len(x)] * bool(len(x)) for x in streams]
    for block in (100, 1000, 1 << 15):
        monkeypatch.setattr(idstore, "BLOCK", block)
        wanted, at = idstore._wanted(np.concatenate(streams)).tolist(), 0
        for x, ends in zip(streams, want, strict=True):
            assert [b - at for b in idstore._ends(wanted, at, at + len(x))] == ends
            at += len(x)


def test_copies_inside_a_document(spark):
    """A passage that a document repeats is stored once, and borrowed once at most by another that repeats it too."""
    passage = sentence(5, 4000)
    rows = [(1, f"{passage} {passage} {passage}"), (2, f"x {passage} y {passage} {sentence(6, 900)}"), (3, sentence(7, 300))]
    target = idstore.write_store(make(spark, rows).coalesce(1), BYTE)
    got = {r["doc_id"]: bytes(r["ids"]) for r in idstore.read_store(spark, target).collect()}
    library = Tokenizer.from_file(BYTE)
    assert got == {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in rows}
    held, stored, owned, uses = {}, 0, set(), Counter()
    for r in spark.read.parquet(f"{target}/store").collect():
        held[r["doc_id"]] = chunks = [bytes(r["addresses"][k : k + 16]) for k in range(0, len(r["addresses"]), 16)]
        borrowed = [chunks[i] for i in r["borrowed"]]
        assert len(set(borrowed)) == len(borrowed) < len(chunks)
        own = dict.fromkeys(c for c in chunks if c not in borrowed)
        assert not owned & set(own) and {chunks[i] for i in r["lent"]} <= set(own)
        owned |= set(own)
        stored += len(r["pack"]) // 2
        uses.update({chunks[i]: n for i, n in zip(r["lent"], r["holders"], strict=True)})
    together = set(held[1]) & set(held[2])
    assert len(together) > 5 and uses == dict.fromkeys(together, 2)
    assert stored < sum(map(len, got.values())) / 4 / 2


def damaged(spark, tmp_path, rows, change):
    """The store of rows with its table changed, and the manifest as it was."""
    target = idstore.write_store(make(spark, rows), BYTE)
    df = spark.read.parquet(f"{target}/store")
    store = change(df.toPandas())
    spark.createDataFrame(store.astype(object).where(store.notna(), None).to_dict("records"), df.schema).write.parquet(str(tmp_path / "store"))
    spark.read.parquet(f"{target}/manifest").write.parquet(str(tmp_path / "manifest"))
    return str(tmp_path)


def test_store_detects_damage(spark, tmp_path):
    def flip(store):
        i = store.index[store["doc_id"] == 7][0]
        store.at[i, "pack"] = bytes([store.at[i, "pack"][0] ^ 1]) + store.at[i, "pack"][1:]
        return store

    path = damaged(spark, tmp_path / "a", odd_rows(), flip)
    with pytest.raises(Exception, match="do not match its recipe"):
        idstore.read_store(spark, path).collect()
    path = damaged(spark, tmp_path / "b", odd_rows(), lambda store: store[store["doc_id"] != 8])
    with pytest.raises(Exception, match="do not match the manifest"):
        idstore.read_store(spark, path).collect()


def test_hot_chunks_are_spread(spark, monkeypatch):
    """A passage that all documents share, over more rows than a task joins."""
    monkeypatch.setattr(session, "HOT", 10)
    monkeypatch.setattr(idstore, "RANGE", 7)
    rows = [(i, sentence(1, 600) + " " + sentence(i + 10, i)) for i in range(60)]
    target = idstore.write_store(make(spark, rows), BYTE)
    got = {r["doc_id"]: r["ids_crc32"] for r in idstore.read_store(spark, target).collect()}
    library = Tokenizer.from_file(BYTE)
    assert got == {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows}
    stored = sum(len(r["pack"]) // 2 for r in spark.read.parquet(f"{target}/store").collect())
    assert stored < sum(len(library.encode(t).ids) for _, t in rows) / 3


def brute_force(lengths, capacity):
    """First-fit decreasing: a packing that best-two-fit should not lose to by more than a bin or so."""
    bins = []
    for x in sorted(lengths, reverse=True):
        for k, room in enumerate(bins):
            if x <= room:
                bins[k] -= x
                break
        else:
            bins.append(capacity - x)
    return len(bins)


def test_plan_packs_all():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 300):
        lengths = rng.integers(1, 2049, n).tolist() + [2048] * (n // 50) + [700] * (n // 3)
        plan = packing.plan(dict(Counter(lengths)))
        got = Counter()
        for p in plan:
            assert sum(p.lengths) <= 2048
            for x in p.lengths:
                got[x] += p.times
        assert got == Counter(lengths)
        assert sum(p.times for p in plan) <= brute_force(lengths, 2048) + 1


def test_pair_replaces_the_smallest():
    plan = packing.plan({60: 1, 30: 1, 22: 1, 18: 1}, 100)
    assert plan[0].lengths == [60, 22, 18]  # greedy took 60 and 30; the pair fills the gap of 40


def test_pack(spark):
    rows = [*odd_rows(), (7, "again")]
    got = packing.pack(make(spark, rows), WORD).collect()
    library = Tokenizer.from_file(WORD)
    want = Counter()
    for r in rows:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[(r[0], piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == -(-sum(r["length"] for r in got) // 2048)
    assert packing.pack(make(spark, rows).limit(0), WORD).count() == 0


def test_hot_length(spark):
    docs = make(spark, [(i, "same text here") for i in range(1000)])
    got = packing.pack(docs, WORD).toPandas()
    assert len(set(zip(got["sequence_id"], got["offset"], strict=True))) == 1000
    assert got["sequence_id"].nunique() == -(-1000 // (2048 // int(got["length"].iloc[0])))


def test_pieces_find_their_places_without_a_shuffle(spark):
    """with 211 shuffle partitions the result was dealt over 211 tasks, each of which sorted and started processes to write."""
    rows = [(i % 50 or None, sentence(i % 40, 1 + i % 300)) for i in range(600)] + [(i, "same text here") for i in range(600)]
    docs = make(spark, rows).repartition(5)
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert packing.pack(docs, WORD).rdd.getNumPartitions() <= 5
        cut = session.materialize(packing.pieces(docs, WORD), "pieces")
        near, far = packing.assign(cut).toPandas(), packing.assign(cut, few=0).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert cut.select("part").distinct().count() > 1
    library = Tokenizer.from_file(WORD)
    for got in (near, far):
        assert sorted(got["length"]) == sorted(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
        assert got["sequence_id"].nunique() == near["sequence_id"].nunique()
        for _, own in got.sort_values("offset").groupby("sequence_id"):
            assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
            assert own["length"].sum() <= 2048
