"""Language identification by prediction by partial matching.

Each language has a context tree over bytes, of order three: for each context seen, how often each byte followed. A
byte's probability comes from the longest context seen; a byte new there costs an escape (method C: distinct followers
over followers and distinct followers) and is then coded by the next shorter context, over the bytes not excluded. The
statistics are frozen after learning, so a byte's exact code length is a function of the three bytes before it, and all
of them become one table. A text's language is the one whose tree codes the whole text in the fewest bits.

Texts are lower-cased; ASCII bytes that are no letters count as one space symbol. Learning uses at most MAX_DOCS
labelled documents a language, drawn by a hash of the id, and is counted on the executors.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.common import held_out
from fieldledger.session import table

ORDER = 3
#: Most labelled documents of a language that are learnt from.
MAX_DOCS = 1_500
#: Bytes of text that are scored at once.
SLICE = 1 << 19
HAS_LETTER = regex.compile(r"\p{L}")  # numbers like ½ and ² are none
FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
UNKNOWN = "und"


def fold(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(FOLD)


def _grams(batches):
    """(lang, four bytes as a number, count) of each batch."""
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            by.setdefault(lang, []).append(b"   " + fold(text))
        langs, grams, counts = [], [], []
        for lang, parts in by.items():
            codes = [np.frombuffer(p, np.uint8).astype(np.int64) for p in parts]
            packed = np.concatenate([((c[:-3] * 256 + c[1:-2]) * 256 + c[2:-1]) * 256 + c[3:] for c in codes])
            g, n = np.unique(packed, return_counts=True)
            langs += [lang] * len(g)
            grams.append(g)
            counts.append(n)
        if grams:
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs), pa.array(np.concatenate(grams)), pa.array(np.concatenate(counts).astype(np.int64))], ["lang", "gram", "n"]
            )


def learn(docs: DataFrame) -> tuple[tuple[str, ...], bytes, bytes, bytes]:
    """The frozen statistics: languages, and for each counted gram its language, bytes and count."""
    rows = docs.filter(F.col("lang").isNotNull() & (F.coalesce(F.col("text"), F.lit("")) != "") & ~held_out())
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in found.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, MAX_DOCS / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(draw < share).select("text", "lang")
    grams = sample.mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = grams.orderBy("lang", "gram").toPandas()
    names = tuple(sorted(found))
    index = {x: i for i, x in enumerate(names)}
    return (
        names,
        np.array([index[x] for x in got["lang"]], np.uint8).tobytes(),
        got["gram"].to_numpy(np.int64).astype(np.uint32).tobytes(),
        got["n"].to_numpy(np.int64).astype(np.uint32).tobytes(),
    )


def blend(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of one order, given those of the next shorter contexts (rows alike)."""
    total, kinds = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
    seen = counts > 0
    full = kinds == counts.shape[-1]
    rest = np.maximum(1 - np.where(seen, lower, 0).sum(-1, keepdims=True), 1e-9)
    scale = np.maximum(np.where(full, total, total + kinds), 1)
    return np.where(total == 0, lower, np.where(seen, counts / scale, kinds / scale * lower / rest))


@lru_cache(maxsize=2)
def tables(model) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Byte to symbol, number of symbols, three symbols to state, and bits by (state, symbol, language)."""
    names, lang, gram, n = model
    lang, gram, n = np.frombuffer(lang, np.uint8), np.frombuffer(gram, np.uint32).astype(np.int64), np.frombuffer(n, np.uint32)
    used = np.unique(np.concatenate([(gram >> s) & 255 for s in (0, 8, 16, 24)] + [np.array([32])]))
    size = len(used) + 1  # the last symbol stands for bytes never seen
    symbol = np.full(256, size - 1, np.int32)
    symbol[used] = np.arange(len(used))
    parts = [symbol[(gram >> s) & 255].astype(np.int64) for s in (24, 16, 8, 0)]
    context = (parts[0] * size + parts[1]) * size + parts[2]
    seen = np.unique(context)
    state = (np.arange(size**3) % (size * size)).astype(np.int32)
    state[seen] = size * size + np.arange(len(seen))
    bits = np.empty((size * size + len(seen), size, len(names)), np.float32)
    for k in range(len(names)):
        own = lang == k
        w, c = n[own].astype(np.float64), [p[own] for p in parts]
        zero = np.bincount(c[3], w, size)
        one = np.bincount(c[2] * size + c[3], w, size * size).reshape(size, size)
        two = np.bincount((c[1] * size + c[2]) * size + c[3], w, size**3).reshape(size * size, size)
        three = np.bincount(np.searchsorted(seen, context[own]) * size + c[3], w, len(seen) * size).reshape(len(seen), size)
        p0 = blend(zero[None, :], np.full((1, size), 1 / size))
        p1 = blend(one, np.broadcast_to(p0, one.shape))
        p2 = blend(two, np.tile(p1, (size, 1)))
        p3 = blend(three, p2[seen % (size * size)])
        bits[: size * size, :, k] = -np.log2(p2)
        bits[size * size :, :, k] = -np.log2(p3)
    return symbol, size, state, bits.reshape(-1, len(names))


def code_lengths(model, texts: list[str]) -> np.ndarray:
    """Bits that each language's tree needs for each whole text."""
    symbol, size, state, bits = tables(model)
    out = np.zeros((len(texts), bits.shape[1]))
    group: list[tuple[int, np.ndarray]] = []

    def settle() -> None:
        c = np.concatenate([x for _, x in group])
        at = np.cumsum([0] + [len(x) for _, x in group])
        three = (c[:-3] * size + c[1:-2]) * size + c[2:-1]
        rows = bits[state[three] * size + c[3:]]
        edges = np.stack([at[:-1], np.minimum(at[1:] - 3, len(rows) - 1)], 1).ravel()
        sums = np.add.reduceat(rows, edges, axis=0, dtype=np.float64)[::2]
        last = group[-1][1]
        if len(last) > 3:  # its end is the end of the rows
            sums[-1] = rows[at[-2] :].sum(0, dtype=np.float64)
        for (i, _), s in zip(group, sums, strict=True):
            out[i] += s
        group.clear()

    held = 0
    for i, text in enumerate(texts):
        c = symbol[np.frombuffer(b"   " + fold(text), np.uint8)]
        for k in range(3, len(c), SLICE):
            part = c[k - 3 : k + SLICE]
            group.append((i, part))
            held += len(part)
            if held >= SLICE:
                settle()
                held = 0
    if group:
        settle()
    return out


def identify(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the chosen language's share of the probability) for each document.

    docs: doc_id, text; further columns are not looked at. A text that is null or has no letter, and any text where
    nothing could be learnt, is `und` with score 0. Equal code lengths choose the language that sorts first. Rows that
    repeat a doc_id, null ones too, are judged one by one; an empty table gives no rows.
    """
    names = model[0]

    def scored(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spoken = [i for i, t in enumerate(texts) if t and HAS_LETTER.search(t)] if names else []
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if spoken:
                cost = code_lengths(model, [texts[i] for i in spoken])
                best = cost.argmin(1)
                share = 1 / np.exp2(np.maximum(cost.min(1)[:, None] - cost, -1000)).sum(1)
                for i, b, s in zip(spoken, best, share, strict=True):
                    langs[i], scores[i] = names[b], float(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
