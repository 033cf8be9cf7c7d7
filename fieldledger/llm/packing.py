"""Packing documents into sequences by best-two-fit.

Documents are tokenised once, cut where they are longer than a sequence, and written as small rows of pieces. The packing
is planned on the histogram of piece lengths, which has at most `capacity` entries whatever the corpus: a bin is filled
greedily with the longest length that fits, then its smallest document is replaced by two unpacked ones that fill the
gap that this opens more tightly; the finished bin is a pattern, repeated as often as the counts allow. Pieces find
their place by rank among those of their length: the task that cuts them numbers those of each length from 0, and the
counts of the parts before, one part a task, shift its numbers. So pieces are neither sorted nor, while the counts are
few, shuffled, and a length that a third of all documents share is no hot spot. The plan has at most a few patterns for
each length and goes to the executors in the task's closure.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.llm.bpe import encoder
from fieldledger.llm.common import small_batches, take_turn
from fieldledger.session import broadcast_if_small, materialize, table

CAPACITY = 2048
END_ID = 0
#: Counts of parts' lengths that go to every executor; more are joined by shuffling.
BASES = 200_000


@dataclass
class Pattern:
    """One bin's lengths, longest first, and how many bins are alike."""

    lengths: list[int]
    times: int


def _largest(present: np.ndarray, most: int, taken: dict[int, int], counts: np.ndarray) -> int:
    """The longest length up to most that has an unpacked piece beyond those taken; 0 if none."""
    while most > 0:
        most = int(present[most])
        if most <= 0 or counts[most] > taken.get(most, 0):
            return max(most, 0)
        most -= 1
    return 0


def _below(counts: np.ndarray) -> np.ndarray:
    """For each length, the longest length up to it that has pieces."""
    marks = np.where(counts > 0, np.arange(len(counts)), 0)
    return np.maximum.accumulate(marks)


def best_two(counts: np.ndarray, taken: dict[int, int], room: int, over: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is at most room, more than over, and as large as can be."""
    free = counts.copy()
    for length, n in taken.items():
        free[length] -= n
    have = np.flatnonzero(free[: room + 1] > 0)
    have = have[have > 0]
    if not len(have):
        return None
    mate = np.maximum.accumulate(np.where(free[: room + 1] > 0, np.arange(room + 1), 0))
    other = mate[room - have]
    alone = (other == have) & (free[have] < 2)  # it can't be its own mate
    for i in np.flatnonzero(alone):
        other[i] = mate[have[i] - 1]
    total = np.where(other > 0, have + other, 0)
    best = int(total.argmax())
    if total[best] <= over:
        return None
    return int(max(have[best], other[best])), int(min(have[best], other[best]))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-two-fit over counts of lengths (1 to capacity); each piece is in one bin."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        counts[length] += n
    out: list[Pattern] = []
    present = _below(counts)
    while (first := int(present[capacity])) > 0:
        bin_, taken, gap = [first], {first: 1}, capacity - first
        while gap and (nxt := _largest(present, gap, taken, counts)):
            bin_.append(nxt)
            taken[nxt] = taken.get(nxt, 0) + 1
            gap -= nxt
        while gap and len(bin_) > 1:
            smallest = bin_[-1]
            taken[smallest] -= 1
            found = best_two(counts, taken, gap + smallest, smallest)
            if found is None:
                taken[smallest] += 1
                break
            bin_ = sorted([*bin_[:-1], *found], reverse=True)
            for x in found:
                taken[x] = taken.get(x, 0) + 1
            gap = capacity - sum(bin_)
        taken = {k: v for k, v in taken.items() if v}
        times = min(int(counts[k]) // v for k, v in taken.items())
        for k, v in taken.items():
            counts[k] -= v * times
        out.append(Pattern(bin_, times))
        present = _below(counts)
    return out


def slots(patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank) of runs of places, and the first sequence and the offset of each run."""
    keys, seqs, offsets, seq = [], [], [], 0
    ranks: dict[int, int] = {}
    for p in patterns:
        at = 0
        for length in p.lengths:
            rank = ranks.get(length, 0)
            keys.append((length << 44) + rank)
            seqs.append(seq)
            offsets.append(at)
            ranks[length] = rank + p.times
            at += length
        seq += p.times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.array(keys, np.int64)[order], np.array(seqs, np.int64)[order], np.array(offsets, np.int64)[order]


def _cut(path: str, capacity: int, end_id: int):
    def run(batches):
        take_turn("encoder")
        encode_many = encoder(path).encode_many
        seen = [0] * (capacity + 1)  # pieces of each length so far
        for batch in small_batches(batches):
            ids = batch.column("doc_id").to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, got in zip(ids, encode_many(batch.column("text").to_pylist()), strict=True):
                tokens = np.append(got.astype("<u4"), np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[start : start + capacity]
                    nth = seen[len(part)]
                    seen[len(part)] += 1
                    for column, x in zip(out, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), nth), strict=True):
                        column.append(x)
            kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "nth"]
            )

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; a null or empty text is the end id alone.

    Also part, the task that cut the piece, and nth, its number from 0 among the part's pieces of that length. Store the
    result before it is used twice: another run may deal the documents to other tasks.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", "text").mapInArrow(
        _cut(path, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, nth int"
    )
    return cut.withColumn("part", F.spark_partition_id())


def assign(cut: DataFrame, capacity: int = CAPACITY, few: int = BASES) -> DataFrame:
    """Adds sequence_id and offset to stored pieces, which are read three times. few: counts that are broadcast at most."""
    sizes = cut.groupBy("length").agg(F.count("*").alias("n"), F.count_if(F.col("nth") == 0).alias("parts")).collect()  # capacity rows at most
    keys, seqs, offsets = slots(plan({r["length"]: r["n"] for r in sizes}, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    key = ["part", F.col("length").cast("int").alias("size")]  # both fit into one long
    bases = cut.groupBy("part", "length").agg(F.count("*").alias("c")).select(*key, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    ranked = (
        cut.select("*", key[1])
        .join(broadcast_if_small(bases, sum(r["parts"] for r in sizes), few), ["part", "size"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("rank"))
    )

    def placed(batches):
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 44) + rank, side="right") - 1
            seq = seqs[at] + rank - (keys[at] & ((1 << 44) - 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(offsets[at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        placed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row a piece with its sequence and place. docs: doc_id, text; further columns are not looked at.

    A null or empty text is the end id alone. Rows that repeat a doc_id, null ones too, are packed each. Pieces of one
    length are interchangeable: which takes which place is not defined beyond that. An empty table gives no rows.
    """
    return assign(materialize(pieces(docs, path, capacity, end_id), "pieces"), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
