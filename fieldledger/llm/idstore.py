"""A content-addressed store of token ids.

A document's id stream (with its end id) is cut where a rolling hash of the last WINDOW ids is under a bound, so equal
passages give equal chunks wherever they stand. A chunk's address is a 128-bit digest of its ids. The store has three
parts, as Parquet, so that any file system Spark can reach will do:

* packs: for each document, the chunks that it owns, that is, those of which it is the first holder, at their first
  places in it; every unique chunk is stored once;
* recipes: for each document, the addresses of its chunks in order, its place in the stream and its Merkle root;
* manifest: for each part and each range of RANGE documents in it, its number of documents and ids, and the Merkle root
  over theirs.

Recipes and packs lie in one table in ascending doc_id order, as separate columns. Reading checks each chunk against its
address, each document against its Merkle root, and each range against the manifest; what is missing is an error.

The ids are shuffled once, to be range-partitioned by doc_id; which chunks are held elsewhere too is found from their
addresses alone, of which a document gives each but once. Only documents that borrow chunks are joined with the packs when
the store is read. A chunk that very many documents share is dealt over several tasks in both joins.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.bpe import encoder
from fieldledger.llm.common import small_batches, take_turn
from fieldledger.session import drop_path, fresh_path, materialize, spread_join, table

END_ID = 2
WINDOW = 16
#: A cut comes every MEAN ids on average, between LEAST and MOST.
LEAST, MEAN, MOST = 64, 256, 1024
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BOUND = np.uint64((1 << 64) // (MEAN - LEAST))
#: Ids that are hashed at a time.
BLOCK = 1 << 15
#: Documents of a part that share a root of the manifest.
RANGE = 4096


def _wanted(ids: np.ndarray) -> np.ndarray:
    """Places behind which the last WINDOW ids ask for a cut, of a stream or of several behind one another."""
    found = []
    for at in range(0, len(ids), BLOCK):
        before = min(at, WINDOW)
        mixed = (ids[at - before : at + BLOCK].astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        mixed ^= mixed >> np.uint64(29)
        total = np.cumsum(mixed, dtype=np.uint64)
        total[WINDOW:] -= total[:-WINDOW].copy()
        total *= MULTIPLIER
        found.append(np.flatnonzero(total[before:] < BOUND) + (at + 1))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _ends(wanted: list[int], at: int, n: int) -> list[int]:
    """Ends of the chunks of the stream from at to n; no cut that it takes depends on what stands before it, as LEAST >= WINDOW."""
    ends = []
    while n - at > LEAST:
        k = bisect.bisect_left(wanted, at + LEAST)
        to = wanted[k] if k < len(wanted) else n
        at = min(to, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a stream: a rolling sum of mixed ids decides, within the size limits."""
    return np.array(_ends(_wanted(ids).tolist(), 0, len(ids)), np.int64)


def address(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of digests; an odd node moves up unchanged, no leaves give zeros."""
    if not leaves:
        return bytes(16)
    while len(leaves) > 1:
        leaves = [address(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def _lists(column: pa.Array) -> list[list]:
    """The lists of a column of numbers; a null is empty."""
    if not len(column):
        return []
    at = column.offsets.to_numpy()
    values = column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).tolist()
    at = (at - at[0]).tolist()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _split(blob: bytes, sizes: list[int]) -> list[bytes]:
    """Parts of so many bytes each."""
    ends = list(accumulate(sizes))
    return [blob[b - n : b] for n, b in zip(sizes, ends, strict=True)]


ENCODED = "doc_id {kind}, width int, sizes array<int>, firsts array<int>, addresses binary, ids binary"


def _encoded(path: str, end_id: int):
    """firsts: a place of each chunk that the document has, its first."""

    def run(batches):
        take_turn("encoder")
        e = encoder(path)
        end, width = np.array([end_id], e.dtype), e.dtype.itemsize
        for batch in small_batches(batches):
            got = [x for ids in e.encode_many(batch.column("text").to_pylist()) for x in (ids, end)]
            flat = np.concatenate(got)
            upto = np.cumsum([len(x) for x in got])[1::2].tolist()
            wanted, cols, at = _wanted(flat).tolist(), ([], [], [], []), 0
            for n in upto:
                ends, blob = _ends(wanted, at, n), flat[at:n].tobytes()
                sizes = [b - a for a, b in zip([at, *ends], ends, strict=False)]
                leaves = [address(c) for c in _split(blob, [width * x for x in sizes])]
                firsts = range(len(leaves)) if len(set(leaves)) == len(leaves) else sorted({a: i for i, a in reversed(list(enumerate(leaves)))}.values())
                for column, x in zip(cols, (sizes, firsts, b"".join(leaves), blob), strict=True):
                    column.append(x)
                at = n
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            columns = [batch.column("doc_id"), pa.array(np.full(len(upto), width, np.int32)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "width", "sizes", "firsts", "addresses", "ids"])

    return run


STORE = (
    "part int, place long, doc_id {kind}, local_start long, n_tokens long, width int, sizes array<int>, addresses binary, "
    "borrowed array<int>, lent array<int>, holders array<long>, root binary, pack binary"
)


def _packed(batches):
    """Sorted rows of (doc_id, row, kind): a document's chunks that others hold too, a row each, then its ids. Writes rows of the store.

    The row of a chunk has its place and, where the document owns it, how many documents hold it."""
    from pyspark import TaskContext

    part, at, place, held, notes = TaskContext.get().partitionId(), 0, 0, None, {}
    for batch in small_batches(batches):
        cols: dict[str, list] = {c: [] for c in ("part", "place", "local_start", "n_tokens", "borrowed", "lent", "holders", "root", "pack")}
        row_, seq_, holders_ = (batch.column(c).to_pylist() for c in ("row", "seq", "holders"))
        docs = [i for i, seq in enumerate(seq_) if seq is None]
        of = batch.take(pa.array(docs, pa.int64()))
        plain = (of.column(c).to_pylist() for c in ("width", "addresses", "ids"))
        whole = zip(_lists(of.column("sizes")), _lists(of.column("firsts")), *plain, strict=True)
        for row, seq, holders in zip(row_, seq_, holders_, strict=True):
            if row != held:
                held, notes = row, {}
            if seq is not None:
                notes[seq] = holders
                continue
            sizes, firsts, width, addresses, blob = next(whole)
            borrowed = sorted(i for i, n in notes.items() if n is None)
            lent = sorted(i for i, n in notes.items() if n is not None)
            pack, k = blob, sum(sizes)
            if borrowed or len(firsts) < len(sizes):
                parts, gone = _split(blob, [width * n for n in sizes]), set(borrowed)
                pack = b"".join([parts[i] for i in firsts if i not in gone])
            values = (part, place, at, k, borrowed, lent, [notes[i] for i in lent], merkle_root(_split(addresses, [16] * len(sizes))), pack)
            for column, x in zip(cols.values(), values, strict=True):
                column.append(x)
            at, place = at + k, place + 1
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), ints, ints, longs, pa.binary(), pa.binary())
        made = {c: pa.array(x, k) for (c, x), k in zip(cols.items(), kinds, strict=True)} | {c: of.column(c) for c in ("doc_id", "width", "sizes", "addresses")}
        names = ["part", "place", "doc_id", "local_start", "n_tokens", "width", "sizes", "addresses", "borrowed", "lent", "holders", "root", "pack"]
        yield pa.RecordBatch.from_arrays([made[c] for c in names], names)


def _address(seq: str) -> Column:
    return F.substring("addresses", F.col(seq) * 16 + 1, F.lit(16)).alias("address")


def write_store(docs: DataFrame, vocabulary: str, target: str | None = None, end_id: int = END_ID) -> str:
    """Writes the store of all documents and returns its folder. A null id sorts first.

    docs: doc_id, text; further columns are not looked at. A null or empty text is the end id alone. Rows that repeat a
    doc_id, null ones too, are documents of their own. An empty table gives an empty store.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    target = target or fresh_path(spark, "id-store")
    staged = materialize(
        docs.select("doc_id", "text").mapInArrow(_encoded(vocabulary, end_id), ENCODED.format(kind=kind)),
        "encoded",
        path=(staging := fresh_path(spark, "encoded")),
        add_row=True,
        compression="zstd",
    )
    chunks = staged.select("doc_id", "row", "addresses", F.explode("firsts").alias("seq")).select("doc_id", "row", "seq", _address("seq"))
    # the first holder owns a chunk; copies inside one document are told by its recipe
    shared = materialize(chunks.groupBy("address").agg(F.min("row").alias("owner"), F.count("*").alias("uses")).filter("uses > 1"), "shared-chunks")
    uses = spread_join(chunks, shared, ["address"], "row", shared)
    notes = uses.select("doc_id", "row", "seq", F.when(F.col("row") == F.col("owner"), F.col("uses")).alias("holders"))
    rows = staged.unionByName(notes, allowMissingColumns=True).withColumn("last", F.col("seq").isNull())
    ordered = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row", "last")
    ordered.drop("last").mapInArrow(_packed, STORE.format(kind=kind)).write.parquet(f"{target}/store", compression="zstd")
    drop_path(spark, staging)
    _ranges(spark.read.parquet(f"{target}/store")).write.parquet(f"{target}/manifest")
    return target


def _range_root(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("place")
    root = merkle_root(rows.column("root").to_pylist())
    sums = (len(rows), sum(rows.column("n_tokens").to_pylist()))
    return pa.table({"part": rows.column("part")[:1], "range": rows.column("range")[:1], "n_docs": pa.array([sums[0]], pa.int64()), "n_tokens": pa.array([sums[1]], pa.int64()), "root": pa.array([root], pa.binary())})


def _ranges(store: DataFrame) -> DataFrame:
    """part, range, n_docs, n_tokens, root of each range of documents of a part, from their own roots."""
    rows = store.select("part", F.floor(F.col("place") / RANGE).alias("range"), "place", "n_tokens", "root")
    return rows.groupBy("part", "range").applyInArrow(_range_root, "part int, range long, n_docs long, n_tokens long, root binary")


def _lend(batches):
    """The chunks that others hold too."""
    for batch in small_batches(batches):
        found, chunks = [], []
        lists = (_lists(batch.column(c)) for c in ("sizes", "borrowed", "lent"))
        plain = (batch.column(c).to_pylist() for c in ("width", "addresses", "pack"))
        for sizes, borrowed, lent, width, addresses, pack in zip(*lists, *plain, strict=True):
            wanted, gone, seen, k = set(lent), set(borrowed), set(), 0
            for i, (n, a) in enumerate(zip(sizes, _split(addresses, [16] * len(sizes)), strict=True)):
                if a in seen:
                    continue
                seen.add(a)
                if i in gone:
                    continue
                if i in wanted:
                    found.append(a)
                    chunks.append(pack[k * width : (k + n) * width])
                k += n
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(chunks, pa.binary())], ["address", "chunk"])


def _whole(sizes: list[int], width: int, addresses: bytes, root: bytes, pack: bytes, borrowed: list[int], got: dict[int, bytes]) -> bytes | None:
    """A document's ids from its pack and its borrowed chunks; None where they are not what its recipe says."""
    leaves = _split(addresses, [16] * len(sizes))
    if len(leaves) * 16 != len(addresses) or merkle_root(leaves) != root:
        return None
    gone, have, parts, k = set(borrowed), {}, [], 0
    for i, (n, a) in enumerate(zip(sizes, leaves, strict=True)):
        chunk = have.get(a)
        if chunk is None:
            if i in gone:
                chunk = got[i]
            else:
                chunk = pack[k : k + n * width]
                k += n * width
            if address(chunk) != a:
                return None
            have[a] = chunk
        if len(chunk) != n * width:
            return None
        parts.append(chunk)
    return b"".join(parts) if k == len(pack) else None


def _restore(bases: dict[int, int], with_ids: bool):
    """Documents from their packs and their borrowed chunks, checked against addresses and roots."""

    def run(batches):
        for batch in small_batches(batches):
            out: list[list] = [[], [], []]
            lists = (_lists(batch.column(c)) for c in ("sizes", "borrowed"))
            names = ("doc_id", "part", "local_start", "n_tokens", "width", "addresses", "root", "pack", "chunks")
            plain = (batch.column(c).to_pylist() for c in names)
            for sizes, borrowed, doc_id, part, start, n_tokens, width, addresses, root, pack, chunks in zip(*lists, *plain, strict=True):
                got = {c["seq"]: c["chunk"] for c in chunks or ()}
                if missing := [i for i in borrowed if got.get(i) is None]:
                    raise ValueError(f"document {doc_id}: chunk {missing[0]} is missing, so its chunks do not match its recipe")
                blob = _whole(sizes, width, addresses, root, pack, borrowed, got)
                if blob is None or len(blob) != n_tokens * width:
                    raise ValueError(f"document {doc_id}: its chunks do not match its recipe")
                ids = np.frombuffer(blob, f"<u{width}").astype("<u4").tobytes()
                for column, x in zip(out, (bases[part] + start, zlib.crc32(ids), ids if with_ids else None), strict=True):
                    column.append(x)
            start, crc, ids = (pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), start, batch.column("n_tokens"), crc, ids], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def read_store(spark: SparkSession, target: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit; null if not wanted) of each document, from the files."""
    store, manifest = spark.read.parquet(f"{target}/store"), spark.read.parquet(f"{target}/manifest")
    kind = store.schema["doc_id"].dataType.simpleString()
    held = [F.col(c).alias(f"held_{c}") for c in ("n_docs", "n_tokens", "root")]
    both = manifest.join(_ranges(store).select("part", "range", *held), ["part", "range"], "full")
    same = [F.col(c).eqNullSafe(F.col(f"held_{c}")) for c in ("n_docs", "n_tokens", "root")]
    parts = both.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.bool_and(same[0] & same[1] & same[2]).alias("same"))
    bases, at = {}, 0
    for row in parts.orderBy("part").collect():  # a row a file
        if not row["same"]:
            raise ValueError(f"part {row['part']}: its documents do not match the manifest")
        bases[row["part"]] = at
        at += row["n_tokens"]
    recipe = store.select("part", "doc_id", "local_start", "n_tokens", "width", "sizes", "addresses", "borrowed", "root", "pack")
    alone = recipe.filter(F.size("borrowed") == 0).withColumn("chunks", F.lit(None).cast("array<struct<seq:int,chunk:binary>>"))
    needy = recipe.filter(F.size("borrowed") > 0)
    uses = needy.select("part", "local_start", "addresses", F.explode("borrowed").alias("seq")).select("part", "local_start", "seq", _address("seq"))
    lenders = store.filter(F.size("lent") > 0)
    lent = lenders.select("width", "sizes", "addresses", "borrowed", "lent", "pack").mapInArrow(_lend, "address binary, chunk binary")
    counts = lenders.select("addresses", F.explode(F.arrays_zip("lent", "holders")).alias("x")).select("addresses", F.col("x.lent").alias("seq"), F.col("x.holders").alias("uses")).select(_address("seq"), "uses")
    # a chunk that is missing is null, and an error where it is wanted
    row = ["part", "local_start"]
    found = spread_join(uses, lent, ["address"], "local_start", counts, "left")
    joined = needy.join(found.groupBy(*row).agg(F.collect_list(F.struct("seq", "chunk")).alias("chunks")), row).select(*alone.columns)
    out = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, ids binary"
    restore = _restore(bases, with_ids)
    return alone.mapInArrow(restore, out).unionByName(joined.mapInArrow(restore, out))


def op1_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    target = write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_store(spark, target, with_ids=False).drop("ids")
