"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles. Documents with equal sets are one class and enter once. A class's set is
embedded as a list of minwise hashes, so that the share of equal places estimates the Jaccard similarity. Each run
samples a place of the list and splits the classes by the value there (similar sets share the token at that place with a
probability equal to their similarity); buckets above the limit are split again on further sampled places, so that a
path is chosen down to small buckets, whose members are compared by brute force (Christiani and Pagh, "Set similarity
join"; Christiani, Pagh and Sivertsen). The recursion ends where a bucket is small, where all its members are near enough
to its first that they are one group already, and where half of them are: splitting would not part those, so the others
are compared with all members. Runs repeat until the target recall: a pair at the threshold is met
by one run with probability of at least P_RUN (0.8 for the first place and 0.96 for each of the few levels that a large
bucket takes, and a pair may also be joined by way of the bucket's first member), so ceil(log(1 - recall) / log(1 -
P_RUN)) runs are made. The tests measure the recall against all pairs.

Bucket comparisons only find which classes may belong together: they keep edges of a spanning forest, never all pairs.
Inside the groups that these edges make, all pairs of classes are compared exactly on their whole sets, and each class
gets its number of links; no link between different texts is lost inside a group, and no pair is ever written out.
Groups and buckets beyond BLOCK members are dealt as pairs of blocks of members, so that a group with a third of all
rows is spread over many tasks. A document's class id is the smallest doc_id that chains of links lead to.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.common import cache, small_batches, take_turn
from fieldledger.session import broadcast_if_small, materialize, numbered, table

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
P_RUN = 0.5
PLACES = 64
#: Buckets above this are split again.
BUCKET = 64
#: What this many levels have not split is compared, too.
LEVELS = 24
BLOCK = 512
#: Members whose lists agree in fewer places than this are not taken further: 4.5 standard errors under the threshold.
LEAST_SHARE = 0.58
PRIME = np.uint64(0x9E3779B97F4A7C15)
MEMO = 400_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        got = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        if len(word) < 64:
            self[word] = got
        return got


_words = cache("ngrams", WordHashes())


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of five-word runs of lower-case words; a shorter text is one run, an empty one has none."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(_words.__getitem__, words)), np.uint64)
    n = max(len(h) - SHINGLE + 1, 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = mix64(out * PRIME + h[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, PLACES, dtype=np.uint64) | np.uint64(1), rng.integers(1, 1 << 63, PLACES, dtype=np.uint64)


MULTIPLY, ADD = _seeds()


def sketch(found: np.ndarray) -> np.ndarray:
    """The minwise hash at each place, 32 bits."""
    out = np.full(PLACES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(found), 4096):
        part = found[k : k + 4096, None] * MULTIPLY[None, :] + ADD[None, :]
        part ^= part >> np.uint64(32)
        out = np.minimum(out, (part * PRIME).min(0))
    return (out >> np.uint64(32)).astype("<u4")


def digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    got = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return int.from_bytes(got[:8], "little", signed=True), int.from_bytes(got[8:], "little", signed=True)


def _sketched(batches):
    take_turn("ngrams")
    for batch in small_batches(batches):
        hi, lo, sizes, lists = [], [], [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text)
            a, b = digest(found)
            hi.append(a)
            lo.append(b)
            sizes.append(len(found))
            lists.append(sketch(found).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lists, pa.binary())],
            ["row", "hi", "lo", "size", "list"],
        )


def _dealt(rows: DataFrame, key: str, counts: DataFrame, order: str) -> DataFrame:
    """Rows of groups as cells of block pairs: each pair of members meets in one cell, or in several of its own block."""
    sized = rows.join(counts.select(key, F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), key)
    own = F.pmod(F.xxhash64(order), F.col("blocks").cast("long")).cast("int")
    paired = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return paired.withColumn("cell", F.struct(key, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")))


def _merge(labels: np.ndarray, i: int, mates: np.ndarray) -> None:
    """Puts i and its mates under one label, the least of theirs."""
    met = np.unique(np.append(labels[mates], labels[i]))
    if len(met) > 1:
        labels[np.isin(labels, met)] = met[0]


def _bucket_edges(rows: pa.Table) -> pa.Table:
    """A spanning forest of the members of one bucket (or cell) whose lists agree well enough; only far ones look for mates, if some are marked."""
    rows = rows.sort_by("rep")
    reps = rows.column("rep").to_numpy()
    lists = np.frombuffer(b"".join(rows.column("list").to_pylist()), "<u4").reshape(len(reps), PLACES)
    labels, least = np.arange(len(reps)), LEAST_SHARE * PLACES
    some = "far" in rows.column_names
    for i in np.flatnonzero(rows.column("far").to_numpy(zero_copy_only=False)) if some else range(len(reps) - 1):
        k = 0 if some else i + 1
        mates = np.flatnonzero((lists[k:] == lists[i]).sum(1) >= least) + k
        if len(mates):
            _merge(labels, i, mates)
    own = np.flatnonzero(labels != np.arange(len(reps)))
    return pa.table({"a": pa.array(reps[labels[own]], pa.int64()), "b": pa.array(reps[own], pa.int64())})


def _agree(one: str, other: str) -> Column:
    """Equal places of two lists of PLACES values of four bytes."""
    parts = F.transform(F.sequence(F.lit(1), F.lit(4 * PLACES - 3), F.lit(4)), lambda i: (F.substring(one, i, F.lit(4)) == F.substring(other, i, F.lit(4))).cast("int"))
    return F.aggregate(parts, F.lit(0), lambda n, x: n + x)


def candidate_edges(classes: DataFrame, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) between classes that some bucket of some run holds together. classes: rep, list."""
    runs = max(1, math.ceil(math.log(1 - recall) / math.log(1 - P_RUN)))
    open_ = classes.select(
        "rep", "list", F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.lit((r * 5 + 1) % PLACES).alias("place")) for r in range(runs)])).alias("at")
    ).select("rep", F.xxhash64("at.run", "at.place", F.expr("substring(list, at.place * 4 + 1, 4)")).alias("path"))
    edges, lists, level, n_classes = [], classes.select("rep", "list"), 0, classes.count()

    def asked(rows: DataFrame, counts: DataFrame, label: str) -> None:
        """Pairs of members of which one is far from the first; those near it are one group already. rows: path, rep, list, near; counts: members, like."""
        blocks, far = F.ceil(F.col("members") / BLOCK).cast("int"), F.ceil((F.col("members") - F.col("like")) / BLOCK).cast("int")
        sized = rows.join(broadcast_if_small(counts.select("path", blocks.alias("blocks"), far.alias("asking")), n_large), "path")
        at = lambda n: F.pmod(F.xxhash64("rep"), F.col(n).cast("long")).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        askers = sized.filter("NOT near").select("path", at("asking").alias("a"), upto("blocks").alias("b"), "rep", "list", F.lit(True).alias("far"))
        others = sized.select("path", upto("asking").alias("a"), at("blocks").alias("b"), "rep", "list", F.lit(False).alias("far"))
        cells = askers.unionByName(others).withColumn("cell", F.struct("path", "a", "b")).select("cell", "rep", "list", "far")
        edges.append(materialize(cells.groupBy("cell").applyInArrow(_bucket_edges, "a long, b long").filter("a <> b").distinct(), label))

    def compared(rows: DataFrame, counts: DataFrame, label: str) -> None:
        """All pairs of the members of these buckets, in blocks. rows: path, rep, list."""
        cells = _dealt(rows, "path", counts, "rep").select("cell", "rep", "list")
        edges.append(materialize(cells.groupBy("cell").applyInArrow(_bucket_edges, "a long, b long").distinct(), label))

    while True:
        counts = open_.groupBy("path").agg(F.count("*").alias("members"), F.min("rep").alias("first")).filter("members > 1")
        counts = materialize(counts, f"buckets-{level}")
        small = counts if level == LEVELS else counts.filter(F.col("members") <= BUCKET)
        compared(open_.join(small.select("path"), "path").join(lists, "rep"), small, f"edges-{level}")
        large = counts.filter(F.col("members") > BUCKET)
        n_large = large.count()
        if level == LEVELS or not n_large:
            break
        # each member against the first of its bucket
        firsts = large.select("path", "first").join(lists.select(F.col("rep").alias("first"), F.col("list").alias("first_list")), "first")
        firsts = broadcast_if_small(firsts, n_large)
        held = open_.join(firsts, "path").join(lists, "rep").select("rep", "path", "first", "list", (_agree("list", "first_list") >= LEAST_SHARE * PLACES).alias("near"))
        held = materialize(held, f"large-{level}")
        edges.append(held.filter("near AND rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct())
        mixed = held.groupBy("path").agg(F.count("*").alias("members"), F.count_if("near").alias("like")).filter("like < members")
        mixed = materialize(mixed, f"mixed-{level}")
        # buckets that are dense don't get smaller by splitting: their members are compared now, like those of a group later
        # and so are those of all others, once that is a thousand comparisons of lists a class, less work than making the lists
        pairs = mixed.filter("2 * like < members").agg(F.sum(F.col("members").cast("double") ** 2)).first()[0] or 0.0
        few = pairs <= 16 * BUCKET * n_classes
        dense, sparse = mixed.filter(F.lit(few) | F.expr("2 * like >= members")), mixed.filter(~F.lit(few) & F.expr("2 * like < members"))
        asked(held.select("path", "rep", "list", "near"), dense, f"dense-{level}")
        if few:
            break
        # two sampled places a bucket: a pair at the threshold shares one of them with probability over 0.95
        at = F.array(*[F.pmod(F.xxhash64("path", F.lit(k), F.lit(level)), F.lit(PLACES)).cast("int") for k in range(2)])
        further = held.join(broadcast_if_small(sparse.select("path"), n_large), "path", "left_semi").select("rep", "path", "list", F.explode(F.array_distinct(at)).alias("place"))
        further = further.select("rep", F.xxhash64("path", "place", F.expr("substring(list, place * 4 + 1, 4)")).alias("path"))
        open_, level = materialize(further, f"paths-{level}"), level + 1
    return functools.reduce(DataFrame.unionByName, edges).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of the edges, by alternating large and small stars; component is the least node."""
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges, known = materialize(small, "cc"), mark
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == known:
            break
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _exact(threshold: float):
    """Links of the members of a cell, counted on whole sets: (rep, links, to) with to the least class of those joined by links."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rep")
        reps, own = rows.column("rep").to_numpy(), rows.column("own").to_numpy()
        weight = rows.column("docs").to_numpy()
        sets = [np.frombuffer(s, "<u8") for s in rows.column("set").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        starts = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1, [len(flat)]])
        place = np.empty(len(flat), np.int64)
        place[order] = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        links, labels = np.zeros(len(reps), np.int64), np.arange(len(reps))
        one = len(set(own.tolist())) == 1
        for i in range(len(reps)):
            held = place[bounds[i] : bounds[i + 1]]
            a, b = starts[held], starts[held + 1]
            n = b - a
            at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(reps))
            ok = both >= threshold * (sizes + sizes[i] - both) - 1e-9
            ok[i] = False
            if not one:
                ok &= own != own[i]  # pairs of one block are counted in its own cell
            links[i] = weight[ok].sum()
            mates = np.flatnonzero(ok)
            if len(mates):
                _merge(labels, i, mates)
        return pa.table({"rep": pa.array(reps, pa.int64()), "links": pa.array(links, pa.int64()), "to": pa.array(reps[labels], pa.int64())})

    return run


def _sets(batches):
    """Whole sets of the representatives."""
    take_turn("ngrams")
    for batch in small_batches(batches):
        found = [shingles(text).astype("<u8").tobytes() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("rep", "component", "docs")] + [pa.array(found, pa.binary())], ["rep", "component", "docs", "set"])


def _classes(stored: DataFrame, threshold: float, recall: float) -> DataFrame:
    """row, n_links, class_row of each row of stored (row, doc): class_row is the least row of the class."""
    texts = stored.select("row", "doc.text")
    rows = materialize(texts.mapInArrow(_sketched, "row long, hi long, lo long, size long, list binary"), "lists")
    full = rows.filter("size > 0")
    classes = materialize(full.groupBy("hi", "lo").agg(F.min("row").alias("rep"), F.count("*").alias("docs")), "classes")
    lists = classes.select("rep").join(full.select(F.col("row").alias("rep"), "list"), "rep")
    groups = materialize(components(candidate_edges(materialize(lists, "class-lists"), recall)), "groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    wanted = groups.withColumnRenamed("node", "rep").join(classes.select("rep", "docs"), "rep")
    sets = texts.join(wanted.withColumnRenamed("rep", "row"), "row").withColumnRenamed("row", "rep")
    sets = sets.select("rep", "component", "docs", "text").mapInArrow(_sets, "rep long, component long, docs long, set binary")
    cells = _dealt(sets, "component", sizes, "rep").select("cell", "rep", "own", "docs", "set")
    found = materialize(cells.groupBy("cell").applyInArrow(_exact(threshold), "rep long, links long, to long"), "links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.filter("to <> rep").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    reps = (
        classes.join(linked, "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("hi", "lo", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class_row"))
    )
    members = full.select("row", "hi", "lo").join(reps, ["hi", "lo"]).select("row", "n_links", "class_row")
    alone = rows.filter("size = 0").select("row", F.lit(0).cast("long").alias("n_links"), F.col("row").alias("class_row"))
    return materialize(members.unionByName(alone), "members")


def similarity_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links for each row of docs (doc_id, text; further columns are not looked at).

    n_links counts the other rows at or above the threshold, copies included. class_id is the least doc_id of the class;
    it is null only where all ids of the class are. Texts without a word (null, empty) have no set: each is a class of
    its own without links. Rows are told apart by a number of their own, so rows that repeat a doc_id, or have none, are
    documents of their own. A pair whose similarity is the threshold is linked. An empty table gives no rows.
    """
    stored = numbered(docs.select("doc_id", "text"), "documents")
    told = stored.select("row", "doc.doc_id").join(_classes(stored, threshold, recall), "row")
    ids = told.groupBy("class_row").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    ids = materialize(ids, "class-ids")
    shared = told.join(broadcast_if_small(ids, ids.count()), "class_row", "left")
    return shared.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, that with the least doc_id (null last, then as they came); columns as they came, of any names.

    Rows with equal ids and different texts are different documents and stay; all rows without a word stay.
    """
    stored = numbered(docs, "documents")
    rows = _classes(stored, options.get("threshold", THRESHOLD), options.get("recall", RECALL))
    told = stored.select("row", "doc.doc_id").join(rows, "row")
    first = told.groupBy("class_row").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    kept = first.select(F.col("first.row").alias("row"))
    return stored.join(kept, "row").select(*[F.col(f"doc.`{c}`") for c in docs.columns])


ORACLE_OP6 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM s GROUP BY r),
both_ AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
links AS (
  SELECT a, b FROM both_ JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE both_.n >= {THRESHOLD} * (x.n + y.n - both_.n) - 1e-9),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
classes AS (SELECT a AS r, min(doc_id) AS class_id FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT doc_id, class_id, (SELECT count(*) FROM links WHERE a = d.r) AS n_links FROM d JOIN classes USING (r)
"""
