"""Quality rules: within a text and by the frequency of its lines across the documents of a host.

Line frequency: each document's lines are normalised (lower case, digits to 0, white space collapsed) and hashed with
the host. For each (host, line) the distinct documents that have it are counted: documents are distinct where their
texts differ, so a page that was stored many times is one document and does not make its own lines frequent. Lines above
both limits are removed, and a document left with too few of its words is rejected as depleted.

Rows are counted by line first, combined before they are dealt. That bounds the distinct documents from above, so only
lines whose rows pass the limits are counted exactly. A row is known by a number of its own, never by its doc_id.
Everything is Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.common import let
from fieldledger.session import broadcast_if_small, materialize, numbered, table

SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is removed in a host where more distinct documents than both have it.
MAX_LINE_DOCS = 20
MAX_LINE_SHARE = 0.001
#: A document is depleted where fewer of its words than this stay, in number or percent.
MIN_WORDS_LEFT = 10
MIN_PERCENT_LEFT = 30


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _window_hashes(w: Column) -> Column:
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return let(
        hashed,
        lambda h: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(h) - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, WINDOW))
        ),
    )


def repeated_words(w: Column) -> Column:
    """How many words lie in windows of eight words that occur twice or more."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            again = F.filter(
                F.transform(
                    p,
                    lambda x, k: F.when(
                        ((k > 0) & (x["h"] == F.get(p, k - 1)["h"])) | (x["h"] == F.get(p, k + 1)["h"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return F.sort_array(again)

        def total(s: Column) -> Column:
            return F.aggregate(
                s,
                F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
                lambda acc, i: F.struct(
                    (acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n"), i.alias("at")
                ),
                lambda acc: acc["n"],
            )

        return let(let(placed, starts), total)

    return F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(
        let(
            _window_hashes(w),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
        )
    )


def measures(text: Column) -> list[Column]:
    """The measures within a text; a null text has no words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    return [
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"))).alias("w"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ]


def line_entries(text: Column, host: Column) -> Column:
    """array<struct<at, key, n>>: place, hash of host and normalised line, and words of each line with a word."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[0-9]+", "0"), "[\\x20\\x09\\x0B-\\x0D]+", " ")

    def entry(line: Column, i: Column) -> Column:
        return let(F.trim(line), lambda x: F.struct(i.alias("at"), F.xxhash64(host, x).alias("key"), F.size(F.split(x, " ")).alias("n"), (x != "").alias("any")))

    found = F.filter(F.transform(F.split(flat, "\n"), entry), lambda e: e["any"])
    return F.transform(found, lambda e: F.struct(e["at"].alias("at"), e["key"].alias("key"), e["n"].alias("n")))


def measured(docs: DataFrame) -> DataFrame:
    """Stored once, without texts: row (as given, else numbered), doc_id, the base measures, base_failed, host, a hash of the text, lines."""
    host = F.xxhash64(F.coalesce(F.col("source"), F.lit("")))
    own = "row" in docs.columns
    wide = docs.select(
        *(["row"] if own else []), "doc_id", *measures(F.col("text")), host.alias("host"), F.xxhash64("text", F.length("text")).alias("text_hash"), line_entries(F.col("text"), host).alias("lines")
    )
    return materialize(wide, "measured", add_row=not own)


def frequent_lines(found: DataFrame, max_docs: int = MAX_LINE_DOCS, max_share: float = MAX_LINE_SHARE) -> DataFrame:
    """The keys of lines that more distinct documents of their host have than both limits allow. found: from measured().

    The share is of the host's rows.
    """
    hosts = materialize(found.groupBy("host").agg(F.count("*").alias("host_docs")), "hosts")
    hosts = broadcast_if_small(hosts, hosts.count())

    def above(counted: DataFrame) -> DataFrame:
        many = counted.filter(F.col("docs") > max_docs).join(hosts, "host")
        return many.filter(F.col("docs") > F.col("host_docs") * max_share).select("host", "key")

    held = found.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda e: e["key"]))).alias("key"))
    often = materialize(above(held.groupBy("host", "key").agg(F.count("*").alias("docs"))), "often-lines")
    among = held.join(broadcast_if_small(often, often.count()), ["host", "key"], "left_semi").distinct()
    frequent = materialize(above(among.groupBy("host", "key").agg(F.count("*").alias("docs"))).select("key"), "frequent-lines")
    return broadcast_if_small(frequent, frequent.count())


def judged(found: DataFrame, frequent: DataFrame) -> DataFrame:
    """found with words_removed, gone (places of the removed lines; null if none), words_left and kept."""
    lines = found.select("row", F.explode("lines").alias("line")).select("row", "line.at", "line.key", "line.n")
    hits = lines.join(frequent, "key", "left_semi").groupBy("row").agg(F.sum("n").cast("long").alias("words_removed"), F.sort_array(F.collect_list("at")).alias("gone"))
    out = found.join(hits, "row", "left").withColumn("words_removed", F.coalesce("words_removed", F.lit(0).cast("long")))
    out = out.withColumn("n_words", F.col("w.n")).withColumn("n_repeat_words", F.col("w.r")).drop("w")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.greatest(F.col("n_words") - F.col("words_removed"), F.lit(0).cast("long"))
    depleted = (F.col("words_removed") > 0) & ((left < MIN_WORDS_LEFT) | (100 * left < MIN_PERCENT_LEFT * F.col("n_words")))
    return out.withColumn("base_failed", failed).withColumn("words_left", left).withColumn("kept", ~F.col("base_failed") & ~depleted)


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_removed", "words_left", "kept")


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """A row a document: the base measures, base_failed, words_removed, words_left and kept.

    docs has doc_id, text and source; further columns are not looked at. A null text is empty (no words, so it fails the
    base rules), a null source is a host of its own, the empty name. Each row is judged by itself, whatever its doc_id,
    null and repeated ones too. Rows with one text on one host count once in a line's documents. A line that exactly as
    many documents have as a limit allows stays. An empty table gives no rows.
    """
    found = measured(docs.select("doc_id", "text", "source"))
    return judged(found, frequent_lines(found, **limits)).select(*RESULT)


def keep_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows that pass, with their frequent lines removed and n_chars counted anew; columns as they came.

    Nulls, repeats and empty tables as in quality_rules(): each row stays or goes by its own text, and its lines are cut
    at its own places. Columns of any further name pass through untouched.
    """
    stored = numbered(docs, "documents")
    found = measured(stored.select("row", "doc.doc_id", "doc.text", "doc.source"))
    passed = judged(found, frequent_lines(found, **limits)).filter("kept").select("row", "gone")
    cut = stored.join(passed, "row").select("doc", "gone")
    lines = F.filter(F.split("doc.text", "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i))
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(lines, "\n"))
    shown = {"text": text, "n_chars": F.when(F.col("gone").isNull(), F.col("doc.n_chars")).otherwise(F.length(text)) if "n_chars" in docs.columns else None}
    kinds = dict(docs.dtypes)
    return cut.select(*[shown[c].cast(kinds[c]).alias(c) if c in shown else F.col(f"doc.`{c}`") for c in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE_OP2 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY k) AS k, w
  FROM (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS k
        FROM (SELECT r, regexp_extract_all(text, '[^ 	-]+') AS words FROM d))),
g AS (
  SELECT r, k, CASE WHEN lead(w, {WINDOW - 1}) OVER x IS NOT NULL
                    THEN concat_ws(' ', w, {", ".join(f"lead(w, {i}) OVER x" for i in range(1, WINDOW))}) END AS gram
  FROM w WINDOW x AS (PARTITION BY r ORDER BY k)),
twice AS (
  SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY r, gram) AS times FROM g WHERE gram IS NOT NULL) WHERE times > 1),
covered AS (
  SELECT r, count(DISTINCT k + i) AS n FROM twice, (SELECT unnest(range({WINDOW})) AS i) GROUP BY r),
sizes AS (SELECT r, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY r),
lines AS (
  SELECT r, host, text, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[ 	-]+', ' ', 'g')) AS norm
  FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d)),
filled AS (SELECT * FROM lines WHERE norm <> ''),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM filled GROUP BY r),
hosts AS (SELECT host, count(*) AS n FROM d GROUP BY host),
frequent AS (
  SELECT host, norm FROM filled JOIN hosts USING (host) GROUP BY host, norm, n
  HAVING count(DISTINCT text) > {MAX_LINE_DOCS} AND count(DISTINCT text) > n * {MAX_LINE_SHARE}),
gone AS (
  SELECT r, sum(length(norm) - length(replace(norm, ' ', '')) + 1) AS n FROM filled JOIN frequent USING (host, norm) GROUP BY r),
m AS (
  SELECT doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_words, CAST(coalesce(s.chars, 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS words_removed
  FROM d LEFT JOIN sizes s USING (r) LEFT JOIN dup USING (r) LEFT JOIN covered c USING (r) LEFT JOIN gone USING (r)),
v AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, greatest(n_words - words_removed, 0) AS words_left FROM m)
SELECT {", ".join(RESULT[:-1])},
       NOT base_failed AND NOT (words_removed > 0 AND (words_left < {MIN_WORDS_LEFT} OR 100 * words_left < {MIN_PERCENT_LEFT} * n_words)) AS kept
FROM v
"""
