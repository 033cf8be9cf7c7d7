"""Join-shaped operators: dictionaries, intervals, overrides, comparisons by position."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.functions import fixed
from fieldledger.functions.text import normalise_code, once, parse_code


def valid_codes(df: DataFrame, code: str, prefixes: DataFrame, valid: bool = True) -> DataFrame:
    """Rows whose code fits the grammar and has a known prefix, or those for which one of both is not so."""
    keyed = df.withColumn("_prefix", parse_code(F.col(code))["prefix"])
    dim = F.broadcast(prefixes.select(F.col("prefix").alias("_prefix")))
    return keyed.join(dim, "_prefix", "left_semi" if valid else "left_anti").drop("_prefix")


def with_prefix_count(df: DataFrame, code: str, prefixes: DataFrame) -> DataFrame:
    keyed = df.withColumn("prefix", parse_code(F.col(code))["prefix"])
    return keyed.join(F.broadcast(prefixes), "prefix", "left")


#: Bits of a known prefix's lane in a long, one of them for the carry; lanes of a long.
LANE = 1 + max(map(len, fixed.PREFIX_COUNTS))
LANES = 62 // LANE
#: Known prefixes from the least to the most frequent, of equals the first one last.
BY_COUNT = [p for _, _, p in sorted((n, -i, p) for i, (p, n) in enumerate(fixed.PREFIX_COUNTS.items()))]
RANKS = len(BY_COUNT)


def _lanes(bits_of) -> list[int]:
    """Longs with bits_of(prefix) in each known prefix's lane."""
    out = [0] * -(-len(fixed.PREFIX_COUNTS) // LANES)
    for i, p in enumerate(fixed.PREFIX_COUNTS):
        out[i // LANES] |= bits_of(p) << LANE * (i % LANES)
    return out


def _unmatched(key: Column) -> Column:
    """Longs in whose lanes as many bits are zero as a known prefix's longest common subsequence with key has letters.

    All prefixes at a time, a letter of key a step (bit-parallel, after Hyyro).
    """
    letters = sorted(set("".join(fixed.PREFIX_COUNTS)))
    at = {c: F.array(*[F.lit(m).cast("long") for m in _lanes(lambda p, c=c: sum(1 << j for j, x in enumerate(p) if x == c))]) for c in letters}
    known = F.create_map(*[x for c in letters for x in (F.lit(c), at[c])])
    full = F.lit(sum(((1 << LANE - 1) - 1) << LANE * i for i in range(LANES))).cast("long")

    def meet(v: Column, m: Column) -> Column:
        both = v.bitwiseAND(m)
        return (v + both).bitwiseOR(v - both).bitwiseAND(full)

    step = lambda acc, c: once(F.try_element_at(known, c), lambda m: F.when(m.isNull(), acc).otherwise(F.zip_with(acc, m, meet)))
    return F.aggregate(F.split(key, ""), F.array_repeat(full, -(-len(fixed.PREFIX_COUNTS) // LANES)), step)


def _ranked(df: DataFrame, prefix: str) -> tuple[DataFrame, Column, list[Column]]:
    """df with _unmatched, the key, and for each known prefix a long that is larger the better it is; _match() reads it.

    Scores are compared as whole numbers, common letters times the sums of lengths of all others, then places by count.
    """
    key = F.upper(F.trim(F.coalesce(F.col(prefix), F.lit(""))))
    sizes = sorted(set(map(len, fixed.PREFIX_COUNTS)))
    place = {p: i for i, p in enumerate(BY_COUNT)}
    ranks = []
    for i, p in enumerate(fixed.PREFIX_COUNTS):
        own = F.shiftright(F.get("_unmatched", F.lit(i // LANES)), LANE * (i % LANES)).bitwiseAND(F.lit((1 << (LANE - 1)) - 1).cast("long"))
        same = (LANE - 1 - F.bit_count(own)).cast("long")
        scale = functools.reduce(operator.mul, [F.col("_size") + n for n in sizes if n != len(p)], F.lit(1).cast("long"))
        ranks.append(same * scale * (RANKS * LANE) + place[p] * LANE + same)
    return df.withColumns({"_unmatched": _unmatched(key), "_size": F.length(key).cast("long")}), key, ranks


def _match(rank: Column) -> Column:
    """struct<prefix, score> of a number of _ranked(); the score is the indel ratio."""
    found = F.get(F.array(*map(F.lit, BY_COUNT)), ((rank - rank % LANE) % (RANKS * LANE) / LANE).cast("int"))
    return F.struct(found.alias("prefix"), (200.0 * (rank % LANE) / (F.col("_size") + F.length(found))).alias("score"))


def fuzzy_prefixes(df: DataFrame, prefix: str, threshold: float = 85.0, most: int = 5) -> DataFrame:
    """Adds matches array<struct<prefix, score>>: the known prefixes most like it, best first, then the more frequent."""
    df, key, ranks = _ranked(df, prefix)
    found = F.transform(F.slice(F.sort_array(F.array(*ranks), False), 1, most), _match)
    found = F.when(key != "", F.filter(found, lambda m: m["score"] >= threshold)).otherwise(F.array().cast("array<struct<prefix:string,score:double>>"))
    return df.withColumn("matches", found).drop("_unmatched", "_size")


def fuzzy_prefix(df: DataFrame, prefix: str, threshold: float = 85.0) -> DataFrame:
    """Adds match struct<prefix, score>: the known prefix most like it, the more frequent of equals; null under the threshold.

    The 65 known prefixes are in the plan, as lanes of a few longs; no join is needed.
    """
    df, key, ranks = _ranked(df, prefix)
    found = df.withColumn("_best", F.greatest(*ranks)).withColumn("_best", _match(F.col("_best")))
    best = F.when((key != "") & (F.col("_best.score") >= threshold), F.col("_best"))
    return found.withColumn("match", best).drop("_unmatched", "_size", "_best")


def interval_join(rows: DataFrame, key: str, spans: DataFrame) -> DataFrame:
    """Rows with the span (id, first_row, last_row) that their key lies in, and offset in it. Spans become keys: an equi-join."""
    keys = spans.select("id", "first_row", F.explode(F.sequence("first_row", "last_row")).alias("_key"))
    return rows.join(keys, rows[key] == keys["_key"]).withColumn("offset", F.col(key) - F.col("first_row")).drop("_key", "first_row")


def count_mismatches(counts: DataFrame, expected: DataFrame, key: str, found: str, wanted: str) -> DataFrame:
    """Keys of both whose counts differ, with the two."""
    return counts.join(expected, key).filter(F.col(found) != F.col(wanted))


def select_named(rows: DataFrame, name: str, asked: list) -> DataFrame:
    """asked (place in the request) and the row of each name that there is; unknown names are passed over."""
    kind = rows.schema[name].dataType.simpleString()
    wanted = rows.sparkSession.createDataFrame(list(enumerate(asked)), f"asked int, {name} {kind}")
    return rows.join(F.broadcast(wanted), name)


def override(base: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """base with the fields that changes gives (not null) in place of its own."""
    new = changes.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = base.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])


def differences(left: DataFrame, right: DataFrame, folded: tuple[str, ...] = ()) -> DataFrame:
    """Rows of either side that the other lacks, repeats counted: side and the row's columns; folded columns are compared in lower case."""
    cols = left.columns
    left, right = (df.withColumns({c: F.lower(c) for c in folded}) if folded else df for df in (left, right))
    left = left.select(*cols)
    one = left.exceptAll(right.select(*cols)).select(F.lit("left").alias("side"), *cols)
    return one.unionByName(right.select(*cols).exceptAll(left).select(F.lit("right").alias("side"), *cols))


def code_prefixes(prefixes: DataFrame) -> DataFrame:
    """All beginnings of known prefixes, each once, and whether it is a whole one."""
    parts = prefixes.select("prefix", F.explode(F.sequence(F.lit(1), F.length("prefix"))).alias("n"))
    return parts.select(F.substring("prefix", F.lit(1), F.col("n")).alias("part"), (F.col("n") == F.length("prefix")).alias("w")).groupBy("part").agg(F.max("w").alias("whole"))


def next_allowed(partial: Column, beginnings: Column) -> Column:
    """What a code grammar admits after a partial code: letters, digits, both, or its end."""
    p = normalise_code(partial)
    letters, digits = F.regexp_extract(p, "^([A-Z]*)", 1), F.regexp_extract(p, "([0-9]*)$", 1)
    known = F.array_contains(beginnings, letters)
    return (
        F.when(p == "", "letter")
        .when(~p.rlike("^[A-Z]+[0-9]*$") | ~known, "reject")
        .when(digits == "", F.when(F.length(letters) < 2, "letter").when(F.length(letters) == 2, "letter_or_digit").otherwise("digit"))
        .when(F.length(digits) < 5, "digit")
        .when(F.length(digits) == 5, "digit_or_end")
        .when(F.length(digits) == 6, "end")
        .otherwise("reject")
    )
