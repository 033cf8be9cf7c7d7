"""One-dimensional profiles: runs, gaps, spacing, valleys. Each profile is a key; windows are by key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs_above(df: DataFrame, key: str, pos: str, value: str, threshold: float, least: int) -> DataFrame:
    """key, first, last, n, total of runs of consecutive positions whose value is at least the threshold."""
    w = Window.partitionBy(key).orderBy(pos)
    on = df.filter(F.col(value) >= threshold)
    starts = on.withColumn("_new", (F.col(pos) - F.lag(pos).over(w) != 1).cast("long"))
    runs = starts.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(w))
    grouped = runs.groupBy(key, "_run").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.filter(F.col("n") >= least).drop("_run")


def bridge(df: DataFrame, key: str, start: str, end: str, most_gap) -> DataFrame:
    """key, first, last, n: intervals joined where the next starts no later than most_gap after the last end."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce((F.col(start) - reach > most_gap).cast("long"), F.lit(0)))
    run = marked.withColumn("_run", F.sum("_new").over(w))
    return run.groupBy(key, "_run").agg(F.min(start).alias("first"), F.max(end).alias("last"), F.count("*").alias("n")).drop("_run")


def best_run(df: DataFrame, key: str, start: str, end: str, total: str, most_gap) -> DataFrame:
    """key, first, last, total: of the runs joined as bridge() joins them, the one of the largest total; the first of equals."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = df.withColumn("_new", F.coalesce((F.col(start) - reach > most_gap).cast("long"), F.lit(0))).withColumn("_run", F.sum("_new").over(w))
    runs = run.groupBy(key, "_run").agg(F.min(start).alias("first"), F.max(end).alias("last"), F.sum(total).alias("total"))
    best = runs.groupBy(key).agg(F.max(F.struct("total", (-F.col("_run")).alias("o"), "first", "last")).alias("b"))
    return best.select(key, "b.first", "b.last", "b.total")


def median_pitch(positions: Column) -> Column:
    """The median distance of neighbours in a sorted array; 1.0 where it is nought or there are none."""

    def middle(d: Column) -> Column:
        n = F.size(d)
        return (F.get(d, F.floor((n - 1) / 2).cast("int")) + F.get(d, F.floor(n / 2).cast("int"))) / 2

    def pitch(p: Column) -> Column:
        steps = F.array_sort(F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x, i: (x - F.get(p, i)).cast("double")))
        return F.when(F.size(p) > 1, middle(steps))

    found = F.element_at(F.transform(F.array(positions), pitch), 1)
    return F.when(found.isNull() | (found == 0), 1.0).otherwise(found)


def smooth(df: DataFrame, key: str, pos: str, value: str, sigma: float) -> DataFrame:
    """Adds smooth: a Gaussian mean over the positions within three sigma; at the ends over those that there are. pos counts by one."""
    reach = int(3 * sigma + 0.5)
    w = Window.partitionBy(key).orderBy(pos)
    weights = {k: math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)}
    near = [(F.lag(value, -k).over(w) if k <= 0 else F.lead(value, k).over(w), wt) for k, wt in weights.items()]
    total = sum(F.coalesce(v * wt, F.lit(0.0)) for v, wt in near)
    norm = sum(F.when(v.isNotNull(), F.lit(wt)).otherwise(0.0) for v, wt in near)
    return df.withColumn("smooth", total / norm)


def median_blur(df: DataFrame, key: str, pos: str, value: str, size: int) -> DataFrame:
    """Adds blurred: the median of size (odd) neighbours; the ends are repeated outwards."""
    half, w = size // 2, Window.partitionBy(key).orderBy(pos)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    near = [F.coalesce(F.lag(value, -k).over(w), first) if k < 0 else F.coalesce(F.lead(value, k).over(w), last) for k in range(-half, half + 1)]
    return df.withColumn("blurred", F.get(F.array_sort(F.array(*near)), F.lit(half)))


def fill_forward(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """value, or where it is null or empty the last one before it, across pages."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(F.when(F.col(value) != "", F.col(value)), ignorenulls=True).over(w))


def ruled_rows(lines: DataFrame, key: str, pos: str, merge: float = 0.35, least: float = 3.0) -> DataFrame:
    """key, row, top, bottom: the rows between the rules of a page, from the heights at which some were seen.

    Rules closer than a share of the median pitch are one; gaps of several pitches get the rules that were missed.
    """
    seen = lines.groupBy(key).agg(F.sort_array(F.collect_list(F.col(pos).cast("double"))).alias("p"))
    pitched = seen.withColumn("pitch", median_pitch(F.col("p"))).withColumn("p", merge_close_by(F.col("p"), F.greatest(F.lit(least), F.col("pitch") * merge)))
    pitched = pitched.withColumn("pitch", median_pitch(F.col("p")))

    def between(p: Column, i: Column, pitch: Column) -> Column:
        k = F.greatest(F.bround((F.get(p, i + 1) - F.get(p, i)) / pitch).cast("int"), F.lit(1))
        many = F.when(k <= 6, k).otherwise(1)
        return F.transform(F.sequence(F.lit(0), many - 1), lambda j: F.get(p, i) + j * (F.get(p, i + 1) - F.get(p, i)) / many)

    n = F.size("p")
    filled = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: between(F.col("p"), i, F.col("pitch"))))
    grid = pitched.filter(n >= 2).select(key, F.concat(filled, F.array(F.element_at("p", -1))).alias("g"))
    rows = F.transform(F.slice("g", 1, F.size("g") - 1), lambda t, i: F.struct(i.alias("row"), F.bround(t).cast("long").alias("top"), F.bround(F.get(F.col("g"), i + 1)).cast("long").alias("bottom")))
    return grid.select(key, F.inline(rows))


def column_cuts(profile: DataFrame, key: str, pos: str, value: str, width: int, least: int, shares: tuple[float, float, float]) -> DataFrame:
    """key, a, b: the two cuts that part a page's ink into three columns, the pair of lowest valleys that leaves each its least share."""
    w = Window.partitionBy(key).orderBy(pos)
    scored = cumulative_share(valley_scores(profile, key, pos, value, width), key, pos, value)
    scored = scored.withColumns({"_l": F.lag("score").over(w), "_r": F.lead("score").over(w)})
    scored = scored.filter((F.col("score") <= F.coalesce("_l", F.col("score"))) & (F.col("score") <= F.coalesce("_r", F.col("score"))))
    one, two = scored.select(key, F.col(pos).alias("a"), F.col("score").alias("sa"), F.col("share").alias("ca")), scored.select(key, F.col(pos).alias("b"), F.col("score").alias("sb"), F.col("share").alias("cb"))
    # only valleys can be cuts, and only those with enough ink before them or after them; a page has a few dozen
    one, two = one.filter(F.col("ca") >= shares[0]), two.filter(F.col("cb") <= 1 - shares[2])
    points = one.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("a", "sa", "ca"))).alias("l")).join(two.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("b", "sb", "cb"))).alias("r")), key)
    pairs = F.flatten(
        F.transform("l", lambda p: F.transform(F.filter("r", lambda q: (q["b"] - p["a"] >= least) & (q["cb"] - p["ca"] >= shares[1])), lambda q: F.struct((p["sa"] + q["sb"]).alias("score"), p["a"].alias("a"), q["b"].alias("b"))))
    )
    return points.select(key, F.array_min(pairs).alias("x")).filter("x IS NOT NULL").select(key, "x.a", "x.b")


def merge_close(positions: Column, least: float) -> Column:
    """A sorted array with each position nearer than least to the last one merged into their midpoint."""
    return merge_close_by(positions, F.lit(least))


def merge_close_by(positions: Column, least: Column) -> Column:
    start = F.array().cast("array<double>")

    def step(kept: Column, p: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        near = (F.size(kept) > 0) & (p - last < least)
        return F.when(near, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array((last + p) / 2))).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(positions, start, step)


def fill_gaps(df: DataFrame, key: str, pos: str, pitch: float, most: int = 6) -> DataFrame:
    """key, pos, added: between positions about k pitches apart (2 <= k <= most), k - 1 further ones, a pitch each."""
    w = Window.partitionBy(key).orderBy(pos)
    span = F.lead(pos).over(w) - F.col(pos)
    steps = df.withColumn("_k", F.coalesce(F.bround(span / pitch), F.lit(0.0)).cast("int"))
    k = F.when(F.col("_k").between(2, most), F.col("_k")).otherwise(F.lit(1))
    return steps.select(key, F.col(pos).alias("_from"), F.explode(F.sequence(F.lit(0), k - 1)).alias("_i")).select(
        key, F.when(F.col("_i") == 0, F.col("_from")).otherwise(F.bround(F.col("_from") + F.col("_i") * pitch)).alias("pos"), (F.col("_i") > 0).alias("added")
    )


def valley_scores(df: DataFrame, key: str, pos: str, value: str, width: int) -> DataFrame:
    """Adds score: value over the larger of the maxima on both sides; 1.0 where those are not positive."""
    w = Window.partitionBy(key).orderBy(pos)
    left, right = F.max(value).over(w.rowsBetween(-width, -1)), F.max(value).over(w.rowsBetween(0, width - 1))
    flank = F.greatest(F.coalesce(left, F.lit(0.0)), F.coalesce(right, F.lit(0.0)))
    return df.withColumn("score", F.when(flank > 0, F.col(value) / flank).otherwise(1.0))


def cumulative_share(df: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Adds share: the part of the key's total up to and with each position."""
    w = Window.partitionBy(key)
    running = F.sum(value).over(w.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("share", running / F.sum(value).over(w))


def best_phase(lines: Column, pitch: int) -> Column:
    """The offset in 0..pitch-1 with the least summed distance of lines to the next grid line; the first of equals."""
    cost = lambda o: F.aggregate(
        lines, F.lit(0).cast("long"), lambda acc, x: acc + F.least(F.pmod(x - o, F.lit(pitch)), F.pmod(o - x, F.lit(pitch)))
    )
    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(pitch - 1)), lambda o: F.struct(cost(o).alias("cost"), o.alias("offset"))))


def best_pair(points: Column, least: int) -> Column:
    """struct<score, a, b>: of all pairs of points (pos, score) at least so far apart, the least summed score; the first of equals."""
    pairs = F.flatten(
        F.transform(points, lambda p: F.transform(F.filter(points, lambda q: q["pos"] - p["pos"] >= least), lambda q: F.struct((p["score"] + q["score"]).alias("score"), p["pos"].alias("a"), q["pos"].alias("b"))))
    )
    return F.array_min(pairs)
