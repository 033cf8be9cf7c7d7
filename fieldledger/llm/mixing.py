"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power alpha, normalised. Alpha is bisected, several halvings a job, for the
largest value in [0, 1] whose weights have the target entropy, and raised, if need be, until no source is repeated more
often than the limit. Shares never leave the executors: a job returns a few sums for each trial value.

The weights are realised within a token budget (by default the least at which no document is left out): a source's quota
is a number of whole epochs and a rest. Documents are dealt by hash into blocks of some hundred, or of the root of the
source's documents if that is more, so that neither the blocks of a source nor the documents of a block are many; each
epoch orders the blocks anew. The rest takes whole blocks in that order and, of the block at the border, documents in hash order. A
document's copies follow from its source, its block and its hash alone, so a source with a third of all rows is no hot
spot: only block totals are ordered by source.

Tokens are white-space words, or what a column of the documents says: a tokenizer can't be run by SQL functions, but its
counts can be given.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.llm.quality import SPACE_CHARS
from fieldledger.session import broadcast_if_small, materialize, table

#: Target entropy as a share of the entropy of equal weights.
TARGET = 0.95
MAX_REPEATS = 4.0
BLOCK_ROWS = 256
HALVINGS, ROUNDS = 4, 5
SEED = 17


@dataclass
class Temperature:
    """The exponent and what normalises it."""

    alpha: float
    norm: float
    tokens: int
    budget: float


def _trial(sources: DataFrame, total: int, alphas: list[float]) -> list[tuple[float, float]]:
    """(normaliser, entropy) of the weights at each exponent, in one job."""
    p = F.col("tokens") / float(total)
    sums = []
    for i, a in enumerate(alphas):
        power = F.pow(p, F.lit(a))
        sums += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(p)).alias(f"s{i}")]
    row = sources.filter("tokens > 0").agg(*sums).first()
    out = []
    for i, a in enumerate(alphas):
        z = row[f"z{i}"]
        out.append((z, math.log(z) - a * row[f"s{i}"] / z))
    return out


def find_alpha(sources: DataFrame, target: float, max_repeats: float, budget: float | None) -> Temperature:
    """sources: tokens by source. Without any token, the exponent is 1 and the budget 0."""
    facts = sources.filter("tokens > 0").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("tokens").alias("lo"), F.max("tokens").alias("hi")).first()
    if not facts["n"]:
        return Temperature(1.0, 1.0, 0, 0.0)
    total, n, lo, hi = int(facts["t"]), facts["n"], int(facts["lo"]), int(facts["hi"])

    def repeats(alpha: float, z: float) -> float:
        if budget is None:
            return (hi / lo) ** (1 - alpha)
        return budget / total * (lo / total) ** (alpha - 1) / z

    def bisect(beyond) -> float:
        """The exponent at which beyond(alpha, normaliser, entropy) turns from false to true; 0 or 1 if it never does."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / (1 << HALVINGS) for i in range((1 << HALVINGS) + 1)]
            marks = [beyond(a, *x) for a, x in zip(grid, _trial(sources, total, grid), strict=True)]
            if marks[0] or not marks[-1]:
                return low if marks[0] else high
            k = marks.index(True)
            low, high = grid[k - 1], grid[k]
        return low

    wanted = target * math.log(n)
    alpha = bisect(lambda a, z, h: h < wanted - 1e-12)  # the largest that keeps the entropy
    alpha = max(alpha, bisect(lambda a, z, h: repeats(a, z) <= max_repeats * (1 + 1e-12)))  # the least that keeps the limit
    z = _trial(sources, total, [alpha])[0][0]
    least = max((x / (x / total) ** alpha for x in (lo, hi))) * z  # B = T / w, largest at an end as the share's power is monotone
    return Temperature(alpha, z, total, float(budget if budget is not None else least))


def _sized(docs: DataFrame, tokens: str | None = None) -> DataFrame:
    """doc_id, source (null: empty), tokens (of that column, else white-space words) and the document's draw."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), SPACE_CHARS[1:], " " * (len(SPACE_CHARS) - 1))
    return docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        (F.coalesce(F.col(f"`{tokens}`").cast("long"), F.lit(0)) if tokens else F.size(F.array_remove(F.split(text, " "), "")).cast("long")).alias("tokens"),
        draw().alias("draw"),
    )


def draw():
    """By id and text: rows without an id, or with one id, are not drawn together unless they are equal."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(SEED))


def plan_mix(sized: DataFrame, target: float = TARGET, max_repeats: float = MAX_REPEATS, budget: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, blocks): a source's weight, quota, epochs and number of blocks; a block's place and, for the last epoch, the draw up to which it is in."""
    sources = materialize(sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    heat = find_alpha(sources, target, max_repeats, budget)
    share = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / float(max(heat.tokens, 1)), F.lit(heat.alpha)) / heat.norm).otherwise(0.0)
    quota = F.col("weight") * heat.budget
    # a quota within a millionth of whole epochs is whole
    near = F.floor(F.col("quota") / F.col("tokens") + 1e-6)
    sources = sources.withColumn("weight", share).withColumn("quota", quota).withColumn("epochs", F.when(F.col("tokens") > 0, near).otherwise(F.lit(1)).cast("int"))
    sources = sources.withColumn("rest", F.greatest(F.col("quota") - F.col("epochs") * F.col("tokens"), F.lit(0.0))).withColumn(
        "blocks", F.ceil(F.col("docs") / F.greatest(F.lit(float(BLOCK_ROWS)), F.sqrt("docs"))).cast("long")
    )
    sources = materialize(sources, "weights")
    few = broadcast_if_small(sources, sources.count())
    placed = sized.join(few, "source").select("source", "draw", sized["tokens"].alias("n"), "epochs", "rest", "quota", few["tokens"].alias("tokens"), F.pmod("draw", "blocks").alias("block"))
    totals = placed.groupBy("source", "block", "epochs", "rest", "quota", "tokens").agg(F.sum("n").alias("n"))
    epoch = totals.select("*", F.explode(F.sequence(F.lit(0), F.col("epochs"))).alias("epoch"))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("source", "epoch", "block", F.lit(SEED)), "block").rowsBetween(Window.unboundedPreceding, -1)
    ordered = epoch.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    ordered = materialize(ordered, "blocks")
    last = ordered.filter("epoch = epochs AND before < rest")
    border = last.filter("before + n > rest").select("source", "block", (F.col("rest") - F.col("before")).alias("room"))
    running = Window.partitionBy("source", "block").orderBy("draw").rangeBetween(Window.unboundedPreceding, 0)
    inside = (
        placed.select("source", "block", "draw", "n")
        .join(broadcast_if_small(border, sources.count()), ["source", "block"])
        .withColumn("run", F.sum("n").over(running))
        .filter("run <= room")
        .groupBy("source", "block")
        .agg(F.max("draw").alias("upto"))
    )
    whole = last.filter("before + n <= rest").select("source", "block", F.lit((1 << 63) - 1).alias("upto"))
    limits = whole.unionByName(inside)
    places = ordered.groupBy("source", "block").agg(
        F.sort_array(F.collect_list(F.struct("epoch", ((F.col("epoch") * F.col("tokens") + F.col("before")) / F.greatest("quota", F.lit(1.0))).alias("place")))).alias("places")
    )
    return sources, materialize(places.join(limits, ["source", "block"], "left"), "plan")


def mix(docs: DataFrame, tokens: str | None = None, **options) -> DataFrame:
    """docs with epoch, block, place and weight, a row for each time a document is used.

    place orders all rows so that every stretch has the target weights; equal places are ordered by nothing further. A
    null source is a source of its own (the empty name), a document without words costs nothing and is used in each whole
    epoch. Rows that repeat both doc_id and text are drawn together; a null doc_id is an id like others. Further columns
    pass through, whatever their names (a column named like one that mix adds comes twice). An empty table gives no rows.
    """
    sized = materialize(_sized(docs, tokens), "sized")
    sources, blocks = plan_mix(sized, **options)
    n_sources, n_blocks = sources.count(), blocks.count()
    few = broadcast_if_small(sources.select(F.col("source").alias("mix_source"), "weight", "epochs", F.col("blocks").alias("n_blocks")), n_sources)
    plan = broadcast_if_small(blocks.select(F.col("source").alias("plan_source"), F.col("block").alias("plan_block"), "places", "upto"), n_blocks)
    names = [F.col(f"doc.`{c}`") for c in docs.columns]
    wide = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce("source", F.lit("")).alias("mix_source"), draw().alias("draw")).join(few, "mix_source")
    wide = wide.withColumn("block", F.pmod("draw", "n_blocks"))
    wide = wide.join(plan, (F.col("mix_source") == F.col("plan_source")) & (F.col("block") == F.col("plan_block")))
    times = F.col("epochs") + F.when(F.col("draw") <= F.col("upto"), 1).otherwise(0)
    used = wide.select("doc", "block", "weight", F.explode(F.slice("places", F.lit(1), times)).alias("use"))
    return used.select(*names, F.col("use.epoch").alias("mix_epoch"), F.col("block").alias("mix_block"), F.col("use.place").alias("mix_place"), F.col("weight").alias("mix_weight"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_place").alias("place"), F.col("mix_weight").alias("weight"))
