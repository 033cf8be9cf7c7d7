"""Pages to one ordered batch: page order, groups across page breaks, remarks bound to their groups, output rows, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldledger.functions import fixed, text as t
from fieldledger.session import broadcast_if_small

BATCH = "batch_id"


def batch_window() -> Window:
    return Window.partitionBy(BATCH).orderBy("page_ord", "row_index")


def _shown() -> Column:
    number = t.survey_number(F.col("survey.text"))
    return F.when(F.col("is_group_first") & number.isNotNull(), F.struct("row_index", number.alias("n")))


def place_pages(rows: DataFrame) -> DataFrame:
    """Adds page_ord: pages by the first number that they show; those without one last, as they came."""
    found = rows.withColumn("_first", F.min(_shown()).over(Window.partitionBy(BATCH, "page_no")))
    order = Window.partitionBy(BATCH).orderBy(F.col("_first.n").asc_nulls_last(), "page_no")
    return found.withColumn("page_ord", (F.dense_rank().over(order) - 1).cast("long")).drop("_first")


def order_pages(rows: DataFrame) -> DataFrame:
    """batch_id, page_no, page_ord, first_survey: the order of pages as place_pages has it."""
    pages = rows.groupBy(BATCH, "page_no").agg(F.min(_shown()).alias("first"))
    order = Window.partitionBy(BATCH).orderBy(F.col("first.n").asc_nulls_last(), "page_no")
    return pages.select(BATCH, "page_no", (F.row_number().over(order) - 1).cast("long").alias("page_ord"), F.col("first.n").alias("first_survey"))


def skip_reason() -> Column:
    """Why a row has no output; null if it has."""
    blank = (F.col("meter.text") == "") & (F.col("remarks.text") == "") & (F.col("survey.text") == "")
    return F.when(F.col("row_status") == "skipped", "section marker or non-Latin line").when(blank, "no ink in any column")


def assign_groups(rows: DataFrame) -> DataFrame:
    """Adds group_id, opens (the row starts a group) and governing; a number repeated after itself goes on with its group.

    Such a row is no longer the first of a group, and its survey cell (if there is one) notes why. Rows before the first
    number are a group of their own, 0.
    """
    w = batch_window()
    earlier = F.last(F.col("group_survey"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    work = rows.withColumn("_again", F.col("is_group_first") & F.col("group_survey").eqNullSafe(earlier))
    work = work.withColumn("opens", F.col("is_group_first") & ~F.col("_again")).withColumn("is_group_first", F.col("opens"))
    if any(f.name == "survey" and isinstance(f.dataType, StructType) for f in rows.schema):
        noted = F.array_union("survey.rules", F.array(F.lit("group_continues_across_pages")))
        work = work.withColumn("survey", F.when(F.col("_again"), F.col("survey").withField("rules", noted)).otherwise(F.col("survey")))
    starts = F.col("opens") | (F.row_number().over(w) == 1)
    count = F.sum(starts.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    governing = F.last(F.col("group_survey"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return work.withColumn("group_id", count - 1).withColumn("governing", governing).drop("_again")


def bind_remarks(rows: DataFrame, joiner: str = fixed.REMARK_JOINER) -> DataFrame:
    """Adds bound (the group's free-standing remarks, joined in row order), n_bound and first_of_group."""
    group = Window.partitionBy(BATCH, "group_id").orderBy("page_ord", "row_index")
    free = F.when((F.size("codes") == 0) & (F.col("remarks.text") != ""), F.col("remarks.text"))
    parts = F.collect_list(free).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = rows.withColumn("first_of_group", F.row_number().over(group) == 1).withColumn("_parts", parts)
    return out.withColumn("bound", F.array_join("_parts", joiner)).withColumn("n_bound", F.size("_parts")).drop("_parts")


def output_rows(rows: DataFrame) -> DataFrame:
    """survey (null where a row continues a group), meter, remark (text or number), status, in order."""
    text = F.when(F.size("codes") > 0, F.col("remarks.text")).when(F.col("opens"), F.col("bound")).otherwise("")
    joined = F.col("first_of_group") & (F.col("n_bound") > 1)
    remark_status = F.when(joined, "manual_review").otherwise(F.col("remarks.status"))
    remark = t.format_remarks(text, F.col("codes"))
    return rows.select(
        BATCH,
        "page_no",
        "page_ord",
        "row_index",
        "group_id",
        F.when(F.col("opens"), F.col("group_survey")).alias("survey"),
        F.col("meter.text").alias("meter"),
        remark.alias("remark"),
        t.row_verdict(F.col("survey.status"), F.col("meter.status"), remark_status).alias("status"),
    )


def grouped(corrected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with their groups and bound remarks, skipped lines with their reason). Nothing vanishes: each line is in one of them."""
    routed = place_pages(corrected).withColumn("reason", skip_reason())
    kept = routed.filter("reason IS NULL").drop("reason")
    return bind_remarks(assign_groups(kept)), routed.filter("reason IS NOT NULL")


def assemble(corrected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(output rows, skipped rows with their reason) of corrected pages."""
    kept, skipped = grouped(corrected)
    return output_rows(kept), skipped


def audit_surveys(rows: DataFrame, known_gaps: DataFrame | None = None) -> DataFrame:
    """batch_id, kind (gap, repeat), previous, current, from the numbers in output order."""
    numbers = rows.withColumn("n", t.survey_number(F.col("survey"))).filter("n IS NOT NULL")
    steps = numbers.select(BATCH, "page_ord", "row_index", F.lag("n").over(batch_window()).alias("previous"), F.col("n").alias("current"))
    found = steps.filter("previous IS NOT NULL AND current <> previous + 1")
    kind = F.when(F.col("current") <= F.col("previous"), "repeat").otherwise("gap")
    found = found.select(BATCH, kind.alias("kind"), "previous", "current")
    if known_gaps is None:
        return found
    known = known_gaps.select(F.lit("gap").alias("kind"), "previous", "current")
    known = broadcast_if_small(known, known.count())
    return found.join(known, ["kind", "previous", "current"], "left_anti").select(BATCH, "kind", "previous", "current")


def audit_duplicates(rows: DataFrame) -> DataFrame:
    """batch_id, meter, n of codes met more than once; placeholders may repeat."""
    named = F.col("meter").isin(*[output for output, _ in fixed.PLACEHOLDERS])
    return rows.filter((F.col("meter") != "") & ~named).groupBy(BATCH, "meter").agg(F.count("*").alias("n")).filter("n > 1")


def audit_row_counts(corrected: DataFrame, expected: DataFrame) -> DataFrame:
    """batch_id, page_no, expected, emitted where they differ; expected: batch_id, page_no, detected_rules (0: unknown)."""
    emitted = corrected.groupBy(BATCH, "page_no").agg(F.count_if(F.col("meter.text") != "").alias("emitted"))
    return (
        emitted.join(expected.filter("detected_rules <> 0"), [BATCH, "page_no"])
        .filter("emitted <> detected_rules")
        .select(BATCH, "page_no", F.col("detected_rules").cast("long").alias("expected"), "emitted")
    )


def audit_all(rows: DataFrame, corrected: DataFrame | None = None, expected: DataFrame | None = None, known_gaps: DataFrame | None = None) -> DataFrame:
    """batch_id, kind, finding: all findings as text."""
    # The wording of the findings.
    surveys = audit_surveys(rows, known_gaps)
    missing = F.col("current") - F.col("previous") - 1
    text = F.when(
        F.col("kind") == "gap",
        F.format_string(
            "survey gap: KE-%d -> KE-%d (%d number%s missing; a page may not have been photographed)",
            "previous", "current", missing, F.when(missing != 1, "s").otherwise(""),
        ),
    ).otherwise(F.format_string("survey out of order or repeated at KE-%d", "current"))
    found = surveys.select(BATCH, "kind", text.alias("finding")).unionByName(
        audit_duplicates(rows).select(
            BATCH, F.lit("duplicate").alias("kind"), F.format_string("duplicate meter code: %s (a misread, or a page photographed twice)", "meter").alias("finding")
        )
    )
    if corrected is None or expected is None:
        return found
    counts = audit_row_counts(corrected, expected)
    finding = F.format_string("row count mismatch in %s: %d ruled lines with ink, %d rows emitted", F.col("page_no").cast("string"), "expected", "emitted")
    return found.unionByName(counts.select(BATCH, F.lit("row_count").alias("kind"), finding.alias("finding")))


def survey_range(rows: DataFrame) -> DataFrame:
    n = t.survey_number(F.col("survey"))
    return rows.groupBy(BATCH).agg(F.min(n).alias("lowest"), F.max(n).alias("highest"))


def summary(rows: DataFrame, skipped: DataFrame) -> DataFrame:
    """batch_id, metric, value; a batch of which all lines are skipped has its metrics, too."""
    names = ["rows", "groups", "needs_review", "corrected", "remarked", "numeric_remarks", "text_remarks", "skipped"]
    counts = rows.groupBy(BATCH).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("survey").isNotNull()).alias("groups"),
        F.count_if(F.col("status") == "manual_review").alias("needs_review"),
        F.count_if(F.col("status") == "corrected").alias("corrected"),
        F.count_if(F.col("remark.number").isNotNull() | F.col("remark.text").isNotNull()).alias("remarked"),
        F.count_if(F.col("remark.number").isNotNull()).alias("numeric_remarks"),
        F.count_if(F.col("remark.text").isNotNull()).alias("text_remarks"),
    )
    out = skipped.groupBy(BATCH).agg(F.count("*").alias("skipped"))
    return counts.join(out, BATCH, "full").fillna(0, names).unpivot([BATCH], names, "metric", "value")


def orphan_remarks(rows: DataFrame) -> DataFrame:
    """batch_id, page_no, row_index, remark: free-standing remarks of rows before a batch's first number, which no group shows. rows: of grouped()."""
    lost = rows.filter((F.col("group_id") == 0) & F.col("governing").isNull() & (F.size("codes") == 0) & (F.col("remarks.text") != ""))
    return lost.select(BATCH, "page_no", "row_index", F.col("remarks.text").alias("remark"))


def unpivot_cells(corrected: DataFrame) -> DataFrame:
    """A row for each cell with something to tell: batch_id, page_no, row_index, field, raw, text, status, rules, candidates."""
    cells = [
        F.struct(
            F.lit(name).alias("field"), F.coalesce(F.col(f"{name}_raw"), F.lit("")).alias("raw"), F.col(f"{name}.text").alias("text"),
            F.col(f"{name}.status").alias("status"), F.array_join(f"{name}.rules", ", ").alias("rules"), F.array_join(f"{name}.candidates", ", ").alias("candidates"),
        )
        for name in ("survey", "meter", "remarks")
    ]
    rows = corrected.select(BATCH, "page_no", "row_index", F.inline(F.array(*cells)))
    return rows.filter(~((F.col("text") == "") & F.col("status").isin("empty", "ok")))
