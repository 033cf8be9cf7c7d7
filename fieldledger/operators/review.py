"""What a reviewer sees: labels, sidecar text, grid as JSON, column widths, row numbers after edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.functions import fixed, text as t
from fieldledger.operators import assembly

FIELDS = ("survey", "meter", "remarks")

# Labels of rules shown to a reviewer.
RULE_LABELS = {
    "ditto_meter": "Ditto expanded", "ditto_remark": "Ditto expanded", "struck_out_correction": "Struck-out value dropped",
    "ambiguous_correction": "Two readings", "section_marker": "Section marker", "special_token": "Placeholder",
}


def rule_label(rule: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RULE_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, rule), F.replace(rule, F.lit("_"), F.lit(" ")))


def joined_map(m: Column) -> Column:
    """k=v | k=v of a map."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " | ")


def column_widths(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, width: the longest text and 2, within 10 and 60."""
    widths = [F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c in columns]
    long = df.agg(*widths).unpivot([], columns, "column", "longest")
    return long.select("column", F.least(F.greatest(F.col("longest") + 2, F.lit(10)), F.lit(60)).alias("width"))


def page_json(rows: DataFrame) -> DataFrame:
    """batch_id, page_no, grid: a page's output rows as JSON, in order."""
    row = F.struct("row_index", F.coalesce("survey", F.lit("")).alias("survey"), "meter", "status")
    return rows.groupBy("batch_id", "page_no").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("grid"))


def cell_view(name: str) -> Column:
    """What a reviewer sees of a cell; <name>_raw is its reading."""
    cell = F.col(name)
    return F.struct(
        cell["text"].alias("text"), F.coalesce(F.col(f"{name}_raw"), F.lit("")).alias("raw"), cell["status"].alias("status"),
        t.needs_review(cell["status"]).alias("needs_review"), cell["candidates"].alias("candidates"), cell["rules"].alias("rules"),
    )


def _confidence(columns: list[str]) -> Column:
    cells = [(F.col(f"{n}.text"), F.col(f"{n}_conf")) for n in FIELDS if f"{n}_conf" in columns]
    return F.bround(t.min_confidence(*cells), 3) if cells else F.lit(0.0)


def grid_rows(kept: DataFrame) -> DataFrame:
    """batch_id, page_ord, row_index and row: one line of the review grid. kept: lines with groups and bound remarks."""
    text = F.when(F.size("codes") > 0, F.trim("remarks.text")).when(F.col("opens"), F.col("bound")).otherwise("")
    review = F.col("row_status").isin(*fixed.SETTLED) & ~t.needs_review(F.col("survey.status")) & ~t.needs_review(F.col("meter.status")) & ~t.needs_review(F.col("remarks.status"))
    page = F.col("page_no").cast("string")
    row = F.struct(
        F.concat_ws("#", page, F.col("row_index").cast("string")).alias("id"), page.alias("page"), F.col("row_index").alias("index"), "group_id",
        F.col("opens").alias("is_group_first"), F.when(F.col("opens"), F.col("group_survey")).otherwise("").alias("survey"), F.col("meter.text").alias("meter"),
        F.coalesce(t.remark_shown(t.format_remarks(text, F.col("codes"))), F.lit("")).alias("remarks"), F.col("codes").alias("annotations"),
        F.struct(*[cell_view(n).alias(n) for n in FIELDS]).alias("cells"), (~review).alias("needs_review"), _confidence(kept.columns).alias("confidence"),
    )
    return kept.select("batch_id", "page_ord", "row_index", row.alias("row"))


def grid_json(kept: DataFrame, skipped: DataFrame, rows: DataFrame, corrected: DataFrame, expected: DataFrame | None = None, known_gaps: DataFrame | None = None) -> DataFrame:
    """batch_id, grid: a batch's whole answer as JSON: rows, audit, skipped and summary. A batch is one notebook, some hundred lines."""
    lines = grid_rows(kept).groupBy("batch_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("page_ord", "row_index", "row"))), lambda x: x["row"]).alias("rows"))
    reasons = F.struct("page_ord", "row_index", F.col("page_no").cast("string").alias("page"), "reason")
    dropped = skipped.groupBy("batch_id").agg(
        F.transform(F.sort_array(F.collect_list(reasons)), lambda x: F.struct(x["page"].alias("page"), x["row_index"].alias("index"), x["reason"].alias("reason"))).alias("skipped")
    )
    surveys = assembly.audit_surveys(rows, known_gaps).groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "gap", F.array("previous", "current")))).alias("survey_gaps"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "repeat", F.col("current")))).alias("survey_repeats"),
    )
    twice = assembly.audit_duplicates(rows).groupBy("batch_id").agg(F.sort_array(F.collect_list("meter")).alias("duplicate_meters"))
    spans = assembly.survey_range(rows)
    out = lines.join(dropped, "batch_id", "full").join(surveys, "batch_id", "left").join(twice, "batch_id", "left").join(spans, "batch_id", "left")
    if expected is not None:
        counts = assembly.audit_row_counts(corrected, expected).groupBy("batch_id")
        out = out.join(counts.agg(F.sort_array(F.collect_list(F.struct(F.col("page_no").cast("string").alias("page"), "expected", "emitted"))).alias("row_count_mismatches")), "batch_id", "left")
    else:
        out = out.withColumn("row_count_mismatches", F.lit(None).cast("array<struct<page:string,expected:bigint,emitted:bigint>>"))
    kinds = dict(out.dtypes)
    listed = ["rows", "skipped", "survey_gaps", "survey_repeats", "duplicate_meters", "row_count_mismatches"]
    out = out.withColumns({c: F.coalesce(c, F.array().cast(kinds[c])) for c in listed})
    audit = [F.col(c) for c in listed[2:]]
    clean = F.size(F.concat(*[F.transform(c, lambda x: F.lit(1)) for c in audit])) == 0
    answer = F.struct(
        "rows", F.struct(clean.alias("clean"), *audit).alias("audit"), "skipped",
        F.struct(F.size("rows").alias("row_count"), F.size(F.filter("rows", lambda r: r["needs_review"])).alias("needs_review"), F.array("lowest", "highest").alias("survey_range"), F.size("skipped").alias("skipped")).alias("summary"),
    )
    return out.select("batch_id", F.to_json(answer, {"ignoreNullFields": "false"}).alias("grid"))


def sidecar_rows(corrected: DataFrame) -> DataFrame:
    """The review sheet: batch_id and ten columns, a row for each cell with something to tell. <field>_engines maps engines to readings."""
    columns = corrected.columns
    cells = [
        F.struct(
            F.lit(name).alias("column"), F.col(f"{name}.text").alias("value"), F.coalesce(F.col(f"{name}_raw"), F.lit("")).alias("raw_ocr"),
            (F.bround(f"{name}_conf", 3) if f"{name}_conf" in columns else F.lit(0.0)).alias("confidence"), F.col(f"{name}.status").alias("status"),
            F.array_join(f"{name}.rules", ", ").alias("applied_rules"), F.array_join(f"{name}.candidates", " | ").alias("alternatives"),
            (joined_map(F.col(f"{name}_engines")) if f"{name}_engines" in columns else F.lit("")).alias("engine_outputs"),
        )
        for name in FIELDS
    ]
    rows = corrected.select("batch_id", F.col("page_no").cast("string").alias("page"), F.col("row_index").alias("row"), F.inline(F.array(*cells)))
    return rows.filter(~((F.col("value") == "") & F.col("status").isin("empty", "ok")))


# The metrics of the summary sheet, in order.
METRICS = (
    ("pages", "Pages processed"), ("rows", "Rows exported"), ("review", "Rows flagged for review"), ("corrected", "Rows auto-corrected"),
    ("skipped", "Rows skipped (markers / non-Latin)"), ("gap", "Survey gaps"), ("repeat", "Survey repeats"), ("duplicate", "Duplicate meter codes"),
    ("row_count", "Row-count mismatches"),
)
CLEAN = "Structural audit clean"


def sidecar_summary(corrected: DataFrame, rows: DataFrame, skipped: DataFrame, findings: DataFrame) -> DataFrame:
    """The summary sheet: batch_id, ord, metric, value. findings: batch_id, kind, finding."""
    pages = corrected.groupBy("batch_id").agg(F.count_distinct("page_no").alias("pages"))
    out = rows.groupBy("batch_id").agg(
        F.count("*").alias("rows"), F.count_if(t.needs_review(F.col("status"))).alias("review"), F.count_if(F.col("status") == "corrected").alias("corrected")
    )
    dropped = skipped.groupBy("batch_id").agg(F.count("*").alias("skipped"))
    kinds = [k for k, _ in METRICS[5:]]
    audit = findings.groupBy("batch_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    wide = pages.join(out, "batch_id", "left").join(dropped, "batch_id", "left").join(audit, "batch_id", "left").fillna(0)
    clean = F.when(sum(F.col(k) for k in kinds) == 0, "yes").otherwise("no")
    told = [F.struct(F.lit(i).alias("ord"), F.lit(name).alias("metric"), F.col(k).cast("string").alias("value")) for i, (k, name) in enumerate(METRICS)]
    told.append(F.struct(F.lit(len(METRICS)).alias("ord"), F.lit(CLEAN).alias("metric"), clean.alias("value")))
    return wide.select("batch_id", F.inline(F.array(*told)))


def badge(status: Column) -> Column:
    """The mark a row of the grid carries: review, fixed or ok."""
    return F.when(t.needs_review(status), "review").when(status == "corrected", "fixed").otherwise("ok")


def reindex(rows: DataFrame, page: list[str], order: str) -> DataFrame:
    """Adds row_index anew from 0 on each page; where rows have the statuses of their cells, needs_review is found anew, too."""
    cells = [c for c in ("survey_status", "meter_status", "remarks_status") if c in rows.columns]
    if cells:
        rows = rows.withColumn("needs_review", F.coalesce(*[F.when(t.needs_review(F.col(c)), True) for c in cells], F.lit(False)))
    return rows.withColumn("row_index", (F.row_number().over(Window.partitionBy(*page).orderBy(order)) - 1).cast("long"))
