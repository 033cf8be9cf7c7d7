"""Deliverables: the workbook, the review sidecar, the dictionary and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.functions import fixed, text as t
from fieldledger.operators import review
from fieldledger.sources import xlsx

# Headers of the review sheet; fields of a report in order.
REVIEW_HEADERS = ("Page", "Row", "Column", "Value", "RawOCR", "Confidence", "Status", "AppliedRules", "Alternatives", "EngineOutputs")
FIELD_ORDER = ("meter", "survey", "remarks")


def write_workbook(rows: DataFrame, path: str) -> None:
    """One batch's output rows as a workbook: a null survey is no cell, a numeric remark a number."""
    xlsx.register(rows.sparkSession)
    order = F.row_number().over(Window.partitionBy("batch_id").orderBy("page_ord", "row_index")).cast("long")
    cells = rows.select(order.alias("ord"), "survey", "meter", F.col("remark.text").alias("remarks_text"), F.col("remark.number").cast("long").alias("remarks_num"))
    cells.write.format("xlsx_rows").mode("append").option("path", path).save()


def write_parquet(rows: DataFrame, path: str) -> None:
    """Any number of batches, a folder a batch, rows in order inside."""
    shown = rows.select("batch_id", "page_ord", "row_index", "survey", "meter", t.remark_shown(F.col("remark")).alias("remarks"), t.remark_type(F.col("remark")).alias("remarks_type"), "status")
    shown.repartition("batch_id").sortWithinPartitions("batch_id", "page_ord", "row_index").write.mode("overwrite").partitionBy("batch_id").parquet(path)


def write_sidecar(corrected: DataFrame, rows: DataFrame, skipped: DataFrame, findings: DataFrame, path: str) -> str | None:
    """The review workbook of one batch: its cells, its metrics, findings and skipped lines. Returns the copy kept of an earlier file.

    A batch is one notebook, of some hundred lines; more than one batch is an error.
    """
    batches = [r["batch_id"] for r in corrected.select("batch_id").distinct().limit(2).collect()]
    if len(batches) > 1:
        raise ValueError("a sidecar is of one batch")
    order = rows.select("page_no", "page_ord").unionByName(skipped.select("page_no", "page_ord")).distinct().withColumn("page", F.col("page_no").cast("string"))
    cells = review.sidecar_rows(corrected).join(order.select("page", "page_ord"), "page", "left")
    fields = ("page", "row", "column", "value", "raw_ocr", "confidence", "status", "applied_rules", "alternatives", "engine_outputs")
    place = F.array_position(F.array(*[F.lit(f) for f in review.FIELDS]), F.col("column"))
    shown, fills = [list(REVIEW_HEADERS)], {}
    for r in cells.orderBy("page_ord", "page", "row", place).select(*fields).collect():
        if r["status"] not in fixed.SETTLED:
            fills[len(shown)] = xlsx.FILL_REVIEW
        elif r["status"] == "corrected":
            fills[len(shown)] = xlsx.FILL_CORRECTED
        shown.append(list(r))
    metrics = review.sidecar_summary(corrected, rows, skipped, findings).orderBy("ord").collect()
    told = [["Metric", "Value"], *[[r["metric"], int(r["value"]) if r["value"].isdigit() else r["value"]] for r in metrics], [], ["Audit findings", ""]]
    told += [["", r["finding"]] for r in findings.orderBy("kind", "finding").collect()]
    dropped = skipped.orderBy("page_ord", "row_index").collect()
    if dropped:
        told += [[], ["Skipped lines", ""], *[[f"{r['page_no']} row {r['row_index']}", r["reason"]] for r in dropped]]
    return xlsx.write_sheets(path, [xlsx.Sheet("Review", shown, _widths(shown), fills, 1), xlsx.Sheet("Summary", told, _widths(told))])


def _widths(rows: list[list]) -> list[int]:
    return [min(max(max((len(str(r[c])) for r in rows if c < len(r) and r[c]), default=0) + 2, 10), 60) for c in range(max(map(len, rows)))]


def write_golden(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_labels(crops: DataFrame, folder: str) -> None:
    """Crops (page_id, row_index, column, image, expected) as Parquet with their images, and labels.csv with a name for each."""
    name = F.concat(F.concat_ws("_", "page_id", F.lpad(F.col("row_index").cast("string"), 2, "0"), "column"), F.lit(".png"))
    named = crops.withColumn("crop", name)
    named.select("crop", "image").write.mode("overwrite").parquet(f"{folder}/crops")
    named.select("page_id", "row_index", "column", "crop", "expected").write.mode("overwrite").csv(f"{folder}/labels.csv", header=True)


def write_dictionary(prefixes: DataFrame, path: str) -> None:
    """prefix<TAB>count, by prefix: a small dimension, so one file."""
    prefixes.orderBy("prefix").select(F.concat_ws("\t", "prefix", F.col("count").cast("string")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def report(scores: DataFrame, misses: DataFrame | None = None) -> str:
    """Markdown: for each field a table of its engines, best first, and the sample misses.

    scores: field, engine, cells, raw, corrected, valid, p50, p95, a row an engine and field; misses: engine, field, crop,
    expected, raw, corrected, some examples of each.
    """
    found = scores.orderBy(F.desc("corrected"), "engine").collect()
    fields = [*FIELD_ORDER, *sorted({r["field"] for r in found} - set(FIELD_ORDER))]
    lines = ["# Engine evaluation", ""]
    for name in fields:
        own = [r for r in found if r["field"] == name]
        if own:
            lines += [f"## {name}", "", "| Engine | Cells | Raw | Corrected | Valid | p50 ms | p95 ms |", "|---|---:|---:|---:|---:|---:|---:|"]
            lines += [f"| {r['engine']} | {r['cells']} | {r['raw']:.1f}% | **{r['corrected']:.1f}%** | {r['valid']:.1f}% | {r['p50']:.0f} | {r['p95']:.0f} |" for r in own]
            lines.append("")
    lines += ["## Sample misses", ""]
    if misses is not None:
        last = None
        for r in misses.orderBy("engine", "field", "crop").collect():
            if last != (r["engine"], r["field"]):
                last = (r["engine"], r["field"])
                lines += [f"### {r['engine']} / {r['field']}", "", "| Crop | Expected | Raw | Corrected |", "|---|---|---|---|"]
            lines.append(f"| `{r['crop']}` | `{r['expected']}` | `{r['raw']}` | `{r['corrected']}` |")
    return "\n".join(lines) + "\n"
