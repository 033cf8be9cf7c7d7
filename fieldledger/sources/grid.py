"""Rows from a grid: file names made unique, settings with fallbacks, rows nested by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.functions import fixed

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds `name`: the given name, with _1, _2 ... after the first of those alike. A name's files are ordered in one task."""
    if name == "name":
        raise ValueError("the input column must not be called name")
    r = F.row_number().over(Window.partitionBy(name).orderBy(order))
    numbered = df.withColumn("_r", r)
    shown = F.when(F.col("_r") == 1, F.col(name)).otherwise(F.concat(name, F.lit("_"), (F.col("_r") - 1).cast("string")))
    return numbered.withColumn("name", shown).drop("_r")


def first_filled(*values: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", F.trim(v)) for v in values])


def nest_by_page(df: DataFrame, page: str, order: str, fields: list[str], position: str | None = None) -> DataFrame:
    """page, first, rows array<struct<order, fields>> in row order; first is where the page first appears in the input.

    position numbers the input's rows; pages come in order of first. Without it, first is the least row number.
    """
    rows = F.sort_array(F.collect_list(F.struct(order, *fields)))
    return df.groupBy(page).agg(F.min(position or order).alias("first"), rows.alias("rows"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of the image files in a folder."""
    pattern = "*.{" + ",".join(s for x in IMAGE_SUFFIXES for s in (x, x.upper())) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def read_labels(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """Crop labels: page_id, row_index, column, crop, expected; only those of the fields asked for."""
    df = spark.read.schema("page_id string, row_index string, column string, crop string, expected string").csv(path, header=True)
    return df.filter(F.col("column").isin(*fields)) if fields else df


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    schema = "page_id string, row_index int, workbook_row int, survey string, meter string, remarks string, remarks_type string, is_group_first string"
    return spark.read.schema(schema).csv(path, header=True)


def golden_pages(golden: DataFrame) -> DataFrame:
    """page_id, first (its first workbook row), rows in order: a golden file by page."""
    return nest_by_page(golden, "page_id", "row_index", ["workbook_row", "survey", "meter", "remarks", "remarks_type", "is_group_first"], "workbook_row")


def expected_values(golden: DataFrame) -> DataFrame:
    """page_id, row_index, column, expected: what each cell should read, a survey without its prefix."""
    bare = F.replace(F.coalesce("survey", F.lit("")), F.lit(fixed.SURVEY_PREFIX), F.lit(""))
    cells = [F.struct(F.lit("survey").alias("column"), bare.alias("expected"))]
    cells += [F.struct(F.lit(c).alias("column"), F.coalesce(c, F.lit("")).alias("expected")) for c in ("meter", "remarks")]
    return golden.select("page_id", "row_index", F.inline(F.array(*cells)))


def check_tiling(spans: DataFrame) -> DataFrame:
    """spans (id, first_row, last_row) as they came; reading them fails where one does not start right after the one before."""
    w = Window.orderBy("first_row")  # a manifest has a row a page
    due = F.lag("last_row").over(w) + 1
    checked = spans.withColumn("_due", due)
    wrong = F.concat(F.lit("span "), F.col("id"), F.lit(" starts at "), F.col("first_row").cast("string"), F.lit(", not at "), F.col("_due").cast("string"))
    fits = F.col("_due").isNull() | (F.col("_due") == F.col("first_row"))
    return checked.withColumn("first_row", F.when(fits, F.col("first_row")).otherwise(F.raise_error(wrong).cast("long"))).drop("_due")


def load_markers(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The patterns of a marker file, in order: lines that are neither blank nor comments (a small file)."""
    lines = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).limit(1).collect()).splitlines()
    return tuple(x.strip() for x in lines if x.strip() and not x.strip().startswith("#"))


def load_tokens(spark: SparkSession, path: str) -> tuple[tuple[tuple[str, tuple[str, ...]], ...], int]:
    """((output, spellings), ...) in declared order and the largest distance, of a placeholder file (a small YAML file)."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).limit(1).collect())
    spec = yaml.safe_load(text) or {}
    tokens = tuple((x["output"], tuple(x.get("variants") or ())) for x in spec.get("tokens", []))
    return tokens, int(spec.get("max_distance", fixed.TOKEN_DISTANCE))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """id, source, surveys, first_row, last_row, continues of a page manifest (a small YAML file, read on the driver)."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).limit(1).collect())
    pages = (yaml.safe_load(text) or {}).get("pages", [])
    rows = [(p["id"], p.get("source"), str(p.get("surveys", "")), int(p["first_row"]), int(p["last_row"]), bool(p.get("continues_previous_group", False))) for p in pages]
    return spark.createDataFrame(rows, "id string, source string, surveys string, first_row long, last_row long, continues boolean")
