"""The notebook view over events: batches of 40 pages of 25 lines, three lines a group, numbered within their batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldledger.session import table

#: Runs on Spark and DuckDB alike.
NB = """
b AS (
  SELECT event_id AS i, CAST(floor(event_id / 25) AS BIGINT) AS page_no, CAST(event_id % 25 AS BIGINT) AS row_index,
         570 + 100 * (CAST(floor(event_id / 1000) AS BIGINT) % 80) + CAST(floor((event_id % 1000) / 3) AS BIGINT) AS sv,
         CASE WHEN event_id % 1000 % 3 = 0 THEN 1 ELSE 0 END AS starts,
         substr('SCOSFESCTSEGPSASFLSCPSFC', CAST(1 + 3 * ((event_id * 7919) % 8) AS INT), 3) AS pfx,
         lpad(CAST((event_id * 104729) % 100000 AS VARCHAR(20)), 5, '0') AS d5, event_id % 11 AS nk, event_id % 13 AS rk
  FROM events),
nb AS (
  SELECT i, concat('b', CAST(CAST(floor(page_no / 40) AS BIGINT) AS VARCHAR(20))) AS batch_id, page_no, row_index, sv, starts, pfx, d5, nk, rk,
         CASE WHEN starts = 1 OR row_index = 0 THEN CAST(sv AS VARCHAR(20)) ELSE '' END AS survey_raw,
         CASE nk WHEN 0 THEN concat('" ', d5) WHEN 1 THEN concat(pfx, ' ', replace(d5, '0', 'O')) WHEN 2 THEN 'No metd'
                 WHEN 3 THEN concat(pfx, ' ', substr(d5, 1, 3), ' ', d5) WHEN 4 THEN concat(pfx, ' ', d5, ' <- ', d5)
                 WHEN 5 THEN concat(pfx, ' 68610 ', d5) ELSE concat(pfx, ' ', d5) END AS meter_raw,
         CASE rk WHEN 0 THEN '+37' WHEN 1 THEN '#37 +24' WHEN 2 THEN '+37 Shop' WHEN 3 THEN '3 Shops' WHEN 4 THEN '"'
                 WHEN 5 THEN 'x - x - x' ELSE '' END AS remarks_raw
  FROM b)
"""

#: As nb, with lines that are marks of a section (nk = 11) and lines without ink (nk = 12), neither at a page's or a group's start.
PAGES = """
np0 AS (
  SELECT *, starts = 0 AND row_index <> 0 AND i % 101 = 50 AS marks, starts = 0 AND row_index <> 0 AND i % 103 = 51 AS void FROM nb),
np AS (
  SELECT i, batch_id, page_no, row_index, sv, starts, pfx, d5, survey_raw, CASE WHEN marks THEN 11 WHEN void THEN 12 ELSE nk END AS nk, CASE WHEN marks OR void THEN 12 ELSE rk END AS rk,
         CASE WHEN marks THEN 'x - x - x' WHEN void THEN '' ELSE meter_raw END AS meter_raw, CASE WHEN marks OR void THEN '' ELSE remarks_raw END AS remarks_raw
  FROM np0)
"""


def nb_sql(spark: SparkSession, sf_dir: str, select: str, **tables: DataFrame) -> DataFrame:
    """A query over nb (and further tables given by name)."""
    return spark.sql(f"WITH {NB.replace('FROM events', 'FROM {events}')}, {PAGES} {select}", events=table(spark, sf_dir, "events"), **tables)


def nb_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb_sql(spark, sf_dir, "SELECT batch_id, page_no, row_index, survey_raw, meter_raw, remarks_raw FROM np")
