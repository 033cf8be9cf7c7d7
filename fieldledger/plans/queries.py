"""Named queries: each operator over the test tables, with an independent SQL version where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.functions import fixed, text as t
from fieldledger.operators import assembly, codes, correction, lookups, review, scoring, signal
from fieldledger.plans.notebook import NB, PAGES, nb_lines, nb_sql
from fieldledger.plans.process import process
from fieldledger.session import table
from fieldledger.sources import grid, replies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, nb: bool = False):
    """Registers a query under its function's name; nb puts the notebook view before the oracle."""

    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH {NB}, {PAGES} {oracle}" if nb else oracle
        return f

    return keep


def listed(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


PREFIX_VALUES = ", ".join(f"('{p}', {n})" for p, n in fixed.PREFIX_COUNTS.items())
DITTO_CLASS = "[\"'’“”„″«»×x*%~,·•]"


# ---------------------------------------------------------------- sources


@query(f"SELECT prefix, CAST(n AS INTEGER) AS count FROM (VALUES {PREFIX_VALUES}) AS v(prefix, n)")
def src_prefix_dim(spark, d):
    return codes.prefix_dim(spark)


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def src_filter_isin(spark, d):
    return table(spark, d, "events").select("event_id", "event_type").filter(F.col("event_type").isin("click", "view", "purchase"))


@query(
    "SELECT doc_id, CASE WHEN r = 1 THEN source ELSE concat(source, '_', CAST(r - 1 AS VARCHAR)) END AS name FROM "
    "(SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)"
)
def dedupe_names(spark, d):
    return grid.unique_names(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "name")


@query(
    "SELECT event_id, CAST(k AS INTEGER) AS row_index, CASE k WHEN 0 THEN CAST(event_id AS VARCHAR) ELSE '' END AS survey, "
    "event_type AS meter, '' AS remarks FROM events, (VALUES (0), (1)) AS v(k)"
)
def json_rows_explode(spark, d):
    e = table(spark, d, "events")
    body = F.concat(
        F.lit('```json\n{"rows": [{"survey": " '), F.col("event_id").cast("string"), F.lit(' ", "meter": "'), "event_type",
        F.lit('", "remarks": null}, 7, {"meter": "'), "event_type", F.lit('"}]}\n```'),
    )
    return replies.reply_rows(e.select("event_id", body.alias("reply")), "reply").drop("reply")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT conv_id, turn, coalesce(nullif(trim(CASE WHEN role = 'system' THEN '  ' ELSE role END), ''), 'default') AS value FROM conversations")
def coalesce_blank(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", grid.first_filled(F.when(F.col("role") == "system", "  ").otherwise(F.col("role")), F.lit("default")).alias("value"))


@query(
    "SELECT conv_id, min(conv_id * 7919 % 1000 * 100 + turn) AS first_seen, count(*) AS n_rows, string_agg(role, '|' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id"
)
def nest_by_page(spark, d):
    placed = table(spark, d, "conversations").withColumn("position", F.col("conv_id") * 7919 % 1000 * 100 + F.col("turn"))
    nested = grid.nest_by_page(placed, "conv_id", "turn", ["role"], "position")
    return nested.select("conv_id", F.col("first").alias("first_seen"), F.size("rows").cast("long").alias("n_rows"), F.array_join(F.transform("rows", lambda r: r["role"]), "|").alias("roles"))


# ---------------------------------------------------------------- scalar rules


@query("SELECT doc_id, trim(regexp_replace(text, '[\\s]+', ' ', 'g')) AS value FROM documents")
def collapse_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", t.collapse(F.col("text")).alias("value"))


@query("SELECT doc_id, regexp_matches(concat(text, CASE WHEN doc_id % 3 = 0 THEN 'سلام' ELSE '' END), '[؀-ۿ]') AS found FROM documents")
def has_non_latin(spark, d):
    marked = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "سلام").otherwise(""))
    return table(spark, d, "documents").select("doc_id", t.has_non_latin(marked).alias("found"))


@query("SELECT doc_id, concat(source, CASE WHEN doc_id % 3 = 0 THEN ' Shop' ELSE '' END) AS value FROM documents")
def strip_non_latin(spark, d):
    marked = F.concat("source", F.when(F.col("doc_id") % 3 == 0, " سلام Shop ").otherwise(""))
    return table(spark, d, "documents").select("doc_id", t.strip_non_latin(marked).alias("value"))


@query("SELECT i, regexp_matches(remarks_raw, '^" + DITTO_CLASS.replace("'", "''") + "{1,2}$') AS found FROM nb", nb=True)
def is_ditto(spark, d):
    return nb_sql(spark, d, "SELECT i, remarks_raw FROM nb").select("i", t.is_ditto(F.col("remarks_raw")).alias("found"))


@query("SELECT i, nk = 0 AS found FROM nb", nb=True)
def is_meter_ditto(spark, d):
    return nb_sql(spark, d, "SELECT i, meter_raw FROM nb").select("i", (t.meter_ditto_digits(F.col("meter_raw")) != "").alias("found"))


@query("SELECT i, nk = 4 AS found FROM nb", nb=True)
def has_pointer(spark, d):
    return nb_sql(spark, d, "SELECT i, meter_raw FROM nb").select("i", t.has_pointer(F.col("meter_raw")).alias("found"))


@query("SELECT i, CASE WHEN nk = 4 THEN concat(pfx, ' ', d5) ELSE meter_raw END AS value FROM nb", nb=True)
def strip_pointer(spark, d):
    return nb_sql(spark, d, "SELECT i, meter_raw FROM nb").select("i", t.strip_pointer(F.col("meter_raw")).alias("value"))


@query("SELECT i, upper(regexp_replace(meter_raw, '[^A-Za-z0-9]', '', 'g')) AS value FROM nb", nb=True)
def normalise_code(spark, d):
    return nb_sql(spark, d, "SELECT i, meter_raw FROM nb").select("i", t.normalise_code(F.col("meter_raw")).alias("value"))


@query("SELECT i, regexp_replace(lower(meter_raw), '[^a-z0-9]+', '', 'g') AS value FROM nb", nb=True)
def token_key(spark, d):
    return nb_sql(spark, d, "SELECT i, meter_raw FROM nb").select("i", t.token_key(F.col("meter_raw")).alias("value"))


@query(
    "SELECT i, regexp_replace(translate(upper(meter_raw), 'ODQUILTJZRBEAVYSGCFP', '00001171228344456679'), '[^0-9\\s]', ' ', 'g') AS value "
    "FROM (SELECT i, replace(replace(meter_raw, 'T', '7'), 't', '7') AS meter_raw FROM nb)",
    nb=True,
)
def coerce_digits(spark, d):
    return nb_sql(spark, d, "SELECT i, meter_raw FROM nb").select("i", t.coerce_digits(F.col("meter_raw")).alias("value"))


@query(
    "SELECT i, CASE WHEN survey_raw = '' THEN '' ELSE concat('KE-', CASE WHEN length(survey_raw) > 4 THEN substr(survey_raw, 1, 4) ELSE survey_raw END) END AS value, "
    "CASE WHEN survey_raw = '' THEN 'empty' ELSE 'ok' END AS status FROM nb",
    nb=True,
)
def correct_survey(spark, d):
    c = t.correct_survey(F.col("survey_raw"))
    return nb_sql(spark, d, "SELECT i, survey_raw FROM nb").select("i", c.alias("c")).select("i", F.col("c.text").alias("value"), "c.status")


@query(
    "SELECT i, CASE WHEN nk IN (3, 4) OR (nk = 5 AND d5 = '68610') THEN d5 END AS digits, nk = 5 AND d5 <> '68610' OR nk = 1 AND len(string_split(trim(replace(d5, '0', ' ')), ' ')) - "
    "len(list_filter(string_split(trim(replace(d5, '0', ' ')), ' '), lambda x: x = '')) > 1 AS ambiguous FROM nb",
    nb=True,
)
def resolve_digits(spark, d):
    r = t.resolve_digits(F.col("meter_raw"))
    return nb_sql(spark, d, "SELECT i, meter_raw FROM nb").select("i", r.alias("r")).select("i", "r.digits", "r.ambiguous")


@query(
    "SELECT i, CASE rk WHEN 0 THEN '-37' WHEN 1 THEN '-37,-24' WHEN 2 THEN '-37' ELSE '' END AS codes, "
    "CASE rk WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'Shop' ELSE remarks_raw END AS residual FROM nb",
    nb=True,
)
def extract_codes(spark, d):
    e = t.extract_codes(F.col("remarks_raw"))
    return nb_sql(spark, d, "SELECT i, remarks_raw FROM nb").select("i", e.alias("e")).select("i", F.array_join("e.codes", ",").alias("codes"), "e.residual")


@query("SELECT i, concat(CAST(i % 10 AS VARCHAR), ' Shops ⑩') AS value FROM nb", nb=True)
def circled_digits(spark, d):
    x = F.concat(F.substring(F.lit(t.CIRCLED), (F.col("i") % 10 + 1).cast("int"), F.lit(1)), F.lit(" Shops ⑩"))
    return nb_sql(spark, d, "SELECT i FROM nb").select("i", t.circled_digits(x).alias("value"))


@query(
    "SELECT i, CASE rk WHEN 0 THEN '-37' WHEN 1 THEN '-37,-24' WHEN 2 THEN '-37,Shop' ELSE nullif(remarks_raw, '') END AS value, "
    "CASE WHEN rk = 0 THEN 'number' WHEN remarks_raw = '' THEN '' ELSE 'text' END AS kind FROM nb",
    nb=True,
)
def format_remarks(spark, d):
    e = nb_sql(spark, d, "SELECT i, remarks_raw FROM nb").withColumn("e", t.extract_codes(F.col("remarks_raw")))
    r = e.withColumn("r", t.format_remarks(F.col("e.residual"), F.col("e.codes")))
    return r.select("i", t.remark_shown(F.col("r")).alias("value"), t.remark_type(F.col("r")).alias("kind"))


@query(
    "SELECT i, CASE WHEN remarks_raw = '' THEN '' WHEN rk = 0 THEN 'text' ELSE 'text' END AS kind, CASE WHEN nk = 2 THEN NULL ELSE CAST(d5 AS BIGINT) END AS number FROM nb",
    nb=True,
)
def remark_type(spark, d):
    rows = nb_sql(spark, d, "SELECT i, remarks_raw, CASE WHEN nk = 2 THEN ' ' ELSE d5 END AS d5 FROM nb")
    return rows.select("i", t.remark_type(t.coerce_remarks(F.col("remarks_raw"))).alias("kind"), t.coerce_remarks(F.col("d5"))["number"].alias("number"))


@query("SELECT i, CASE WHEN nk = 2 THEN NULL WHEN rk = 5 THEN 'x - x - x' ELSE nullif(remarks_raw, '') END AS value FROM nb", nb=True)
def coerce_remarks(spark, d):
    rows = nb_sql(spark, d, "SELECT i, CASE WHEN nk = 2 THEN ' ' ELSE remarks_raw END AS x FROM nb")
    return rows.select("i", t.coerce_remarks(F.col("x"))["text"].alias("value"))


@query("SELECT i, TRY_CAST(regexp_extract(meter_raw, '[0-9]+') AS BIGINT) AS value FROM nb", nb=True)
def survey_number(spark, d):
    return nb_sql(spark, d, "SELECT i, meter_raw FROM nb").select("i", t.survey_number(F.col("meter_raw")).alias("value"))


@query("SELECT i, CASE WHEN nk % 2 = 0 THEN d5 ELSE concat('K', d5) END AS value FROM nb", nb=True)
def proj_strip_prefix(spark, d):
    rows = nb_sql(spark, d, "SELECT i, CASE WHEN nk % 2 = 0 THEN concat('  ke - ', d5) ELSE concat('K', d5) END AS x FROM nb")
    return rows.select("i", t.strip_survey_prefix(F.col("x")).alias("value"))


@query(
    "SELECT i, regexp_replace(meter_raw, '[^0-9]', '', 'g') AS survey, regexp_replace(upper(meter_raw), '[^A-Z0-9]', '', 'g') AS meter, "
    "trim(regexp_replace(meter_raw, '\\s+', ' ', 'g')) AS remarks FROM nb",
    nb=True,
)
def postprocess(spark, d):
    x = F.col("meter_raw")
    return nb_sql(spark, d, "SELECT i, meter_raw FROM nb").select("i", *[t.postprocess(F.lit(f), x).alias(f) for f in ("survey", "meter", "remarks")])


@query(
    "SELECT i, CASE g WHEN 'A' THEN '49' WHEN 'U' THEN '04' WHEN 'T' THEN '71' WHEN 'O' THEN '0' WHEN 'S' THEN '5' WHEN 'C' THEN '60' WHEN 'F' THEN '7' "
    "WHEN 'P' THEN '9' WHEN 'E' THEN '3' WHEN 'L' THEN '1' WHEN 'G' THEN '69' ELSE '' END AS value FROM (SELECT i, substr(pfx, 3, 1) AS g FROM nb)",
    nb=True,
)
def digit_alternatives(spark, d):
    rows = nb_sql(spark, d, "SELECT i, substr(pfx, 3, 1) AS g FROM nb")
    return rows.select("i", F.array_join(t.digit_alternatives(F.col("g")), "").alias("value"))


@query(
    "SELECT i, CASE WHEN c IN (401, 403) THEN 'credentials' WHEN c = 404 THEN 'model' WHEN c = 429 THEN 'rate' ELSE 'other' END AS kind "
    "FROM (SELECT i, 400 + CAST(i % 30 AS INTEGER) AS c FROM nb)",
    nb=True,
)
def classify_error(spark, d):
    return nb_sql(spark, d, "SELECT i, 400 + CAST(i % 30 AS INT) AS c FROM nb").select("i", t.classify_error(F.col("c")).alias("kind"))


@query("SELECT event_id, round(least(greatest(exp(-value / 100), 0.0), 1.0), 9) AS confidence FROM events")
def clamp_exp(spark, d):
    return table(spark, d, "events").select("event_id", F.round(t.clamp_exp(-F.col("value") / 100), 9).alias("confidence"))


@query("SELECT i, concat(CAST(page_no AS VARCHAR), '#', CAST(row_index AS VARCHAR)) AS row_id, i * 8 / 1000.0 AS confidence FROM nb", nb=True)
def proj_row_id(spark, d):
    rows = nb_sql(spark, d, "SELECT i, page_no, row_index FROM nb")
    return rows.select("i", F.concat_ws("#", "page_no", "row_index").alias("row_id"), F.bround(F.col("i") * 8 / F.lit(1000.0), 3).alias("confidence"))


@query("SELECT doc_id, concat('out/', source, '_review.xlsx') AS path FROM documents")
def path_suffix(spark, d):
    return table(spark, d, "documents").select("doc_id", t.suffixed_path(F.concat(F.lit("out/"), "source", F.lit(".xlsx")), "_review").alias("path"))


@query(
    "SELECT i, CASE nk WHEN 0 THEN 'Ditto expanded' WHEN 3 THEN 'Struck-out value dropped' WHEN 5 THEN 'Two readings' ELSE 'rule ' || CAST(nk AS VARCHAR) END AS label FROM nb",
    nb=True,
)
def pretty_rules(spark, d):
    rows = nb_sql(spark, d, "SELECT i, CASE nk WHEN 0 THEN 'ditto_meter' WHEN 3 THEN 'struck_out_correction' WHEN 5 THEN 'ambiguous_correction' ELSE concat('rule_', CAST(nk AS STRING)) END AS rule FROM nb")
    return rows.select("i", review.rule_label(F.col("rule")).alias("label"))


@query("SELECT i, concat(pfx, ' ', d5) AS value FROM nb", nb=True)
def render_code(spark, d):
    return nb_sql(spark, d, "SELECT i, concat(pfx, d5) AS x FROM nb").select("i", t.render_code(F.col("x")).alias("value"))


@query("SELECT i, concat('easy=', pfx, ' | small=', d5) AS value FROM nb", nb=True)
def map_join(spark, d):
    rows = nb_sql(spark, d, "SELECT i, map('easy', pfx, 'small', d5) AS m FROM nb")
    return rows.select("i", review.joined_map(F.col("m")).alias("value"))


@query("SELECT i, concat_ws(',', '-37', CASE WHEN nk <> 3 THEN concat('-', CAST(nk AS VARCHAR)) END) AS value FROM (SELECT i, CASE WHEN nk = 3 THEN 37 ELSE nk END AS nk0, nk FROM nb)", nb=True)
def array_union_codes(spark, d):
    rows = nb_sql(spark, d, "SELECT i, nk FROM nb")
    more = F.array(F.concat(F.lit("-"), F.when(F.col("nk") == 3, 37).otherwise(F.col("nk")).cast("string")))
    return rows.select("i", F.array_join(F.array_union(F.array(F.lit("-37")), more), ",").alias("value"))


@query("SELECT i, CASE WHEN nk = rk THEN concat('a', CAST(nk AS VARCHAR)) ELSE concat('a', CAST(nk AS VARCHAR), ',a', CAST(rk AS VARCHAR)) END AS value FROM nb", nb=True)
def ordered_distinct(spark, d):
    rows = nb_sql(spark, d, "SELECT i, array(concat('a', CAST(nk AS STRING)), concat('a', CAST(rk AS STRING)), concat('a', CAST(nk AS STRING))) AS a FROM nb")
    return rows.select("i", F.array_join(F.array_distinct("a"), ",").alias("value"))


@query("SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS text, min(length(text)) AS least FROM conversations GROUP BY conv_id")
def ordered_concat(spark, d):
    parts = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("p"), F.min(F.length("text")).cast("long").alias("least"))
    return parts.select("conv_id", F.array_join(F.transform("p", lambda x: x["role"]), " ").alias("text"), "least")


# ---------------------------------------------------------------- filters and verdicts


@query("SELECT i, remarks_raw FROM nb WHERE rk = 5", nb=True)
def filter_section_marker(spark, d):
    return nb_sql(spark, d, "SELECT i, remarks_raw FROM nb").filter(t.is_section_marker(F.col("remarks_raw")))


@query("SELECT i, CASE WHEN nk IN (1, 2, 6, 7, 8, 9, 10) AND NOT (nk = 2) AND NOT (nk = 1 AND contains(d5, '0')) THEN pfx END AS prefix, CASE WHEN nk IN (1, 6, 7, 8, 9, 10) AND NOT (nk = 1 AND contains(d5, '0')) THEN d5 END AS digits FROM nb", nb=True)
def parse_meter(spark, d):
    rows = nb_sql(spark, d, "SELECT i, meter_raw FROM nb")
    p = t.parse_code(F.col("meter_raw"))
    return rows.select("i", p["prefix"].alias("prefix"), p["digits"].alias("digits"))


VALID = "regexp_matches(c, '^[A-Z]{2,3}[0-9]{5,6}$') AND regexp_extract(c, '^[A-Z]+') IN (" + listed(fixed.PREFIX_COUNTS) + ")"
CODED = "(SELECT i, CASE WHEN nk = 6 THEN concat('QQQ', d5) ELSE regexp_replace(meter_raw, '[^A-Za-z0-9]', '', 'g') END AS c FROM nb)"


def _coded(spark, d):
    return nb_sql(spark, d, "SELECT i, CASE WHEN nk = 6 THEN concat('QQQ', d5) ELSE regexp_replace(meter_raw, '[^A-Za-z0-9]', '') END AS c FROM nb")


@query(f"SELECT i, c FROM {CODED} WHERE {VALID}", nb=True)
def semi_valid_meter(spark, d):
    return lookups.valid_codes(_coded(spark, d), "c", codes.prefix_dim(spark))


@query(f"SELECT i, c FROM {CODED} WHERE NOT ({VALID})", nb=True)
def anti_invalid_prefix(spark, d):
    return lookups.valid_codes(_coded(spark, d), "c", codes.prefix_dim(spark), valid=False)


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view')")
def filter_isin(spark, d):
    return table(spark, d, "events").select("event_id", "event_type").filter(~F.col("event_type").isin("view"))


@query(
    "SELECT i, CASE WHEN c > 0 AND c < 0.5 AND meter_raw <> '' AND nk <> 5 THEN 'low_confidence' WHEN nk = 5 THEN 'ambiguous' ELSE 'ok' END AS status "
    "FROM (SELECT i, meter_raw, nk, (i % 10) / 10.0 AS c FROM nb)",
    nb=True,
)
def flag_low_confidence(spark, d):
    rows = nb_sql(spark, d, "SELECT i, meter_raw, CASE WHEN nk = 5 THEN 'ambiguous' ELSE 'ok' END AS s, (i % 10) / 10.0D AS c FROM nb")
    return rows.select("i", t.flag_low(F.col("c"), F.col("meter_raw"), F.col("s")).alias("status"))


@query(
    "SELECT i, CASE WHEN nk = 5 OR rk = 4 THEN 'manual_review' WHEN nk IN (0, 1) THEN 'corrected' ELSE 'ok' END AS verdict FROM nb", nb=True
)
def row_verdict(spark, d):
    rows = nb_sql(spark, d, "SELECT i, CASE WHEN nk = 5 THEN 'ambiguous' WHEN nk IN (0, 1) THEN 'corrected' ELSE 'ok' END AS m, CASE rk WHEN 4 THEN 'manual_review' WHEN 6 THEN 'empty' ELSE 'ok' END AS r FROM nb")
    return rows.select("i", t.row_verdict(F.lit("ok"), F.col("m"), F.col("r")).alias("verdict"))


@query(
    "SELECT i, coalesce(least(CASE WHEN nk <> 2 THEN (i % 7) / 7.0 END, CASE WHEN rk < 6 THEN (i % 5) / 5.0 END), 0.0) AS least_conf FROM nb", nb=True
)
def min_confidence(spark, d):
    rows = nb_sql(spark, d, "SELECT i, CASE WHEN nk = 2 THEN '' ELSE 'x' END AS m, remarks_raw AS r, (i % 7) / 7.0D AS mc, (i % 5) / 5.0D AS rc FROM nb")
    return rows.select("i", t.min_confidence((F.col("m"), F.col("mc")), (F.col("r"), F.col("rc"))).alias("least_conf"))


@query("SELECT o.o_custkey AS k, count(*) AS orders, any_value(c_nationkey) AS expected FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1 HAVING count(*) <> any_value(c_nationkey)")
def count_mismatch_filter(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("expected"))
    return lookups.count_mismatches(counts, wanted, "k", "orders", "expected")


@query("SELECT CAST(p AS INTEGER) AS asked, doc_id FROM (VALUES (0, 3), (1, 1), (2, 7), (3, -5)) AS v(p, k) JOIN documents ON doc_id = k")
def subset_join(spark, d):
    return lookups.select_named(table(spark, d, "documents").select("doc_id"), "doc_id", [3, 1, 7, -5]).select("asked", "doc_id")


# ---------------------------------------------------------------- joins


@query(
    "SELECT i, CASE s WHEN 0 THEN 'SCO' WHEN 1 THEN 'SFE' WHEN 2 THEN 'SFL' END AS match, CASE WHEN s = 0 THEN 100.0 WHEN s < 3 THEN CAST(600.0 AS DOUBLE) / (s + 6) END AS score FROM (SELECT i, CAST(i % 4 AS INTEGER) AS s FROM nb)",
    nb=True,
)
def fuzzy_prefix(spark, d):
    rows = nb_sql(spark, d, "SELECT i, CASE i % 4 WHEN 0 THEN 'sco' WHEN 1 THEN 'SFEX ' WHEN 2 THEN 'XSFLX' ELSE 'QQQQQ' END AS p FROM nb")
    return lookups.fuzzy_prefix(rows, "p", 70.0).select("i", F.col("match.prefix").alias("match"), "match.score")


@query(
    "SELECT i, CASE nk WHEN 2 THEN 'NoMeter' WHEN 3 THEN 'EmptyPlot' WHEN 4 THEN 'Plot' END AS output, CASE nk WHEN 2 THEN 2 WHEN 3 THEN 0 WHEN 4 THEN 1 END AS distance FROM nb",
    nb=True,
)
def token_match(spark, d):
    rows = nb_sql(spark, d, "SELECT i, CASE nk WHEN 2 THEN 'No metd' WHEN 3 THEN 'Vacant plot' WHEN 4 THEN 'plat' ELSE meter_raw END AS x FROM nb")
    m = codes.match_token(F.col("x"))
    return rows.select("i", m["output"].alias("output"), m["distance"].alias("distance"))


@query(
    "SELECT l_orderkey AS k, l_linenumber AS n, concat('page_', CAST(l_orderkey // 100 AS VARCHAR)) AS id, l_orderkey % 100 AS offset FROM lineitem WHERE l_orderkey BETWEEN 100 AND 999"
)
def range_join_manifest(spark, d):
    spans = spark.range(1, 10).select(F.concat(F.lit("page_"), F.col("id").cast("string")).alias("id"), (F.col("id") * 100).alias("first_row"), (F.col("id") * 100 + 99).alias("last_row"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    return lookups.interval_join(rows, "k", spans)


@query("SELECT conv_id, turn, role AS expected, CASE WHEN turn = 3 THEN 'user' ELSE role END AS produced FROM conversations WHERE turn = 3 AND role <> 'user'")
def zip_compare(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("expected"))
    made = c.select("conv_id", "turn", F.when(F.col("turn") == 3, "user").otherwise(F.col("expected")).alias("produced"))
    return c.join(made, ["conv_id", "turn"]).filter(~F.col("expected").eqNullSafe(F.col("produced")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 20 = 0 THEN 99 ELSE c_nationkey END AS c_nationkey FROM customer")
def override_coalesce(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    changes = base.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.when(F.col("c_custkey") % 20 == 0, 99).cast("int").alias("c_nationkey"))
    return lookups.override(base, changes, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query(
    "SELECT conv_id, score, a, b FROM (SELECT p.conv_id, length(p.text) + length(q.text) AS score, p.turn AS a, q.turn AS b, "
    "row_number() OVER (PARTITION BY p.conv_id ORDER BY length(p.text) + length(q.text), p.turn, q.turn) AS r "
    "FROM conversations p JOIN conversations q ON p.conv_id = q.conv_id AND q.turn - p.turn >= 2) WHERE r = 1"
)
def pair_argmin(spark, d):
    points = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("pos"), F.length("text").cast("long").alias("score")))).alias("p"))
    best = signal.best_pair(F.col("p"), 2)
    return points.select("conv_id", best.alias("x")).filter("x IS NOT NULL").select("conv_id", "x.score", "x.a", "x.b")


@query(
    "SELECT page_no, cost, offset_at FROM (SELECT page_no, o AS offset_at, CAST(sum(least((x - o + 70) % 7, (o - x + 100003 * 7) % 7)) AS BIGINT) AS cost, "
    "row_number() OVER (PARTITION BY page_no ORDER BY sum(least((x - o + 70) % 7, (o - x + 100003 * 7) % 7)), o) AS r "
    "FROM (SELECT page_no, (i * 13) % 101 AS x FROM nb), (SELECT unnest(range(7)) AS o) GROUP BY page_no, o) WHERE r = 1",
    nb=True,
)
def phase_argmin(spark, d):
    rows = nb_sql(spark, d, "SELECT page_no, collect_list((i * 13) % 101) AS xs FROM nb GROUP BY page_no")
    best = signal.best_phase(F.col("xs"), 7)
    return rows.select("page_no", best.alias("b")).select("page_no", F.col("b.cost").cast("long").alias("cost"), F.col("b.offset").cast("long").alias("offset_at"))


@query("SELECT DISTINCT part, whole FROM (SELECT substr(prefix, 1, CAST(k AS BIGINT)) AS part, max(k = length(prefix)) OVER (PARTITION BY substr(prefix, 1, CAST(k AS BIGINT))) AS whole "
       f"FROM (SELECT prefix FROM (VALUES {PREFIX_VALUES}) AS v(prefix, n)), (VALUES (1), (2), (3)) AS w(k) WHERE k <= length(prefix))")  # fmt: skip
def prefix_trie(spark, d):
    return lookups.code_prefixes(codes.prefix_dim(spark))


@query(
    "SELECT i, CASE WHEN s = 0 THEN 'letter' WHEN s = 1 THEN 'letter' WHEN s = 2 THEN 'letter_or_digit' WHEN s = 3 THEN 'digit' WHEN s < 8 THEN 'digit' ELSE 'digit_or_end' END AS allowed "
    "FROM (SELECT i, CAST(i % 9 AS INTEGER) AS s FROM nb)",
    nb=True,
)
def grammar_accept(spark, d):
    rows = nb_sql(spark, d, "SELECT i, substr(concat(pfx, d5), 1, CAST(i % 9 AS INT)) AS p FROM nb")
    known = F.array(*[F.lit(x) for x in sorted({p[:k] for p in fixed.PREFIX_COUNTS for k in range(1, len(p) + 1)})])
    return rows.select("i", lookups.next_allowed(F.col("p"), known).alias("allowed"))


# ---------------------------------------------------------------- aggregates



@query("SELECT CASE WHEN nk > 5 OR nk = 1 AND NOT contains(d5, '0') THEN pfx END AS prefix, count(*) AS n FROM nb GROUP BY 1", nb=True)
def prefix_counts(spark, d):
    rows = nb_sql(spark, d, "SELECT meter_raw FROM nb")
    return rows.groupBy(t.parse_code(F.col("meter_raw"))["prefix"].alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT CAST(length(regexp_replace(meter_raw, '[^0-9]', '', 'g')) AS INTEGER) AS digits, count(*) AS n FROM nb GROUP BY 1", nb=True)
def digit_len_hist(spark, d):
    rows = nb_sql(spark, d, "SELECT meter_raw FROM nb")
    return rows.groupBy(F.length(F.regexp_replace("meter_raw", "[^0-9]", "")).alias("digits")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) < 9")
def rare_prefixes(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n < 9")


@query("SELECT meter_raw, count(*) AS n FROM nb WHERE nk IN (2, 5) GROUP BY 1", nb=True)
def anomalies(spark, d):
    rows = nb_sql(spark, d, "SELECT meter_raw FROM nb")
    return rows.filter(t.parse_code(F.col("meter_raw")).isNull() & ~t.has_pointer(F.col("meter_raw")) & ~F.col("meter_raw").rlike("^\"| [0-9]*O|^[A-Z]+ [0-9]{3} ")).groupBy("meter_raw").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "meter_raw")


@query("SELECT batch_id, concat(pfx, lpad(CAST(CAST(d5 AS INTEGER) % 50 AS VARCHAR), 5, '0')) AS meter, count(*) AS n FROM nb WHERE nk > 5 GROUP BY 1, 2 HAVING count(*) > 1", nb=True)
def audit_duplicates(spark, d):
    rows = nb_sql(spark, d, "SELECT batch_id, CASE WHEN nk > 5 THEN concat(pfx, lpad(CAST(CAST(d5 AS INT) % 50 AS STRING), 5, '0')) ELSE 'NoMeter' END AS meter FROM nb")
    return assembly.audit_duplicates(rows)


@query("SELECT batch_id, page_no, 20 AS expected, count(*) FILTER (nk <> 2) AS emitted FROM nb GROUP BY 1, 2 HAVING count(*) FILTER (nk <> 2) <> 20", nb=True)
def audit_row_counts(spark, d):
    rows = nb_sql(spark, d, "SELECT batch_id, page_no, named_struct('text', CASE WHEN nk = 2 THEN '' ELSE meter_raw END) AS meter FROM nb")
    return assembly.audit_row_counts(rows, rows.select("batch_id", "page_no", F.lit(20).alias("detected_rules")).distinct())


@query("SELECT batch_id, min(sv) AS lowest, max(sv) AS highest FROM nb GROUP BY 1", nb=True)
def survey_range(spark, d):
    return assembly.survey_range(nb_sql(spark, d, "SELECT batch_id, concat('KE-', CAST(sv AS STRING)) AS survey FROM nb"))


@query("SELECT conv_id, string_agg(role, ', ' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def group_listagg(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.expr("listagg(role, ', ') WITHIN GROUP (ORDER BY turn)").alias("roles"))


@query(
    "SELECT lang, count(*) AS total, count(*) FILTER (quality = 1) AS raw_hits, count(*) FILTER (toxic = 1) AS corrected_hits, count(*) FILTER (n_chars > 1000) AS valid, "
    "100.0 * count(*) FILTER (toxic = 1) / count(*) AS corrected_rate FROM labels JOIN documents USING (doc_id) GROUP BY lang"
)
def score_by_field(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return scoring.score_by_field(both.withColumn("one", F.lit(1)).withColumn("long", F.col("n_chars") > 1000), ["lang"], "quality", "toxic", "one", "long")


@query("SELECT lang, 100.0 * avg(toxic) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def rank_engines(spark, d):
    return score_by_field(spark, d).select("lang", F.col("corrected_rate").alias("rate")).orderBy(F.desc("rate"), "lang")


@query(
    "SELECT event_type, median(value) AS p50, list_sort(list(value))[CAST(least(count(value) - 1, floor(count(value) * 0.95)) AS BIGINT) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type"
)
def latency_percentiles(spark, d):
    return scoring.latencies(table(spark, d, "events"), ["event_type"], "value")


@query(
    "SELECT p_brand, count(*) AS pages, count(*) FILTER (p_size % 2 = p_partkey % 2) AS side_hits, count(*) FILTER (p_size = 25) AS exact, "
    "count(*) FILTER (abs(p_size - 25) <= 2) AS within_two, avg(abs(p_size - 25)) AS mean_error FROM part GROUP BY p_brand"
)
def segmentation_score(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_size", F.lit(25).alias("want"), (F.col("p_size") % 2).alias("a"), (F.col("p_partkey") % 2).alias("b"))
    return scoring.segmentation_score(p, ["p_brand"], "want", "p_size", "a", "b")


@query("SELECT col AS column, CAST(least(greatest(n + 2, 10), 60) AS INTEGER) AS width FROM (SELECT 'p_name' AS col, max(length(p_name)) AS n FROM part UNION ALL SELECT 'p_brand', max(length(p_brand)) FROM part UNION ALL SELECT 'p_size', max(length(CAST(p_size AS VARCHAR))) FROM part)")
def autosize(spark, d):
    return review.column_widths(table(spark, d, "part"), ["p_name", "p_brand", "p_size"])


@query("SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS DOUBLE) / sum(length(text)) OVER (PARTITION BY conv_id) AS share FROM conversations")
def cumulative_share(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return signal.cumulative_share(c, "conv_id", "turn", "n").select("conv_id", "turn", "share")


# ---------------------------------------------------------------- windows

#: Letters O for zeros leave one run of digits, or none, where all other digits stand together; two of them are repaired.
ONE_RUN, ZEROS = "regexp_matches(d5, '^0*[1-9]*0*$')", "(5 - length(replace(d5, '0', '')))"
READABLE = f"(nk IN (3, 4, 6, 7, 8, 9, 10) OR nk = 5 AND d5 = '68610' OR nk = 1 AND {ONE_RUN} AND {ZEROS} <= 2)"
FILL = f"last_value(CASE WHEN {READABLE} THEN pfx END IGNORE NULLS) OVER (PARTITION BY page_no ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("SELECT i, CASE WHEN f IS NULL THEN meter_raw ELSE concat(f, d5) END AS meter, CASE WHEN f IS NULL THEN 'manual_review' ELSE 'corrected' END AS status "
       f"FROM (SELECT *, {FILL} AS f FROM nb) WHERE nk = 0", nb=True)  # fmt: skip
def ditto_meter(spark, d):
    rows = nb_sql(spark, d, "SELECT i, batch_id, page_no, row_index, meter_raw, nk FROM nb")
    out = correction.fill_meters(rows).filter("nk = 0")
    return out.select("i", F.col("meter.text").alias("meter"), "meter.status")


REMARK_FILL = "last_value(CASE rk WHEN 2 THEN 'Shop' WHEN 3 THEN '3 Shops' END IGNORE NULLS) OVER (PARTITION BY page_no ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"SELECT i, coalesce(f, '\"') AS remark, CASE WHEN f IS NULL THEN 'manual_review' ELSE 'corrected' END AS status FROM (SELECT *, {REMARK_FILL} AS f FROM nb) WHERE rk = 4", nb=True)
def ditto_remark(spark, d):
    rows = nb_sql(spark, d, "SELECT i, batch_id, page_no, row_index, remarks_raw, rk FROM nb")
    out = correction.correct_remarks(rows).filter("rk = 4")
    return out.select("i", F.col("remarks.text").alias("remark"), "remarks.status")


def _grouped(spark, d, extra="TRUE"):
    rows = nb_sql(spark, d, f"SELECT i, batch_id, page_no AS page_ord, row_index, survey_raw FROM nb WHERE {extra}")
    survey = F.when(F.col("survey_raw") != "", F.concat(F.lit("KE-"), "survey_raw"))
    return assembly.assign_groups(rows.withColumn("group_survey", survey).withColumn("is_group_first", survey.isNotNull()))


@query(
    "SELECT i, sv - min(sv) OVER (PARTITION BY batch_id) AS group_id, row_number() OVER (PARTITION BY batch_id, sv ORDER BY i) = 1 AS opens, concat('KE-', CAST(sv AS VARCHAR)) AS governing FROM nb",
    nb=True,
)
def assign_groups(spark, d):
    return _grouped(spark, d).select("i", "group_id", "opens", "governing")


GAPPED = "(SELECT batch_id, sv, lag(sv) OVER (PARTITION BY batch_id ORDER BY sv) AS p FROM (SELECT DISTINCT batch_id, sv FROM nb WHERE sv % 17 <> 0))"


@query(f"SELECT batch_id, p AS previous, sv AS current FROM {GAPPED} WHERE sv <> p + 1", nb=True)
def audit_gaps(spark, d):
    rows = nb_sql(spark, d, "SELECT DISTINCT batch_id, sv AS page_ord, 0 AS row_index, concat('KE-', CAST(sv AS STRING)) AS survey FROM nb WHERE sv % 17 <> 0")
    return assembly.audit_surveys(rows).filter("kind = 'gap'").select("batch_id", "previous", "current")


@query("SELECT batch_id, sv AS current FROM (SELECT batch_id, sv, page_no, lag(sv) OVER (PARTITION BY batch_id ORDER BY -page_no, row_index) AS p FROM nb) WHERE sv <= p", nb=True)
def audit_repeats(spark, d):
    rows = nb_sql(spark, d, "SELECT batch_id, -page_no AS page_ord, row_index, concat('KE-', CAST(sv AS STRING)) AS survey FROM nb")
    return assembly.audit_surveys(rows).filter("kind = 'repeat'").select("batch_id", "current")


@query("SELECT batch_id, sv, concat('survey gap: KE-', CAST(p AS VARCHAR), ' -> KE-', CAST(sv AS VARCHAR), ' (', CAST(sv - p - 1 AS VARCHAR), ' number', CASE WHEN sv - p - 1 <> 1 THEN 's' ELSE '' END, "
       f"' missing; a page may not have been photographed)') AS finding FROM {GAPPED} WHERE sv > p + 1", nb=True)  # fmt: skip
def describe_audit(spark, d):
    rows = nb_sql(spark, d, "SELECT DISTINCT batch_id, sv AS page_ord, 0 AS row_index, concat('KE-', CAST(sv AS STRING)) AS survey, '' AS meter FROM nb WHERE sv % 17 <> 0")
    found = assembly.audit_all(rows).filter("kind = 'gap'")
    return found.select("batch_id", F.regexp_extract("finding", "-> KE-([0-9]+)", 1).try_cast("long").alias("sv"), "finding")


@query("SELECT page_no, CASE WHEN f > p + 1 THEN 'gap' ELSE 'overlap' END AS kind FROM (SELECT page_no, f, lag(l) OVER (PARTITION BY 1 ORDER BY page_no) AS p FROM "
       "(SELECT page_no, min(i) + CASE WHEN page_no % 7 = 3 THEN 1 WHEN page_no % 7 = 5 THEN -1 ELSE 0 END AS f, max(i) AS l FROM nb GROUP BY page_no)) WHERE f <> p + 1", nb=True)  # fmt: skip
def tiling_check(spark, d):
    spans = nb_sql(spark, d, "SELECT page_no, min(i) + CASE WHEN page_no % 7 = 3 THEN 1 WHEN page_no % 7 = 5 THEN -1 ELSE 0 END AS f, max(i) AS l FROM nb GROUP BY page_no")
    after = spans.select((F.col("page_no") + 1).alias("page_no"), F.col("l").alias("p"))
    return spans.join(after, "page_no").filter("f <> p + 1").select("page_no", F.when(F.col("f") > F.col("p") + 1, "gap").otherwise("overlap").alias("kind"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r = 1")
def first_per_group(spark, d):
    first = table(spark, d, "conversations").groupBy("conv_id").agg(F.min(F.struct("turn", "role")).alias("f"))
    return first.select("conv_id", "f.turn", "f.role")


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) AS r FROM events) WHERE r <= 12")
def top_n_per_group(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc_nulls_last("value"), "event_id")
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).filter("r <= 12").select("event_type", "event_id", "value")


@query("SELECT page_no, min(row_index) AS first, max(row_index) AS last, count(*) AS n, CAST(sum(nk) AS BIGINT) AS total FROM "
       "(SELECT page_no, row_index, nk, row_index - row_number() OVER (PARTITION BY page_no ORDER BY row_index) AS g FROM nb WHERE nk >= 4) GROUP BY page_no, g HAVING count(*) >= 3", nb=True)  # fmt: skip
def islands_min_len(spark, d):
    return signal.runs_above(nb_sql(spark, d, "SELECT page_no, row_index, nk FROM nb"), "page_no", "row_index", "nk", 4, 3)


@query("SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM "
       "(SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CASE WHEN CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) > 86400 THEN 1 ELSE 0 END AS g FROM events)) GROUP BY user_id, s")  # fmt: skip
def bridge_gaps(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_timestamp("ts").alias("a"), F.unix_timestamp("ts").alias("z"))
    return signal.bridge(e, "user_id", "a", "z", 86400)


@query("SELECT i, CASE WHEN nk < 4 THEN 1 ELSE 2 END AS n, CASE WHEN nk < 4 THEN (nk / 2.0 + nk + 4) / 2 WHEN nk < 6 THEN nk + 4.0 ELSE nk + 2.0 END AS last FROM (SELECT i, CAST(nk AS DOUBLE) AS nk FROM nb)", nb=True)
def merge_close(spark, d):
    rows = nb_sql(spark, d, "SELECT i, array(0.0D, CAST(nk AS DOUBLE), CAST(nk + 4 AS DOUBLE)) AS p FROM nb")
    m = signal.merge_close(F.col("p"), 6.0)
    return rows.select("i", m.alias("m")).select("i", F.size("m").alias("n"), F.element_at("m", -1).alias("last"))


@query("SELECT page_no, CASE WHEN median(g) IS NULL OR median(g) = 0 THEN 1.0 ELSE CAST(median(g) AS DOUBLE) END AS pitch FROM (SELECT page_no, row_index * row_index - lag(row_index * row_index) OVER (PARTITION BY page_no ORDER BY row_index) AS g FROM nb WHERE nk > 4) GROUP BY page_no", nb=True)
def median_pitch(spark, d):
    rows = nb_sql(spark, d, "SELECT page_no, sort_array(collect_list(row_index * row_index)) AS p FROM nb WHERE nk > 4 GROUP BY page_no")
    return rows.select("page_no", signal.median_pitch(F.col("p")).alias("pitch"))


@query("SELECT page_no, first, last, total FROM (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY total DESC, first) AS r FROM (SELECT page_no, min(row_index) AS first, max(row_index) AS last, CAST(sum(nk) AS BIGINT) AS total FROM "
       "(SELECT page_no, row_index, nk, sum(g) OVER (PARTITION BY page_no ORDER BY row_index) AS s FROM (SELECT page_no, row_index, nk, CASE WHEN row_index - lag(row_index) OVER (PARTITION BY page_no ORDER BY row_index) > 3 THEN 1 ELSE 0 END AS g "
       "FROM nb WHERE nk > 7)) GROUP BY page_no, s)) WHERE r = 1", nb=True)  # fmt: skip
def max_sum_run(spark, d):
    runs = nb_sql(spark, d, "SELECT page_no, row_index AS a, row_index AS z, CAST(nk AS BIGINT) AS nk FROM nb WHERE nk > 7")
    return signal.best_run(runs, "page_no", "a", "z", "nk", 3)


@query("SELECT page_no, row_index, CASE WHEN (a >= b AND a <= c) OR (a <= b AND a >= c) THEN a WHEN (b >= a AND b <= c) OR (b <= a AND b >= c) THEN b ELSE c END AS blurred FROM "
       "(SELECT page_no, row_index, nk AS b, coalesce(lag(nk) OVER w, nk) AS a, coalesce(lead(nk) OVER w, nk) AS c FROM nb WINDOW w AS (PARTITION BY page_no ORDER BY row_index))", nb=True)  # fmt: skip
def median_blur(spark, d):
    rows = nb_sql(spark, d, "SELECT page_no, row_index, nk FROM nb")
    return signal.median_blur(rows, "page_no", "row_index", "nk", 3).select("page_no", "row_index", "blurred")


@query("SELECT i, CAST(sv AS VARCHAR) AS survey_raw FROM nb", nb=True)
def continuation_fill(spark, d):
    rows = nb_sql(spark, d, "SELECT i, batch_id, page_no, row_index, survey_raw FROM nb")
    return signal.fill_forward(rows, "batch_id", ["page_no", "row_index"], "survey_raw").select("i", "survey_raw")


@query("SELECT page_no, CAST(CASE WHEN k = 0 THEN x ELSE x + 2 * k END AS DOUBLE) AS pos, k > 0 AS added FROM (SELECT page_no, x, unnest(range(CASE WHEN g % 2 = 0 AND g / 2 BETWEEN 2 AND 6 THEN g // 2 ELSE 1 END)) AS k "
       "FROM (SELECT page_no, row_index * 2 AS x, coalesce(lead(row_index) OVER (PARTITION BY page_no ORDER BY row_index) - row_index, 0) * 2 AS g FROM nb WHERE nk > 6))", nb=True)  # fmt: skip
def gap_fill(spark, d):
    rows = nb_sql(spark, d, "SELECT page_no, CAST(row_index * 2 AS DOUBLE) AS x FROM nb WHERE nk > 6")
    return signal.fill_gaps(rows, "page_no", "x", 2.0)


@query("SELECT page_no, row_index, CASE WHEN m > 0 THEN nk / CAST(m AS DOUBLE) ELSE 1.0 END AS score FROM (SELECT page_no, row_index, nk, greatest(coalesce(max(nk) OVER (PARTITION BY page_no ORDER BY row_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0), "
       "coalesce(max(nk) OVER (PARTITION BY page_no ORDER BY row_index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 0)) AS m FROM nb)", nb=True)  # fmt: skip
def valley_score(spark, d):
    rows = nb_sql(spark, d, "SELECT page_no, row_index, nk FROM nb")
    return signal.valley_scores(rows, "page_no", "row_index", "nk", 3).select("page_no", "row_index", "score")


@query("SELECT page_no, i, row_number() OVER (PARTITION BY page_no ORDER BY i) - 1 AS row_index FROM nb WHERE nk <> 2", nb=True)
def reindex_rows(spark, d):
    return review.reindex(nb_sql(spark, d, "SELECT page_no, i FROM nb WHERE nk <> 2"), ["page_no"], "i")


# ---------------------------------------------------------------- set operations


@query("SELECT conv_id AS k, 'a' AS side FROM conversations UNION ALL SELECT doc_id, 'b' FROM documents")
def union_all_pages(spark, d):
    a = table(spark, d, "conversations").select(F.col("conv_id").alias("k"), F.lit("a").alias("side"))
    return a.unionByName(table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.lit("b").alias("side")))


@query("SELECT 'left' AS side, c_custkey, c_mktsegment FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT 'right', c_custkey, 'X' FROM customer WHERE c_custkey % 9 = 0")
def golden_except(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return lookups.differences(c, c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 9 == 0, "X").otherwise(F.col("c_mktsegment"))))


# ---------------------------------------------------------------- composites

METER_SQL = f"""
m AS (SELECT *, {FILL} AS f FROM np),
mt AS (SELECT *, CASE WHEN nk IN (11, 12) THEN '' WHEN nk = 0 AND f IS NULL THEN meter_raw WHEN nk = 0 THEN concat(f, d5) WHEN nk = 2 THEN 'NoMeter' WHEN {READABLE} THEN concat(pfx, d5)
             WHEN nk = 1 AND {ONE_RUN} THEN concat(pfx, replace(d5, '0', 'O')) ELSE meter_raw END AS meter,
             CASE WHEN nk = 11 THEN 'skipped' WHEN nk = 12 THEN 'empty' WHEN nk = 0 AND f IS NULL THEN 'manual_review' WHEN nk IN (0, 2, 3, 4) THEN 'corrected' WHEN nk = 1 AND NOT contains(d5, '0') OR nk > 5 THEN 'ok'
                  WHEN {READABLE} THEN 'corrected' WHEN nk = 1 AND {ONE_RUN} THEN 'invalid_format' ELSE 'ambiguous' END AS ms
       FROM m),
rt AS (SELECT *, {REMARK_FILL} AS rf FROM mt),
rr AS (SELECT *, CASE rk WHEN 2 THEN 'Shop' WHEN 3 THEN '3 Shops' WHEN 4 THEN coalesce(rf, '"') ELSE '' END AS remark,
              CASE rk WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'ok' WHEN 3 THEN 'ok' WHEN 4 THEN CASE WHEN rf IS NULL THEN 'manual_review' ELSE 'corrected' END WHEN 5 THEN 'skipped' ELSE 'empty' END AS rs,
              CASE rk WHEN 0 THEN '-37' WHEN 1 THEN '-37,-24' WHEN 2 THEN '-37' ELSE '' END AS codes FROM rt)"""
REVIEWED = "('manual_review', 'ambiguous', 'invalid_format')"


def _lines(spark, d):
    return nb_sql(spark, d, "SELECT i, batch_id, page_no, row_index, survey_raw, meter_raw, remarks_raw FROM np")


@query(f", {METER_SQL.strip()} SELECT i, meter, ms AS status FROM mt", nb=True)
def correct_meter(spark, d):
    out = correction.fill_meters(_lines(spark, d))
    return out.select("i", F.col("meter.text").alias("meter"), "meter.status")


@query(f", {METER_SQL.strip()} SELECT i, remark, rs AS status, codes FROM rr", nb=True)
def correct_remarks(spark, d):
    out = correction.correct_remarks(_lines(spark, d))
    return out.select("i", F.col("remarks.text").alias("remark"), "remarks.status", F.array_join("codes", ",").alias("codes"))


@query(f", {METER_SQL.strip()} SELECT i, CASE WHEN survey_raw = '' THEN '' ELSE concat('KE-', survey_raw) END AS survey, meter, remark, codes, survey_raw <> '' AS is_group_first FROM rr", nb=True)
def correct_page(spark, d):
    out = correction.correct_page(_lines(spark, d))
    return out.select("i", F.col("survey.text").alias("survey"), F.col("meter.text").alias("meter"), F.col("remarks.text").alias("remark"), F.array_join("codes", ",").alias("codes"), "is_group_first")


ASSEMBLED = f""", {METER_SQL.strip()},
g AS (SELECT *, row_number() OVER (PARTITION BY batch_id, sv ORDER BY i) = 1 AS opens FROM rr WHERE nk < 11),
bnd AS (SELECT batch_id AS bb, sv AS bsv, string_agg(remark, ', ' ORDER BY i) AS bound, count(*) AS nb_ FROM g WHERE codes = '' AND remark <> '' GROUP BY 1, 2),
o1 AS (SELECT g.*, CASE WHEN codes <> '' THEN remark WHEN opens THEN coalesce(bound, '') ELSE '' END AS txt, opens AND coalesce(nb_, 0) > 1 AS joined FROM g LEFT JOIN bnd ON bb = batch_id AND bsv = sv),
o AS (SELECT *, CASE WHEN ms IN {REVIEWED} OR rs = 'manual_review' OR joined THEN 'manual_review' WHEN ms = 'corrected' OR rs = 'corrected' THEN 'corrected' ELSE 'ok' END AS verdict,
             CASE WHEN codes = '-37' AND txt = '' THEN 'number' WHEN codes <> '' OR txt <> '' THEN 'text' ELSE '' END AS remark_type FROM o1)
"""


@query(f"{ASSEMBLED} SELECT i, CASE WHEN opens THEN concat('KE-', CAST(sv AS VARCHAR)) END AS survey, meter, nullif(concat_ws(',', nullif(codes, ''), nullif(txt, '')), '') AS remark, remark_type, verdict AS status FROM o", nb=True)
def assemble_rows(spark, d):
    rows, _ = assembly.assemble(correction.correct_page(_lines(spark, d)))
    i = (F.col("page_no") * 25 + F.col("row_index")).alias("i")
    return rows.select(i, "survey", "meter", t.remark_shown(F.col("remark")).alias("remark"), t.remark_type(F.col("remark")).alias("remark_type"), "status")


@query(f", {METER_SQL.strip()} SELECT i, CASE nk WHEN 11 THEN 'section marker or non-Latin line' WHEN 12 THEN 'no ink in any column' ELSE 'kept' END AS route FROM rr", nb=True)
def route_kept_skipped(spark, d):
    routed = correction.correct_page(_lines(spark, d)).withColumn("reason", assembly.skip_reason())
    return routed.select("i", F.coalesce("reason", F.lit("kept")).alias("route"))


@query("SELECT batch_id, page_no, row_number() OVER (PARTITION BY batch_id ORDER BY CASE WHEN page_no % 5 = 0 THEN 1 ELSE 0 END, sv, page_no) - 1 AS page_ord FROM (SELECT batch_id, page_no, CASE WHEN page_no % 5 = 0 THEN 0 ELSE -min(sv) + 1000000 END AS sv FROM nb GROUP BY 1, 2)", nb=True)
def order_pages(spark, d):
    rows = nb_sql(spark, d, "SELECT batch_id, page_no, row_index, named_struct('text', CASE WHEN page_no % 5 = 0 THEN '' ELSE concat('KE-', CAST(1000000 - sv AS STRING)) END) AS survey, row_index = 0 AND page_no % 5 <> 0 AS is_group_first FROM nb")
    return assembly.order_pages(rows).select("batch_id", "page_no", "page_ord")


@query(f"{ASSEMBLED} SELECT batch_id, bsv - min(sv) OVER (PARTITION BY batch_id) AS group_id, bound FROM (SELECT batch_id, sv, min(bsv) AS bsv, min(bound) AS bound FROM (SELECT g.batch_id, g.sv, bsv, bound FROM g LEFT JOIN bnd ON bb = batch_id AND bsv = sv) GROUP BY 1, 2) QUALIFY bound IS NOT NULL", nb=True)
def bind_remarks(spark, d):
    rows = nb_sql(spark, d, "SELECT i, batch_id, page_no, page_no AS page_ord, row_index, survey_raw, remarks_raw FROM np WHERE nk < 11")
    survey = F.when(F.col("survey_raw") != "", F.concat(F.lit("KE-"), "survey_raw"))
    cells = correction.correct_remarks(rows).withColumn("group_survey", survey).withColumn("is_group_first", survey.isNotNull())
    bound = assembly.bind_remarks(assembly.assign_groups(cells))
    return bound.filter("first_of_group AND n_bound > 0").select("batch_id", "group_id", "bound")


SKIPPED = "(SELECT batch_id AS sb, count(*) AS skipped FROM np WHERE nk >= 11 GROUP BY 1)"


@query(f"{ASSEMBLED} SELECT batch_id, metric, value FROM (SELECT * EXCLUDE (sb) REPLACE (coalesce(skipped, 0) AS skipped) FROM (SELECT batch_id, count(*) AS rows, count(*) FILTER (opens) AS groups, "
       "count(*) FILTER (verdict = 'manual_review') AS needs_review, count(*) FILTER (verdict = 'corrected') AS corrected, count(*) FILTER (remark_type <> '') AS remarked, "
       f"count(*) FILTER (remark_type = 'number') AS numeric_remarks, count(*) FILTER (remark_type = 'text') AS text_remarks FROM o GROUP BY batch_id) LEFT JOIN {SKIPPED} ON sb = batch_id) "
       "UNPIVOT (value FOR metric IN (rows, groups, needs_review, corrected, remarked, numeric_remarks, text_remarks, skipped))", nb=True)  # fmt: skip
def summary_metrics(spark, d):
    rows, skipped = assembly.assemble(correction.correct_page(_lines(spark, d)))
    return assembly.summary(rows, skipped)


@query(f", {METER_SQL.strip()}, cells AS (SELECT i, 'survey' AS field, CASE WHEN survey_raw = '' THEN '' ELSE concat('KE-', survey_raw) END AS text, CASE WHEN survey_raw = '' THEN 'empty' ELSE 'ok' END AS status FROM rr "
       "UNION ALL SELECT i, 'meter', meter, ms FROM rr UNION ALL SELECT i, 'remarks', remark, rs FROM rr) SELECT * FROM cells WHERE NOT (text = '' AND status IN ('empty', 'ok'))", nb=True)  # fmt: skip
def unpivot_cells(spark, d):
    out = assembly.unpivot_cells(correction.correct_page(_lines(spark, d)))
    return out.select((F.col("page_no") * 25 + F.col("row_index")).alias("i"), "field", "text", "status")


CONFIDENT = "SELECT *, CAST((i % 10) / 10.0D AS DOUBLE) AS meter_conf, 0.9D AS survey_conf, CAST(NULL AS DOUBLE) AS remarks_conf FROM np"


@query(f", {METER_SQL.strip()}, cells AS (SELECT page_no, row_index, 'survey' AS field, CASE WHEN survey_raw = '' THEN '' ELSE concat('KE-', survey_raw) END AS value, survey_raw AS raw_ocr, 0.9 AS confidence, CASE WHEN survey_raw = '' THEN 'empty' ELSE 'ok' END AS status FROM rr "
       "UNION ALL SELECT page_no, row_index, 'meter', meter, meter_raw, (i % 10) / 10.0, CASE WHEN ms IN ('ok', 'corrected') AND i % 10 BETWEEN 1 AND 4 THEN 'low_confidence' ELSE ms END FROM rr "
       "UNION ALL SELECT page_no, row_index, 'remarks', remark, remarks_raw, 0.0, rs FROM rr) "
       "SELECT CAST(page_no AS VARCHAR) AS page, row_index AS row, field AS \"column\", value, raw_ocr, CAST(confidence AS DOUBLE) AS confidence, status FROM cells WHERE NOT (value = '' AND status IN ('empty', 'ok'))", nb=True)  # fmt: skip
def sidecar_rows(spark, d):
    out = review.sidecar_rows(correction.correct_page(nb_sql(spark, d, CONFIDENT)))
    return out.select("page", "row", "column", "value", "raw_ocr", "confidence", "status")


@query(f"{ASSEMBLED}, steps AS (SELECT batch_id, sv, lag(sv) OVER (PARTITION BY batch_id ORDER BY i) AS p FROM o WHERE opens), "
       "twice AS (SELECT batch_id, count(*) AS n FROM (SELECT batch_id, meter FROM o WHERE meter NOT IN ('', 'NoMeter') GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1), "
       "inked AS (SELECT batch_id, page_no, count(*) FILTER (meter <> '') AS emitted FROM rr GROUP BY 1, 2), off AS (SELECT batch_id, count(*) AS n FROM inked WHERE emitted <> 24 GROUP BY 1), "
       "w AS (SELECT batch_id, count(DISTINCT page_no) AS pages FROM rr GROUP BY 1), x AS (SELECT batch_id, count(*) AS n, count(*) FILTER (verdict = 'manual_review') AS review, count(*) FILTER (verdict = 'corrected') AS fixed FROM o GROUP BY 1), "
       "gaps AS (SELECT batch_id, count(*) FILTER (sv > p + 1) AS g, count(*) FILTER (sv <= p) AS r FROM steps GROUP BY 1), "
       f"v AS (SELECT w.batch_id, pages, x.n AS n, review, fixed, coalesce(skipped, 0) AS sk, g, r, coalesce(twice.n, 0) AS dup, coalesce(off.n, 0) AS off FROM w JOIN x USING (batch_id) JOIN gaps USING (batch_id) LEFT JOIN twice USING (batch_id) LEFT JOIN off USING (batch_id) LEFT JOIN {SKIPPED} ON sb = w.batch_id) "
       "SELECT batch_id, CAST(ord AS INTEGER) AS ord, metric, CAST(value AS VARCHAR) AS value FROM v, (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS k(ord), "
       "LATERAL (SELECT CASE ord WHEN 0 THEN 'Pages processed' WHEN 1 THEN 'Rows exported' WHEN 2 THEN 'Rows flagged for review' WHEN 3 THEN 'Rows auto-corrected' WHEN 4 THEN 'Rows skipped (markers / non-Latin)' WHEN 5 THEN 'Survey gaps' "
       "WHEN 6 THEN 'Survey repeats' WHEN 7 THEN 'Duplicate meter codes' WHEN 8 THEN 'Row-count mismatches' ELSE 'Structural audit clean' END AS metric, "
       "CASE ord WHEN 0 THEN CAST(pages AS VARCHAR) WHEN 1 THEN CAST(n AS VARCHAR) WHEN 2 THEN CAST(review AS VARCHAR) WHEN 3 THEN CAST(fixed AS VARCHAR) WHEN 4 THEN CAST(sk AS VARCHAR) WHEN 5 THEN CAST(g AS VARCHAR) "
       "WHEN 6 THEN CAST(r AS VARCHAR) WHEN 7 THEN CAST(dup AS VARCHAR) WHEN 8 THEN CAST(off AS VARCHAR) ELSE CASE WHEN g + r + dup + off = 0 THEN 'yes' ELSE 'no' END END AS value)", nb=True)  # fmt: skip
def sidecar_summary(spark, d):
    done = process(_lines(spark, d).drop("i"), nb_sql(spark, d, "SELECT DISTINCT batch_id, page_no, 24 AS detected_rules FROM np"))
    return review.sidecar_summary(done.corrected, done.rows, done.skipped, done.findings)


@query(f"{ASSEMBLED} SELECT i, CAST(i // 25 AS VARCHAR) || '#' || CAST(row_index AS VARCHAR) AS id, CASE WHEN opens THEN concat('KE-', CAST(sv AS VARCHAR)) ELSE '' END AS survey, meter, "
       f"coalesce(nullif(concat_ws(',', nullif(codes, ''), nullif(txt, '')), ''), '') AS remarks, meter_raw AS raw, ms IN {REVIEWED} OR rs = 'manual_review' AS needs_review FROM o", nb=True)  # fmt: skip
def grid_json(spark, d):
    done = process(_lines(spark, d).drop("i"))
    row = "rows array<struct<id:string,page:string,index:bigint,survey:string,meter:string,remarks:string,cells:struct<meter:struct<raw:string>>,needs_review:boolean>>"
    rows = done.grid().select(F.inline(F.from_json("grid", row)["rows"]))
    return rows.select((F.col("page").cast("long") * 25 + F.col("index")).alias("i"), "id", "survey", "meter", "remarks", F.col("cells.meter.raw").alias("raw"), "needs_review")


@query(f"{ASSEMBLED} SELECT batch_id, count(*) AS row_count, count(*) FILTER (ms IN {REVIEWED} OR rs = 'manual_review') AS needs_review, min(sv) FILTER (opens) AS lowest, max(sv) FILTER (opens) AS highest, any_value(skipped) AS skipped "
       f"FROM o LEFT JOIN {SKIPPED} ON sb = batch_id GROUP BY 1", nb=True)  # fmt: skip
def grid_json_summary(spark, d):
    done = process(_lines(spark, d).drop("i"))
    told = F.from_json("grid", "summary struct<row_count:bigint,needs_review:bigint,survey_range:array<bigint>,skipped:bigint>")["summary"]
    out = done.grid().select("batch_id", told.alias("s"))
    return out.select("batch_id", "s.row_count", "s.needs_review", F.get("s.survey_range", F.lit(0)).alias("lowest"), F.get("s.survey_range", F.lit(1)).alias("highest"), F.nullif("s.skipped", F.lit(0)).alias("skipped"))


@query(f", {METER_SQL.strip()} SELECT i, CASE WHEN ms IN {REVIEWED} THEN 'review' WHEN ms = 'corrected' THEN 'fixed' ELSE 'ok' END AS badge FROM mt", nb=True)
def cell_badge(spark, d):
    return correction.fill_meters(_lines(spark, d)).select("i", review.badge(F.col("meter.status")).alias("badge"))


@query("SELECT i, CASE rk WHEN 2 THEN 'Shop' WHEN 3 THEN '3 Shops' ELSE '' END AS text, CASE rk WHEN 0 THEN '-37' WHEN 1 THEN '-37|-24' WHEN 2 THEN '-37' ELSE '' END AS codes FROM nb", nb=True)
def split_remark(spark, d):
    rows = nb_sql(spark, d, "SELECT i, CASE rk WHEN 0 THEN -37 END AS number, CASE rk WHEN 1 THEN '-37,-24' WHEN 2 THEN '-37,Shop' WHEN 3 THEN '3 Shops' END AS text FROM nb")
    part = t.split_remark(F.struct("text", "number"))
    return rows.select("i", part["text"].alias("text"), F.array_join(part["codes"], "|").alias("codes"))


@query("SELECT batch_id, page_no, concat('[', string_agg(concat('{\"row_index\":', CAST(row_index AS VARCHAR), ',\"survey\":\"', survey_raw, '\",\"meter\":\"', pfx, d5, '\",\"status\":\"ok\"}'), ',' ORDER BY row_index), ']') AS grid FROM nb GROUP BY 1, 2", nb=True)
def grid_to_json(spark, d):
    rows = nb_sql(spark, d, "SELECT batch_id, page_no, row_index, nullif(survey_raw, '') AS survey, concat(pfx, d5) AS meter, 'ok' AS status FROM nb")
    return review.page_json(rows)


@query(f"SELECT batch_id, 'gap' AS kind, count(*) AS n FROM {GAPPED} WHERE sv > p + 1 GROUP BY 1 "
       "UNION ALL SELECT batch_id, 'duplicate', count(*) FROM (SELECT batch_id, sv % 300 AS m FROM (SELECT DISTINCT batch_id, sv FROM nb WHERE sv % 17 <> 0) GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1 "
       "UNION ALL SELECT batch_id, 'row_count', count(*) FROM (SELECT batch_id, page_no, count(*) AS n FROM nb GROUP BY 1, 2) WHERE page_no % 4 <> 3 AND n <> 25 - page_no % 4 GROUP BY 1", nb=True)  # fmt: skip
def audit_all(spark, d):
    rows = nb_sql(spark, d, "SELECT DISTINCT batch_id, sv AS page_ord, 0 AS row_index, concat('KE-', CAST(sv AS STRING)) AS survey, concat('SFT', lpad(CAST(sv % 300 AS STRING), 5, '0')) AS meter FROM nb WHERE sv % 17 <> 0")
    corrected = nb_sql(spark, d, "SELECT batch_id, page_no, named_struct('text', concat(pfx, d5)) AS meter FROM nb")
    expected = nb_sql(spark, d, "SELECT DISTINCT batch_id, page_no, CASE WHEN page_no % 4 = 3 THEN 0 ELSE 25 - page_no % 4 END AS detected_rules FROM nb")
    return assembly.audit_all(rows, corrected, expected).groupBy("batch_id", "kind").agg(F.count("*").alias("n"))


@query(f"SELECT i, CASE WHEN {ZEROS} <= 2 THEN concat(pfx, d5) ELSE '' END AS best, CAST(CASE WHEN {ZEROS} <= 2 THEN {ZEROS} ELSE -1 END AS INTEGER) AS edits FROM nb WHERE nk = 1", nb=True)
def repair_meter(spark, d):
    out = codes.with_repairs(nb_sql(spark, d, "SELECT i, meter_raw FROM nb WHERE nk = 1"), "meter_raw", "found")
    best = F.get("found", F.lit(0))
    return out.select("i", F.coalesce(best["text"], F.lit("")).alias("best"), F.coalesce(best["edits"], F.lit(-1)).alias("edits"))
