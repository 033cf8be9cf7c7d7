"""Correction of pages of readings: survey, meter and remark cells, and the marks that repeat the line above.

lines: batch_id, page_no, row_index, survey_raw, meter_raw, remarks_raw. A page's rows are a few dozen, so the windows by
(batch_id, page_no) are small and many. A repeat mark inherits the last resolved prefix above it. Whether a line passes
on another prefix than it inherits is known only once it is resolved, so the fill is repeated until no inherited prefix
changes: one round where every base prefix is known and every inherited run has five or six digits, a few otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.functions import fixed, text as t
from fieldledger.operators.codes import token_of_raw, with_repairs
from fieldledger.session import materialize

PAGE = ("batch_id", "page_no")
FIELDS = ("survey", "meter", "remarks")


@dataclass(frozen=True)
class Rules:
    """What a run may configure: patterns of section markers, placeholders, and the confidence under which a cell is reviewed."""

    markers: tuple[str, ...] = fixed.SECTION_MARKERS
    tokens: tuple = fixed.PLACEHOLDERS
    token_distance: int = fixed.TOKEN_DISTANCE
    low_confidence: float = 0.5


PLAIN = Rules()

NONE = "array<string>"


def above() -> Window:
    return Window.partitionBy(*PAGE).orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)


def _none() -> Column:
    return F.array().cast(NONE)


def _rules(*named: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(when, name) for when, name in named]), lambda r: r.isNotNull())


def resolve_meters(rows: DataFrame, inherited: str, rules: Rules = PLAIN) -> DataFrame:
    """Adds meter struct<text, status, candidates, rules> for meter_raw, given the inherited prefix (may be null)."""
    raw = t.collapse(F.col("meter_raw"))
    work = rows.withColumn("_raw", raw).withColumn("_marker", t.is_section_marker(F.col("_raw"), rules.markers))
    token = token_of_raw(rules.tokens, rules.token_distance)
    work = work.withColumn("_token", F.when(~F.col("_raw").rlike("(?U)\\d"), token))
    work = work.withColumn("_run", t.meter_ditto_digits(F.col("_raw")))
    ditto = F.col("_run") != ""
    work = work.withColumn("_lost", ditto & F.col(inherited).isNull())
    work = work.withColumn("_code", F.when(ditto & ~F.col("_lost"), F.concat(inherited, "_run")).otherwise(F.col("_raw")))
    work = work.withColumn("_fix", t.resolve_digits(F.col("_code")))
    head = F.left(F.col("_code"), F.position(F.col("_fix.digits"), F.col("_code")) - 1)
    own = F.right(t.normalise_code(F.regexp_replace(head, "(?U)\\d+", "")), F.lit(3))
    hint = F.coalesce(F.when(own != "", own), F.col(inherited), F.lit(""))
    work = work.withColumn("_code2", F.when(F.col("_fix.corrected"), F.concat(hint, F.col("_fix.digits"))).otherwise(F.col("_code")))
    work = with_repairs(work, "_code2", "_found")
    best = F.get("_found", F.lit(0))
    fixed_rules = ((ditto, "ditto_meter"), (F.col("_fix.corrected"), "struck_out_correction"))
    edits = F.when(best["edits"] > 0, F.concat(F.lit("repair_"), best["edits"].cast("string"), F.lit("_edit")))
    applied = F.concat(_rules(*fixed_rules), F.when(edits.isNotNull(), F.array(edits)).otherwise(_none()))
    cell = (
        F.when(F.col("_raw") == "", t._cell(F.lit(""), F.lit("empty"), _none(), _none()))
        .when(F.col("_marker"), t._cell(F.lit(""), F.lit("skipped"), _none(), F.array(F.lit("section_marker"))))
        .when(
            F.col("_token").isNotNull(),
            t._cell(F.col("_token.output"), F.when(F.col("_token.distance") == 0, "ok").otherwise("corrected"), _none(), F.array(F.lit("special_token"))),
        )
        .when(F.col("_lost"), t._cell(F.col("_raw"), F.lit("manual_review"), _none(), F.array(F.lit("ditto_no_prefix"))))
        .when(
            F.col("_fix.ambiguous"),
            t._cell(F.col("_code"), F.lit("ambiguous"), F.col("_fix.candidates"), F.concat(_rules((ditto, "ditto_meter")), F.array(F.lit("ambiguous_correction")))),
        )
        .when(
            F.size("_found") == 0,
            t._cell(
                t.normalise_code(F.col("_code2")),
                F.when(t.parse_code(F.col("_code2")).isNotNull(), "invalid_prefix").otherwise("invalid_format"),
                _none(),
                F.concat(_rules(*fixed_rules), F.array(F.lit("repair_failed"))),
            ),
        )
        .otherwise(
            t._cell(best["text"], F.when(F.size(applied) > 0, "corrected").otherwise("ok"), F.transform(F.slice("_found", 2, fixed.KEPT), lambda r: r["text"]), applied)
        )
    )
    return work.withColumn("meter", cell).drop("_raw", "_marker", "_token", "_run", "_lost", "_code", "_fix", "_code2", "_found")


def observed_prefix(meter_text: Column) -> Column:
    got = F.regexp_extract(F.upper(F.trim(meter_text)), "^([A-Z]{2,3})[0-9]{4,6}$", 1)
    return F.when(got != "", got)


def fill_meters(lines: DataFrame, rules: Rules = PLAIN) -> DataFrame:
    """Adds meter, with repeat marks resolved.

    Every line is resolved once by itself. Lines that inherit are resolved again with the prefix that reaches them, until
    none gets another prefix than before: once where all prefixes are known ones. Only those lines are dealt with again,
    and each round settles at least the first unsettled line of every page, so the rounds end.
    """
    rows = resolve_meters(lines.withColumn("_inherited", F.lit(None).cast("string")).withColumn("_inherits", _inherits()), "_inherited", rules)
    rows = materialize(rows, "meters")
    while True:
        # a line that inherits passes on what it is given until it is resolved itself
        given = F.last(observed_prefix(F.col("meter.text")), ignorenulls=True).over(above())
        told = rows.withColumn("_given", given)
        changed = told.filter(F.col("_inherits") & ~F.col("_given").eqNullSafe(F.col("_inherited")))
        if changed.isEmpty():
            return rows.drop("_inherited", "_inherits")
        again = changed.drop("meter", "_inherited").withColumnRenamed("_given", "_inherited")
        kept = told.filter(~F.col("_inherits") | F.col("_given").eqNullSafe(F.col("_inherited"))).drop("_given")
        rows = materialize(kept.unionByName(resolve_meters(again, "_inherited", rules)), "meters")


def _inherits() -> Column:
    """Lines whose reading depends on the line above: repeat marks, and struck-out runs without letters before them."""
    raw = t.collapse(F.col("meter_raw"))
    return (t.meter_ditto_digits(raw) != "") | raw.rlike("(?U)^[^A-Za-z]*\\d.*\\d")


def correct_remarks(lines: DataFrame, rules: Rules = PLAIN) -> DataFrame:
    """Adds remarks struct<text, status, candidates, rules> and codes array<string>."""
    raw = t.collapse(F.col("remarks_raw"))
    work = lines.withColumn("_raw", raw).withColumn("_marker", t.is_section_marker(F.col("_raw"), rules.markers)).withColumn("_foreign", t.has_non_latin(F.col("_raw")))
    work = work.withColumn("_plain", t.strip_non_latin(F.col("_raw"))).withColumn("_ditto", t.is_ditto(F.col("_plain")))
    base = ~F.col("_marker") & ~F.col("_ditto") & (F.col("_plain") != "")
    kept = t.extract_codes(F.col("_plain"))["residual"]
    seen = F.when(base & (kept != "") & ~t.is_ditto(kept), kept)
    work = work.withColumn("_above", F.last(seen, ignorenulls=True).over(above()))
    lost = F.col("_ditto") & F.col("_above").isNull()
    work = work.withColumn("_split", t.extract_codes(F.when(F.col("_ditto"), F.col("_above")).otherwise(F.col("_plain"))))
    foreign = _rules((F.col("_foreign"), "non_latin_dropped"))
    coded = F.size("_split.codes") > 0
    cell = (
        F.when(F.col("_raw") == "", t._cell(F.lit(""), F.lit("empty"), _none(), _none()))
        .when(F.col("_marker"), t._cell(F.lit(""), F.lit("skipped"), _none(), F.array(F.lit("section_marker"))))
        .when(F.col("_plain") == "", t._cell(F.lit(""), F.lit("skipped"), _none(), foreign))
        .when(lost, t._cell(F.col("_plain"), F.lit("manual_review"), _none(), F.concat(foreign, F.array(F.lit("ditto_no_remark")))))
        .otherwise(
            t._cell(
                F.col("_split.residual"),
                F.when(F.col("_ditto"), "corrected").otherwise("ok"),
                _none(),
                F.concat(foreign, _rules((F.col("_ditto"), "ditto_remark"), (coded, "annotation_extracted"))),
            )
        )
    )
    codes = F.when(base | (F.col("_ditto") & ~lost), F.array_distinct("_split.codes")).otherwise(_none())
    return work.withColumn("remarks", cell).withColumn("codes", codes).drop("_raw", "_marker", "_foreign", "_plain", "_ditto", "_above", "_split")


def flag_low(rows: DataFrame, rules: Rules = PLAIN) -> DataFrame:
    """Cells that are settled but were read with little confidence become low_confidence, with a note; <field>_conf is theirs."""
    for name in FIELDS:
        cell = F.col(name)
        status = t.flag_low(F.col(f"{name}_conf"), cell["text"], cell["status"], rules.low_confidence)
        noted = F.when(status == "low_confidence", F.array_union(cell["rules"], F.array(F.lit("low_confidence")))).otherwise(cell["rules"])
        rows = rows.withColumn(name, t._cell(cell["text"], status, cell["candidates"], noted))
    return rows


def correct_page(lines: DataFrame, rules: Rules = PLAIN) -> DataFrame:
    """All cells of all pages corrected, with codes, group_survey, is_group_first and row_status.

    Where lines have survey_conf, meter_conf or remarks_conf, cells of little confidence are flagged; a null is none.
    """
    known = [f"{name}_conf" for name in FIELDS if f"{name}_conf" in lines.columns]
    if known:
        lines = lines.withColumns({f"{n}_conf": F.coalesce(F.col(f"{n}_conf").cast("double") if f"{n}_conf" in known else F.lit(None), F.lit(0.0)) for n in FIELDS})
    # dealt by batch once: pages, groups and audits all lie inside a batch
    rows = correct_remarks(fill_meters(lines, rules).repartition("batch_id"), rules).withColumn("survey", t.correct_survey(t.strip_survey_prefix(F.col("survey_raw"))))
    skipped = (F.col("meter.status") == "skipped") & F.col("remarks.status").isin("skipped", "empty")
    first = F.col("survey.text") != ""
    rows = (
        rows.withColumn("is_group_first", first)
        .withColumn("group_survey", F.when(first, F.col("survey.text")))
        .withColumn("row_status", F.when(skipped, "skipped").otherwise("ok"))
    )
    return flag_low(rows, rules) if known else rows
