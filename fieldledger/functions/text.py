"""Scalar rules as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldledger.functions import fixed

QUOTED = "[" + "".join("\\" + c if not c.isalnum() else c for c in fixed.DITTO_GLYPHS) + "]"
POINTER = "[" + "".join("\\" + c if c in "=>" else c for c in fixed.POINTER_GLYPHS) + "]|<-|->|--+>"
CIRCLED = "⓪①②③④⑤⑥⑦⑧⑨"


def once(value: Column, body) -> Column:
    """body(value) with value worked out once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def collapse(x: Column) -> Column:
    """Trimmed, with each run of (any) white space as one space; a null is empty."""
    return F.regexp_replace(F.regexp_replace(blank(x), "(?U)^\\s+|\\s+$", ""), "(?U)\\s+", " ")


def has_non_latin(x: Column) -> Column:
    return blank(x).rlike(fixed.NON_LATIN)


def strip_non_latin(x: Column) -> Column:
    return collapse(F.regexp_replace(blank(x), fixed.NON_LATIN, " "))


def is_ditto(x: Column) -> Column:
    return collapse(x).rlike(f"^{QUOTED}{{1,2}}$")


def meter_ditto_digits(x: Column) -> Column:
    """The digits after a repeat mark; empty if there is no such mark."""
    mark = QUOTED[:-1] + "\\s]"
    return F.regexp_extract(collapse(x), f"(?U)^{mark}+(\\d{{4,6}})$", 1)


def is_section_marker(x: Column, patterns: tuple[str, ...] = fixed.SECTION_MARKERS) -> Column:
    """Whether a line is a mark of a section, by any of the patterns; without patterns none is."""
    if not patterns:
        return F.lit(False)
    return once(collapse(x), lambda c: (c != "") & c.rlike("(?iU)" + "|".join(f"(?:{m})" for m in patterns)))


def has_pointer(x: Column) -> Column:
    return blank(x).rlike(POINTER)


def strip_pointer(x: Column) -> Column:
    return collapse(F.regexp_replace(collapse(x), f"(?s)(?:{POINTER}).*$", ""))


def normalise_code(x: Column) -> Column:
    return F.upper(F.regexp_replace(blank(x), "[^A-Za-z0-9]", ""))


def token_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(blank(x)), "[^a-z0-9]+", "")


def coerce_digits(x: Column) -> Column:
    """Letters to the digits that they most likely are; other characters to spaces."""
    letters = "".join(fixed.LETTER_AS_DIGITS)
    digits = "".join(d[0] for d in fixed.LETTER_AS_DIGITS.values())
    return F.regexp_replace(F.translate(F.upper(blank(x)), letters, digits), "(?U)[^\\d\\s]", " ")


def parse_code(x: Column, relaxed: bool = True) -> Column:
    """struct<prefix, digits> of a code, or null."""
    pattern = "^([A-Z]{2,3})([0-9]{5" + (",6" if relaxed else "") + "})$"
    return once(
        normalise_code(x),
        lambda c: F.when(
            c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("prefix"), F.regexp_extract(c, pattern, 2).alias("digits"))
        ),
    )


def resolve_digits(x: Column) -> Column:
    """struct<digits, corrected, ambiguous, candidates>: which run of digits survives a correction."""

    def settled(runs: Column) -> Column:
        complete = F.filter(runs, lambda r: F.length(r) >= 5)
        distinct = F.array_distinct(complete)
        none = F.lit(None).cast("string")

        def out(digits, corrected, ambiguous, candidates):
            return F.struct(
                digits.alias("digits"), F.lit(corrected).alias("corrected"), F.lit(ambiguous).alias("ambiguous"), candidates.alias("candidates")
            )

        return (
            F.when(F.size(runs) <= 1, out(none, False, False, complete))
            .when(F.size(distinct) > 1, out(none, False, True, distinct))
            .when(F.size(distinct) == 1, out(F.get(distinct, F.lit(0)), True, False, distinct))
            .otherwise(out(none, False, True, runs))
        )

    return once(F.regexp_extract_all(collapse(x), F.lit("(?U)\\d+"), 0), settled)


def correct_survey(x: Column) -> Column:
    """struct<text, status, candidates, rules> of a survey cell."""

    def built(raw: Column) -> Column:
        def ran(p: Column) -> Column:
            runs, source, raw = p["runs"], p["source"], p["raw"]
            many, confused = F.size(runs) > 1, source != F.upper(raw)
            named = F.transform(F.array_distinct(runs), lambda r: F.concat(F.lit(fixed.SURVEY_PREFIX), r))
            none = F.array().cast("array<string>")
            return (
                F.when(raw == "", _cell(F.lit(""), F.lit("empty"), none, none))
                .when(F.size(runs) == 0, _cell(F.lit(""), F.lit("invalid_format"), none, F.array(F.lit("survey_no_digits"))))
                .otherwise(
                    _cell(
                        F.concat(F.lit(fixed.SURVEY_PREFIX), F.try_element_at(runs, F.lit(-1))),
                        F.when(many | confused, "corrected").otherwise("ok"),
                        F.when(many, named).otherwise(none),
                        F.filter(
                            F.array(F.when(many, "survey_struck_out"), F.when(confused, "survey_char_confusion")), lambda r: r.isNotNull()
                        ),
                    )
                )
            )

        source = coerce_digits(raw)
        return once(F.struct(raw.alias("raw"), source.alias("source"), F.regexp_extract_all(source, F.lit("(?U)\\d{2,4}"), 0).alias("runs")), ran)

    return once(collapse(x), built)


def _cell(text: Column, status: Column, candidates: Column, rules: Column) -> Column:
    return F.struct(text.alias("text"), status.alias("status"), candidates.alias("candidates"), rules.alias("rules"))


def circled_digits(x: Column) -> Column:
    return F.translate(blank(x), CIRCLED, "0123456789")


def extract_codes(x: Column, allow_bare: bool = False, sign: str = fixed.CODE_SIGN) -> Column:
    """struct<codes, residual>: side codes in output form, and what is left."""
    strip = lambda t: F.regexp_replace(t, "^[,;]+|[,;]+$", "")
    pattern = ("^[+#†]?" if allow_bare else "^[+#†]") + "[0-9]{1,4}$"
    is_code = lambda t: strip(t).rlike(pattern)

    def split(parts: Column) -> Column:
        number = lambda t: F.regexp_extract(strip(t), "([0-9]{1,4})$", 1).cast("int").cast("string")
        return F.struct(
            F.transform(F.filter(parts, is_code), lambda t: F.concat(F.lit(sign), number(t))).alias("codes"),
            F.array_join(F.filter(parts, lambda t: ~is_code(t) & (t != "")), " ").alias("residual"),
        )

    return once(F.split(collapse(x), " "), split)


def format_remarks(text: Column, codes: Column) -> Column:
    """struct<text, number>: a lone code is a number; codes and text are joined; neither is null in both."""

    def built(p: Column) -> Column:
        body, codes = p["body"], p["codes"]
        lone = (F.size(codes) == 1) & (body == "")
        joined = F.concat_ws(",", F.concat(codes, F.when(body != "", F.array(body)).otherwise(F.array().cast("array<string>"))))
        return F.struct(
            F.when(~lone & ((F.size(codes) > 0) | (body != "")), joined).alias("text"),
            F.when(lone, F.get(codes, F.lit(0)).cast("int")).alias("number"),
        )

    codes = F.coalesce(codes, F.array().cast("array<string>"))
    return once(F.struct(collapse(circled_digits(text)).alias("body"), codes.alias("codes")), built)


def remark_shown(remark: Column) -> Column:
    return F.coalesce(remark["text"], remark["number"].cast("string"))


def remark_type(remark: Column) -> Column:
    return F.when(remark["number"].isNotNull(), "number").when(remark["text"].isNotNull(), "text").otherwise("")


def coerce_remarks(x: Column) -> Column:
    """Text back to struct<text, number>: blank is null in both, whole numbers are numbers."""
    return once(
        collapse(x),
        lambda c: F.struct(
            F.when((c != "") & ~c.rlike("^-?[0-9]+$"), c).alias("text"), F.when(c.rlike("^-?[0-9]+$"), c.try_cast("bigint")).alias("number")
        ),
    )


def survey_number(x: Column) -> Column:
    """The first run of digits as a number, or null."""
    return F.regexp_extract(blank(x), "([0-9]+)", 1).try_cast("bigint")


def strip_survey_prefix(x: Column) -> Column:
    return F.regexp_replace(blank(x), "(?iU)^\\s*KE[-\\s]*", "")


def postprocess(field: Column, x: Column) -> Column:
    """What a field's alphabet allows of a reading."""
    return (
        F.when(field == "survey", F.regexp_replace(blank(x), "[^0-9]", ""))
        .when(field == "meter", F.regexp_replace(F.upper(blank(x)), "[^A-Z0-9]", ""))
        .otherwise(collapse(x))
    )


def digit_alternatives(glyph: Column) -> Column:
    """For review: the digits that a glyph may stand for, its own first."""
    table = F.create_map(*[F.lit(v) for k, d in fixed.LETTER_AS_DIGITS.items() for v in (k, "".join(d))])
    found = F.coalesce(F.try_element_at(table, F.upper(glyph)), F.lit(""))
    return F.when(glyph.rlike("^[0-9]$"), F.array(glyph)).otherwise(F.filter(F.split(found, ""), lambda d: d != ""))


def clamp_exp(logprob: Column) -> Column:
    return F.least(F.greatest(F.exp(logprob), F.lit(0.0)), F.lit(1.0))


def classify_error(code: Column) -> Column:
    return (
        F.when(code.isin(401, 403), "credentials").when(code == 404, "model").when(code == 429, "rate").otherwise("other")
    )


def needs_review(status: Column) -> Column:
    return ~status.isin(*fixed.SETTLED)


def row_verdict(*statuses: Column) -> Column:
    review, corrected = F.lit(False), F.lit(False)
    for s in statuses:
        review = review | needs_review(s)
        corrected = corrected | (s == "corrected")
    return F.when(review, "manual_review").when(corrected, "corrected").otherwise("ok")


def min_confidence(*cells: tuple[Column, Column]) -> Column:
    """Least confidence of the cells that are not empty; 0.0 if all are."""
    found = [F.when(text != "", confidence) for text, confidence in cells]
    return F.coalesce(F.least(*found) if len(found) > 1 else found[0], F.lit(0.0))


def flag_low(confidence: Column, text: Column, status: Column, limit: float = 0.5) -> Column:
    low = (confidence > 0) & (confidence < limit) & (text != "") & status.isin("ok", "corrected")
    return F.when(low, "low_confidence").otherwise(status)


def render_code(x: Column) -> Column:
    """A code as written: a space between letters and digits."""
    return F.regexp_replace(blank(x), "^([A-Z]+)([0-9]+)$", "$1 $2")


def split_remark(remark: Column) -> Column:
    """struct<text, codes>: a workbook remark (struct<text, number>) back to the body and the side codes it was joined from."""
    shown = F.coalesce(remark["text"], remark["number"].cast("string"), F.lit(""))

    def split(parts: Column) -> Column:
        is_code = lambda p: F.trim(p).rlike("^-[0-9]+$")
        return F.struct(
            F.array_join(F.filter(parts, lambda p: ~is_code(p) & (F.trim(p) != "")), ",").alias("text"),
            F.transform(F.filter(parts, is_code), lambda p: F.trim(p)).alias("codes"),
        )

    return once(F.split(shown, ","), split)


def safe_name(x: Column, otherwise: str) -> Column:
    """A file name without folders, ending in .xlsx; blank gives the other name."""
    name = F.when(F.trim(blank(x)) == "", F.lit(otherwise)).otherwise(F.trim(blank(x)))
    named = F.when(F.lower(name).endswith(".xlsx"), name).otherwise(F.concat(name, F.lit(".xlsx")))
    return F.regexp_extract(named, "([^/]*)$", 1)


def suffixed_path(path: Column, suffix: str) -> Column:
    return F.regexp_replace(path, "^(.*?)(\\.[^./]*)?$", "$1" + re.escape(suffix).replace("\\", "") + "$2")
