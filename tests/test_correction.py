"""Row-level cases of the notebook's rules."""

import pytest
from pyspark.sql import functions as F

from fieldledger.functions import text as t
from fieldledger.operators import assembly, codes, correction

LINES = "batch_id string, page_no long, row_index long, survey_raw string, meter_raw string, remarks_raw string"


def lines(spark, rows, page=0):
    return spark.createDataFrame([("b", page, i, *(list(r) + [""] * 3)[:3]) for i, r in enumerate(rows)], LINES)


def page(spark, rows):
    return correction.correct_page(lines(spark, rows)).orderBy("row_index").collect()


def values(spark, xs, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_grammar(spark):
    got = values(spark, ["SFT 77430", "LA494585", "SFT7743", "S77430", "SFTX7430", "77430", "", None], t.parse_code)
    assert [tuple(g) if g else None for g in got] == [("SFT", "77430"), ("LA", "494585")] + [None] * 6


def test_repairs(spark):
    cases = {"5FT77430": "SFT77430", "SFP 93O95": "SFP93095", "P5A 33901": "PSA33901", "SCE 1O194": "SCE10194", "5EG 74422": "SEG74422", "SF 77430": None, "SCI 79031": "SCI79031", "TTY51697": "TT451697", "SCT4538": "SC74538"}
    df = codes.with_repairs(spark.createDataFrame([(x,) for x in cases], "x string"), "x", "found")
    got = {r["x"]: [f["text"] for f in r["found"]] for r in df.collect()}
    assert {k: (v[0] if v else None) for k, v in got.items()} == cases
    assert "SCT79031" in got["SCI 79031"][1:]
    assert all(len(v) <= 5 for v in got.values())


def test_dimension_size():
    found = codes.letter_readings()
    assert (len(found), sum(len(r) for _, r in found), max(len(r) for _, r in found)) == (1421, 3210, 15)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("661", "SCT 89642"), ("662", '" 45386')], ["SCT89642", "SCT45386"]),
        ([("", "SCT 89642"), ("", '" 4538'), ("", '" 45386')], ["SCT89642", "SC74538", "SC45386"]),
        ([("", "SFL 836 83628"), ("", "SCE 10194 <- 10194")], ["SFL83628", "SCE10194"]),
        ([("", "No metd"), ("", "no  meter"), ("", "SFP O3095"), ("", "P5A 33901")], ["NoMeter", "NoMeter", "SFP03095", "PA33901"]),
        ([("", "SEH 12345"), ("", '" 23456')], ["SEA12345", "SEA23456"]),
    ],
)
def test_meters(spark, rows, want):
    assert [r["meter"]["text"] for r in page(spark, rows)] == want


def test_meter_statuses(spark):
    got = page(spark, [("", '" 70028'), ("", "SCC 68610 68674"), ("", "SFP 93O95"), ("", "P5A 33901"), ("", ""), ("", 'End Block "C"')])
    assert [r["meter"]["status"] for r in got] == ["manual_review", "ambiguous", "ambiguous", "invalid_prefix", "empty", "skipped"]
    assert got[1]["meter"]["candidates"] == ["68610", "68674"]
    assert got[5]["row_status"] == "skipped"


def test_survey(spark):
    got = [tuple(x) for x in values(spark, ["678 668", "66O", "7", "12345", "", None], t.correct_survey)]
    assert [(g[0], g[1]) for g in got] == [("KE-668", "corrected"), ("KE-660", "corrected"), ("", "invalid_format"), ("KE-1234", "ok"), ("", "empty"), ("", "empty")]
    assert got[0][2] == ["KE-678", "KE-668"] and got[0][3] == ["survey_struck_out"]


def test_remarks(spark):
    got = page(spark, [("", "", "Imam Bargah"), ("", "", ""), ("", "", '"'), ("", "", "+37 Shop"), ("", "", "#37 +24"), ("", "", "3 Shops"), ("", "", "x - x - x")])
    assert [r["remarks"]["text"] for r in got] == ["Imam Bargah", "", "Imam Bargah", "Shop", "", "3 Shops", ""]
    assert [r["codes"] for r in got] == [[], [], [], ["-37"], ["-37", "-24"], [], []]


def test_format_remarks(spark):
    df = spark.createDataFrame([("", ["-37"]), ("SHOP", ["-37"]), ("", []), ("", ["-0"]), ("④ Shops", None)], "x string, c array<string>")
    got = [tuple(r[0]) for r in df.select(t.format_remarks(F.col("x"), F.col("c"))).collect()]
    assert got == [(None, -37), ("-37,SHOP", None), (None, None), (None, 0), ("4 Shops", None)]


def test_markers_and_marks(spark):
    assert values(spark, ['End Block "C"', "x - x - x", "----------", "Remarks", "p. 12", "Shop", "x"], t.is_section_marker) == [True] * 5 + [False] * 2
    assert values(spark, ["x", '"', "''", "xyz", "", "~ "], t.is_ditto) == [True, True, True, False, False, True]
    assert values(spark, ["a  b", None, "  x "], t.collapse) == ["a b", "", "x"]


def assembled(spark, pages):
    """pages: {page_no: rows}"""
    df = None
    for no, rows in pages.items():
        part = lines(spark, rows, no)
        df = part if df is None else df.unionByName(part)
    corrected = correction.correct_page(df)
    rows, skipped = assembly.assemble(corrected)
    return rows.orderBy("page_ord", "row_index").collect(), skipped.collect(), corrected, rows


def test_page_order_and_groups(spark):
    rows, _, _, _ = assembled(spark, {5: [("620", "SFT 11111")], 1: [("", "SFT 22222")], 9: [("619", "SFT 33333"), ("", "SFT 44444")], 12: [("619", "SFT 55555"), ("619", "SFT 66666")]})
    assert [(r["page_no"], r["survey"]) for r in rows] == [(9, "KE-619"), (9, None), (12, None), (12, None), (5, "KE-620"), (1, None)]
    assert [r["group_id"] for r in rows] == [0, 0, 0, 0, 1, 1]


def test_binding(spark):
    rows, _, _, _ = assembled(spark, {1: [("600", "SFT 11111"), ("", "SFT 22222", "Shop"), ("", "SFT 33333", "+37 Shop")], 2: [("600", "SFT 44444", "Mosque")]})
    assert [r["remark"]["text"] for r in rows] == ["Shop, Mosque", None, "-37,Shop", None]
    assert rows[0]["status"] == "manual_review"


def test_orphans_and_skips(spark):
    rows, skipped, _, _ = assembled(spark, {1: [("", "SFT 11111", "lost"), ("600", "SFT 22222"), ("", "", "+37"), ("", "x - x - x")]})
    assert [(r["group_id"], r["survey"], r["remark"]["text"]) for r in rows] == [(0, None, None), (1, "KE-600", None)]
    assert sorted(r["reason"] for r in skipped) == ["no ink in any column", "section marker or non-Latin line"]


def test_audits(spark):
    _, _, corrected, rows = assembled(spark, {1: [("600", "TZ 51697"), ("604", "SFT 22222")], 2: [("680", "TZ 51697")], 3: [("680", "SFT 33333"), ("", "")]})
    found = {tuple(r)[1:] for r in assembly.audit_surveys(rows).collect()}
    assert found == {("gap", 600, 604), ("gap", 604, 680)}
    known = spark.createDataFrame([(604, 680)], "previous long, current long")
    assert [tuple(r)[1:] for r in assembly.audit_surveys(rows, known).collect()] == [("gap", 600, 604)]
    assert [(r["meter"], r["n"]) for r in assembly.audit_duplicates(rows).collect()] == [("TZ51697", 2)]
    expected = spark.createDataFrame([("b", 1, 3), ("b", 2, 1), ("b", 3, 0)], "batch_id string, page_no long, detected_rules int")
    assert [tuple(r) for r in assembly.audit_row_counts(corrected, expected).collect()] == [("b", 1, 3, 2)]
    assert assembly.audit_all(rows, corrected, expected).count() == 4


def test_many_known_gaps(spark):
    _, _, _, rows = assembled(spark, {1: [("600", "TZ 51697"), ("604", "SFT 22222")]})
    known = spark.range(100_001, numPartitions=1).selectExpr("IF(id = 100000, 600, 10000 + id) AS previous", "IF(id = 100000, 604, 10002 + id) AS current")
    assert assembly.audit_surveys(rows, known).count() == 0
