"""Whole runs, review output, configured rules, and profiles, on small cases worked out by hand."""

import itertools
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldledger.functions import fixed
from fieldledger.functions import text as t
from fieldledger.operators import assembly, lookups, review, signal, vision
from fieldledger.operators.codes import letter_readings, letter_table
from fieldledger.operators.correction import Rules, correct_page
from fieldledger.plans.process import export, process
from fieldledger.sources import grid, sinks, xlsx
from fieldledger.streaming.pages import LINES

ROWS = [
    ("b", 7, 0, "600", "SFT 11111", "Shop"),
    ("b", 7, 1, "", '" 22222', ""),
    ("b", 7, 2, "601", "SFT 11111", "+37"),
    ("b", 7, 3, "", "x - x - x", ""),
    ("b", 7, 4, "", "", ""),
    ("b", 9, 0, "601", "SFL 33333", ""),
    ("b", 9, 1, "605", "SCO 4O444", "Mill"),
]


def lines(spark, rows=ROWS):
    return spark.createDataFrame(rows, LINES)


def test_run_as_json(spark):
    expected = spark.createDataFrame([("b", 7, 5), ("b", 9, 2)], "batch_id string, page_no long, detected_rules int")
    done = process(lines(spark), expected)
    got = json.loads(done.grid().first()["grid"])
    assert [(r["id"], r["survey"], r["meter"], r["remarks"], r["group_id"], r["needs_review"]) for r in got["rows"]] == [
        ("7#0", "KE-600", "SFT11111", "Shop", 0, False), ("7#1", "", "SFT22222", "", 0, False), ("7#2", "KE-601", "SFT11111", "-37", 1, False),
        ("9#0", "", "SFL33333", "", 1, False), ("9#1", "KE-605", "SCO 4O444", "Mill", 2, True),
    ]
    assert got["audit"] == {"clean": False, "survey_gaps": [[601, 605]], "survey_repeats": [], "duplicate_meters": ["SFT11111"], "row_count_mismatches": [{"page": "7", "expected": 5, "emitted": 3}]}
    assert got["skipped"] == [{"page": "7", "index": 3, "reason": "section marker or non-Latin line"}, {"page": "7", "index": 4, "reason": "no ink in any column"}]
    assert got["summary"] == {"row_count": 5, "needs_review": 1, "survey_range": [600, 605], "skipped": 2}
    again = got["rows"][3]
    assert not again["is_group_first"] and "group_continues_across_pages" in again["cells"]["survey"]["rules"]
    assert {r["kind"] for r in done.findings.collect()} == {"gap", "duplicate", "row_count"}
    gaps = spark.createDataFrame([(601, 605)], "previous long, current long")
    assert "gap" not in {r["kind"] for r in process(lines(spark), known_gaps=gaps).findings.collect()}


def test_all_known_gaps_count(spark):
    """More known gaps than fit a broadcast are all known."""
    rows = spark.createDataFrame([("b", 0, i, f"KE-{i * 2}") for i in range(400)], "batch_id string, page_ord long, row_index long, survey string")
    known = spark.range(0, 300_000).select((F.col("id") * 2).alias("previous"), (F.col("id") * 2 + 2).alias("current"))
    assert assembly.audit_surveys(rows).count() == 399 and assembly.audit_surveys(rows, known).count() == 0


def test_batch_of_skipped_lines_only(spark):
    done = process(lines(spark, [("z", 1, 0, "", "x - x - x", "")]))
    assert {r["metric"]: r["value"] for r in done.summary.collect()}["skipped"] == 1
    assert json.loads(done.grid().first()["grid"])["summary"]["skipped"] == 1


def test_confidences(spark):
    wide = lines(spark).withColumns({"meter_conf": F.when(F.col("row_index") == 0, 0.3).otherwise(0.8), "survey_conf": F.lit(None).cast("double")})
    got = {(r["page_no"], r["row_index"]): r for r in correct_page(wide).collect()}
    assert got[7, 0]["meter"]["status"] == "low_confidence" and got[7, 0]["meter"]["rules"][-1] == "low_confidence"
    assert got[7, 1]["meter"]["status"] == "corrected" and got[9, 1]["meter"]["status"] == "ambiguous" and got[7, 0]["survey"]["status"] == "ok"
    done = process(wide)
    row = json.loads(done.grid().first()["grid"])["rows"][0]
    assert row["needs_review"] and row["confidence"] == 0.0  # no confidence of the survey cell is none


def test_orphan_remarks(spark):
    kept, _ = assembly.grouped(correct_page(lines(spark, [("b", 1, 0, "", "SFT 11111", "Hut"), ("b", 1, 1, "600", "SFT 22222", "Shop")])))
    assert [tuple(r) for r in assembly.orphan_remarks(kept).collect()] == [("b", 1, 0, "Hut")]


def test_sidecar(spark, tmp_path):
    path, side = str(tmp_path / "out.xlsx"), str(tmp_path / "out_review.xlsx")
    export(lines(spark), path, side)
    cells = [[v for v, _ in c] for _, c in xlsx.read_sheet(side, "Review", columns=10)]
    assert cells[0][:7] == ["7", "0", "survey", "KE-600", "600", "0.0", "ok"] and len(cells) == 12
    told = {c[0][0]: c[1][0] for _, c in xlsx.read_sheet(side, "Summary", columns=2) if c[0][0]}
    assert told["Pages processed"] == "2" and told["Rows exported"] == "5" and told["Rows skipped (markers / non-Latin)"] == "2"
    assert told["Survey gaps"] == "1" and told["Duplicate meter codes"] == "1" and told["Structural audit clean"] == "no"
    assert told["7 row 3"] == "section marker or non-Latin line"
    with zipfile.ZipFile(side) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert 's="1"' in sheet and 's="2"' in sheet and "frozen" in sheet
    two = process(lines(spark, [*ROWS, ("c", 1, 0, "600", "SFT 11111", "")]))
    with pytest.raises(ValueError, match="one batch"):
        sinks.write_sidecar(two.corrected, two.rows, two.skipped, two.findings, side)


def test_sheets(spark, tmp_path):
    path = str(tmp_path / "two.xlsx")
    xlsx.write_sheets(path, [xlsx.Sheet("One", [["a"], ["x"]], [10]), xlsx.Sheet("Two", [["h", "m"], ["y", " SFT 1 "], [None, "  "], ["z", None]], [10, 10])])
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/workbook.xml"] = parts["xl/workbook.xml"].replace(b"<sheets>", b'<bookViews><workbookView activeTab="1"/></bookViews><sheets>')
    with zipfile.ZipFile(path, "w") as z:
        for n, body in parts.items():
            z.writestr(n, body)
    assert [c[0][0] for _, c in xlsx.read_sheet(path)] == ["y", None, "z"]  # the active sheet
    assert [c[0][0] for _, c in xlsx.read_sheet(path, "One")] == ["x"]
    xlsx.register(spark)
    only = spark.read.format("xlsx_rows").options(path=path, only="meter").load()
    assert [(r["survey"], r["meter"]) for r in only.collect()] == [(None, "SFT 1")]
    assert xlsx.letters(0) == "A" and xlsx.letters(27) == "AB"


def test_configured_files(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# marks\n\n^total$\n^carried\\s+over\n")
    (tmp_path / "t.yaml").write_text("max_distance: 1\ntokens:\n  - output: Locked\n    variants: [door locked]\n")
    (tmp_path / "p.yaml").write_text("pages:\n  - {id: p1, source: a.jpg, surveys: 1-2, first_row: 2, last_row: 5}\n  - {id: p2, first_row: 6, last_row: 9, continues_previous_group: true}\n")
    tokens, most = grid.load_tokens(spark, str(tmp_path / "t.yaml"))
    rules = Rules(markers=grid.load_markers(spark, str(tmp_path / "m.txt")), tokens=tokens, token_distance=most)
    rows = [("b", 1, 0, "", "Total", ""), ("b", 1, 1, "", "Door lockd", ""), ("b", 1, 2, "", "No meter", ""), ("b", 1, 3, "", "x - x - x", "")]
    got = [r["meter"] for r in correct_page(lines(spark, rows), rules).orderBy("row_index").collect()]
    assert [(m["text"], m["status"]) for m in got[:2]] == [("", "skipped"), ("Locked", "corrected")]
    assert got[2]["status"] == "invalid_format" and got[3]["status"] == "invalid_format"
    none = Rules(markers=(), tokens=())
    assert [r["meter"]["status"] for r in correct_page(lines(spark, rows[:1]), none).collect()] == ["invalid_format"]
    pages = grid.load_manifest(spark, str(tmp_path / "p.yaml"))
    assert [tuple(r) for r in pages.orderBy("id").collect()] == [("p1", "a.jpg", "1-2", 2, 5, False), ("p2", None, "", 6, 9, True)]
    assert grid.check_tiling(pages).count() == 2
    with pytest.raises(Exception, match="starts at 6, not at 5"):
        grid.check_tiling(pages.withColumn("last_row", F.col("last_row") - 1)).collect()


def test_golden_files(spark, tmp_path):
    golden = spark.createDataFrame([("p1", 0, 10, "KE-600", "SFT11111", "-37", "number", "True"), ("p0", 0, 12, None, "SFL1", None, "", "False"), ("p1", 1, 11, "", "SFT2", "Shop", "text", "False")],
                                   "page_id string, row_index int, workbook_row int, survey string, meter string, remarks string, remarks_type string, is_group_first string")
    sinks.write_golden(golden, str(tmp_path / "g"))
    back = grid.read_golden(spark, str(tmp_path / "g"))
    pages = [(r["page_id"], r["first"], [x["meter"] for x in r["rows"]]) for r in grid.golden_pages(back).orderBy("first").collect()]
    assert pages == [("p1", 10, ["SFT11111", "SFT2"]), ("p0", 12, ["SFL1"])]
    cells = {(r["page_id"], r["row_index"], r["column"]): r["expected"] for r in grid.expected_values(back).collect()}
    assert cells["p1", 0, "survey"] == "600" and cells["p0", 0, "remarks"] == "" and len(cells) == 9
    crops = grid.expected_values(back).withColumn("image", F.lit(b"x"))
    sinks.write_labels(crops, str(tmp_path / "c"))
    labels = grid.read_labels(spark, str(tmp_path / "c/labels.csv"), ["meter"])
    assert sorted(r["crop"] for r in labels.collect()) == ["p0_00_meter.png", "p1_00_meter.png", "p1_01_meter.png"]
    folded = lookups.differences(back.select("remarks"), back.select(F.upper("remarks").alias("remarks")), ("remarks",))
    assert folded.count() == 0 and lookups.differences(back.select("remarks"), back.select(F.upper("remarks").alias("remarks"))).count() == 2


def test_report(spark):
    scores = spark.createDataFrame([("meter", f"e{i}", 10, 1.0, float(i), 3.0, 4.0, 5.0) for i in range(1200)], "field string, engine string, cells int, raw double, corrected double, valid double, p50 double, p95 double")
    misses = spark.createDataFrame([("e1", "meter", "c.png", "A", "B", "C")], "engine string, field string, crop string, expected string, raw string, corrected string")
    got = sinks.report(scores, misses)
    assert got.count("\n| e") == 1200 and "| e1199 | 10 | 1.0% | **1199.0%** | 3.0% | 4 | 5 |" in got and "| `c.png` | `A` | `B` | `C` |" in got


def test_profiles(spark):
    rules = spark.createDataFrame([("p", x) for x in (10, 11, 30, 50, 110)], "page string, y int")
    got = [(r["row"], r["top"], r["bottom"]) for r in signal.ruled_rows(rules, "page", "y").orderBy("row").collect()]
    assert got == [(0, 10, 30), (1, 30, 50), (2, 50, 70), (3, 70, 90), (4, 90, 110)]
    ink = [9, 9, 9, 0, 9, 9, 9, 0, 9, 9]
    profile = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate(ink)], "page string, x int, ink double")
    assert [tuple(r) for r in signal.column_cuts(profile, "page", "x", "ink", 3, 2, (0.1, 0.1, 0.1)).collect()] == [("p", 3, 7)]
    flat = signal.smooth(profile.withColumn("ink", F.lit(2.0)), "page", "x", "ink", 1.0)
    assert all(abs(r["smooth"] - 2.0) < 1e-12 for r in flat.collect())
    blurred = [r["blurred"] for r in signal.median_blur(profile, "page", "x", "ink", 3).orderBy("x").collect()]
    assert blurred == [9.0] * 10
    one = spark.createDataFrame([([5],), ([],)], "p array<int>").select(signal.median_pitch(F.col("p")).alias("m"))
    assert [r["m"] for r in one.collect()] == [1.0, 1.0]


def test_review_helpers(spark):
    df = spark.createDataFrame([(1, "a.b", "ok", "corrected"), (2, " x/../y ", "ambiguous", "ok"), (3, None, "ok", "ok")], "i int, name string, meter_status string, survey_status string")
    got = df.select(t.safe_name(F.col("name"), "N").alias("n"), review.badge(F.col("survey_status")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("a.b.xlsx", "fixed"), ("y.xlsx", "ok"), ("N.xlsx", "ok")]
    assert [r["needs_review"] for r in review.reindex(df, ["name"], "i").orderBy("i").collect()] == [False, True, False]
    best = lookups.fuzzy_prefixes(spark.createDataFrame([("SFX",), ("",)], "p string"), "p", 60.0).collect()
    assert [m["prefix"] for m in best[0]["matches"]] == ["SX", "SFL", "SFE", "SFC", "SFY"] and best[1]["matches"] == []


def test_fuzzy_prefixes_against_the_plain_ratio(spark):
    """All prefixes at a time in a few bits each: the same scores as one table of subsequences for each."""
    rng = random.Random(4)
    keys = ["", " sco ", "S", "SCOSCO", "ésx😀", "QQQQQ", "x" * 70 + "SCO", "OCS", None, *["".join(rng.choice("SCOFEXLATPYZ1 ") for _ in range(rng.randint(1, 7))) for _ in range(60)]]
    rows = spark.createDataFrame([(k,) for k in keys], "p string")

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *itertools.accumulate(range(1, len(b) + 1), lambda acc, j: row[j - 1] + 1 if b[j - 1] == x else max(acc, row[j]), initial=0)][1:]
        return 200.0 * row[-1] / (len(a) + len(b))

    for r in lookups.fuzzy_prefix(lookups.fuzzy_prefixes(rows, "p", 20.0, 9), "p", 20.0).collect():
        key = (r["p"] or "").strip(" ").upper()
        known = sorted((-ratio(key, p), -n, i, p) for i, (p, n) in enumerate(fixed.PREFIX_COUNTS.items())) if key else []
        want = [(p, -s) for s, _, _, p in known if -s >= 20.0][:9]
        assert [tuple(m) for m in r["matches"]] == want, r["p"]
        assert (tuple(r["match"]) if r["match"] else None) == (want[0] if want else None)


def test_fuzzy_prefix_does_not_walk_each_prefix(spark):
    plan = lookups.fuzzy_prefix(spark.createDataFrame([("SFX",)], "p string"), "p")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_engines_by_name():
    assert vision.build("transcript").recognise(b" KE-12 ", "survey").text == "12"
    assert vision.build("transcript").recognise(b"sft 1-2", "meter").text == "SFT12"
    with pytest.raises(KeyError, match="unknown engine 'x'; known: .*transcript"):
        vision.build("x")


def test_letter_readings_against_a_plain_search():
    """Each reading of three glyphs: all combinations by cost, the likeliest WIDTH of them, known prefixes only."""
    table = letter_table()
    for glyphs, found in letter_readings()[::97]:
        kept = [("", 0)]
        for g in glyphs:
            kept = sorted([(x + c, n + k) for x, n in kept for c, (k, _) in table[g].items() if n + k <= fixed.MAX_EDITS], key=lambda r: r[1])[: fixed.WIDTH]
        assert found == [r for r in kept if r[0] in fixed.PREFIX_COUNTS]
