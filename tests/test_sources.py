"""Sources, sinks, engines and the stream."""

from pyspark.sql import functions as F

from fieldledger.operators import codes
from fieldledger.plans.process import export, process
from fieldledger.sources import grid, replies, sinks, xlsx
from fieldledger.streaming.pages import LINES, stream_pages

ROWS = [("b", 1, 0, "600", "SFT 11111", "+37"), ("b", 1, 1, "", "SFT 22222", "Shop"), ("b", 1, 2, "601", "No metd", "")]


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "out.xlsx")
    lines = spark.createDataFrame(ROWS, LINES)
    export(lines, path)
    export(lines, path)
    assert len(list(tmp_path.glob("out_*.xlsx"))) == 1  # the earlier file is kept
    xlsx.register(spark)
    got = [tuple(r)[1:] for r in spark.read.format("xlsx_rows").option("path", path).load().orderBy("row").collect()]
    assert got == [(2, "KE-600", "SFT11111", "-37", "number"), (3, None, "SFT22222", None, ""), (4, "KE-601", "NoMeter", None, "")]


def test_process(spark, tmp_path):
    done = process(spark.createDataFrame(ROWS, LINES))
    values = {r["metric"]: r["value"] for r in done.summary.collect()}
    assert values == {"rows": 3, "groups": 2, "needs_review": 0, "corrected": 1, "remarked": 1, "numeric_remarks": 1, "text_remarks": 0, "skipped": 0}
    sinks.write_parquet(done.rows, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 3


def test_replies(spark):
    texts = ['```json\n{"rows":[{"survey":" 1 ","meter":null},3]}\n```', 'so: {"rows":[{"meter":"x"}]} ok', "[]", "none", None, '[{"meter":"y","remarks":5}]']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, reply string")
    got = [tuple(r) for r in replies.reply_rows(df, "reply").drop("reply").orderBy("i").collect()]
    assert got == [(0, 0, "1", "", ""), (1, 0, "", "x", ""), (5, 0, "", "y", "5")]


def test_dictionary(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# note\n\nsft\t3\nLA\n")
    assert [tuple(r) for r in codes.load_prefixes(spark, str(tmp_path / "p.txt")).collect()] == [("SFT", 3), ("LA", 0)]
    sinks.write_dictionary(codes.prefix_dim(spark), str(tmp_path / "d"))
    assert codes.load_prefixes(spark, str(tmp_path / "d")).agg(F.sum("count"), F.count("*")).first()[:] == (862, 65)


def test_names_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, f string")
    assert [r["name"] for r in grid.unique_names(df, "f", "i").orderBy("i").collect()] == ["a", "a_1", "b"]
    (tmp_path / "x.JPG").write_bytes(b"1")
    (tmp_path / "x.txt").write_bytes(b"2")
    assert grid.read_images(spark, str(tmp_path)).count() == 1


def test_engines(spark):
    from fieldledger.operators import vision

    class Echo(vision.Engine):
        name = "echo"

        def recognise(self, image, field):
            if image == b"bad":
                raise ValueError("no")
            return vision.Reading(image.decode() + field, 0.9)

    cells = spark.createDataFrame([("p", 0, "meter", b"x", 0.1), ("p", 1, "meter", b"bad", 0.1), ("p", 2, "meter", b"y", 0.0)], "page string, row_index int, field string, image binary, ink double")
    got = [(r["text"], r["engine"], r["error"]) for r in vision.recognise_cells(cells, Echo).orderBy("row_index").collect()]
    assert got == [("xmeter", "echo", None), ("", "echo", "no"), ("", "blank", None)]


def test_stream(spark, tmp_path):
    spark.createDataFrame(ROWS, LINES).write.parquet(str(tmp_path / "in"))
    q = stream_pages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
