"""Reports to one file: the driver puts parts together and holds no rows."""

import csv
import io
import resource

import pytest
from pyspark.sql import functions as F

from quarry.operators import reports
from quarry.sinks.reports import write_csv, write_lines
from quarry.sinks.terminal import tell

ROWS = [("b", 'quo"te', None, 1), ("a,x", "line\nend", "", -5), (" c ", "#no comment", "é🙂", None), ("d\r", "", '""', 7), ("a", "x", "\\", 0), (None, "p", "q", 2)]


def test_csv_as_the_standard_library_writes_it(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "k string, a string, `b c` string, n int").repartition(4)
    for path in (str(tmp_path / "out.csv"), f"file://{tmp_path}/uri.csv"):
        write_csv(df, path)
    expected = io.StringIO(newline="")
    writer = csv.writer(expected)
    writer.writerow(df.columns)
    writer.writerows(sorted(ROWS, key=lambda r: (r[0] is not None, (r[0] or "").encode())))
    for name in ("out.csv", "uri.csv"):
        assert (tmp_path / name).read_bytes().decode() == expected.getvalue()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out.csv", "uri.csv"]
    write_csv(df.limit(0), str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_bytes() == b"k,a,b c,n\r\n"


def test_many_rows_do_not_pass_through_the_driver(spark, tmp_path):
    n = 2_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rows = spark.range(n).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("k"), F.lit("some text, with a comma").alias("t"))
    write_csv(rows.orderBy(F.xxhash64("k")), str(tmp_path / "many.csv"))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 50_000
    with (tmp_path / "many.csv").open(newline="") as f:
        read = csv.reader(f)
        assert next(read) == ["k", "t"] and all(r == [f"{i:08d}", "some text, with a comma"] for i, r in enumerate(read))
        assert read.line_num == n + 1


def test_lines(spark, tmp_path):
    write_lines(spark.createDataFrame([("x",), ("é",), ("",)], "l string").coalesce(1), str(tmp_path / "l"))
    assert (tmp_path / "l").read_text() == "x\né\n\n"


@pytest.mark.parametrize("rows", [[("p/1", 1, "A: x"), ("p/2", 2, "B: y\nC: z")], []])
def test_reports_in_pieces(spark, tmp_path, rows):
    found = spark.createDataFrame(rows, "path string, n int, secrets string")
    out = io.StringIO()
    tell(reports.report_pieces(found, "Secrets found in", "path", "secrets", "None.\n"), str(tmp_path / "r"), out)
    text = reports.text_report(found, "Secrets found in", "path", "secrets", "None.\n")
    assert out.getvalue() == text + "\n" and (tmp_path / "r").read_text() == text
    assert text == ("\n1 Secrets found in p/1:\nA: x\n\n2 Secrets found in p/2:\nB: y\nC: z\n" if rows else "None.\n")
