"""Reports to files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_dir

#: What ends a line of a CSV file.
CSV_END = "\r\n"


def csv_line(columns: list[str]) -> Column:
    """Columns as a line of a CSV file: nulls are empty; fields with a comma, a quote or a line end stand in quotes."""
    fields = []
    for c in columns:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        fields.append(F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    return F.concat_ws(",", *fields)


def _path(path: str) -> str:
    return path if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) else Path(path).absolute().as_uri()


def write_lines(lines: DataFrame, path: str, end: str = "\n", head: str = "") -> None:
    """The one string column of lines, in order, as one file of any filesystem. Executors write its parts to the shared folder; the driver then puts these together, a buffer at a time, and holds no rows."""
    spark: SparkSession = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    folder = f"{shared_dir(spark).rstrip('/')}/quarry-lines-{uuid.uuid4().hex}"
    lines.write.option("lineSep", end).text(folder)
    source = place(folder).getFileSystem(conf)
    target = place(_path(path)).getFileSystem(conf)
    # No checksum file beside a report.
    target = target.getRawFileSystem() if hasattr(target, "getRawFileSystem") and target.getScheme() == "file" else target
    out = target.create(place(_path(path)), True)
    try:
        out.write((head + end).encode() if head else b"")
        parts = sorted(p.getPath().toString() for p in source.listStatus(place(folder)) if p.getPath().getName().startswith("part-"))
        for part in parts:
            piece = source.open(place(part))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, 1 << 16, False)
            finally:
                piece.close()
    finally:
        out.close()
    source.delete(place(folder), True)


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file, rows by their first column, of any filesystem; without a scheme, on the driver's disk."""
    write_lines(rows.orderBy(rows.columns[0]).select(csv_line(rows.columns)), path, CSV_END, ",".join(rows.columns))


def write_csv_parts(rows: DataFrame, folder: str) -> None:
    """CSV files in a folder, written by the executors: for results that one file should not hold."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).csv(folder)


def write_text(text: str | Iterable[str], path: str) -> None:
    """A text, or its pieces one after another, to a file on the driver's disk."""
    with Path(path).open("w", encoding="utf-8", errors="replace", newline="") as out:
        for piece in [text] if isinstance(text, str) else text:
            out.write(piece)
