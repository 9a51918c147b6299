"""Files and seed lists."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import CrawlError, ScanError
from quarry.functions.text import strip
from quarry.schemas import FILE
from quarry.session import shared_dir, ship_package


def _hidden(name: str) -> bool:
    """Whether Spark's own file sources pass over a name."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _literal(path: str) -> str:
    """A path in which no character stands for others."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def hidden_entries(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(folders, files) below a path, or the path itself, whose names Spark's file sources pass over; of folders also those inside hidden ones.

    The driver walks the folders of any filesystem, and keeps hidden names only.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(top):
        raise ScanError(f"no such file or folder: {path}")
    status = fs.getFileStatus(top)
    folders, files = [], []
    if not status.isDirectory():
        return [], [status.getPath().toString()] if _hidden(top.getName()) else []
    todo = [status.getPath()]
    while todo:
        entries = fs.listStatusIterator(todo.pop())
        while entries.hasNext():
            entry = entries.next()
            own = entry.getPath()
            hidden = _hidden(own.getName())
            if entry.isDirectory():
                todo.append(own)
                if hidden:
                    folders.append(own.toString())
            elif hidden:
                files.append(own.toString())
    return folders, files


def _copied(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, content) of hidden files, read from copies under plain names in the shared folder."""
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    folder = f"{shared_dir(spark).rstrip('/')}/quarry-hidden-{uuid.uuid4().hex}"
    for i, name in enumerate(files):
        source, target = jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.hadoop.fs.Path(f"{folder}/{i}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
    names = spark.createDataFrame(list(enumerate(files)), "_i long, _path string")
    read = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"/([0-9]+)$", 1).cast("long").alias("_i"), "content")
    return read.join(names, "_i").select(F.col("_path").alias("path"), "content")


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a file, or of all files below a folder, of any filesystem that Spark reads; hidden ones too. Executors list and read; a path without a scheme gives
    paths without one. Files of no bytes give no rows."""
    folders, files = hidden_entries(spark, path)
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    # Hidden folders are read as roots; what is below one of them in a plain folder is read with it, and below a hidden one as a root of its own.
    found = reduce(DataFrame.unionAll, (source.load(_literal(p)).select("path", "content") for p in [path, *folders]))
    if files:
        found = found.unionAll(_copied(spark, files))
    return found if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else found.withColumn("path", F.regexp_replace("path", "^file:(//)?", ""))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of read_bytes: UTF-8 with invalid bytes dropped and line ends as line feeds, binary files included."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "text"])

    return read_bytes(spark, path).mapInArrow(run, FILE)


def seeds(spark: SparkSession, url: str | None = None, file: str | None = None) -> DataFrame:
    """Distinct seed urls of an option and of a file with one a line; blank lines do not count."""
    if not url and not file:
        raise CrawlError("a url or a file of urls is needed")
    found = spark.createDataFrame([(url.strip(),)] if url else [], "url string")
    if file:
        found = found.union(spark.read.text(file).select(strip(F.col("value")).alias("url")))
    return found.filter("url != ''").distinct()
