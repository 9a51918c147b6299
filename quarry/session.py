"""Session helpers: the package on the executors, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of an Arrow batch at most: a batch holds whole texts, and a worker holds it several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once for each SparkContext, so that Python workers can import it, and bound the session's Arrow batches."""
    context = spark.sparkContext
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not (now.rstrip("b").isdigit() and 0 < int(now.rstrip("b")) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    if getattr(context, "_quarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, f"quarry/{source.relative_to(root)}")
    context.addPyFile(str(archive))
    context._quarry_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that driver and executors share")
        found = getattr(spark.sparkContext, "_quarry_shared", None) or tempfile.mkdtemp(prefix="quarry-shared-")
        spark.sparkContext._quarry_shared = found
    return found


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends, and the rows survive a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # The steps behind this table are done with; a collection in the driver lets Spark remove their shuffle files.
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table._quarry_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut wrote, once nothing that is still to run reads them."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._quarry_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
