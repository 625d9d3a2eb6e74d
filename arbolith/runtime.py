"""Session helpers shared by all operators: cut lineage, size checks, ordinals."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a table may have at most to be collected to the driver or put into one task.
SMALL_ROWS = 200_000


def session(name: str = "arbolith", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect (tests and bench use it)."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # no stack is taken for every expression
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named in spark.checkpoint.dir.

    Only where that setting is missing (single-machine tests) a temporary folder is made and
    set as the checkpoint folder; on a cluster the setting must be given.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_arbolith_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="arbolith-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark._arbolith_dir = own
        spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at a path of any file system that the session knows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once, so that their Python finds it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_arbolith_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="arbolith-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "arbolith_src.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as made:
        for source in sorted(root.rglob("*.py")):
            made.write(source, Path(root.name, source.relative_to(root)))
    context.addPyFile(str(archive))
    context._arbolith_shipped = True


_written: dict[str, SparkSession] = {}


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, to be deleted with what ``materialize`` writes."""
    path = f"{shared_dir(spark)}/arbolith-{os.getpid()}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation, and a table used more than
    once is computed once. The files go by ``free``, by ``release`` or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._arbolith_path = path
    return made


def _delete(path: str) -> None:
    spark = _written.pop(path)
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; a local folder can still be removed
        if path.startswith("file:"):
            shutil.rmtree(path[5:].replace("//", "/"), ignore_errors=True)


def free(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these very DataFrames; nothing that reads them may run after."""
    for df in frames:
        path = getattr(df, "_arbolith_path", None)
        if path in _written:
            _delete(path)


def release() -> None:
    """Delete every table that ``materialize`` wrote (their DataFrames can't be read after)."""
    for path in list(_written):
        _delete(path)


atexit.register(release)


def small_or_none(df: DataFrame, limit: int = SMALL_ROWS) -> list | None:
    """The rows of ``df`` if they are at most ``limit``, else None. Reads limit + 1 rows at most."""
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else rows


def with_ordinals(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense ordinals from 0 in the given order, without a single-task sort.

    Range-partitions by ``order``, numbers within partitions and adds each partition's offset;
    only one count per partition goes through the driver. ``order`` must be unique.
    """
    spark = df.sparkSession
    numbered = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mid", F.monotonically_increasing_id())
    )
    part = F.shiftright("__mid", 33)
    counts = sorted((r["p"], r["n"]) for r in numbered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = spark.createDataFrame(offsets or [(0, 0)], "__p long, __offset long")  # a row for each partition
    return (
        numbered.withColumn("__p", part)
        .join(F.broadcast(table), "__p")
        .withColumn(name, F.col("__offset") + F.col("__mid").bitwiseAND((1 << 33) - 1))
        .drop("__p", "__offset", "__mid")
    )
