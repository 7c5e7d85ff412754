"""Session settings and the shared scratch area for staged frames."""

from __future__ import annotations

import contextlib
import functools
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs a further shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on (UTC, ANSI, AQE skew handling)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", app: str = "tillview", shared: str | None = None) -> SparkSession:
    """A single-machine session for tests and the bench, which name the folder for staged tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: what ``spark.checkpoint.dir`` names, or else a folder in the warehouse.

    A warehouse that is a folder of each machine will do on one machine only; a cluster must name a shared one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    warehouse, master = spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master
    if ("://" not in warehouse or warehouse.startswith("file:")) and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return f"{warehouse.rstrip('/')}/staged"


def spread(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Hand a small input to all cores before work that is heavy per row.

    A file with one row group is read by one task however many cores wait. ``scan`` is the file scan
    ``df`` is made of; with at least as many splits as cores the rows are left where they are. Only the number of
    tasks depends on it, never a result.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = (df if scan is None else scan).rdd.getNumPartitions()
    return df if splits >= cores else df.repartition(cores)


_STAGED: list[str] = []


# Shuffle files go when the run that made them has ended, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``more`` of the same columns go to the same table.

    Later reads see exactly the rows written, also after executors are lost, and Catalyst knows the
    size of what it reads. What was shuffled for a frame is given back before the next one is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    with _own_shuffles(spark):
        for part in (df, *more):
            part.write.mode("append").parquet(path, compression="zstd")
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


# Of a larger table, as many bytes of its files are shuffled at a time, in so many passes at most.
_PASS_BYTES, _PASSES = 512 << 20, 8


def passes(table: DataFrame, *keys: str) -> list[DataFrame]:
    """A table as it is read, cut by a hash of ``keys`` (or all columns) so that rows with equal keys are in one part.

    Parts that are shuffled and written one after the other need their share of the disk at a time. A frame that is
    more than a table is left whole, as each part would make it anew. Only the number of runs depends on the
    size, never a result.
    """
    plan = table._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    n = min(_PASSES, -(-size // _PASS_BYTES)) if plan.children().isEmpty() else 1
    if n <= 1:
        return [table]
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in keys or table.columns]), F.lit(n))
    return [table.where(part == i) for i in range(n)]


def unstage(df: DataFrame) -> None:
    """Delete the staged tables ``df`` reads, which nothing else may read any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    for path in [p for p in _STAGED if p.rsplit("/", 1)[-1] in folders]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _STAGED.remove(path)


_CACHES: list[dict] = []


def inputs(spark: SparkSession, folder: str) -> tuple:
    """Name, size and time of every file of the tables in ``folder``: changed inputs are other inputs."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for pattern in ("/*.parquet", "/*.parquet/*"):
        at = path(folder.rstrip("/") + pattern)
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in at.getFileSystem(conf).globStatus(at) or []]
    return tuple(sorted(out))


def kept_for_inputs(build: Callable[[str], object]) -> Callable[[SparkSession, str], object]:
    """Keep what ``build`` makes of a folder while application and input files stay, until drop_staged."""
    made: dict = {}
    _CACHES.append(made)

    @functools.wraps(build)
    def get(spark: SparkSession, folder: str) -> object:
        key = (spark.sparkContext.applicationId, folder, inputs(spark, folder))
        if key not in made:
            made[key] = build(folder)
        return made[key]

    return get


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables this process has staged and forget what was built on them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for made in _CACHES:
        made.clear()
    count = len(_STAGED)
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(conf).delete(path, True)
    return count
