"""Session defaults and the staging helper that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", memory: str = "8g", checkpoint_dir: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    # Python workers import this package, whatever folder the session starts in
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("crosspanel")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # wide projections beyond the JIT method limit run faster outside whole-stage code
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", memory)
        # concurrent fits share the cores instead of queueing
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    # stored tables of a local session stay out of the folder it starts in
    builder = builder.config("spark.sql.warehouse.dir", f"{checkpoint_dir or tempfile.mkdtemp(prefix='crosspanel-')}/warehouse")
    if checkpoint_dir:
        builder = builder.config(CHECKPOINT_CONF, checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_fallback: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its machine.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="crosspanel-stage-")
    return _fallback[app]


_staged: dict[str, list[str]] = {}


def _part_files(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().toString() for f in found if f.getPath().getName().startswith("part-"))


def stage(df: DataFrame, in_order: bool = False, **options: str) -> DataFrame:
    """Write `df` as Parquet (with the writer's `options`) in the shared folder and read it back.

    With `in_order` the files are read by name, so that equal tables come in
    equal partitions whatever order the file system lists them in.

    Used where several passes follow one expensive result (window features that
    are then aggregated per date and joined back). Later passes read only the
    columns they need, and lost executors never recompute the windows.
    """
    path = f"{staging_root(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _staged.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    paths = _part_files(df.sparkSession, path) if in_order else []
    return df.sparkSession.read.schema(df.schema).parquet(*(paths or [path]))


def track(spark: SparkSession, path: str) -> None:
    """Have `release` delete a folder that was written by other means than `stage`."""
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)


def staged(spark: SparkSession) -> int:
    """Number of tables this application has staged and not released."""
    return len(_staged.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Delete what this application has staged after the first `since` tables (all but the newest with `keep_last`).

    Call it when results are written: frames that still read a staged table fail afterwards.
    """
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    kept = paths[:since] + (paths[since:][-1:] if keep_last else [])
    for path in paths[since : len(paths) - (len(kept) - min(since, len(paths)))]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if kept:
        _staged[spark.sparkContext.applicationId] = kept
