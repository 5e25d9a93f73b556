"""Session set-up and the shared folder used for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("tallyframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of this session.

    The folder the cluster names in ``spark.checkpoint.dir`` wins.  A local
    session without one gets a fresh temporary folder; a cluster without one is
    an error, because a machine-local folder is lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="tallyframe-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for one written stage."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the keys into a fixed number of tasks.

    For small rows that mean much work each: Spark joins small partitions by
    their bytes, which would leave such work to one task.  One task more than a
    shuffle has, or the planner takes an earlier shuffle by the same keys (and
    its joined partitions) to be good enough and drops this one.
    """
    spark = df.sparkSession
    tasks = 1 + max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder once, as Parquet, and continue from there.

    Used where several branches read the same expensive result, and wherever a
    value that Spark could compute differently on a second run (a partition id)
    must stay fixed.  A branch reads only the columns it needs.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    _STAGES.append(path)
    stage = df.sparkSession.read.schema(df.schema).parquet(path)
    # Only this very frame is the stage; a frame derived from it is not.
    stage.__dict__["_is_stage"] = True
    return stage


def row_measure(schema: T.StructType) -> list[Column]:
    """Aggregates ``rows`` and ``bytes``: eight bytes a field, and the length of every text, binary or nested value."""
    length: Column = F.lit(8 * len(schema.fields)).cast("bigint")
    for field in schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            length = length + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            length = length + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")]


def stage_size(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a frame, by one aggregate; known already for a measured stage."""
    known = df.__dict__.get("_size")
    if known is None:
        known = tuple(df.agg(*row_measure(df.schema)).first())
        if df.__dict__.get("_is_stage"):
            df.__dict__["_size"] = known
    return known


def measured_stage(df: DataFrame) -> DataFrame:
    """``df`` as a stage that knows its size, in one reading.

    Rows and bytes are summed while they are written, by an accumulator: a task that ran twice can only make them
    larger, so they may choose a plan but are no result.  A frame that is a stage already is not written again.
    """
    if df.__dict__.get("_is_stage"):
        return df
    seen = Observation()
    stage = cut_lineage(df.observe(seen, *row_measure(df.schema)))
    found = seen.get
    if "rows" in found:
        stage.__dict__["_size"] = (found["rows"], found["bytes"])
    return stage


_STAGES: list[str] = []


def drop_stage(*frames: DataFrame) -> None:
    """Delete the stages that ``frames`` read, for jobs of many steps; nothing may read them any more.

    Shuffle files go when the driver's JVM finds that no plan refers to them, so it is asked to look.
    """
    for df in frames:
        spark = df.sparkSession
        files = df.inputFiles()
        for path in [p for p in _STAGES if any(p.rsplit("/", 1)[-1] in file for file in files)]:
            _STAGES.remove(path)
            _delete(spark, path)
    if frames:
        frames[0].sparkSession._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_stages(spark: SparkSession) -> int:
    """Delete what :func:`cut_lineage` has written; call it when results that read it are done."""
    paths, _STAGES[:] = list(_STAGES), []
    for path in paths:
        _delete(spark, path)
    return len(paths)
