"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "assaylake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def wide_plans(spark: SparkSession) -> None:
    """Session settings for tables of tens of derived columns.

    The optimizer restates every filter for every alias it contains; a completeness filter over
    36 text-to-number columns would be restated 2^36 times.  Switching that inference off is
    the documented remedy; pushdown and pruning are not affected.

    HotSpot never compiles a method of more than 8,000 bytes of code, so one generated loop over
    36 text columns would run interpreted for every row.  Beyond that size Spark then evaluates the
    columns by smaller generated methods, which are compiled.
    """
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


#: Spark deletes the shuffle files of a query as soon as it has ended, not when its plan is collected as garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is used only where none is configured, which is a single-machine run.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def _checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="assaylake-checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def store_rows(df: DataFrame) -> DataFrame:
    """The rows as packed Parquet beside the checkpoints: a fraction of their size, and read by column.

    The order of rows and their partitions are not kept, so nothing that draws by partition may read them.
    Spark sizes the table by its packed files, so joins of many of its rows are to be marked against broadcasts.
    The write's shuffle files are deleted at its end, since the table stands for them.  Rows that Parquet cannot
    hold (columns of no type, or of one name) are checkpointed.
    """
    spark, schema = df.sparkSession, df.schema
    if "void" in schema.simpleString() or len({c.lower() for c in df.columns}) < len(df.columns):
        return cut_lineage(df)
    path = f"{_checkpoint_folder(spark)}/rows-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, where all executors can write."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        return tempfile.mkdtemp(prefix=f"assaylake-{name}-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a scratch folder on whatever file system holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
