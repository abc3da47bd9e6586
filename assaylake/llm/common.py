"""Shared helpers: staged tables in the shared folder, components, spread ranks, sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, in every operator of this subpackage: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark deletes the shuffle files of a query as soon as it has ended, not when its plan is collected as garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STAGED: list[str] = []  # tables in the shared folder that release() deletes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests on one machine) a temporary folder is made once per session.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("assaylake.llm.shared", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="assaylake-llm-")
        spark.conf.set("assaylake.llm.shared", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here.

    A lost executor then costs only the tasks that were running; earlier work is not redone.  What the
    write shuffled is deleted at its end, since the written table stands for it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex[:12]}-{name}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    _STAGED.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._assaylake_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables whose last reader has itself been staged; they must be results of ``stage``."""
    for df in tables:
        path = df._assaylake_path
        if path in _STAGED:
            _STAGED.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    at = hadoop.Path(path)
    at.getFileSystem(conf).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete all tables staged so far; to be called once results that read them are written."""
    while _STAGED:
        _delete(spark, _STAGED.pop())


def small_side(df: DataFrame, bytes_a_row: int = 64, bound_bytes: int = 16 << 20) -> DataFrame:
    """Marks a staged side for broadcast if its counted rows fit the bound; else leaves it to the planner.

    A hashed row of one long takes about 64 bytes.
    """
    return F.broadcast(df) if df.count() * bytes_a_row <= bound_bytes else df


def word_count(text: Column | str) -> Column:
    """Number of words of a text; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the smallest node.

    Alternates large-star and small-star steps, each a grouped minimum and an equi-join; the number
    of rounds grows with the logarithm of the longest path.  Nodes may be any ordered type without
    nulls; an empty edge table gives an empty result.  Each round is staged in the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    now = stage(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen.n == 0 or (seen.n, seen.h) == before:
            break
        before = (seen.n, seen.h)
        both = now.select("a", "b").unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(a.alias("u"), F.least(a, F.col("m")).alias("m"))
        large = both.join(low, a == F.col("u")).where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(a.alias("u"), "m")
        small = large.join(low, a == F.col("u")).select(b.alias("a"), F.col("m").alias("b")) \
            .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        old, now = now, stage(small.where(a != b).distinct(), "edges")
        discard(old)
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(a.alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def spread_rank(rows: DataFrame, group: list[str], order: list[str], shard: Column,
                size: Column | None = None) -> DataFrame:
    """Adds ``before`` (sum of ``size``, or rows, ahead of the row within its group) without one task per group.

    ``shard`` must not decrease along ``order``.  Sums per shard are ranked in a small window, rows
    only within their shard, so a group with a third of all rows is spread over its shards.
    """
    size = F.lit(1).cast("long") if size is None else size
    rows = rows.withColumn("_shard", shard).withColumn("_size", size)
    sums = rows.groupBy(*group, "_shard").agg(F.sum("_size").alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_shard").alias("_g_shard"),
                       F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    same = F.col("_shard").eqNullSafe(F.col("_g_shard"))
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    within = Window.partitionBy(*group, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_in", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(sums, same) \
        .withColumn("before", F.col("_base") + F.col("_in")) \
        .drop("_shard", "_size", "_in", "_base", "_g_shard", *[f"_g_{c}" for c in group])
