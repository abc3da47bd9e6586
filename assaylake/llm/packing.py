"""Packing into length buckets whose bounds minimise padding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_rank, stage, table, word_count


@dataclass(frozen=True)
class PackParams:
    """buckets: largest number of length buckets; batch_tokens: token budget of a padded batch;
    shard_rows: aimed rows per task when positions inside a bucket are counted."""

    buckets: int = 16
    batch_tokens: int = 65536
    shard_rows: int = 20_000


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least padding in total.

    Dynamic program over the ascending distinct lengths: best[k][j] is the least number of padded
    tokens (count times upper bound) of the first j lengths in k buckets.  Best split points never
    move left as j grows, so each layer is solved by divide and conquer, level by level on arrays.
    """
    n = len(lengths)
    if n == 0:
        return []
    lengths, rows = lengths.astype(np.int64), np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    best = lengths * rows[1:]  # one bucket up to each length
    choices = []
    for _ in range(1, min(buckets, n)):
        nxt, split = np.empty(n, np.int64), np.zeros(n, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            mid = (low + high) // 2
            at = np.arange(first, min(mid, last) + 1)  # lengths before `at` are in earlier buckets
            before = np.where(at > 0, best[np.maximum(at - 1, 0)], 0)
            cost = before + lengths[mid] * (rows[mid + 1] - rows[at])
            pick = int(cost.argmin())
            nxt[mid], split[mid] = cost[pick], at[pick]
            if low < mid:
                todo.append((low, mid - 1, first, int(at[pick])))
            if mid < high:
                todo.append((mid + 1, high, int(at[pick]), last))
        choices.append(split)
        best = nxt
    bounds, end = [], n - 1
    for split in reversed(choices):
        bounds.append(int(lengths[end]))
        end = int(split[end]) - 1
        if end < 0:
            break
    if end >= 0:
        bounds.append(int(lengths[end]))
    return bounds[::-1]


def pack(docs: DataFrame, params: PackParams | None = None, text: str = "text", key: str = "doc_id",
         tokens: str | None = None) -> DataFrame:
    """(key, n_tokens, bucket, bucket_tokens, batch, slot, padding), a row for every input row.

    ``bucket`` counts from 1 by length; a batch of a bucket holds as many documents as fit the token
    budget when padded to ``bucket_tokens``, one at least (documents longer than the budget are
    batches of their own).  Documents of a bucket are batched in hash order.  Lengths are words
    unless ``tokens`` names a column; null and empty texts have length 0 and share the lowest bucket.
    The length histogram has a row per distinct length, whatever the number of documents; it alone
    goes to the driver.  Repeated rows and null keys are packed like others; other columns are
    ignored; an empty table gives no row.
    """
    p = params or PackParams()
    size = word_count(text) if tokens is None else F.coalesce(F.col(tokens), F.lit(0)).cast("long")
    rows = stage(docs.select(F.col(key).alias("key"), size.alias("n_tokens"), F.xxhash64(F.lit("pack"), F.col(key)).alias("draw")), "lengths")
    seen = rows.groupBy("n_tokens").count().collect()
    seen = np.array(sorted((r["n_tokens"], r["count"]) for r in seen), np.int64).reshape(-1, 2)
    bounds = bucket_bounds(seen[:, 0], seen[:, 1], p.buckets)
    if not bounds:
        bounds = [0]
    held = np.diff(np.concatenate([[0], np.cumsum(seen[:, 1])[np.searchsorted(seen[:, 0], bounds)]])) if len(seen) else [0]
    limits, shards = F.array(*[F.lit(b).cast("long") for b in bounds]), F.array(*[F.lit(int(h) // p.shard_rows + 1) for h in held])
    at = F.size(F.filter(limits, lambda b: b < F.col("n_tokens")))
    rows = rows.withColumn("bucket", (at + 1).cast("int"))
    n = F.element_at(shards, F.col("bucket"))
    shard = F.floor((F.shiftrightunsigned("draw", 40) * n) / (1 << 24)).cast("int")  # the hash's leading bits, in order
    order = F.shiftrightunsigned("draw", 1)
    placed = spread_rank(rows.withColumn("_order", order), ["bucket"], ["_order", "key", "n_tokens"], shard)
    wide = F.element_at(limits, F.col("bucket"))
    fit = F.greatest(F.lit(1), F.floor(F.lit(p.batch_tokens) / F.greatest(F.lit(1), wide))).cast("long")
    return placed.select("key", "n_tokens", "bucket", wide.alias("bucket_tokens"), F.floor(F.col("before") / fit).cast("long").alias("batch"),
                         F.pmod(F.col("before"), fit).cast("int").alias("slot"), (wide - F.col("n_tokens")).alias("padding"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: bucket, batch and slot of every document."""
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last one: where every remaining document (draw) is packed."""
    return pack(docs).withColumnRenamed("key", "doc_id")
