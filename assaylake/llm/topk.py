"""Exact top-k inner products with an impact-ordered, score-at-a-time index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table


@dataclass(frozen=True)
class TopkParams:
    """k: results per query; levels: impact levels of the index; block_rows and query_rows: vectors
    and queries handled together; rescore: share of a block below which possible members are rescored;
    query_files: files that the groups of queries are dealt to, at most."""

    k: int = 20
    levels: int = 4
    block_rows: int = 16384
    query_rows: int = 512
    rescore: float = 0.02
    query_files: int = 256


def integer_vectors(rows: DataFrame, key: str, vector: str, scale: int = 64) -> DataFrame:
    """(key, v): components floor(scale * x); vectors null or with null or non-finite components are left out."""
    x = F.col(vector).cast("array<double>")
    fine = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return rows.select(F.col(key).alias("key"), F.when(fine, F.transform(x, lambda e: F.floor(e * scale))).alias("v")).where("v IS NOT NULL AND key IS NOT NULL")


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _compact(x: np.ndarray) -> tuple[str, bytes]:
    """Type and bytes of whole numbers in the narrowest type that holds them."""
    low, high = (x.min(), x.max()) if x.size else (0, 0)
    kind = next((t for t in (np.int8, np.int16, np.int32) if np.iinfo(t).min <= low and high <= np.iinfo(t).max), np.float64)
    return np.dtype(kind).str, x.astype(kind).tobytes()


def impact_segments(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posting segments of a block, by descending quantised impact.

    The impact of a posting (vector, dimension, value) is the size of its value, quantised to levels
    of about equally many postings.  Returns, sorted by level, then dimension (a segment is a level's
    postings of a dimension): level, dimension, vector position and value of each posting.
    """
    position, dimension = np.nonzero(x)
    value = x[position, dimension]
    size = np.abs(value)
    edges = np.quantile(size, np.linspace(0, 1, levels + 1)[1:-1]) if len(size) else np.zeros(0)
    level = levels - 1 - np.searchsorted(edges, size, "right")
    order = np.lexsort((position, dimension, level))
    return level[order].astype(np.int8), dimension[order].astype(np.int32), position[order].astype(np.int32), value[order]


def block_topk(x: np.ndarray, ids: np.ndarray, segments, queries: np.ndarray, own: np.ndarray, p: TopkParams):
    """Exact top k of a block for each query: (query number, id, score) arrays.

    Levels are processed from the highest impact down, all queries of the group at once.  After each
    one, a vector's unprocessed components bound its score from both sides (Cauchy-Schwarz on exact
    partial norms).  A vector whose upper bound is below the k-th best lower bound is proven out.
    Processing stops once few enough possible members are left, and these are rescored exactly.
    """
    level, dimension, position, value = segments
    n, width = x.shape
    partial, rest = np.zeros((len(queries), n)), (x * x).sum(axis=1)
    norm = np.sqrt((queries * queries).sum(axis=1))[:, None]
    same = own[:, None] == ids[None, :]
    k = min(p.k, n)
    possible = ~same
    ends = np.searchsorted(level, np.arange(p.levels + 1))
    for at in range(p.levels):
        lo, hi = ends[at], ends[at + 1]
        part = np.zeros((n, width))
        part[position[lo:hi], dimension[lo:hi]] = value[lo:hi]
        partial += queries @ part.T
        rest = np.maximum(rest - (part * part).sum(axis=1), 0)
        slack = norm * np.sqrt(rest)[None, :] * (1 + 1e-9)
        lower = np.where(same, -np.inf, partial - slack)
        bar = np.partition(lower, n - k, axis=1)[:, n - k][:, None]
        possible = (partial + slack >= bar) & ~same
        if possible.mean() <= p.rescore:
            break
    which, vec, score = [], [], []
    for q in range(len(queries)):
        members = np.flatnonzero(possible[q])
        exact = x[members] @ queries[q]
        best = np.lexsort((ids[members], -exact))[:k]
        which.append(np.full(len(best), q)), vec.append(ids[members][best]), score.append(exact[best])
    return np.concatenate(which), np.concatenate(vec), np.concatenate(score)


def top_k(vectors: DataFrame, queries: DataFrame, params: TopkParams | None = None) -> DataFrame:
    """(query, rank, key, score): each query's ``k`` highest integer inner products over all other rows.

    Both inputs have (key, v) as integer_vectors() gives them.  Ties go to the smaller key.  Vectors
    are dealt to blocks by a hash of their key; each block becomes one index row of impact-ordered
    posting segments in the shared folder, a group of queries one row too.  Groups of queries meet every block (a stated query set
    against all rows, in blocks), read from there by each task; a task passes on ``k`` rows per query, merged at the end.

    A query never finds rows of its own key; a key that repeats is queried once and found as often as
    it occurs.  Shorter vectors count as filled up with zeros.  Scores are exact up to 2**53.  Empty
    tables, and queries without another row, give no rows.
    """
    p = params or TopkParams()
    kept = stage(vectors, "vectors")
    size = kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    blocks, width = max(1, -(-size.n // p.block_rows)), size.width

    parts = ("level", "dimension", "position", "value")

    def build(batches: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(batches["v"], width), batches["key"].to_numpy(np.int64)
        packs = [_compact(part) for part in impact_segments(x, p.levels)]
        return pd.DataFrame({"block": [batches["block"].iloc[0]], "ids": [ids.tobytes()], "kinds": [" ".join(kind for kind, _ in packs)]}
                            | {name: [held] for name, (_, held) in zip(parts, packs)})

    shape = "block int, ids binary, kinds string, level binary, dimension binary, position binary, value binary"
    placed = kept.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "key"), F.lit(blocks)).cast("int"))
    index = stage(placed.groupBy("block").applyInPandas(build, shape), "index")
    asked = stage(queries.dropDuplicates(["key"]), "queries")
    groups = max(1, -(-asked.count() // p.query_rows))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        kind, held = _compact(_matrix(group["v"], width))
        return pd.DataFrame({"own": [group["key"].to_numpy(np.int64).tobytes()], "kind": [kind], "q": [held]})

    grouped = asked.withColumn("g", F.pmod(F.xxhash64(F.lit("group"), "key"), F.lit(groups))).repartition(min(groups, p.query_files), "g")
    packed = stage(grouped.groupBy("g").applyInPandas(pack, "own binary, kind string, q binary"), "packed")
    # Every block's file meets every group's file where they are read: nothing is shuffled, broadcast or multiplied on disk.
    met = index.crossJoin(packed.hint("shuffle_replicate_nl"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None  # the block at hand; all groups of a task meet it before the next one
        for b in batches:
            for row in range(b.num_rows):
                own_, kind, q_, block = (b.column(i)[row].as_py() for i in range(4))
                if block != at:
                    ids_, kinds, *held = (b.column(i)[row].as_py() for i in range(4, 10))
                    at, ids = block, np.frombuffer(ids_, np.int64)
                    segments = [np.frombuffer(part, t) for part, t in zip(held, kinds.split(" "))]
                    segments[3] = segments[3].astype(np.float64)
                    x = np.zeros((len(ids), width))
                    x[segments[2], segments[1]] = segments[3]
                own = np.frombuffer(own_, np.int64)
                asking = np.frombuffer(q_, kind).astype(np.float64).reshape(len(own), width)
                which, vec, score = block_topk(x, ids, segments, asking, own, p)
                yield pa.RecordBatch.from_arrays([pa.array(own[which]), pa.array(vec), pa.array(score.astype(np.int64))], ["query", "key", "score"])

    found = met.select("own", "kind", "q", "block", "ids", "kinds", *parts).mapInArrow(each, "query long, key long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("key"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).select("query", "rank", "key", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the 20 best of all other rows for every vec_id divisible by 20."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.pmod("key", F.lit(20)) == 0)).select(
        F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
