"""Centroid clustering of integer vectors over subvector dictionaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: Components beyond this could make a squared distance overflow 64 bits.
LARGEST = 1 << 26


@dataclass(frozen=True)
class ClusterParams:
    """dims: components of a vector; scale: a component x becomes floor(scale * x); clusters, rounds,
    seed: of the clustering; chunk: vectors that share dictionaries; merge: neighbouring blocks of
    dimensions become one while the joint dictionary has at most one entry per ``merge`` vectors."""

    dims: int = 64
    scale: int = 256
    clusters: int = 40
    rounds: int = 5
    seed: int = 2
    chunk: int = 1 << 14
    merge: int = 8


def whole_vectors(df: DataFrame, p: ClusterParams, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, v): integer vectors of the rows with exactly ``dims`` components, all finite."""
    x = F.col(vector)
    fine = (F.size(x) == p.dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.where(F.coalesce(x.isNotNull() & fine, F.lit(False))) \
        .select(F.col(key).alias("key"), F.transform(x, lambda e: F.floor(F.lit(p.scale) * e.cast("double"))).alias("v"))


def first_centroids(vectors: DataFrame, p: ClusterParams) -> np.ndarray:
    """The vectors whose keys have the smallest digests of ``seed:key``; equal digests by vector, null keys never."""
    digest = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("key").cast("string")).cast("binary"), 256)
    rows = vectors.where("key IS NOT NULL").select(digest.alias("d"), "v").orderBy("d", "v").limit(p.clusters).collect()  # bounded by clusters
    return np.array([r.v for r in rows], np.int64).reshape(-1, p.dims)


def encode_chunk(x: np.ndarray, merge: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Dictionaries of a chunk: (first dimension, width, distinct subvectors, code of every vector).

    Lossless: ``distinct[code]`` gives the block back.  Blocks start with one dimension each;
    neighbours of equal width are joined as long as their joint dictionary stays small.
    """
    blocks = []
    for d in range(x.shape[1]):
        distinct, code = np.unique(x[:, d], return_inverse=True)
        blocks.append((d, 1, distinct[:, None], code))
    while True:
        out, at, joined = [], 0, False
        while at < len(blocks):
            a = blocks[at]
            b = blocks[at + 1] if at + 1 < len(blocks) else None
            if b is not None and a[1] == b[1]:
                pair, code = np.unique(a[3].astype(np.int64) * len(b[2]) + b[3], return_inverse=True)
                if merge * len(pair) <= len(x):
                    rows = np.concatenate([a[2][pair // len(b[2])], b[2][pair % len(b[2])]], axis=1)
                    out.append((a[0], a[1] + b[1], rows, code))
                    at, joined = at + 2, True
                    continue
            out.append(a)
            at += 1
        blocks = out
        if not joined:
            return blocks


def encoded(vectors: DataFrame, p: ClusterParams) -> DataFrame:
    """(keys, starts, widths, sizes, entries, codes): chunks of vectors as dictionaries and codes."""
    kind = vectors.schema["key"].dataType.simpleString()
    schema = f"keys array<{kind}>, starts array<int>, widths array<int>, sizes array<int>, entries binary, codes binary"
    names = ["keys", "starts", "widths", "sizes", "entries", "codes"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def chunk() -> pa.RecordBatch:
            keys = pa.concat_arrays([b.column(0) for b in held])
            x = np.concatenate([np.asarray(b.column(1).flatten(), np.int64).reshape(-1, p.dims) for b in held])
            if np.abs(x).max() > LARGEST:
                raise ValueError(f"a component beyond {LARGEST} would make distances overflow")
            blocks = encode_chunk(x, p.merge)
            entries = np.concatenate([b[2].ravel() for b in blocks]).astype(np.int32)
            codes = np.concatenate([b[3] for b in blocks]).astype(np.uint16 if len(x) <= 1 << 16 else np.uint32)
            lists = [pa.array([[int(v) for v in c]], pa.list_(pa.int32())) for c in zip(*[(b[0], b[1], len(b[2])) for b in blocks])]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *lists,
                                               pa.array([entries.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())], names)

        size = 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, p.chunk - size)
                held.append(part)
                size += part.num_rows
                b = b.slice(part.num_rows)
                if size == p.chunk:
                    yield chunk()
                    held, size = [], 0
        if held:
            yield chunk()

    return vectors.select("key", "v").mapInArrow(each, schema)


class Chunk:
    """A chunk read back: distances of all its vectors come from one table per block."""

    def __init__(self, row: dict):
        self.n = len(row["keys"])
        self.blocks, entry, code = [], 0, 0
        entries = np.frombuffer(row["entries"], np.int32)
        codes = np.frombuffer(row["codes"], np.uint16 if self.n <= 1 << 16 else np.uint32)
        for start, width, size in zip(row["starts"], row["widths"], row["sizes"]):
            self.blocks.append((start, width, entries[entry:entry + size * width].reshape(size, width).astype(np.int64), codes[code:code + self.n]))
            entry, code = entry + size * width, code + self.n

    def distances(self, centroids: np.ndarray, rows: slice) -> np.ndarray:
        """Exact squared distances of the vectors in ``rows`` to all centroids; tables are made once."""
        if not hasattr(self, "tables"):
            self.tables = [((d[:, None, :] - centroids[None, :, s:s + w]) ** 2).sum(axis=2) for s, w, d, _ in self.blocks]
        total = np.zeros((rows.stop - rows.start, len(centroids)), np.int64)
        for t, (_, _, _, code) in zip(self.tables, self.blocks):
            total += t[code[rows]]
        return total

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid, the smaller one of equals, and the distance."""
        best, value = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for at in range(0, self.n, 4096):
            rows = slice(at, min(self.n, at + 4096))
            d = self.distances(centroids, rows)
            best[rows] = d.argmin(axis=1)
            value[rows] = d[np.arange(len(d)), best[rows]]
        return best, value

    def sums(self, best: np.ndarray, clusters: int, dims: int) -> np.ndarray:
        """Componentwise sums per cluster, by counting codes per cluster: sums of dictionary entries."""
        out = np.zeros((clusters, dims), np.int64)
        for s, w, d, code in self.blocks:
            pairs, n = np.unique(best * len(d) + code, return_counts=True)
            np.add.at(out, (pairs // len(d), slice(s, s + w)), d[pairs % len(d)] * n[:, None])
        return out


def moved(chunks: DataFrame, centroids: np.ndarray, p: ClusterParams) -> np.ndarray:
    """Centroids after one round: assign every vector, then the floor of each component's mean."""
    sums = [f"s{i}" for i in range(p.dims)]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((len(centroids), p.dims), np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            for row in b.to_dict("records"):
                chunk = Chunk(row)
                best, _ = chunk.nearest(centroids)
                total += chunk.sums(best, len(centroids), p.dims)
                count += np.bincount(best, minlength=len(centroids))
        frame = pd.DataFrame(total, columns=sums)
        frame.insert(0, "n", count)
        frame.insert(0, "cluster", np.arange(len(centroids), dtype=np.int32))
        yield frame[frame.n > 0]

    schema = "cluster int, n long, " + ", ".join(f"{s} long" for s in sums)
    got = chunks.mapInPandas(each, schema).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect()
    out = centroids.copy()  # a row per cluster came back
    for r in got:
        out[r.cluster] = [r[s] // r.n for s in sums]
    return out


def cluster(df: DataFrame, params: ClusterParams | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row per vector that takes part.

    Integer k-means: components become floor(scale * x); the vectors with the smallest key digests
    are the first centroids; each round assigns every vector to the nearest centroid (the smaller
    number of equals) and replaces non-empty centroids by the floor of their vectors' mean.

    Vectors are stored once as chunks of dictionary codes: every block of dimensions holds each of
    its distinct subvectors once.  A round computes the exact distances of these to the centroids,
    and a vector's distance is a sum over its codes.  Only the centroids, clusters x dims numbers, go
    to the tasks and their sums come back, whatever the number of vectors; no vector is shuffled.

    Vectors that are null, of another length, or hold null or non-finite components give no row.
    Null keys are clustered but never first centroids; repeated rows repeat and count as often; with
    fewer vectors than clusters there are fewer centroids; an empty table gives no row.  Components
    whose integer exceeds 2 ** 26 raise an error, as distances could overflow.  Other columns are ignored.
    """
    p = params or ClusterParams()
    vectors = whole_vectors(df, p, vector, key)
    centroids = first_centroids(vectors, p)
    kind = vectors.schema["key"].dataType.simpleString()
    if not len(centroids):
        return df.sparkSession.createDataFrame([], f"key {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    chunks = stage(encoded(vectors, p), "vector-chunks")
    for _ in range(p.rounds):
        centroids = moved(chunks, centroids, p)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(b.to_pylist()):
                best, distance = Chunk(row).nearest(centroids)
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(best.astype(np.int32)), pa.array(distance)], ["key", "cluster", "distance"])

    out = stage(chunks.mapInArrow(each, f"key {kind}, cluster int, distance long"), "assigned")
    totals = out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()  # a row per cluster
    own, whole = {r.cluster: r.d for r in totals}, sum(r.d for r in totals)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def by_cluster(values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster"))

    return out.select("key", "cluster", "distance", by_cluster([own.get(i, 0) for i in range(len(centroids))]).cast("long").alias("cluster_inertia"),
                      F.lit(whole).cast("long").alias("inertia"), by_cluster(digest).alias("centroid_sha256"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: cluster of every vector of ``embeddings``."""
    return cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("key", "vec_id")


def _round_sql(i: int) -> str:
    return f"""
a{i} AS MATERIALIZED (SELECT r, vec_id, v, cluster, distance FROM (
  SELECT e.r, e.vec_id, e.v, c.cluster, CAST(list_sum(list_transform(range(1, 65), lambda j: (e.v[j] - c.v[j]) * (e.v[j] - c.v[j]))) AS BIGINT) AS distance
  FROM e CROSS JOIN c{i} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1),
"""


def _moved_sql(i: int) -> str:
    return f"""
m{i} AS MATERIALIZED (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
  SELECT cluster, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, 65) t(j) GROUP BY cluster, j) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (cluster)),
"""


OP12_SQL = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS cluster, v FROM e WHERE vec_id IS NOT NULL
  ORDER BY cluster LIMIT 40),
""" + "".join(_round_sql(i) + _moved_sql(i) for i in range(5)) + _round_sql(5) + """
t AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS d FROM a5 GROUP BY cluster)
SELECT a.vec_id, a.cluster, a.distance, t.d AS cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM t) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a5 a JOIN t USING (cluster) JOIN c5 c USING (cluster)
"""
