"""Exact nearest neighbours by pivots, without pairing all rows.

Reference vectors are assigned to the nearest of a bounded set of pivots (a Voronoi cell).  A
query first searches its own cell, which bounds the distance of its k-th neighbour; then it
visits only cells that can hold anything closer (triangle inequality and the half-space
between two pivots).  Cells are cut into blocks of bounded size, the queries that visit a cell
into packs of bounded size, so a task holds one pack and one block, whatever the cell sizes.
Inside a block neighbouring vectors lie in leaves with a bounding box, and a query reads the
leaves in its reach only; wide vectors, which boxes do not tell apart, are measured
against the whole block by a matrix product.  Copies of a vector are searched once and carry a
count; a query travels under a number, not with its vector, once it has been searched.

Nothing is approximated and no candidate list is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_col
from ..session import store_rows

BLOCK = 32768  # vectors per packed reference block
QUERY_BLOCK = 32768  # vectors per packed query block
NUMBERS = 1 << 21  # numbers a block of wide vectors holds at most; a quarter of it a pack of queries
MAX_PIVOTS = 4096  # bounds what the driver and the closures hold
LEAF = 32  # reference vectors per leaf
TILE = 128  # neighbouring queries measured against the leaves at a time
WIDE = 12  # from so many dimensions on, a block is searched whole


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed dimension by dimension so that copies are exactly at 0."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = a[:, d, None] - b[None, :, d]
        gap *= gap
        out += gap
    return out


def _pieces(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """Small pieces of the batches, so that a matrix of rows by pivots stays within some megabytes."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def _by_place(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows in which neighbours stand together: halved at the median of the widest side."""
    order = np.arange(len(x))[None, :]
    while order.shape[1] > leaf:
        parts = x[order]  # segments of one length; repeated places fill up the last one
        side = (parts.max(axis=1) - parts.min(axis=1)).argmax(axis=1)
        values = np.take_along_axis(parts, side[:, None, None], axis=2)[:, :, 0]
        half = -(-order.shape[1] // 2)
        ranked = np.take_along_axis(order, np.argpartition(values, half - 1, axis=1), axis=1)
        if ranked.shape[1] % 2:
            ranked = np.concatenate([ranked, ranked[:, -1:]], axis=1)
        order = ranked.reshape(-1, half)
    flat = order.ravel()
    return flat[np.sort(np.unique(flat, return_index=True)[1])]


def _top(d2: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the smallest per row, ascending."""
    near = np.argpartition(d2, top - 1, axis=1)[:, :top] if top < d2.shape[1] else np.broadcast_to(np.arange(d2.shape[1]), d2.shape)
    values = np.take_along_axis(d2, near, axis=1)
    order = np.argsort(values, axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1), np.take_along_axis(values, order, axis=1)


def _whole_block(q: np.ndarray, r: np.ndarray, top: int) -> Iterator[tuple]:
    """Nearest vectors by a matrix product; whatever its rounding may hide is measured again."""
    middle = r.mean(axis=0)
    rc, rows = r - middle, max(1, min(256, (1 << 22) // len(r)))
    lengths = (rc**2).sum(axis=1)
    for at in range(0, len(q), rows):
        part = q[at : at + rows]
        qc = part - middle
        own = (qc**2).sum(axis=1)
        rough = lengths[None, :] - 2.0 * (qc @ rc.T) + own[:, None]
        slack = 1e-13 * q.shape[1] * (own + lengths.max())
        count = top + 8
        while count < len(r):
            near = np.argpartition(rough, count - 1, axis=1)[:, :count]
            ranked = np.sort(np.take_along_axis(rough, near, axis=1), axis=1)
            if (ranked[:, -1] > ranked[:, top - 1] + 2 * slack).all():
                break
            count *= 4
        else:
            near = np.broadcast_to(np.arange(len(r)), rough.shape)
        d2 = np.zeros(near.shape)
        for d in range(q.shape[1]):
            d2 += (part[:, d, None] - r[near, d]) ** 2
        pick, values = _top(d2, top)
        yield np.arange(at, at + len(part)), np.take_along_axis(near, pick, axis=1), values


def _by_leaves(q: np.ndarray, bound: np.ndarray, r: np.ndarray, top: int) -> Iterator[tuple]:
    """Nearest vectors of a block in the order of ``_by_place``: a query's nearest leaves bound its distance, then it reads all leaves in reach."""
    starts = np.arange(0, len(r), LEAF)
    low, high = np.minimum.reduceat(r, starts, axis=0), np.maximum.reduceat(r, starts, axis=0)
    cells = np.full((len(starts) * LEAF, r.shape[1]), np.inf)
    cells[: len(r)] = r
    cells = np.ascontiguousarray(cells.T).reshape(r.shape[1], len(starts), LEAF)
    first = min(len(starts), 2 + -(-top // LEAF))

    def read(part: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        d2 = np.zeros((*leaves.shape, LEAF))
        for d in range(part.shape[1]):
            gap = cells[d][leaves]
            gap -= part[:, d, None, None]
            gap *= gap
            d2 += gap
        return d2.reshape(len(part), -1)

    def boxes(part: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        away = np.zeros((len(part), len(leaves)))
        for d in range(part.shape[1]):
            gap = np.maximum(low[leaves, d] - part[:, d, None], part[:, d, None] - high[leaves, d])
            np.maximum(gap, 0.0, out=gap)
            gap *= gap
            away += gap
        return away

    order, around = _by_place(q, TILE), min(len(starts), 4 * first + 8)
    for at in range(0, len(q), TILE):
        here = order[at : at + TILE]
        part = q[here]
        reach = np.square(bound[here] * (1 + 1e-9) + 1e-12)
        seen = np.arange(len(starts))
        if around < len(starts):
            # Leaves around the tile bound its queries; what lies beyond the widest bound is out for all of them.
            gap = np.maximum(np.maximum(low - part.max(axis=0), part.min(axis=0) - high), 0.0)
            apart = (gap * gap).sum(axis=1)
            off = (low + high) / 2 - part.mean(axis=0)
            some = np.argpartition((off * off).sum(axis=1), around - 1)[:around]
            close = some[np.argpartition(boxes(part, some), first - 1, axis=1)[:, :first]]
            reach = np.minimum(reach, np.partition(read(part, close), top - 1, axis=1)[:, top - 1])
            seen = np.flatnonzero(apart <= reach.max() * (1 + 1e-9))
            if not len(seen):
                continue
        away = boxes(part, seen)
        count = (away <= (reach * (1 + 1e-9))[:, None]).sum(axis=1)
        # Queries that read about as many leaves go together.
        level = np.ceil(np.log2(np.maximum(count, 1))).astype(int)
        for step in np.unique(level[count > 0]):
            rows = np.flatnonzero((level == step) & (count > 0))
            most = int(count[rows].max())
            for some in np.array_split(rows, -(-len(rows) * most * LEAF // NUMBERS)):
                leaves = seen[np.argpartition(away[some], most - 1, axis=1)[:, :most]]
                pick, values = _top(read(part[some], leaves), min(top, most * LEAF))
                near = np.take_along_axis(leaves, pick // LEAF, axis=1) * LEAF + pick % LEAF
                yield here[some], np.minimum(near, len(r) - 1), values


def _distinct(df: DataFrame, vec: str) -> DataFrame:
    return df.select(F.transform(as_col(vec), lambda x: x.cast("double")).alias("vec")).groupBy(
        "vec"
    ).agg(F.count(F.lit(1)).alias("copies"))


class PivotIndex:
    """Distinct reference vectors with their cell, and the per-cell facts on the driver."""

    def __init__(self, ref: DataFrame, vec: str, seed: int = 42, pivots: int | None = None):
        vectors = _distinct(ref, vec)
        n = vectors.count()
        if n == 0:
            raise ValueError("no reference vectors")
        width = vectors.select(F.max(F.size("vec"))).first()[0]
        self.block = max(1, min(BLOCK, NUMBERS // max(1, width)))
        # Half a block per cell; no more cells than vectors in one.
        wanted = pivots or max(1, min(MAX_PIVOTS, math.isqrt(n), -(-2 * n // self.block)))
        picked = vectors.orderBy(F.xxhash64(F.lit(seed), "vec"), "vec").limit(wanted)
        self.pivots = _matrix(picked.toPandas()["vec"])
        pivot_matrix = self.pivots

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in _pieces(batches):
                d2 = _squared(_matrix(pdf["vec"]), pivot_matrix)
                cell = d2.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), reach=np.sqrt(d2[np.arange(len(pdf)), cell]))

        # The cells are read several times and must be the same each time.
        self.members = store_rows(
            vectors.mapInPandas(
                assign, "vec array<double>, copies bigint, cell int, reach double"
            )
        )
        facts = self.members.groupBy("cell").agg(
            F.count(F.lit(1)).alias("size"), F.sum("copies").alias("rows"),
            F.max("reach").alias("far"), F.min("reach").alias("near"),
        ).toPandas()
        p = len(self.pivots)
        self.size = np.zeros(p, dtype="int64")
        self.rows = np.zeros(p, dtype="int64")
        self.far, self.near = np.full(p, -np.inf), np.full(p, np.inf)
        at = facts["cell"].to_numpy()
        self.size[at], self.rows[at] = facts["size"], facts["rows"]
        self.far[at], self.near[at] = facts["far"], facts["near"]
        self.blocks = np.maximum(1, -(-self.size // self.block))

    def packed(self) -> DataFrame:
        """Reference blocks: cell, block, its vectors laid end to end by place, and their copies."""
        per_cell = F.array(*[F.lit(int(b)) for b in self.blocks])
        block = F.pmod(F.xxhash64("vec"), F.get(per_cell, F.col("cell"))).cast("int")
        width = self.pivots.shape[1]

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for cell, block, flat, copies in zip(pdf["cell"], pdf["block"], pdf["members"], pdf["copies"]):
                    r = flat.reshape(-1, width)
                    order = _by_place(r, LEAF) if width < WIDE else np.arange(len(r))
                    yield pd.DataFrame({"cell": [cell], "block": [block], "members": [r[order].ravel()], "copies": [copies[order]]})

        blocks = (
            self.members.withColumn("block", block)
            .groupBy("cell", "block")
            .agg(F.collect_list(F.struct("vec", "copies")).alias("_m"))
            .select(
                "cell", "block",
                F.flatten("_m.vec").alias("members"), F.col("_m.copies").alias("copies"),
            )
        )
        return blocks.mapInPandas(placed, "cell int, block int, members array<double>, copies array<bigint>")


_PACK_SCHEMA = "cell int, rows bigint, queries array<double>"


def _packs(index: PivotIndex, k: int, further: bool):
    """Query vectors packed per visited cell, each followed by its bound and its number.

    First visit (``further`` off): the nearest cells that together hold at least k rows.
    Second visit: all other cells that may hold a vector nearer than the k-th so far.
    """
    pivots, rows, far, near = index.pivots, index.rows, index.far, index.near
    gaps = np.sqrt(_squared(pivots, pivots))
    gaps[gaps == 0] = np.inf

    def visits(bound: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d2 = _squared(x, pivots)
        home = d2.argmin(axis=1)
        first = np.zeros(d2.shape, dtype=bool)
        first[np.arange(len(x)), home] = True
        poor = np.flatnonzero(rows[home] < k)
        if len(poor):
            order = np.argsort(d2[poor], axis=1, kind="stable")
            held = np.cumsum(rows[order], axis=1)
            some = np.zeros(order.shape, dtype=bool)
            np.put_along_axis(some, order, (held - rows[order]) < k, axis=1)
            first[poor] = some
        first &= rows > 0
        if not further:
            return np.nonzero(first)
        own = d2[np.arange(len(x)), home]
        dist = np.sqrt(d2)
        # The slack covers rounding in the bounds; it only adds visits.
        reach = bound * (1 + 1e-9) + 1e-12
        i, c = np.nonzero(((dist - far) <= reach[:, None]) & ~first)
        half_space = (d2[i, c] - own[i]) / (2 * gaps[home[i], c])
        kept = (np.maximum(near[c] - dist[i, c], half_space) <= reach[i]) & (rows[c] > 0)
        return i[kept], c[kept]

    def packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = 4 * NUMBERS // (pivots.shape[1] + 2)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pd.DataFrame:
            cells = np.concatenate([c for c, _ in waiting])
            order = np.argsort(cells, kind="stable")
            found, starts = np.unique(cells[order], return_index=True)
            parts = np.split(np.concatenate([x for _, x in waiting])[order], starts[1:])
            waiting.clear()
            return pd.DataFrame({"cell": found.astype("int32"), "rows": [len(p) for p in parts], "queries": [p.ravel() for p in parts]})

        held = 0
        for pdf in _pieces(batches):
            x = _matrix(pdf["vec"])
            bound = pdf["bound"].to_numpy(dtype=float) if further else np.full(len(x), np.inf)
            row, cell = visits(bound, x)
            if not len(row):
                continue
            # a query, how far it still looks, and its number
            waiting.append((cell, np.column_stack([x, bound, pdf["number"].to_numpy(dtype=float)])[row]))
            held += len(row)
            if held > most:
                yield flush()
                held = 0
        if waiting:
            yield flush()

    return packs


def _search(
    index: PivotIndex, packs: DataFrame, k: int, skip_self: bool, with_vectors: bool
) -> DataFrame:
    """Candidates of every query: ``number, found`` with up to k nearest of the visited block."""
    width = index.pivots.shape[1]
    size = max(1, min(QUERY_BLOCK, NUMBERS // 4 // (width + 2)))
    packs = store_rows(packs)
    asked = np.zeros(len(index.pivots), dtype="int64")
    for row in packs.groupBy("cell").agg(F.sum("rows").alias("rows")).collect():  # one row per pivot
        asked[row["cell"]] = row["rows"]
    # As many packs per cell as its queries fill, each with a copy of the cell's blocks.
    per_cell = F.array(*[F.lit(int(max(1, -(-a // size)))) for a in asked])
    copies = F.get(per_cell, F.col("cell"))
    # The work is in the packs, not in their bytes: one task for about each of them.
    tasks = max(1, min(MAX_PIVOTS, int(np.ceil(asked / size).sum())))
    queries = (
        packs.withColumn("copy", F.pmod(F.xxhash64(F.get("queries", width + 1)), copies).cast("int"))
        .repartition(tasks, "cell", "copy")
        .groupBy("cell", "copy").agg(F.flatten(F.collect_list("queries")).alias("queries"))
    )
    refs = index.packed().withColumn("copy", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1)))
    pairs = queries.join(refs, ["cell", "copy"]).select("queries", "members", "copies")

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for flat_q, flat_r, counts in zip(pdf["queries"], pdf["members"], pdf["copies"]):
                q, r = flat_q.reshape(-1, width + 2), flat_r.reshape(-1, width)
                number, bound, q = q[:, -1].astype("int64"), q[:, -2], np.ascontiguousarray(q[:, :-2])
                counts, top = np.asarray(counts), min(k + 1, len(r))
                hits = _whole_block(q, r, top) if width >= WIDE else _by_leaves(q, bound, r, top)
                out = []
                for rows, near, near_d2 in hits:
                    times = np.where(near_d2 < np.inf, counts[near], 0)
                    if skip_self:
                        times = times - (near_d2 == 0)
                    before = np.cumsum(times, axis=1) - times
                    times = np.clip(np.minimum(times, k - before), 0, None).astype("int32")
                    dist = np.sqrt(near_d2)
                    kept = (times > 0) & (dist <= bound[rows, None] * (1 + 1e-9) + 1e-12)
                    for i in np.flatnonzero(kept.any(axis=1)):
                        on = kept[i]
                        out.append((number[rows[i]], dist[i, on], times[i, on], r[near[i, on]].ravel() if with_vectors else None))
                if out:
                    yield pd.DataFrame(out, columns=["number", "dist", "times", "near"])

    hits = pairs.mapInPandas(
        nearest,
        "number bigint, dist array<double>, times array<int>, near array<double>",
    )
    one = lambda d, i: F.struct(
        d.alias("dist"),
        F.get("times", i).alias("times"),
        (
            F.slice("near", i * F.lit(width) + F.lit(1), F.lit(width))
            if with_vectors
            else F.lit(None).cast("array<double>")
        ).alias("vec"),
    )
    return hits.select("number", F.transform("dist", one).alias("found"))


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k nearest over all visited blocks: ``number, found, bound``.

    A block's own nearest are ranked and cut already, so only queries of several blocks go through the rows one by one.
    """
    merged = found.groupBy("number").agg(F.collect_list("found").alias("_lists")).withColumn(
        "found", F.array_sort(F.flatten("_lists")))
    start = F.struct(
        F.lit(0).alias("held"),
        F.filter("found", lambda x: F.lit(False)).alias("kept"),
    )
    step = lambda acc, x: F.struct(
        F.least(acc["held"] + x["times"], F.lit(k)).alias("held"),
        F.when(
            acc["held"] < k,
            F.array_append(
                acc["kept"],
                F.struct(
                    x["dist"].alias("dist"),
                    F.least(x["times"], F.lit(k) - acc["held"]).alias("times"),
                    x["vec"].alias("vec"),
                ),
            ),
        ).otherwise(acc["kept"]).alias("kept"),
    )
    trimmed = merged.withColumn("_k", F.when(F.size("_lists") == 1, F.col("found")).otherwise(F.aggregate("found", start, step)["kept"]))
    kept = F.col("_k")
    held = F.aggregate(kept, F.lit(0), lambda a, x: a + x["times"])
    last = F.try_element_at(kept, F.lit(-1))["dist"]
    return trimmed.select(
        "number",
        kept.alias("found"),
        F.when(held >= k, last).otherwise(F.lit(float("inf"))).alias("bound"),
    )


def nearest_vectors(
    index: PivotIndex, queries: DataFrame, vec: str, k: int, skip_self: bool = False,
    with_vectors: bool = True,
) -> DataFrame:
    """k nearest reference vectors of every distinct query vector.

    Gives ``vec`` and ``found``: distance, how many of the k places it takes (copies), vector;
    nearest first.  ``skip_self`` leaves out one copy of the query vector itself.
    """
    # The numbers are read several times and must be the same each time.
    distinct = store_rows(_distinct(queries, vec).select("vec", F.monotonically_increasing_id().alias("number")))
    want = k + 1 if skip_self else k
    first = distinct.mapInPandas(_packs(index, want, False), _PACK_SCHEMA)
    first = store_rows(_merge(_search(index, first, k, skip_self, with_vectors), k))
    looking = distinct.hint("merge").join(first.select("number", "bound"), "number", "left").select(
        "vec", "number", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    more = looking.mapInPandas(_packs(index, want, True), _PACK_SCHEMA)
    more = _search(index, more, k, skip_self, with_vectors)
    merged = _merge(first.select("number", "found").unionByName(more), k).select("number", "found")
    return distinct.hint("merge").join(merged, "number").select("vec", "found")


def knn_distance(
    ref: DataFrame, app: DataFrame, id_col: str, vec: str, k: int = 10,
    k_app: int | None = None, seed: int = 42, pivots: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Mean distance to the nearest reference rows: (reference rows, application rows).

    A reference row does not count itself.  ``k_app`` is the number of neighbours of an
    application row where it differs.
    """
    index = PivotIndex(ref, vec, seed, pivots)

    def distances(rows: DataFrame, n: int, skip_self: bool) -> DataFrame:
        found = nearest_vectors(index, rows, vec, n, skip_self, with_vectors=False)
        weight = lambda f: f["dist"] * f["times"]
        total = F.aggregate("found", F.lit(0.0), lambda a, f: a + weight(f))
        held = F.aggregate("found", F.lit(0), lambda a, f: a + f["times"])
        # Distances feed thresholds, histograms and joins: search once.
        mean = store_rows(found.select(F.col("vec").alias("_v"), (total / held).alias("knn_distance")))
        # Packed rows look smaller than they are, so the join is marked: neither side is broadcast.
        keyed = rows.withColumn("_k", F.transform(as_col(vec), lambda x: x.cast("double")))
        return keyed.hint("merge").join(mean, F.col("_k") == F.col("_v")).select(as_col(id_col), "knn_distance")

    return distances(ref, k, True), distances(app, k_app or k, False)
