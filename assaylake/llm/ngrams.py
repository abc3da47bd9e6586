"""Byte n-gram counts and modified Kneser-Ney estimates, shared by the two perplexity operators.

The unit is a byte of the UTF-8 text.  An n-gram of up to seven bytes packs into one 64-bit
integer without collisions, every text can be scored without unknown symbols, and the number of
distinct n-grams grows far more slowly than the text.  Each document is padded at its start with
order - 1 bytes 0x02 and at its end with one byte 0x03; n-grams never cross documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

_FLUSH = 1 << 22  # distinct n-grams held by a task before it passes counts on
CHUNK = 2 << 20  # bytes of text handled at once
_START, _END = b"\x02", b"\x03"


def padded(text: bytes, order: int) -> np.ndarray:
    return np.frombuffer(_START * (order - 1) + text + _END, np.uint8)


def codes(padded_bytes: np.ndarray, order: int) -> np.ndarray:
    """Packed n-gram ending at each byte from the order-th one on."""
    n = len(padded_bytes) - order + 1
    out = padded_bytes[:n].astype(np.int64)
    for i in range(1, order):
        out <<= 8
        out |= padded_bytes[i:i + n]
    return out


def text_codes(texts: Iterator[tuple[int, bytes]], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (document numbers, codes) with about CHUNK codes; long texts come in pieces."""
    held, of, size = [], [], 0
    for number, text in texts:
        row = padded(text, order)
        for at in range(0, len(row) - order + 1, CHUNK):
            part = codes(row[at:at + CHUNK + order - 1], order)
            held.append(part), of.append(np.full(len(part), number, np.int32))
            size += len(part)
            if size >= CHUNK:
                yield np.concatenate(of), np.concatenate(held)
                held, of, size = [], [], 0
    if held:
        yield np.concatenate(of), np.concatenate(held)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts per code, ascending."""
    grams, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    distinct, at = np.unique(grams, return_inverse=True)
    return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)


def count_ngrams(docs: DataFrame, order: int, text: str = "text") -> DataFrame:
    """(g, c): packed n-grams of all texts and how often they occur; counts are combined in the task first."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            texts = ((0, t.as_py().encode()) for t in b.column(0) if t.is_valid)
            for _, grams in text_codes(texts, order):
                at, distinct = pd.factorize(grams)
                parts.append((distinct, np.bincount(at, minlength=len(distinct))))
                size += len(distinct)
                if size > _FLUSH:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > _FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in parts[0]], ["g", "c"])
                        parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in merged(parts)], ["g", "c"])

    return docs.select(text).mapInArrow(each, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def mask(n: int) -> Column:
    return F.lit((1 << (8 * n)) - 1).cast("long")


def kneser_ney(counts: DataFrame, order: int) -> tuple[DataFrame, DataFrame, float]:
    """Interpolated modified Kneser-Ney estimates of all orders from counts of the highest.

    Returns entries (n, g, lp): natural log probability of the last byte of g after the bytes before
    it; contexts (n, g, lg): log of the weight that the n-grams starting with the n - 1 bytes g
    leave to the next lower order; and the log probability of a byte that never occurred.  Orders
    below the highest count distinct bytes to the left instead of occurrences.  Each order has three
    discounts from its counts of counts (fixed ones where these are degenerate); the lowest order is
    interpolated with 256 equally likely bytes.
    """
    top = stage(counts, "counts")
    levels = {order: top}
    for n in range(order - 1, 0, -1):
        levels[n] = stage(levels[n + 1].groupBy(F.col("g").bitwiseAND(mask(n)).alias("g")).agg(F.count(F.lit(1)).alias("c")), f"counts{n}")
    c, entries, contexts, below, floor = F.col("c"), [], [], None, -math.log(256)
    for n in range(1, order + 1):
        seen = levels[n].agg(*[F.coalesce(F.sum((c == k).cast("long")), F.lit(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        d = discounts(seen.n1, seen.n2, seen.n3, seen.n4)
        cut = F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
        rows = levels[n].withColumn("ctx", F.shiftright("g", 8)).withColumn("cut", cut)
        ctx = rows.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("cut").alias("left"))
        ctx = ctx.select(F.col("ctx").alias("of"), "total", (F.col("left") / F.col("total")).alias("gamma"))
        rows = rows.join(ctx, F.col("ctx") == F.col("of"))
        own = (c - F.col("cut")) / F.col("total")
        if n == 1:
            rows = rows.select("g", (own + F.col("gamma") / 256).alias("p"))
            got = ctx.first()
            floor = math.log(got.gamma / 256) if got and got.gamma > 0 else floor
        else:
            lower = below.select(F.col("g").alias("suffix"), F.col("p").alias("q"))
            rows = rows.join(lower, F.col("g").bitwiseAND(mask(n - 1)) == F.col("suffix")) \
                .select("g", (own + F.col("gamma") * F.col("q")).alias("p"))
            contexts.append(ctx.select(F.lit(n).alias("n"), F.col("of").alias("g"), F.log("gamma").alias("lg")))
        below = stage(rows, f"p{n}")
        entries.append(below.select(F.lit(n).alias("n"), "g", F.log("p").alias("lp")))
    both = [entries[0], contexts[0]]
    for x in entries[1:]:
        both[0] = both[0].unionByName(x)
    for x in contexts[1:]:
        both[1] = both[1].unionByName(x)
    return stage(both[0], "entries"), stage(both[1], "contexts"), floor


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three modified Kneser-Ney discounts, kept inside (0, count)."""
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))
