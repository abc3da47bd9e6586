"""Toxicity: class-conditional Kneser-Ney models of bytes, compared per byte of text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_side, stage, table
from .ngrams import CHUNK, discounts, mask, merged, text_codes
from .quality_model import ClassifierParams, blocks_of

#: Models: 0 and 1 leave out the fold of that number and serve the calibration only, 2 has both folds.
MODELS, CLASSES, WHOLE = 3, 2, 2
_CELLS = [(m, c) for m in range(MODELS) for c in range(CLASSES)]


@dataclass(frozen=True)
class ToxicityParams:
    """order: bytes of the longest n-gram; shared: orders up to this one are counted over both classes
    together; fit_bytes: text of a class that the fit reads at most (whole documents, drawn by the hash
    of their key; the larger class is also thinned to the volume of the smaller one, so that neither
    model knows more rare expressions just by its size); threshold: lowest score predicted as toxic;
    held_bytes: models whose counted entries fit it go to the tasks as arrays, larger ones are joined;
    block_bytes: text per block of documents in these joins."""

    order: int = 5
    shared: int = 2
    fit_bytes: int = 1 << 28
    threshold: float = 0.7
    held_bytes: int = 64 << 20
    block_bytes: int = 8 << 20


def normal(text: Column) -> Column:
    """Lower-case words of letters of the whole text with one space around each; empty without a letter."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.when(words != "", F.concat(F.lit(" "), words, F.lit(" "))).otherwise("")


def may_learn(key: Column) -> Column:
    """True for rows whose labels may be learned from; false for held-out rows and null keys."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def fit_rows(docs: DataFrame, labels: DataFrame, p: ToxicityParams, text: str, key: str) -> DataFrame:
    """(toxic, fold, text): the labelled documents of the fit, normalised.

    A document with several labels is toxic if one of them says so; null labels say nothing.
    """
    known = labels.where(may_learn(F.col(key)) & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("label_key")) \
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    draw = F.pmod(F.xxhash64(F.lit("toxicity fit"), F.col("label_key")), F.lit(1 << 30)) / float(1 << 30)
    known = stage(known.select("label_key", "toxic", draw.alias("draw"), F.pmod(F.xxhash64(F.lit("fold"), "label_key"), F.lit(2)).cast("int").alias("fold")), "labelled")
    met = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(small_side(known), F.col("id") == F.col("label_key"))
    volume = {r.toxic: r.n for r in met.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("n")).collect() if r.n}
    least = min([p.fit_bytes, *volume.values()]) if len(volume) == 2 else 0
    share = F.when(F.col("toxic") == 1, least / volume.get(1, 1)).otherwise(least / volume.get(0, 1))
    return met.where(F.col("draw") < share).select("toxic", "fold", normal(F.col("text")).alias("text"))


def count_cells(rows: DataFrame, order: int) -> DataFrame:
    """(toxic, fold, g, c): n-gram counts per class and fold, combined inside the tasks first."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {k: [] for k in range(4)}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for k, parts in held.items():
                if parts:
                    g, c = merged(parts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k // 2, np.int32)), pa.array(np.full(len(g), k % 2, np.int32)),
                                                      pa.array(g, pa.int64()), pa.array(c, pa.int64())], ["toxic", "fold", "g", "c"])
                    held[k] = []

        for b in batches:
            cell = 2 * np.asarray(b.column(0)) + np.asarray(b.column(1))
            for of, grams in text_codes(((int(k), t.as_py().encode()) for k, t in zip(cell, b.column(2)) if t.is_valid), order):
                for k in np.unique(of):
                    at, distinct = pd.factorize(grams[of == k])
                    held[int(k)].append((distinct, np.bincount(at, minlength=len(distinct))))
                    size += len(distinct)
                if size > 2 * CHUNK:
                    yield from flush()
                    size = 0
        yield from flush()

    return rows.select("toxic", "fold", "text").mapInArrow(each, "toxic int, fold int, g long, c long") \
        .groupBy("toxic", "fold", "g").agg(F.sum("c").alias("c"))


def _wide(rows: DataFrame, value: str) -> DataFrame:
    """(n, g, v0 .. v5): one column per model and class, null where it has no such n-gram."""
    cells = [F.max(F.when((F.col("m") == m) & (F.col("toxic") == c), F.col(value))).alias(f"v{i}") for i, (m, c) in enumerate(_CELLS)]
    return rows.groupBy("n", "g").agg(*cells)


def class_models(counts: DataFrame, p: ToxicityParams) -> tuple[DataFrame, DataFrame, list[float]]:
    """Modified Kneser-Ney estimates of every model and class: entries, contexts, floors.

    entries (n, g, v0..): log probability of g's last byte after the bytes before it; contexts
    (n, g, v0..): log of the weight that context g of order n leaves to the next lower order; floors:
    log probability of a byte that never occurred.  Orders above ``shared`` belong to one class; the
    others count distinct extensions seen in either class, so an expression rare in both classes is
    smoothed alike in both.
    """
    by = ["m", "toxic"]
    both = F.explode(F.array(F.lit(WHOLE), 1 - F.col("fold"))).alias("m")
    level = stage(counts.select(both, "toxic", "g", "c").groupBy("m", "toxic", "g").agg(F.sum("c").alias("c")), "cells")
    levels = {p.order: level}
    for n in range(p.order - 1, 0, -1):
        short = F.col("g").bitwiseAND(mask(n)).alias("g")
        if n > p.shared:
            level = level.groupBy(*by, short).agg(F.count(F.lit(1)).alias("c"))
        else:
            level = level.select("m", "g").distinct().groupBy("m", short).agg(F.count(F.lit(1)).alias("c")) \
                .withColumn("toxic", F.explode(F.array(F.lit(0), F.lit(1)))).select(*by, "g", "c")
        level = levels[n] = stage(level, f"cells{n}")
    c, entries, contexts, below = F.col("c"), [], [], None
    floors = [-math.log(256)] * len(_CELLS)
    for n in range(1, p.order + 1):
        seen = levels[n].groupBy(*by).agg(*[F.sum((c == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()  # a row per model and class
        cut = F.lit(None).cast("double")
        for r in seen:
            d = discounts(r.n1, r.n2, r.n3, r.n4)
            cut = F.when((F.col("m") == r.m) & (F.col("toxic") == r.toxic), F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])).otherwise(cut)
        rows = levels[n].withColumn("ctx", F.shiftright("g", 8)).withColumn("cut", cut)
        ctx = rows.groupBy(*by, "ctx").agg(F.sum("c").alias("total"), F.sum("cut").alias("left")) \
            .select(*by, "ctx", "total", (F.col("left") / F.col("total")).alias("gamma"))
        own = (c - F.col("cut")) / F.col("total")
        rows = rows.join(ctx, [*by, "ctx"])
        if n == 1:
            rows = rows.select(*by, "g", (own + F.col("gamma") / 256).alias("p"))
            for r in ctx.collect():  # one empty context per model and class
                if r.gamma > 0:
                    floors[_CELLS.index((r.m, r.toxic))] = math.log(r.gamma / 256)
        else:
            lower = below.select(*by, F.col("g").alias("suffix"), F.col("p").alias("q"))
            rows = rows.withColumn("suffix", F.col("g").bitwiseAND(mask(n - 1))).join(lower, [*by, "suffix"]) \
                .select(*by, "g", (own + F.col("gamma") * F.col("q")).alias("p"))
            contexts.append(ctx.select(*by, F.lit(n).alias("n"), F.col("ctx").alias("g"), F.log("gamma").alias("lg")))
        below = stage(rows, f"cellp{n}")
        entries.append(below.select(*by, F.lit(n).alias("n"), "g", F.log("p").alias("lp")))
    whole = [entries[0], contexts[0]]
    for x in entries[1:]:
        whole[0] = whole[0].unionByName(x)
    for x in contexts[1:]:
        whole[1] = whole[1].unionByName(x)
    return stage(_wide(whole[0], "lp"), "entries"), stage(_wide(whole[1], "lg"), "contexts"), floors


def gram_ratios(grams: DataFrame, entries: DataFrame, contexts: DataFrame, floors: list[float], order: int) -> DataFrame:
    """(g, r): for distinct n-grams, log of toxic over ordinary probability of the last byte, by model."""
    cells = range(len(_CELLS))
    rows = grams.select("g", *[F.lit(None).cast("double").alias(f"lp{i}") for i in cells], *[F.lit(0.0).alias(f"left{i}") for i in cells])
    for n in range(order, 0, -1):
        own = entries.where(F.col("n") == n).select(F.col("g").alias("of"), *[f"v{i}" for i in cells])
        rows = rows.join(own, F.col("g").bitwiseAND(mask(n)) == F.col("of"), "left").select(
            "g", *[F.coalesce(f"lp{i}", F.col(f"left{i}") + F.col(f"v{i}")).alias(f"lp{i}") for i in cells], *[f"left{i}" for i in cells])
        if n > 1:
            ctx = contexts.where(F.col("n") == n).select(F.col("g").alias("of"), *[f"v{i}" for i in cells])
            rows = rows.join(ctx, F.shiftright(F.col("g").bitwiseAND(mask(n)), 8) == F.col("of"), "left").select(
                "g", *[f"lp{i}" for i in cells], *[(F.col(f"left{i}") + F.coalesce(f"v{i}", F.lit(0.0))).alias(f"left{i}") for i in cells])
    done = [F.coalesce(f"lp{i}", F.col(f"left{i}") + floors[i]) for i in cells]
    ratios = [(done[_CELLS.index((m, 1))] - done[_CELLS.index((m, 0))]).cast("float") for m in range(MODELS)]
    return rows.select("g", F.array(*ratios).alias("r"))


class RatioArrays:
    """All models as ascending keys per order with a column per model and class; looked up by bisection."""

    def __init__(self, entries: DataFrame, contexts: DataFrame, floors: list[float], order: int):
        self.order, self.floors = order, np.array(floors)
        self.entries, self.contexts = self._arrays(entries), self._arrays(contexts)

    @staticmethod
    def _arrays(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        table, out = rows.toArrow(), {}  # rows were counted against ``held_bytes``
        n, g = table["n"].to_numpy(), table["g"].to_numpy()
        values = np.stack([table[f"v{i}"].to_numpy().astype(np.float32) for i in range(len(_CELLS))], axis=1)
        for k in np.unique(n):
            at = np.flatnonzero(n == k)
            at = at[np.argsort(g[at])]
            out[int(k)] = (g[at], values[at])
        return out

    @staticmethod
    def _find(held: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(held[0], keys), len(held[0]) - 1)
        return np.where((held[0][at] == keys)[:, None], held[1][at], np.float32("nan"))

    def ratios(self, grams: np.ndarray) -> np.ndarray:
        """(n-grams, models): log of toxic over ordinary probability of the last byte."""
        lp, left = np.full((len(grams), len(_CELLS)), np.nan), np.zeros((len(grams), len(_CELLS)))
        for n in range(self.order, 0, -1):
            own = grams & ((1 << (8 * n)) - 1)
            lp = np.where(np.isnan(lp), left + self._find(self.entries[n], own), lp)
            if n > 1:
                left += np.nan_to_num(self._find(self.contexts[n], own >> 8))
        lp = np.where(np.isnan(lp), left + self.floors, lp)
        return np.stack([lp[:, _CELLS.index((m, 1))] - lp[:, _CELLS.index((m, 0))] for m in range(MODELS)], axis=1)


def held_ratios(docs: DataFrame, model: RatioArrays) -> DataFrame:
    """(key, x0, x1, x2) as ``document_ratios`` gives them, by one narrow pass with the whole model in the tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("key").schema
    for m in range(MODELS):
        schema = schema.add(f"x{m}", "double")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = sent.value
        for b in batches:
            total, size = np.zeros((MODELS, b.num_rows)), np.ones(b.num_rows)

            def texts() -> Iterator[tuple[int, bytes]]:
                for i, t in enumerate(b.column(1)):
                    data = (t.as_py() or "").encode()
                    if data:
                        size[i] = len(data) + 1
                        yield i, data

            for of, grams in text_codes(texts(), arrays.order):
                local, distinct = pd.factorize(grams)
                value = arrays.ratios(distinct)
                for m in range(MODELS):
                    total[m] += np.bincount(of, value[:, m][local], b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(t / size) for t in total]], schema.names)

    return docs.select("key", "text").mapInArrow(each, schema)


def document_ratios(docs: DataFrame, entries: DataFrame, contexts: DataFrame, floors: list[float], p: ToxicityParams) -> DataFrame:
    """(key, x0, x1, x2): log-likelihood ratio per byte of every document under each model; 0 without a byte.

    ``docs`` has columns key and text (normalised).  Blocks of documents are staged with their distinct
    n-grams; these are answered by joins spread by n-gram, and the answers return to their blocks.
    """
    import zstandard

    blocks = stage(blocks_of(docs, ClassifierParams(order=p.order, block_bytes=p.block_bytes)), "toxic-blocks")
    wanted = blocks.select("block", F.explode("grams").alias("g"))
    found = stage(gram_ratios(wanted.select("g").distinct(), entries, contexts, floors, p.order), "toxic-ratios")
    answers = wanted.join(found, "g").groupBy(F.col("block").alias("of")).agg(F.sort_array(F.collect_list(F.struct("g", "r"))).alias("a"))
    met = blocks.select("block", "keys", "sizes", "body").repartition("block").join(answers, F.col("block") == F.col("of"), "left")
    met = met.select("keys", "sizes", "body", F.col("a.g").alias("g"), F.flatten("a.r").alias("r"))
    schema = docs.select("key").schema
    for m in range(MODELS):
        schema = schema.add(f"x{m}", "double")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, sizes = b.column(0)[i].values, np.asarray(b.column(1)[i].values, np.int64)
                body, at = zstandard.ZstdDecompressor().decompress(b.column(2)[i].as_py()), np.concatenate([[0], np.cumsum(sizes)])
                held = b.column(3)[i].is_valid
                known = np.asarray(b.column(3)[i].values, np.int64) if held else np.zeros(0, np.int64)
                value = np.asarray(b.column(4)[i].values, np.float32).astype(float).reshape(-1, MODELS) if held else np.zeros((0, MODELS))
                total = np.zeros((MODELS, len(sizes)))
                for of, grams in text_codes(((k, body[at[k]:at[k + 1]]) for k in range(len(sizes)) if sizes[k]), p.order):
                    local, distinct = pd.factorize(grams)
                    where = np.searchsorted(known, distinct)
                    for m in range(MODELS):
                        total[m] += np.bincount(of, value[where, m][local], len(sizes))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(t / (sizes + 1)) for t in total]], schema.names)

    return met.mapInArrow(each, schema)


def calibrate(bins: list[tuple[float, int, int]], rounds: int = 100) -> tuple[float, float]:
    """(slope, intercept) of a logistic regression on (ratio, toxic, documents) by damped Newton steps."""
    x, y, w = (np.array(v, float) for v in zip(*bins))
    scale = max(1e-9, float(np.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w))))
    f = np.stack([x / scale, np.ones(len(x))])
    theta, ridge = np.zeros(2), np.array([1e-3, 1e-6])

    def loss(t: np.ndarray) -> float:
        z = t @ f
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + (ridge * t * t).sum() / 2)

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(theta @ f, -500, 500)))
        step = np.linalg.solve((f * (w * q * (1 - q))) @ f.T + np.diag(ridge), f @ (w * (q - y)) + ridge * theta)
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, ratio, score, predicted), a row per input row.

    Two modified Kneser-Ney models, of toxic and of ordinary labelled text, share their lowest orders.
    A document's ratio is the difference of its log-likelihoods per byte of normalised text; a logistic
    curve turns it into a score.  The curve is fitted on labelled rows by models that leave out their
    fold, so that it knows ratios of unseen text; scores come from the model with both folds for every
    row alike.  Labels count only where crc32 of the key is not 1 modulo 3; neither they nor other
    columns are inputs of a score.  Null and empty texts and texts without a letter have ratio 0.  If
    one class has no labelled text, nothing can be compared and every score is 0.  Very long texts are
    read whole, in pieces; repeated rows repeat; null keys are never learned from and not held out.
    """
    p = params or ToxicityParams()
    held_out = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col(key).alias("key"), normal(F.col(text)).alias("text"))
    counts = stage(count_cells(fit_rows(docs, labels, p, text, key), p.order), "cells-top")
    seen = {(r.toxic, r.fold) for r in counts.select("toxic", "fold").distinct().collect()}
    if len(seen) < 4:  # a class or a fold without text
        return docs.select(F.col(key).alias("key")).select(
            "key", held_out.alias("held_out"), F.lit(0.0).alias("ratio"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    entries, contexts, floors = class_models(counts, p)
    if (entries.count() + contexts.count()) * 4 * (2 + len(_CELLS)) <= p.held_bytes:
        ratios = held_ratios(rows, RatioArrays(entries, contexts, floors, p.order))
    else:
        ratios = document_ratios(rows, entries, contexts, floors, p)
    ratios = stage(ratios, "toxic-scores")
    known = stage(labels.where(may_learn(F.col(key)) & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("label_key")).agg(
        (F.max("toxic") > 0).cast("int").alias("toxic")), "known")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "label_key"), F.lit(2))
    apart = ratios.join(small_side(known), F.col("key") == F.col("label_key")).select(
        F.floor(F.when(fold == 0, F.col("x0")).otherwise(F.col("x1")) * 2048).alias("bin"), "toxic")
    bins = apart.groupBy("bin", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()  # a ratio per byte lies within +-40: bounded
    slope, intercept = calibrate([((r.bin + 0.5) / 2048, r.toxic, r.n) for r in bins])
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), slope * F.col("x2") + intercept))))
    return ratios.select("key", held_out.alias("held_out"), F.col("x2").alias("ratio"), score.alias("score"),
                         (score >= p.threshold).cast("int").alias("predicted"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: toxicity score of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("key", "doc_id")
