"""Quality rules: base statistics and language-specific bands of n-gram perplexity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import stage, table
from .ngrams import count_ngrams, kneser_ney, text_codes

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class RuleParams:
    """order: bytes of the longest n-gram; lower, upper: quartile distances from the first and third
    quartile to the ends of a language's band (junk lies above it more often than below);
    piece_entries: model entries that a task holds at once (16 bytes each)."""

    order: int = 5
    lower: float = 3.0
    upper: float = 1.5
    piece_entries: int = 2_000_000
    min_words: int = 50


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(seen[0x80:0xC0].sum())
    chars = points - int(seen[list(_SPACES)].sum())
    symbols = int(seen[list(_SYMBOLS)].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, repeats = len(words), 0
    if n > 3:
        word = pd.factorize(np.array(words, object))[0].astype(np.int64)
        pair = pd.factorize(word[:-1] * (n + 1) + word[1:])[0].astype(np.int64)
        window = pd.factorize(pair[:-1] * (n + 1) + word[2:])[0]
        twice = np.flatnonzero(np.bincount(window)[window] >= 2)
        marked = np.zeros(n, bool)
        for k in range(3):
            marked[twice + k] = True
        repeats = int(marked.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


class HashArrays:
    """A piece of the model: ascending 64-bit keys and their values, looked up by binary search.

    A key packs the order above the bytes of the n-gram, so different n-grams never share one.
    """

    def __init__(self, entries: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray], order: int, floor: float,
                 piece: int, pieces: int):
        self.entries, self.contexts, self.order, self.floor, self.piece, self.pieces = entries, contexts, order, floor, piece, pieces

    @staticmethod
    def _find(held: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(held[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(held[0], keys), len(held[0]) - 1)
        hit = held[0][at] == keys
        return hit, np.where(hit, held[1][at], 0.0)

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's last byte, 0 for n-grams of other pieces."""
        out = np.zeros(len(grams))
        open_ = np.flatnonzero(piece_of(grams, self.pieces) == self.piece) if self.pieces > 1 else np.arange(len(grams))
        carried = np.zeros(len(open_))
        for n in range(self.order, 0, -1):
            own = grams[open_] & ((1 << (8 * n)) - 1)
            hit, value = self._find(self.entries, (n << 56) | own)
            out[open_[hit]] = carried[hit] + value[hit]
            open_, carried, own = open_[~hit], carried[~hit], own[~hit]
            if n > 1:
                carried = carried + self._find(self.contexts, (n << 56) | (own >> 8))[1]
        out[open_] = carried + self.floor
        return out


def sorted_arrays(rows: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and their values of (n, g, value) rows.

    Rows are sorted in the cluster and written to the shared folder as runs of packed keys and
    values; the driver only strings the runs together.
    """
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, values = (np.ascontiguousarray(b.column(i).to_numpy()) for i in range(2))
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:1]), pa.array([keys.tobytes()]), pa.array([values.tobytes()])], ["first", "keys", "held"])

    key = F.shiftleft(F.col("n").cast("long"), 56).bitwiseOR(F.col("g"))
    ordered = rows.select(key.alias("key"), F.col(value).cast("double").alias("held")).repartitionByRange("key").sortWithinPartitions("key")
    packed = stage(ordered.mapInArrow(runs, "first long, keys binary, held binary"), f"arrays-{value}").collect()
    packed.sort(key=lambda r: r.first)
    return (np.frombuffer(b"".join(bytes(r.keys) for r in packed), np.int64), np.frombuffer(b"".join(bytes(r.held) for r in packed), np.float64))


def piece_of(grams, pieces: int):
    """Piece of an n-gram: its second and third last bytes, the context's end, mixed.

    All that scoring a byte can look up in orders of three and more ends its context in the same
    two bytes, so it lies in one piece; orders one and two are in every piece.
    """
    return ((grams >> 8) & 0xFFFF) * 40503 % 65536 * pieces // 65536


def perplexities(docs: DataFrame, entries: DataFrame, contexts: DataFrame, floor: float, p: RuleParams, text: str, key: str) -> DataFrame:
    """(key, row, base columns, nll, n_bytes), a row per input row and model piece to be summed by row.

    The model goes to the tasks in pieces of at most ``piece_entries`` entries (more only if one
    two-byte context end has more); each piece is one scan that sums the log probabilities of the
    bytes it covers.
    """
    spark, names = docs.sparkSession, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    pieces = max(1, -(-(entries.count() + contexts.count()) // p.piece_entries))
    kind = docs.schema[key].dataType
    schema = StructType([StructField("key", kind), StructField("mark", LongType())] + [StructField(c, LongType()) for c in names]) \
        .add("nll", "double").add("n_bytes", "long")
    parts = []
    for piece in range(pieces):
        def own(rows: DataFrame, context: bool) -> DataFrame:
            end = F.col("g") if context else F.shiftright("g", 8)
            mixed = F.floor(F.pmod(end.bitwiseAND(F.lit(0xFFFF).cast("long")) * 40503, F.lit(65536)) * pieces / 65536)
            return rows.where((F.col("n") <= 2) | (mixed == piece)) if pieces > 1 else rows

        model = HashArrays(sorted_arrays(own(entries, False), "lp"), sorted_arrays(own(contexts, True), "lg"), p.order, floor, piece, pieces)
        sent = spark.sparkContext.broadcast(model)  # at most 16 bytes times piece_entries

        def each(batches: Iterator[pa.RecordBatch], sent=sent, first=piece == 0) -> Iterator[pa.RecordBatch]:
            arrays = sent.value
            for b in batches:
                texts = [(t.as_py() or "").encode() for t in b.column(2)]
                nll = np.zeros(len(texts))
                for of, grams in text_codes(((i, t) for i, t in enumerate(texts) if t), arrays.order):
                    at, distinct = pd.factorize(grams)
                    nll -= np.bincount(of, arrays.score(distinct)[at], len(texts))
                base = [base_counts(t) if t and first else (0,) * 5 for t in texts]
                columns = [pa.array([x[k] for x in base], pa.int64()) for k in range(5)]
                size = pa.array([len(t) + 1 if t else 0 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, pa.array(nll), size], schema.names)

        parts.append(docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).mapInArrow(each, schema))
    if pieces == 1:
        return parts[0]
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    # repeated rows are summed together and share out the sum again
    share = F.count(F.lit(1)) / pieces
    return whole.groupBy("key", "mark").agg(*[(F.sum(c) / share).cast("long").alias(c) for c in names], (F.sum("nll") / share).alias("nll"),
                                            F.max("n_bytes").alias("n_bytes"), share.cast("int").alias("times")) \
        .withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def quality_rules(docs: DataFrame, params: RuleParams | None = None, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(key, lang, base columns, perplexity, lower, upper, base_failed, kept), a row per input row.

    Perplexity per byte comes from a modified Kneser-Ney model counted over all texts.  Documents
    that pass the base rules give their language's band: first quartile minus ``lower`` and third quartile
    plus ``upper`` quartile distances of the log perplexity (null languages are one of their own).
    A document is kept if it passes the base rules (50 words or more, at most half of them in
    repeated three-word windows) and lies within the band.  Null and empty texts have counts of 0,
    a null perplexity and fail.  Very long texts are read whole, in pieces; repeated rows repeat and
    count as often; null keys are rows like others; other columns are ignored.
    """
    p = params or RuleParams()
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    entries, contexts, floor = kneser_ney(count_ngrams(rows, p.order), p.order)
    keyed = rows.withColumn("key", F.struct("key", "lang"))
    scored = perplexities(keyed, entries, contexts, floor, p, "text", "key")
    failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = stage(scored.select("key.key", "key.lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                 F.when(F.col("n_bytes") > 0, F.col("nll") / F.col("n_bytes")).alias("bits"), failed.alias("base_failed")), "scored")
    quartiles = scored.where(~F.col("base_failed")).groupBy("lang").agg(F.percentile_approx("bits", [0.25, 0.75], 10000).alias("q"))
    q = F.col("q")
    bands = quartiles.select(F.col("lang").alias("of"), (q[0] - p.lower * (q[1] - q[0])).alias("low"), (q[1] + p.upper * (q[1] - q[0])).alias("high"))
    out = scored.join(F.broadcast(bands), F.col("lang").eqNullSafe(F.col("of")), "left")  # a row per language
    inside = F.coalesce((F.col("bits") >= F.col("low")) & (F.col("bits") <= F.col("high")), F.lit(False))
    return out.select("key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.exp("bits").alias("perplexity"),
                      F.exp("low").alias("lower"), F.exp("high").alias("upper"), "base_failed", (~F.col("base_failed") & inside).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: counts, perplexity and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id").drop("lang", "lower", "upper")
