"""Language identification with a string kernel: Nystroem landmarks and kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Buckets of the hashed n-grams of all lengths (2 ** 20).
BUCKETS = 1 << 20
_STEP = 1 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    """Documented bounds of the fit; prediction has none.

    per_language: labelled rows per language in the fit (the lowest hashes of the key);
    landmarks: of these, Nystroem landmarks per language; spectrum: longest n-gram;
    ridge: penalty relative to the number of fitted rows; batch: texts per matrix product.
    A text with at least ``min_grams`` distinct n-grams is rejected below its language's threshold: the
    score of a text that shares nothing with the landmarks, plus ``reject`` of the way from there to the
    ``low`` quantile of the language's labelled rows, scored by models that did not see them.
    """

    per_language: int = 150
    landmarks: int = 24
    spectrum: int = 3
    ridge: float = 1e-3
    batch: int = 256
    min_grams: int = 80
    low: float = 0.01
    reject: float = 0.25


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    buckets: np.ndarray  # buckets of any landmark, ascending
    presence: np.ndarray  # landmarks x buckets, 0 or 1
    norms: np.ndarray  # square roots of the landmarks' own kernel values
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    spectrum: int
    batch: int
    limits: tuple[float, ...] = ()  # lowest accepted score of each language


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point: its lower-case letter, or a space."""
    points = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            points[c] = ord(low) if len(low) == 1 else c
    return points


class Spectrum:
    """Distinct hashed n-grams of lengths 1 to ``longest`` of a whole text, read in pieces."""

    def __init__(self, longest: int):
        self.longest, self.seen, self.points = longest, np.zeros(BUCKETS, bool), _letters()

    def codes(self, text: str | None) -> np.ndarray | None:
        """Ascending buckets, or None for a text without a letter."""
        if not text:
            return None
        found, any_letter, tail = [], False, np.full(1, 32, np.uint32)
        for at in range(0, len(text), _STEP):
            raw = np.frombuffer(text[at:at + _STEP].encode("utf-32-le", "surrogatepass"), np.uint32)
            mapped = self.points[raw]
            any_letter = any_letter or bool((mapped != 32).any())
            p = np.concatenate([tail, mapped, np.full(1, 32, np.uint32)] if at + _STEP >= len(text) else [tail, mapped])
            blank = p == 32
            keep = np.ones(len(p), bool)
            keep[1:] = ~(blank[1:] & blank[:-1])  # one space between words
            p = p[keep]
            code = np.zeros(len(p), np.uint32)
            for n in range(1, self.longest + 1):
                m = len(p) - n + 1
                if m <= 0:
                    break
                code = (code[:m] ^ p[n - 1:n - 1 + m]) * np.uint32(0x9E3779B1) + np.uint32(n)
                bucket = (code ^ (code >> np.uint32(15))) >> np.uint32(3) & np.uint32(BUCKETS - 1)
                self.seen[bucket] = True
                if len(text) <= _STEP:
                    found.append(bucket)
            tail = p[-(self.longest - 1):] if self.longest > 1 else p[:0]
        hit = np.flatnonzero(self.seen) if any_letter else None
        if len(text) > _STEP:
            self.seen[:] = False
        for bucket in found:
            self.seen[bucket] = False
        return hit


def _kernel(rows: list[np.ndarray], buckets: np.ndarray, presence: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of rows of codes against the landmarks, as one matrix product."""
    x = np.zeros((len(rows), len(buckets)), np.float32)
    own = np.ones(len(rows))
    for i, codes in enumerate(rows):
        at = np.searchsorted(buckets, codes)
        at[at == len(buckets)] = 0
        x[i, at[buckets[at] == codes]] = 1
        own[i] = max(1, len(codes))
    return (x @ presence.T).astype(np.float64) / np.sqrt(own)[:, None] / norms[None, :]


def in_fit(key: Column) -> Column:
    """True for rows whose key may be learned from; false for held-out rows and null keys."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit_sample(docs: DataFrame, p: LanguageParams, text: str, key: str, lang: str) -> DataFrame:
    """(lang, text): at most ``per_language`` labelled rows per language, by the hash of the key.

    Each language's share is thinned by a hash threshold before the ranking, so no window holds
    more than a few times ``per_language`` rows however common the language is.
    """
    labelled = docs.where(in_fit(F.col(key)) & F.col(lang).isNotNull())
    counts = labelled.groupBy(F.col(lang).alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    draw = F.pmod(F.xxhash64(F.lit("language fit"), F.col(key)), F.lit(1_000_000)) / 1e6
    thin = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("_key"), draw.alias("_draw")) \
        .where(F.col("text").rlike(r"\p{L}")) \
        .join(F.broadcast(counts), F.col("lang") == F.col("_lang")).where(  # counts: a row per language
            F.col("_draw") * F.col("_n") <= 4 * p.per_language + 40)
    order = Window.partitionBy("lang").orderBy("_draw", "_key")
    return thin.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= p.per_language).select("lang", "text")


def fit_language(docs: DataFrame, params: LanguageParams | None = None, text: str = "text", key: str = "doc_id",
                 lang: str = "lang") -> LanguageModel | None:
    """Kernel ridge regression, one against the rest, on Nystroem features of a bounded sample.

    Tasks turn the sampled texts into bucket lists; only these come to the driver.  Null languages
    and texts without a letter are not learned from.  None if nothing is left to learn from.
    """
    p = params or LanguageParams()

    def each(batches):
        spectrum = Spectrum(p.spectrum)
        for b in batches:
            codes = [spectrum.codes(t) for t in b["text"]]
            yield pd.DataFrame({"lang": b["lang"], "codes": [None if c is None else c.astype(np.int32).tobytes() for c in codes]})

    got = fit_sample(docs, p, text, key, lang).mapInPandas(each, "lang string, codes binary").where("codes IS NOT NULL").collect()
    rows = sorted((r.lang, bytes(r.codes)) for r in got)  # one order, however tasks return
    if not rows:
        return None
    languages = tuple(sorted({r[0] for r in rows}))
    codes = [np.frombuffer(r[1], np.int32).astype(np.int64) for r in rows]
    of = np.array([languages.index(r[0]) for r in rows])
    model = _solve(codes, of, languages, p)
    apart = np.zeros(len(of))
    for half in (0, 1):  # scores of rows that the model has not seen
        seen, other = np.arange(len(of)) % 2 == half, np.arange(len(of)) % 2 != half
        if len(np.unique(of[seen])) == len(languages):
            part = _solve([codes[i] for i in np.flatnonzero(seen)], of[seen], languages, p)
            f = _values([codes[i] for i in np.flatnonzero(other)], part)
            apart[other] = np.clip((f[np.arange(len(f)), of[other]] + 1) / 2, 0, 1)
    nothing = (model.bias.max() + 1) / 2
    limits = tuple(float(nothing + p.reject * max(0.0, np.quantile(apart[of == k], p.low) - nothing)) for k in range(len(languages)))
    return replace(model, limits=limits)


def _values(codes: list[np.ndarray], model: LanguageModel) -> np.ndarray:
    return _kernel(codes, model.buckets, model.presence, model.norms) @ model.weights + model.bias


def _solve(codes: list[np.ndarray], of: np.ndarray, languages: tuple[str, ...], p: LanguageParams) -> LanguageModel:
    chosen = []
    for k in range(len(languages)):
        own = np.flatnonzero(of == k)
        chosen += list(own[np.linspace(0, len(own) - 1, min(p.landmarks, len(own))).round().astype(int)])
    buckets = np.unique(np.concatenate([codes[i] for i in chosen]))
    presence = np.zeros((len(chosen), len(buckets)), np.float32)
    for row, i in enumerate(chosen):
        presence[row, np.searchsorted(buckets, codes[i])] = 1
    norms = np.sqrt(presence.sum(axis=1).astype(np.float64))
    inner = _kernel([codes[i] for i in chosen], buckets, presence, norms)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = _kernel(codes, buckets, presence, norms) @ root
    share = np.bincount(of, minlength=len(languages))[of]
    weight = len(of) / (len(languages) * share)  # languages count alike
    target = np.where(of[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    mean, middle = np.average(features, axis=0, weights=weight), np.average(target, axis=0, weights=weight)
    left = (features - mean) * weight[:, None]
    gram = left.T @ (features - mean) + p.ridge * len(of) * np.eye(features.shape[1])
    beta = np.linalg.solve(gram, left.T @ (target - middle))
    return LanguageModel(languages, buckets, presence, norms, root @ beta, middle - mean @ beta, p.spectrum, p.batch)


def language_of(model: LanguageModel | None, text: Column) -> Column:
    """Struct (lang, score, grams) of a whole text, scored in batched matrix products inside the tasks;
    grams counts its distinct n-grams."""
    def predict(texts: pd.Series) -> pd.DataFrame:
        spectrum = Spectrum(model.spectrum) if model else None
        lang, score, grams = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), np.int32)
        rows, at = [], []

        def flush() -> None:
            f = _values(rows, model)
            best = f.argmax(axis=1)
            lang[at] = np.array(model.languages, object)[best]
            score[at] = np.clip((f[np.arange(len(at)), best] + 1) / 2, 0, 1)
            rows.clear(), at.clear()

        for i, t in enumerate(texts if model else []):
            codes = spectrum.codes(t)
            if codes is not None:
                rows.append(codes), at.append(i)
                grams[i] = len(codes)
            if len(rows) == model.batch:
                flush()
        if rows:
            flush()
        return pd.DataFrame({"lang": lang, "score": score, "grams": grams})

    return F.pandas_udf(predict, "lang string, score double, grams int")(text)


def identify(docs: DataFrame, params: LanguageParams | None = None, text: str = "text", key: str = "doc_id",
             lang: str = "lang", fit_on: DataFrame | None = None) -> DataFrame:
    """(key, held_out, lang_pred, score), a row for every input row.

    Learns from rows of ``fit_on`` (the input by default) whose crc32 of the key is not divisible by
    five; language, source and key are no inputs of a prediction.  Null texts and texts without a
    letter get ``und`` with score 0, and so does every row if there is nothing to learn from.  A
    null key is neither held out nor learned from.  Equal scores go to the first language by name.
    Very long texts are read whole, in pieces.  Other columns are ignored; repeated rows repeat.
    """
    model = fit_language(docs if fit_on is None else fit_on, params, text, key, lang)
    held_out = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.select(F.col(key).alias("key"), held_out.alias("held_out"), language_of(model, F.col(text)).alias("_p")) \
        .select("key", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the predicted language of every document."""
    return identify(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def accepted(model: LanguageModel, found: Column, text: Column, p: LanguageParams) -> Column:
    """Whether a text is taken as one of the learned languages, by its struct of ``language_of``.

    The model decides for texts with at least ``min_grams`` distinct n-grams.  Shorter ones give it too
    little to go by; they pass if at least half of what is not white space are letters.
    """
    limit = F.element_at(F.create_map(*[F.lit(v) for pair in zip(model.languages, model.limits) for v in pair]), found["lang"])
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]", ""))
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    return (found["lang"] != UNKNOWN) & F.when(found["grams"] >= p.min_grams, found["score"] >= limit).otherwise(2 * letters >= solid)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in none of the learned languages go, all columns stay.

    Those are texts without a letter and texts that ``accepted`` refuses.  Where no language can be
    learned (no labelled row), texts with a letter stay.
    """
    p = LanguageParams()
    model = fit_language(docs, p)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(F.struct("*").alias("row"), language_of(model, F.col("text")).alias("found"))
    return rows.where(F.coalesce(accepted(model, F.col("found"), F.col("row.text"), p), F.lit(False))).select("row.*")
