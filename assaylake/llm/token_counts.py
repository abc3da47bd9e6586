"""Token counts per section from one encoding of each whole document."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed value: the pre-tokenisation pattern that belongs to the byte-level vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "most")


@dataclass(frozen=True)
class TokenParams:
    """vocabulary: file of base64 byte strings and ranks, read on the driver and sent to the tasks;
    rule: who gets a token that crosses a boundary, the section of its ``first`` or ``last``
    character or the one with ``most`` of its bytes (ties to the earlier)."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    rule: str = "first"


@lru_cache(maxsize=1)
def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of token spans [start, end) to consecutive sections [bounds[i], bounds[i+1]).

    Returns each token's section and whether it reaches into another.  Empty sections get nothing.
    """
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    crossing = first != last
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    chosen = first.copy()
    for t in np.flatnonzero(crossing):
        at = np.arange(first[t], last[t] + 1)
        held = np.minimum(bounds[at + 1], ends[t]) - np.maximum(bounds[at], starts[t])
        chosen[t] = at[int(held.argmax())]
    return chosen, crossing


def section_bounds(fields: list[bytes]) -> tuple[bytes, list[tuple[int, int]], np.ndarray]:
    """The document made of its fields, (field, section) numbers and byte bounds of the sections.

    Fields are joined by line breaks; sections are the lines of a field.  A line break belongs to
    the section it ends.
    """
    names, bounds, at = [], [0], 0
    for f, data in enumerate(fields):
        lines = data.split(b"\n")
        for s, line in enumerate(lines):
            ends = 1 if s < len(lines) - 1 or f < len(fields) - 1 else 0
            at += len(line) + ends
            names.append((f, s)), bounds.append(at)
    return b"\n".join(fields), names, np.array(bounds, np.int64)


def section_tokens(docs: DataFrame, fields: list[str], params: TokenParams | None = None, key: str = "doc_id") -> DataFrame:
    """(key, field, section, char_start, char_end, n_tokens, n_crossing), a row per section of every field.

    A document is encoded once and whole; its token spans are joined to the sections' spans, so the
    counts of a document's sections add up to the length of its encoding.  ``n_crossing`` counts
    those of the section's tokens that reach into another one.  Offsets are characters of the fields
    joined by line breaks.  Null fields are left out; a document whose fields are all null gives no
    row, an empty text one empty section.  Repeated rows and null keys give rows like others; other
    columns are ignored; special-token strings in a text are ordinary text.
    """
    p = params or TokenParams()
    if p.rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(p.vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, under a megabyte
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, field string, section int, char_start long, char_end long, n_tokens int, n_crossing int"
    names = ["key", "field", "section", "char_start", "char_end", "n_tokens", "n_crossing"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes = _encoder(sent.value)
        for b in batches:
            row, field, columns = [], [], [[] for _ in range(5)]

            def flush() -> pa.RecordBatch:
                made = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
                keys = b.column(0).take(pa.array(np.array(row, np.int64)))
                out = [keys, pa.array(field, pa.string()), pa.array(made[0], pa.int32()), pa.array(made[1], pa.int64()),
                       pa.array(made[2], pa.int64()), pa.array(made[3], pa.int32()), pa.array(made[4], pa.int32())]
                return pa.RecordBatch.from_arrays(out, names)

            for i in range(b.num_rows):
                given = [(n, b.column(k + 1)[i].as_py()) for k, n in enumerate(fields)]
                given = [(n, v) for n, v in given if v is not None]
                if not given:
                    continue
                data, of, bounds = section_bounds([v.encode() for _, v in given])
                ends = np.cumsum(sizes[np.array(encoder.encode_ordinary("\n".join(v for _, v in given)), np.int64)]) if data else np.zeros(0, np.int64)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                section, crossing = allocate(starts, ends, bounds, p.rule)
                letters = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[bounds]
                row += [i] * len(of)
                field += [given[f][0] for f, _ in of]
                for c, x in zip(columns, (np.array([s for _, s in of]), letters[:-1], letters[1:], np.bincount(section, minlength=len(of)),
                                          np.bincount(section, crossing, len(of)).astype(np.int64))):
                    c.append(x)
                if len(row) > 200_000:
                    yield flush()
                    row, field, columns = [], [], [[] for _ in range(5)]
            if row:
                yield flush()

    return docs.select(key, *[F.col(c).cast("string") for c in fields]).mapInArrow(each, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: tokens of every line of every document; section_no counts from 1."""
    return section_tokens(table(spark, sf_dir, "documents"), ["text"]).select(
        F.col("key").alias("doc_id"), (F.col("section") + 1).alias("section_no"), "char_start", "char_end", "n_tokens", "n_crossing")
