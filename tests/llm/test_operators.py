"""Every operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables
and extra columns with clashing names."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assaylake.llm import (common, language, lines, mixing, near_copies, ngrams, packing, perplexity_rules, quality_model, simhash,
                           token_counts, topk, units)
from assaylake.llm.common import components, spread_rank

SHAPE = "doc_id long, text string, lang string, source string, key string, fp long, h1 long, line string, _drops string"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source) with columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, "k", 1, 2, "l", "d") for r in rows], SHAPE)


def odd_rows():
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977} of" for i in range(30000))
    same = "One line that is long enough to count.\nAnother line that is long enough, too."
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, same, "en", "a"), (5, same, "en", "b"), (5, same, "en", "b"),
            (None, same, "en", None), (6, long, "de", "a"), (7, "x", None, "b"), (8, "12 34 !!", "de", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_rows())


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# --- helpers -----------------------------------------------------------------------------------

def test_components_and_spread_rank(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {x: top(x) for x in list(root) if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("g"), "id")
    ranked = spread_rank(rows, ["g"], ["id"], F.floor(F.col("id") / 100), F.col("id"))
    sums = defaultdict(int)
    for r in sorted(ranked.collect(), key=lambda r: r.id):
        assert r.before == sums[r.g]
        sums[r.g] += r.id


def test_release(spark, monkeypatch):
    monkeypatch.setattr(common, "_STAGED", [])
    held = common.stage(spark.range(5).toDF("n"), "held")
    assert held.count() == 5
    path = common._STAGED[0].removeprefix("file:")
    assert os.path.isdir(path)
    common.release(spark)
    assert not os.path.exists(path) and not common._STAGED


# --- SimHash -----------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, sample):
    rows = sample.select("doc_id", "text").collect()
    want = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    root = {k: k for k in want}
    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(want, 2):
        if bin(want[a] ^ want[b]).count("1") <= 3 and top(a) != top(b):
            root[max(top(a), top(b))] = min(top(a), top(b))
    got = simhash.op5_simhash(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{v:016x}", top(k)) for k, v in want.items()}


@pytest.mark.parametrize("bits", [1, 2, 3, 5])
def test_near_pairs_lose_none(spark, bits):
    random.seed(bits)
    seeds = [random.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    values = {s ^ sum(1 << b for b in random.sample(range(64), random.randrange(bits + 2))) for s in seeds for _ in range(8)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    got = simhash.near_pairs(spark.createDataFrame([(v,) for v in signed] * 2, "fp long"), bits).collect()
    want = {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= bits}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_simhash_odd(odd, none):
    got = [(r.key, r.fp, r.component) for r in simhash.simhash_groups(odd).collect()]
    assert len(got) == 10
    by = {k: (f, c) for k, f, c in got}
    assert by[1] == by[2] == by[3] == (0, 1)
    assert by[4][1] == by[5][1] == by[None][1] == 4
    assert simhash.simhash_groups(none).count() == 0
    assert sorted(r.doc_id or 0 for r in simhash.simhash_stage(None, odd, "").collect()) == [0, 1, 4, 6, 7, 8]


def test_stage_removes_every_near_copy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rnd = random.Random(8)
    made = [" ".join(f"w{rnd.randrange(4000)}" for _ in range(n)) for n in range(5, 200, 5) for _ in range(4)]
    for t in list(made):  # one or two words changed, and long runs of edits linked in a chain
        words = t.split()
        for _ in range(2):
            words[rnd.randrange(len(words))] = f"new{rnd.random()}"
            made.append(" ".join(words))
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(made)], docs.schema))
    sets = {}
    for r in docs.collect():
        w = (r.text or "").lower().split()
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    root = {k: k for k in sets}
    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    holders, shared = defaultdict(list), Counter()
    for k, s in sets.items():
        for g in s:
            shared.update((o, k) for o in holders[g])
            holders[g].append(k)
    for (a, b), n in shared.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n) and top(a) != top(b):
            root[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.key: r.component for r in near_copies.copy_groups(docs).collect()}
    assert got == {k: top(k) for k in sets}
    left = {r.doc_id for r in simhash.simhash_stage(spark, docs, "").collect()}
    assert left == {k for k in sets if top(k) == k} and not left & {56, 914, 875}


def test_near_copy_stage_joins_fingerprints(spark, monkeypatch):
    """The stage's candidates come from SimHash and pigeonring too, and the exact similarity decides."""
    rnd = random.Random(3)
    base = [" ".join(f"w{rnd.randrange(9000)}" for _ in range(300)) for _ in range(6)]
    made = base + [" ".join([*t.split()[:-1], f"new{i}"]) for i, t in enumerate(base)]
    seen, join = [], near_copies.near_pairs
    monkeypatch.setattr(near_copies, "near_pairs", lambda fps, bits: seen.append(join(fps, bits)) or seen[-1])
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert [r.doc_id for r in simhash.simhash_stage(spark, docs, "").orderBy("doc_id").collect()] == list(range(6))
    fps = [simhash.set_fingerprint(near_copies.shingles(t, 5)) for t in made]
    near = {(min(a, b), max(a, b)) for a, b in combinations(fps, 2) if 0 < bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert len(seen) == 1 and near and {(r.a, r.b) for r in seen[0].collect()} == near
    classes = spark.createDataFrame(list(enumerate(fps)), "h long, fp long")
    stars = {(r.a, r.b) for r in near_copies.simhash_stars(classes).collect()}
    close = {tuple(sorted(((i, j)))) for i, j in combinations(range(12), 2) if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 3}
    assert {tuple(sorted(x)) for x in stars} == close
    assert simhash.set_fingerprint(np.zeros(0, np.uint64)) == 0


# --- language: the stage decides by its model, the model equals plain sums -----------------------

def test_language_stage_refuses_unknown_languages(spark, sample):
    rows = [tuple(r) for r in sample.collect()]
    odd = ["Это простой текст на русском языке, который никто здесь не знает, и он достаточно длинный.", "これは日本語で書かれた長い文章であり、学習に使われた四つの言語のどれにも属していないので、取り除かれるべきものです。",
           "Tämä on suomenkielinen lause, jota kukaan ei tunne, ja se on tarpeeksi pitkä.", "%%% 12 z ###", "0x1f && 0x2e || !q[7]; " * 8]
    fine = ["Re.", "x", rows[0][1]]
    docs = spark.createDataFrame(rows + [(10_000 + i, t, None, "s", len(t)) for i, t in enumerate(odd + fine)], sample.schema)
    out = language.language_stage(spark, docs, "")
    assert out.columns == docs.columns
    left = {r.doc_id for r in out.collect()}
    assert left & set(range(10_000, 10_100)) == {10_000 + len(odd) + i for i in range(len(fine))}
    clean = {r[0] for r in rows if r[1] and len(r[1]) > 200}
    assert len(clean - left) <= 0.01 * len(clean)


def test_language_scores_against_plain_numpy(spark):
    """Kernel, landmarks and ridge once more, n-gram by n-gram, on a small table."""
    random.seed(11)
    sounds = {"aa": ["ka", "ro", "mi"], "bb": ["sche", "tzu", "ung"], "cc": ["ión", "ña", "qué"]}
    rows = [(i, " ".join("".join(random.choices(sounds[l], k=random.randint(1, 3))) for _ in range(6)), l, "s")
            for i, l in enumerate(random.choices(list(sounds), k=60))]
    p = language.LanguageParams(per_language=100, landmarks=4)
    got = {r.key: r for r in language.identify(documents(spark, rows), p).collect()}

    def grams(t):
        t = " " + " ".join(t.lower().split()) + " "
        return {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    model = language.fit_language(documents(spark, rows), p)
    fit = sorted((l, language.Spectrum(3).codes(t).astype(np.int32).tobytes(), t) for k, t, l, _ in rows if zlib.crc32(str(k).encode()) % 5)
    sets, of = [grams(t) for *_, t in fit], [l for l, *_ in fit]
    marks = []
    for l in model.languages:
        own = [i for i, x in enumerate(of) if x == l]
        marks += [sets[own[round(j)]] for j in np.linspace(0, len(own) - 1, min(4, len(own)))]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    x = np.array([[kernel(a, b) for b in marks] for a in sets]) @ root
    y = np.array([[1.0 if l == m else -1.0 for m in model.languages] for l in of])
    w = np.array([len(of) / (len(model.languages) * of.count(l)) for l in of])
    mx, my = (w[:, None] * x).sum(0) / w.sum(), (w[:, None] * y).sum(0) / w.sum()
    beta = np.linalg.solve((x - mx).T @ (w[:, None] * (x - mx)) + p.ridge * len(of) * np.eye(x.shape[1]), (x - mx).T @ (w[:, None] * (y - my)))
    for key, text, *_ in rows:
        f = (np.array([kernel(grams(text), b) for b in marks]) @ root - mx) @ beta + my
        assert got[key].score == pytest.approx(np.clip((f.max() + 1) / 2, 0, 1), abs=1e-4)
        assert got[key].lang_pred == model.languages[int(f.argmax())]


# --- lines -------------------------------------------------------------------------------------

def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(text, times, letters="abé"):
    out = list(text)
    for _ in range(times):
        at, how = random.randint(0, len(out)), random.random()
        if how < 0.34 or not out:
            out.insert(at, random.choice(letters))
        elif how < 0.67:
            del out[min(at, len(out) - 1)]
        else:
            out[min(at, len(out) - 1)] = random.choice(letters)
    return "".join(out)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_edit_distance(spark, most):
    random.seed(most)
    pairs = [(a, edited(a, random.randint(0, 5))) for a in ("".join(random.choice("abé") for _ in range(random.randint(0, 40))) for _ in range(400))]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.edit_distance(F.col("a"), F.col("b"), most).alias("d")).collect()
    for r in got:
        d = levenshtein(r.a, r.b)
        assert r.d == (d if d <= most else None), r


@pytest.mark.parametrize("hot", [1, 48])
def test_line_marks(spark, hot):
    random.seed(5)
    base = ["".join(random.choice("abcdé ") for _ in range(random.randint(18, 60))) for _ in range(12)]
    rows = [(i, "\n".join(edited(random.choice(base), random.choice([0, 0, 1, 2, 4])) for _ in range(4)) + "\nshort one\n" + random.choice("xyz"), "en", "a") for i in range(60)]
    got = {(r.key, r.pos): r for r in lines.mark_lines(documents(spark, rows), lines.LineParams(hot=hot)).collect()}
    at = {(i, k): x for i, t, *_ in rows for k, x in enumerate(t.split("\n")) if x.strip()}
    assert set(got) == set(at)
    first = {}
    for k in sorted(at):
        first.setdefault(at[k], k)
    near = {a: [b for b in first if a != b and min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= 2 and levenshtein(a, b) <= 2] for a in first}
    assert sum(map(len, near.values())) > 50
    for k, x in at.items():
        r = got[k]
        assert ((r.class_key, r.class_pos), r.n_copies, r.n_links) == (first[x], sum(v == x for v in at.values()), len(near[x]))
        assert r.kept == (first[x] == k and not any(first[y] < k for y in near[x]))


def test_lines_odd(odd, none):
    out = lines.dedup_lines(odd)
    assert out.columns == odd.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert set(texts) == {1, 2, 3, 4, 6, 7, 8}
    assert texts[1] is None and texts[2] == "" and "\n" in texts[4]
    assert lines.mark_lines(none).count() == 0 and lines.dedup_lines(none).count() == 0


# --- language ----------------------------------------------------------------------------------

def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.op7_language(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert set(got) == set(truth)
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert {k for k, r in got.items() if r.held_out} == set(held)
    assert np.mean([got[k].lang_pred == truth[k] for k in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    other = language.identify(docs.withColumn("source", F.lit("x")).withColumn("doc_id", F.col("doc_id") + 0), fit_on=docs)
    assert {(r.key, r.lang_pred) for r in other.collect()} == {(k, r.lang_pred) for k, r in got.items()}
    odd_got = language.identify(odd, fit_on=docs).collect()
    assert len(odd_got) == 10
    assert {r.key for r in odd_got if r.lang_pred == "und"} == {1, 2, 3, 8}
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(odd, fit_on=none).collect()} == {"und"}
    assert {r.doc_id for r in language.language_stage(spark, odd, "").collect()} == {4, 5, None, 6, 7}


def test_spectrum_pieces(monkeypatch):
    text = "Über den Wolken, " * 40 + "ça va"
    whole = language.Spectrum(3).codes(text)
    monkeypatch.setattr(language, "_STEP", 50)
    assert (language.Spectrum(3).codes(text) == whole).all()
    assert language.Spectrum(3).codes("12 !") is None


# --- mixing ------------------------------------------------------------------------------------

def test_mixing(spark):
    random.seed(1)
    size = {"a": 600, "b": 60, "c": 40, None: 30}
    rows = [(i, " ".join(["w"] * random.randint(1, 30)), "en", s) for i, s in enumerate(s for s, n in size.items() for _ in range(n))]
    tokens = Counter()
    for _, t, _, s in rows:
        tokens[s] += len(t.split())
    p = mixing.MixParams(entropy=0.9, block_tokens=200)
    docs = documents(spark, rows)
    got = mixing.mix_sources(docs, p).collect()
    drawn = Counter()
    for r in got:
        drawn[r.source] += r.n_tokens
    total = sum(tokens.values())
    share = {s: drawn[s] / total for s in tokens}
    entropy = -sum(x * math.log(x) for x in share.values()) / math.log(len(share))
    assert abs(entropy - 0.9) < 0.02 and share["a"] < tokens["a"] / total
    assert max(Counter((r.key, r.epoch) for r in got).values()) == 1
    for s in tokens:  # whole epochs first, each a permutation of all documents
        ids = {i for i, _, _, x in rows if x == s}
        for e in range(1, int(drawn[s] // tokens[s]) + 1):
            assert {r.key for r in got if r.source == s and r.epoch == e} == ids
    ranks = {e: {r.key: r.block_rank for r in got if r.source == "c" and r.epoch == e} for e in (1, 2)}
    assert any(ranks[1][k] != r for k, r in ranks[2].items())
    capped = Counter()
    for r in mixing.mix_sources(docs, mixing.MixParams(entropy=1.0, max_repeats=2.0, block_tokens=200)).collect():
        capped[r.source] += r.n_tokens
    assert all(capped[s] <= 2 * tokens[s] + 1 for s in tokens) and capped[None] > 1.8 * tokens[None]


def test_mixing_odd(spark, odd, none):
    got = mixing.mix_sources(odd).collect()
    assert {r.key for r in got} <= {4, 5, None, 6, 7, 8}
    assert mixing.mix_sources(none).count() == 0
    out = mixing.mixing_stage(spark, odd, "")
    assert out.columns == odd.columns and out.where("doc_id < 4").count() == 0


# --- packing -----------------------------------------------------------------------------------

def least_padding(lengths, counts, buckets):
    n, best = len(lengths), None
    for k in range(1, min(buckets, n) + 1):
        for cut in combinations(range(1, n), k - 1):
            edges = [0, *cut, n]
            cost = sum(lengths[b - 1] * counts[i] for a, b in zip(edges, edges[1:]) for i in range(a, b))
            best = cost if best is None else min(best, cost)
    return best


def test_bounds_are_optimal():
    random.seed(2)
    for _ in range(60):
        n = random.randint(1, 9)
        lengths, counts = sorted(random.sample(range(0, 100), n)), [random.randint(1, 50) for _ in range(n)]
        bounds = packing.bucket_bounds(np.array(lengths), np.array(counts), k := random.randint(1, 4))
        cost = sum(c * min(b for b in bounds if b >= x) for x, c in zip(lengths, counts))
        assert len(bounds) <= k and bounds[-1] == lengths[-1] and cost == least_padding(lengths, counts, k)


def test_packing(sample, odd, none):
    p = packing.PackParams(buckets=4, batch_tokens=2000, shard_rows=10)
    got = packing.pack(sample, p).collect()
    assert sorted(r.key for r in got) == sorted(r.doc_id for r in sample.select("doc_id").collect())
    groups = defaultdict(list)
    for r in got:
        assert r.padding == r.bucket_tokens - r.n_tokens >= 0
        groups[r.bucket, r.batch].append(r)
    for (bucket, batch), rows in groups.items():
        fit = max(1, 2000 // rows[0].bucket_tokens)
        last = batch == max(b for k, b in groups if k == bucket)
        assert sorted(r.slot for r in rows) == list(range(len(rows))) and (len(rows) == fit or last and len(rows) < fit)
    odd_rows_ = packing.pack(odd).collect()
    assert len(odd_rows_) == 10 and {r.n_tokens for r in odd_rows_ if r.key in (1, 2, 3)} == {0}
    assert packing.pack(none).count() == 0


# --- top k -------------------------------------------------------------------------------------

def test_topk(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.2, (700, 12)).astype(float)
    x[100:160] = x[100]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1020, [1.0, None] + [0.0] * 10), (1040, [float("nan")] * 12), (1060, [float("inf")] * 12), (1080, [0.5, 0.5]), (1100, [0.0] * 12)]
    table = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, key int")
    vectors = topk.integer_vectors(table, "vec_id", "embedding")
    p = topk.TopkParams(block_rows=200, query_rows=16)
    got = topk.top_k(vectors, vectors.where("key % 20 = 0"), p).collect()
    v = {i: np.array([math.floor(64 * c) for c in r] + [0] * (12 - len(r))) for i, r in rows if r and all(c is not None and math.isfinite(c) for c in r)}
    want = set()
    for q in (i for i in v if i % 20 == 0):
        best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:20]
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {(r["query"], r["rank"], r["key"], r["score"]) for r in got} == want and len(got) == len(want)
    empty = vectors.where("key < 0")
    assert topk.top_k(empty, empty).count() == 0 and topk.top_k(vectors.where("key = 0"), vectors.where("key = 0")).count() == 0


# --- units -------------------------------------------------------------------------------------

def test_repeated_spans(sample):
    p = units.UnitParams()
    rows = sorted((r.doc_id, r.text) for r in sample.select("doc_id", "text").collect())
    first, gone = {}, {}
    for key, text in rows:
        for level, start, end, _, digest in sorted(units.units_in(text, p), key=lambda u: u[1]):
            if (level, digest) in first:
                gone[key, start, end, level] = first[level, digest]
            else:
                first[level, digest] = (key, start)
    want = {(k, s, e, level): f for (k, s, e, level), f in gone.items()
            if level == 0 or not any(k == k2 and l2 == 0 and s2 <= s and e <= e2 for k2, s2, e2, l2 in gone)}
    got = units.repeated_spans(sample).collect()
    assert {(r.key, r.start, r.end, int(r.unit == "sentence")): (r.first_key, r.first_start) for r in got} == want
    assert len(got) == len(want) > 20
    cut = {r.doc_id: r for r in units.remove_spans(sample, units.repeated_spans(sample)).collect()}
    for key, text in rows:
        spans = sorted((s, e) for k, s, e, _ in want if k == key)
        assert [(s.start, s.end) for s in cut[key].removed or []] == spans
        for s, e in reversed(spans):
            text = text[:s] + text[e:]
        assert cut[key].text == text


def test_units_find_and_normalise():
    text = "  First  LINE has five words. \nshort\nOne two three four five six seven eight! Nine ten."
    found = list(units.units_in(text, units.UnitParams()))
    assert [(u[0], text[u[1]:u[2]]) for u in found] == [
        (0, "First  LINE has five words."), (0, "One two three four five six seven eight! Nine ten."), (1, "One two three four five six seven eight!")]
    assert found[0][4] == next(units.units_in("first line HAS five words.", units.UnitParams()))[4]
    assert [text[u[1]:u[2]] for u in units.units_in("a b c d e\nf\n\ng h i j k", units.UnitParams("paragraph", 2, None)) if (text := "a b c d e\nf\n\ng h i j k")] \
        == ["a b c d e\nf", "g h i j k"]


def test_units_odd(odd, none):
    got = units.repeated_spans(odd).collect()
    assert {r.key for r in got} == {5, None} and {r.first_key for r in got} == {4}
    assert len([r for r in got if r.key == 5]) == 4
    assert units.repeated_spans(none).count() == 0


# --- tokens ------------------------------------------------------------------------------------

@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(sample, rule):
    docs = sample.limit(30)
    with open(token_counts.TokenParams.vocabulary, "rb") as f:
        encoder, sizes = token_counts._encoder(f.read())
    rows = {r.doc_id: r for r in docs.collect()}
    got = defaultdict(list)
    for r in token_counts.section_tokens(docs, ["source", "text"], token_counts.TokenParams(rule=rule)).collect():
        got[r.key].append(r)
    assert set(got) == set(rows)
    for key, parts in got.items():
        whole = rows[key].source + "\n" + rows[key].text
        parts.sort(key=lambda r: r.char_start)
        assert "".join(whole[r.char_start:r.char_end] for r in parts) == whole
        ids = encoder.encode_ordinary(whole)
        assert encoder.decode(ids) == whole and sum(r.n_tokens for r in parts) == len(ids)
        bounds = [len(whole[:r.char_start].encode()) for r in parts] + [len(whole.encode())]
        at, want = 0, Counter()
        for i in ids:
            span = range(at, at := at + int(sizes[i]))
            inside = [sum(bounds[s] <= b < bounds[s + 1] for b in span) for s in range(len(parts))]
            hit = [s for s, n in enumerate(inside) if n]
            want[{"first": hit[0], "last": hit[-1], "most": inside.index(max(inside))}[rule]] += 1
        assert [r.n_tokens for r in parts] == [want[s] for s in range(len(parts))]


def test_tokens_odd(odd, none):
    got = token_counts.section_tokens(odd, ["text"]).collect()
    assert Counter(r.key for r in got) == {2: 1, 3: 2, 4: 2, 5: 4, None: 2, 6: 1, 7: 1, 8: 1}
    assert token_counts.section_tokens(none, ["text"]).count() == 0


# --- n-gram models -----------------------------------------------------------------------------

def plain_kneser_ney(texts, order):
    """Probability function, by the textbook formulas on dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        row = ngrams.padded(t.encode(), order).tobytes()
        for i in range(len(row) - order + 1):
            counts[order][row[i:i + order]] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    off, sums = {}, {}
    for n, table in counts.items():
        of = Counter(table.values())
        off[n] = ngrams.discounts(*[of[k] for k in (1, 2, 3, 4)])
        sums[n] = defaultdict(lambda: [0, 0.0])
        for g, c in table.items():
            sums[n][g[:-1]][0] += c
            sums[n][g[:-1]][1] += off[n][min(c, 3) - 1]

    def p(g):
        n = len(g)
        lower = 1 / 256 if n == 1 else p(g[1:])
        if g[:-1] not in sums[n]:
            return lower
        total, left = sums[n][g[:-1]]
        c = counts[n].get(g, 0)
        return ((c - off[n][min(c, 3) - 1]) if c else 0) / total + left / total * lower

    return p


def plain_nll(p, text, order):
    row = ngrams.padded(text.encode(), order).tobytes()
    return -sum(math.log(p(row[i:i + order])) for i in range(len(row) - order + 1))


def test_kneser_ney_and_both_scorers(spark, sample, monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK", 1000)
    rows = sample.where("doc_id < 40")
    train = [r.text for r in rows.where("doc_id % 2 = 0").collect()]
    for order in (3,):
        p = plain_kneser_ney(train, order)
        assert abs(sum(p(b"th"[:order - 1] + bytes([b])) for b in range(256)) - 1) < 1e-9
        entries, contexts, floor = ngrams.kneser_ney(ngrams.count_ngrams(rows.where("doc_id % 2 = 0"), order), order)
        want = {r.doc_id: plain_nll(p, r.text, order) for r in rows.collect()}
        for pieces in (10**6, entries.count() // 2):
            rp = perplexity_rules.RuleParams(order=order, piece_entries=pieces)
            got = perplexity_rules.perplexities(rows.unionByName(rows), entries, contexts, floor, rp, "text", "doc_id").collect()
            assert len(got) == 2 * len(want)
            for r in got:
                assert math.isclose(r.nll, want[r.key], rel_tol=1e-9)
                assert r.n_words == perplexity_rules.base_counts(rows_text(rows, r.key))[0]
        cp = quality_model.ClassifierParams(order=order, block_bytes=20000)
        scored = quality_model.document_scores(rows.select(F.col("doc_id").alias("key"), "text"), entries, contexts, floor, cp).collect()
        assert len(scored) == len(want)
        for r in scored:
            assert math.isclose(r.nll, want[r.key], rel_tol=1e-5)


_TEXTS = {}


def rows_text(rows, key):
    if not _TEXTS:
        _TEXTS.update({r.doc_id: r.text.encode() for r in rows.collect()})
    return _TEXTS[key]


def test_base_counts():
    def plain(text):
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
        grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        marked = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
        rows = [x for x in text.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(rows) - len(set(rows)), len(marked)

    random.seed(6)
    for _ in range(200):
        text = "".join(random.choice(["a", "b", "é", "漢", "#", "<", " ", "\n", "\t", "\x0b", " ", "\x1c"]) for _ in range(random.randint(0, 80)))
        assert perplexity_rules.base_counts(text.encode()) == plain(text), repr(text)


def test_rules_and_classifier_odd(spark, odd, none):
    got = perplexity_rules.quality_rules(odd).collect()
    assert len(got) == 10
    by = {r.key: r for r in got}
    assert by[1].perplexity is None and not by[1].kept and by[2].n_words == 0 and by[3].base_failed
    assert by[6].n_words == 60000
    assert perplexity_rules.quality_rules(none).count() == 0
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 1, 1), (6, 0, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    out = quality_model.classify_quality(odd, labels).collect()
    assert len(out) == 10 and {r.key for r in out if r.trusted} == {4}
    kept = {r.key for r in out if r.kept}
    assert {4, 5, None} <= kept and not kept & {1, 2, 6}
    assert quality_model.classify_quality(none, labels).count() == 0
    assert not any(r.kept for r in quality_model.classify_quality(odd, labels.where("doc_id < 0")).collect())


def test_verdicts_on_labels(spark):
    """Clean documents stay, most labelled junk goes."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = defaultdict(list)
    for r in quality_model.op1_quality(spark, sf).collect():
        kept[labels.get(r.doc_id)].append(r.kept)
    assert np.mean(kept[1, 0]) > 0.97 and np.mean(kept[0, 0]) < 0.25
    judged = [r for r in perplexity_rules.op10_quality_rules(spark, sf).collect() if not r.base_failed]
    assert np.mean([r.kept for r in judged if labels.get(r.doc_id) == (1, 0)]) > 0.97
    assert np.mean([r.kept for r in judged if labels.get(r.doc_id, (1,))[0] == 0]) < 0.65  # at three quartile distances 0.8 would stay


def test_line_sketch_and_shared_keys(spark):
    """Lines one character apart are linked whatever the character, and unmoved keys of equal lengths are made once."""
    p = lines.LineParams()
    assert {name for _, name, key in lines.probe_keys(p) if key is None} == {f"i{i}" for i in range(p.edits + 1)}
    marks = [chr(c) for c in range(33, 127)] + list("\u00df\u00e4\u00e9\u03b1\u4e2d")
    rows = [(2 * i + k, f"{i:03d} " * 8 + end) for i, c in enumerate(marks) for k, end in enumerate(("", c))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.key: r for r in lines.mark_lines(docs, p).collect()}
    assert all(got[2 * i].n_links >= 1 and not got[2 * i + 1].kept for i in range(len(marks)))


def test_near_pairs_are_never_broadcast(spark):
    """Each fingerprint is listed under 68 keys, which Spark sizes as one: a table below its limit went to the driver 68-fold."""
    fps = spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % (1 << 63),) for i in range(1, 200)] + [(7,), (15,)], "fp long")
    pairs = simhash.near_pairs(fps)
    assert [tuple(r) for r in pairs.collect()] == [(7, 15)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_topk_meets_blocks_without_broadcast_or_shuffle(spark):
    """Groups of queries times blocks are read where they are compared; wide numbers and many files give the same rows."""
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-300, 300) * (10**6 if i % 7 == 0 else 1) for _ in range(5)]) for i in range(90)]
    vectors = spark.createDataFrame(rows, "key long, v array<long>")
    found = topk.top_k(vectors, vectors.where("key % 3 = 0"), topk.TopkParams(k=4, block_rows=20, query_rows=5, query_files=3))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and plan.count("Exchange") == 1
    want = set()
    for key, v in rows[::3]:
        best = sorted((-sum(a * b for a, b in zip(v, w)), k) for k, w in rows if k != key)[:4]
        want |= {(key, rank, k, -score) for rank, (score, k) in enumerate(best, 1)}
    assert {tuple(r) for r in found.collect()} == want


def test_sets_are_compared_in_scans_and_turns(spark, monkeypatch):
    """Shares of the classes and of the pairs give the links of one pass; no scan fetches more classes than the bound."""
    rng, rows = random.Random(5), []
    for i in range(30):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        rows += [(3 * i + j, " ".join(words[:60 - 2 * j])) for j in range(3)]
    docs = spark.createDataFrame(rows + [(1000, rows[0][1]), (None, "one"), (None, None)], "doc_id long, text string")
    fetched, real = [], near_copies.stage
    monkeypatch.setattr(near_copies, "stage", lambda df, name: fetched.append(name) or real(df, name))
    whole = sorted(map(tuple, near_copies.copy_groups(docs).collect()), key=str)
    assert fetched.count("copies-links") == fetched.count("copies-sets") == 3
    fetched.clear()
    parts = sorted(map(tuple, near_copies.copy_groups(docs, near_copies.CopyParams(needed=20, turns=3, compared=50)).collect()), key=str)
    assert parts == whole and fetched.count("copies-sets") >= 4 and fetched.count("copies-links") >= 5
    assert sum(k is not None and k != c for k, c in whole) == 61


def test_a_staged_table_leaves_no_shuffle_files(spark):
    """What a staged table shuffled goes at its end; plans that are still held can run again."""
    from glob import glob

    from pyspark import SparkContext

    local = SparkContext._active_spark_context._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: sum((glob(f"{d}/**/shuffle_*.data", recursive=True) for d in local), [])
    before = set(files())
    grouped = spark.range(1000).groupBy(F.pmod("id", F.lit(7)).alias("k")).count()
    staged = common.stage(grouped, "counts")
    assert not set(files()) - before and staged.count() == grouped.count() == 7
    assert spark.conf.get(common._CLEAN) == "false"


def test_pipeline_fingerprints_are_never_broadcast(spark, monkeypatch):
    """The pipeline's candidates come from the same join of listed keys."""
    seen, real = [], near_copies.components
    monkeypatch.setattr(near_copies, "components", lambda edges: seen.append(edges) or real(edges))
    classes = spark.createDataFrame([(i, i * 0x9E3779B97F4A7C15 % (1 << 63)) for i in range(1, 100)] + [(200, 7), (201, 15), (202, 7)], "h long, fp long")
    stars = near_copies.simhash_stars(common.stage(classes, "classes"))
    assert {tuple(r) for r in stars.collect()} == {(200, 201), (200, 202)}
    assert "Broadcast" not in seen[0]._jdf.queryExecution().executedPlan().toString()
