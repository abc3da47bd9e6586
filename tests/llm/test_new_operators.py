"""Toxicity, clustering and conversation repair against plain versions, and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from assaylake.llm import clustering, conversations, toxicity
from assaylake.llm.ngrams import discounts

SF = "/root/testdata/sf0.01"


# --- conversation repair -------------------------------------------------------------------------

def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if fate == 1:
            text = ""
        if fate == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if fate == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def plain_repair(rows):
    """Faults, and the least (cost, audit, turns) by trying every edit with whole strings."""
    solid = [t.strip(" \t\n\x0b\x0c\r") for _, _, t in rows]
    seen, faults = set(), []
    for (_, role, text), s in zip(rows, solid):
        faults.append("blank" if not s else "duplicate" if (role, text) in seen else "truncated" if s[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {("", "u"), ("", "s"), ("s", "u"), ("u", "a"), ("a", "u")}
    best = {"": (0, "", [])}

    def insert(best):
        for _ in range(2):
            for last, (cost, audit, turns) in list(best.items()):
                for to, name in (("u", "user"), ("a", "assistant")):
                    if (last, to) in follow:
                        new = (cost + 2, audit + "I", [*turns, f"{name}:"])
                        if to not in best or new[:2] < best[to][:2]:
                            best[to] = new
        return best

    best = insert(best)
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for last, (cost, audit, turns) in best.items():
            ways = [(last, 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                ways.append((role[:1], extra, "K", [f"{role}:{text}"]))
                ways += [(to, 2 + extra, "R", [f"{name}:{text}"]) for to, name in (("u", "user"), ("a", "assistant"))]
            for to, more, edit, turn in ways:
                if edit == "D" or (last, to) in follow:
                    new = (cost + more, audit + edit, turns + turn)
                    if to not in after or new[:2] < after[to][:2]:
                        after[to] = new
        best = insert(after)
    cost, audit, turns = min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])
    return Counter(faults), cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()


def plain_audit(rows):
    out, kept = {}, plain_damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted(kept.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0))  # ties: equal rows only
        faults, cost, audit, digest = plain_repair(mine)
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)
    return out


def conversation_rows(n, seed):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        turn = rng.choice([0, 0, 5, -3])
        for _ in range(rng.choice([0, 1, 2, 4, 9, 40])):
            turn += rng.choice([1, 1, 1, 2, 7])
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            rows.append((conv, turn, role, rng.choice(["Yes.", "Is it?", "no end", " \t\n", None, "", "Ends! \n", "ß é…", "No. 5"])))
    rows += [(None, 3, "user", "A."), (None, 4, "assistant", "B."), (7000, None, "user", "Null turn."), (7000, 2, "assistant", "x"), (7001, None, None, None)]
    return rows


@pytest.mark.parametrize("params", [conversations.RepairParams(), conversations.RepairParams(piece=3, copies=1, flush=5)])
def test_repair_against_whole_strings(spark, params):
    rows = conversation_rows(120, 5)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, piece int, audit string").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.audit_conversations(frame, params).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert got == plain_audit(rows)
    assert any(v[5] == 0 and v[7] == hashlib.sha256(b"").hexdigest() for v in got.values())  # nothing left after damage


def test_repair_of_the_whole_table_and_its_turns(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    want = plain_audit(rows)
    got = {r.conv_id: r for r in entry.queries()["op13_conversations"](spark, SF).collect()}
    assert {k: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for k, r in got.items()} == want
    turns = defaultdict(list)
    for r in conversations.repaired_conversations(table).orderBy("conv_id", "piece", "position").collect():
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, w in want.items():
        assert hashlib.sha256("\n".join(turns[conv]).encode()).hexdigest() == w[-1]


def test_repair_of_a_hot_conversation_and_empty_tables(spark):
    rows = [(1, 5, "user", "Same.")] * 400 + [(1, t, "assistant", f"Answer {t % 9}.") for t in range(6, 600)] + [(2, 0, "user", "Hi.")]
    shape = "conv_id long, turn long, role string, text string"
    got = {r.conv_id: r for r in conversations.audit_conversations(spark.createDataFrame(rows, shape), conversations.RepairParams(piece=50)).collect()}
    want = plain_audit(rows)
    for k, w in want.items():
        assert (got[k].duplicate, got[k].illegal, got[k].cost, got[k].audit, got[k].repaired_sha256) == (w[2], w[4], w[5], w[6], w[7])
    assert conversations.audit_conversations(spark.createDataFrame([], shape)).count() == 0


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 5])
def test_linked_strings_sort_like_strings(modulus):
    """Also with a modulus so small that different prefixes share hashes."""
    rng, audits, text = random.Random(2), conversations.Audits(modulus), {0: ""}
    for _ in range(300):
        node = rng.choice(list(text))
        letter = rng.choice("DIKR")
        if text[node] + letter not in text.values():
            text[audits.add(node, letter)] = text[node] + letter
    assert all(audits.text(n) == t for n, t in text.items())
    for _ in range(4000):
        a, b = rng.choice(list(text)), rng.choice(list(text))
        assert audits.less(a, b) == (text[a] < text[b])


# --- clustering ----------------------------------------------------------------------------------

def plain_clusters(rows, p):
    kept = [(k, [math.floor(p.scale * x) for x in v]) for k, v in rows if v and len(v) == p.dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{p.seed}:{k}".encode()).hexdigest(), v) for k, v in kept if k is not None)[:p.clusters]
    centroids = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids)) for _, v in kept]

    for _ in range(p.rounds):
        of = assign()
        for i in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, of) if c == i]
            if own:
                centroids[i] = [sum(x) // len(own) for x in zip(*own)]
    of = assign()
    inertia = Counter()
    for d, c in of:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((k, c, d, inertia[c], sum(inertia.values()), digest[c]) for (k, _), (d, c) in zip(kept, of)), key=str)


def test_clusters_against_plain_lists(spark):
    rng = random.Random(4)
    p = clustering.ClusterParams(dims=6, clusters=7, rounds=3, chunk=64, merge=2)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, rng.random()]) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (304, [float("nan")] * 6), (305, [float("inf")] * 6),
             (5, rows[5][1]), (None, [0.1] * 6), (306, [0.0] * 6), (307, [-0.0] * 6)]
    frame = spark.createDataFrame([(*r, 3, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, key string").repartition(3)
    got = sorted(map(tuple, clustering.cluster(frame, p).collect()), key=str)
    assert got == plain_clusters(rows, p)
    assert clustering.cluster(frame.limit(0), p).count() == 0
    few = clustering.cluster(frame.where("vec_id < 3"), p).collect()
    assert sorted(r.cluster for r in few) == [0, 1, 2] and all(r.distance == 0 for r in few)
    with pytest.raises(Exception, match="overflow"):
        clustering.cluster(spark.createDataFrame([(1, [1e9] * 6)], "vec_id long, embedding array<double>"), p).collect()


def test_dictionaries_are_lossless_and_small():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-3, 4, (4000, 8)), rng.integers(-10**6, 10**6, (4000, 8))], axis=1)
    blocks = clustering.encode_chunk(x, 8)
    assert any(w > 1 for _, w, _, _ in blocks)
    back = np.empty_like(x)
    for s, w, distinct, code in blocks:
        assert len(np.unique(distinct, axis=0)) == len(distinct) and (w == 1 or 8 * len(distinct) <= len(x))
        back[:, s:s + w] = distinct[code]
    assert (back == x).all()


def test_clustering_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()['op12_clustering']})").fetchall()
    assert sorted(want) == sorted(map(tuple, entry.queries()["op12_clustering"](spark, SF).select(*names).collect()))


# --- toxicity ------------------------------------------------------------------------------------

def plain_ratio(texts, order, shared):
    """Ratio per byte by dictionaries: texts of class 0 and 1, orders up to ``shared`` counted over both."""
    pad = lambda t: b"\x02" * (order - 1) + t.encode() + b"\x03"
    grams = lambda t, n: [pad(t)[i - n + 1:i + 1] for i in range(order - 1, len(pad(t)))]
    counts = [{order: Counter(g for t in of for g in grams(t, order))} for of in texts]
    for n in range(order - 1, 0, -1):
        if n > shared:
            for c in counts:
                c[n] = Counter(g[1:] for g in c[n + 1])
        else:
            both = Counter(g[1:] for g in {*counts[0][n + 1], *counts[1][n + 1]})
            counts[0][n] = counts[1][n] = both

    def chance(c, g):
        if not g:
            return 1 / 256
        own, lower = counts[c][len(g)], chance(c, g[1:])
        alike = [v for h, v in own.items() if h[:-1] == g[:-1]]
        if not alike:
            return lower
        d = (0, *discounts(*[sum(v == k for v in own.values()) for k in (1, 2, 3, 4)]))
        cut = lambda v: d[min(v, 3)]
        return (own[g] - cut(own[g]) + sum(map(cut, alike)) * lower) / sum(alike)

    return lambda t: sum(math.log(chance(1, g) / chance(0, g)) for g in grams(t, order)) / (len(t.encode()) + 1)


def toxic_rows(n):
    rng = random.Random(8)
    words = ["the", "river", "house", "green", "walks", "under", "small", "garden", "and", "often", "light"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(8, 40))]
        for _ in range(1 + len(text) // 9 if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(["grob", "grobian", "grobling", "schuft"])
        docs.append((i, " ".join(text).capitalize() + ".", "en", "a"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_of_unseen_rows_and_odd_ones(spark):
    docs, labels = toxic_rows(240)
    odd = [(1000, None, None, None), (1001, "", "en", "a"), (1002, "1234 !!", "en", "a"), (None, docs[0][1], "en", "a"), (3, docs[3][1], "en", "a"),
           (1003, "the river " * 60000 + "schuft", "en", "a")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in docs + odd], "doc_id long, text string, lang string, source string, toxic int, key string")
    marks = spark.createDataFrame(labels + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(frame, marks).collect()
    assert len(rows) == len(docs) + len(odd)
    by = {r.key: r for r in rows}
    for key, _, toxic in labels:
        assert by[key].held_out == (zlib.crc32(str(key).encode()) % 3 == 1)
        assert by[key].predicted == int(by[key].score >= 0.7)
    unseen = [(by[key].predicted, toxic) for key, _, toxic in labels if by[key].held_out]
    caught, alarms = [p for p, t in unseen if t], [p for p, t in unseen if not t]
    assert np.mean(caught) >= 0.9 and np.mean(alarms) <= 0.1
    assert by[1000].ratio == by[1001].ratio == 0 and by[1002].predicted == 0 and by[1003].predicted == 0
    other = toxicity.score_toxicity(frame, marks.selectExpr("doc_id", "quality", "IF(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) AS toxic"))
    assert {r.key: r.score for r in other.collect()} == {k: r.score for k, r in by.items()}  # held-out labels do not matter
    for none in (marks.limit(0), marks.where("toxic = 0")):
        assert {(r.score, r.predicted) for r in toxicity.score_toxicity(frame, none).collect()} == {(0.0, 0)}
    assert toxicity.score_toxicity(frame.limit(0), marks).count() == 0


def test_ratios_against_dictionaries(spark):
    docs, labels = toxic_rows(60)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    p = toxicity.ToxicityParams(order=4, shared=2)
    fit = toxicity.fit_rows(frame, marks, p, "text", "doc_id").collect()
    ratio = plain_ratio([[r.text for r in fit if r.toxic == c] for c in (0, 1)], 4, 2)
    volume = [sum(len(r.text.encode()) for r in fit if r.toxic == c) for c in (0, 1)]
    assert 0.5 < volume[0] / volume[1] < 2  # classes are evened out
    rows = {r.key: r.ratio for r in toxicity.score_toxicity(frame, marks, p).collect()}
    joined = toxicity.score_toxicity(frame, marks, toxicity.ToxicityParams(order=4, shared=2, held_bytes=0, block_bytes=500)).collect()
    assert {r.key: r.ratio for r in joined} == pytest.approx(rows, abs=1e-5)
    for key, text, *_ in docs[:20]:
        words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        assert rows[key] == pytest.approx(ratio(f" {' '.join(words)} "), abs=1e-5)
