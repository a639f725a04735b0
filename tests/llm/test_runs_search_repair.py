"""Periodic runs, exact top-k search and conversation repair against plain
Python versions, and on nulls, empty and long texts, ties, repeated rows,
empty tables and clashing column names."""

import hashlib
import heapq
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import conversation_repair, maxscore, periodic_runs
from panelwright.llm.conversation_repair import repair_conversations
from panelwright.llm.maxscore import top_k
from panelwright.llm.periodic_runs import WaveletTree, find_runs
from panelwright.llm.periodic_runs import periodic_runs as run_report


# --- periodic runs ----------------------------------------------------------------

def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in found.items())


def brute_report(key, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(("" if key is None else str(key)).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (len(runs), *top, top[0] if top[0] is None else 1000 * top[1] // top[2],
            hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def patterned(rng):
    kinds, out = rng.choice([1, 2, 3, 20]), []
    for _ in range(rng.randint(0, 6)):
        p = [rng.randrange(kinds) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 17]))]
        p = p[:1] * rng.randint(0, 5) + p
        out += (p * rng.randint(1, 9))[:rng.randint(1, 150)]
    return out


def test_runs_of_batches_of_symbol_arrays():
    rng, seen = random.Random(1), 0
    for _ in range(150):
        texts = [patterned(rng) for _ in range(rng.randint(1, 6))]
        counts = np.array([len(t) for t in texts])
        base = np.concatenate([[0], np.cumsum(counts)])
        symbols = np.repeat(np.arange(len(texts)), counts) * 50 + np.array([c for t in texts for c in t], dtype=np.int64)
        got = find_runs(symbols, np.repeat(base[:-1], counts), np.repeat(base[1:], counts))
        expected = [(a + int(base[i]), n, q) for i, t in enumerate(texts) for a, n, q in brute_runs(t)]
        assert list(zip(*[x.tolist() for x in got])) == expected
        seen += len(expected)
    assert seen > 500


def test_wavelet_tree_counts_and_selects():
    rng = np.random.default_rng(3)
    for m in (1, 2, 7, 64, 65):
        values = rng.permutation(m)
        tree = WaveletTree(values)
        lo = rng.integers(0, m, 50)
        hi = np.minimum(lo + rng.integers(1, m + 1, 50), m)
        x = rng.integers(0, m + 1, 50)
        assert tree.smaller(lo, hi, x).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(lo, hi, x)]
        nth = np.array([rng.integers(0, b - a) for a, b in zip(lo, hi)])
        assert tree.smallest(lo, hi, nth).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(lo, hi, nth)]


def test_run_report(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK_CHARS", 3_000)
    rng = random.Random(5)
    texts = [" ".join(map(str, patterned(rng))) for _ in range(120)]
    texts += [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x\x0by\x0cx y x y x y x y", "\x1ca \x1ca \x1ca \x1ca \x1ca \x1ca", "é é é é é é",
              " ".join(f"w{i % 977}" for i in range(9_000))]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, "b b b b b b b"), (None, None), (-10, texts[0])]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, key string, start string, n_runs int").repartition(3)
    got = sorted((tuple(r) for r in run_report(df).collect()), key=repr)
    assert got == sorted(((i, *brute_report(i, t)) for i, t in rows), key=repr)
    empty = run_report(df.limit(0))
    assert empty.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] and empty.isEmpty()


# --- top-k search -----------------------------------------------------------------

def brute_top(rows, asked, k, scale):
    live = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            live.append((i, [math.floor(scale * x) for x in v]))
    out = []
    for a, (i, q) in enumerate(live):
        if i is not None and asked(i):
            scored = sorted((-sum(x * y for x, y in zip(q, v)), j is None, j or 0, j) for b, (j, v) in enumerate(live) if a != b)
            out += [(i, n + 1, j, -s) for n, (s, _, _, j) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def found(df, k=5):
    return sorted((tuple(r) for r in top_k(df, F.col("id") % 5 == 0, k).collect()), key=repr)


@pytest.mark.parametrize("spread", [0.05, 0.4, 30.0, 2e6])
def test_top_k(spark, monkeypatch, spread):
    """From impacts that fit 24 bits of a sum to ones that need more than 53."""
    monkeypatch.setattr(maxscore, "BLOCK", 16)
    monkeypatch.setattr(maxscore, "PROBE", 3)
    monkeypatch.setattr(maxscore, "SHARD_CELLS", 12 * 90)
    rng = np.random.default_rng(int(spread))
    centre = rng.normal(size=(6, 12)) * spread
    rows = [(i, (centre[i % 6] + rng.normal(size=12) * spread / 3).astype("float32").tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert found(df) == brute_top(rows, lambda i: i % 5 == 0, 5, 256)


def test_top_k_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_CELLS", 20)
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (5, None), (10, [None, 1.0]), (15, [float("nan"), 1.0]), (20, [float("inf"), 1.0]),
            (25, []), (30, [0.001, -0.001]), (35, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])]
    rows += [(100 + i, [1.0, 2.0]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 1, "s", 2) for i, v in rows], "vec_id long, embedding array<double>, row int, shard string, id int").repartition(4)
    assert found(df) == brute_top(rows, lambda i: i % 5 == 0, 5, 256)
    assert found(df.limit(0)) == []
    assert found(df.where("vec_id = 25")) == []
    assert found(df.where("embedding IS NULL")) == []


def test_top_k_merges_many_shards_and_keeps_scores_in_range(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_CELLS", 2)
    monkeypatch.setattr(maxscore, "MERGE", 3)
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3) == brute_top(rows, lambda i: i % 5 == 0, 3, 256)
    huge = spark.createDataFrame([(0, [1e300]), (1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")
    assert found(huge) == [(0, 1, 1, 2 ** 63 - 1), (0, 2, 2, 1 - 2 ** 63)]


# --- conversation repair ------------------------------------------------------------

def brute_repair(rows):
    """Shortest paths by (cost, audit) over (rows used, last initial)."""
    talks, out = {}, set()
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t, r, x))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = (("user", "u"), ("assistant", "a"))
    for c, talk in talks.items():
        d = []
        for t, r, x in talk:
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            r, x = " " if r is None else r, " " if x is None else x
            x = "" if h == 1 else "".join(ch for ch in x if ch not in ".!?") if h == 2 else x
            d += [(t, "user" if h == 4 else r, x)] * (0 if h == 0 else 2 if h == 3 else 1)
        d.sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1].encode(), hashlib.sha256(e[2].encode()).digest()))
        turns = [t for t, _, _ in d if t is not None]
        faults = []
        for i, (_, r, x) in enumerate(d):
            said = x.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not said else "duplicate" if (r, x) in [e[1:] for e in d[:i]] else "truncated" if said[-1] not in ".!?" else "")
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, at, lines = heapq.heappop(heap)
            if i == len(d) and at in ("", "a"):
                break
            if (i, at) in done:
                continue
            done.add((i, at))
            for name, u in names:
                if (at, u) in step:
                    heapq.heappush(heap, (cost + 5, audit + "I", i, step[at, u], (*lines, name + ":")))
            if i < len(d):
                _, r, x = d[i]
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, at, lines))
                if faults[i] in ("", "truncated"):
                    extra = 5 if faults[i] else 0
                    if (at, r[:1]) in step:
                        heapq.heappush(heap, (cost + extra, audit + "K", i + 1, step[at, r[:1]], (*lines, f"{r}:{x}")))
                    for name, u in names:
                        if (at, u) in step:
                            heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, step[at, u], (*lines, f"{name}:{x}")))
        out.add((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                 sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(d, d[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def talks(rng):
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "usr"]
    texts = ["", "a.", "b", "c!", " x? \n", "y", "z. .", " ", " \x0b\x0c", "line\nline.", None]
    rows = []
    for c in [None, *range(50)]:
        for t in range(rng.choice([1, 3, 10, 40])):
            x = rng.choice(texts)
            rows.append((c, rng.choice([None, t, t, t + 2]), rng.choice(roles), x if x is None or rng.random() < 0.3 else f"{x}{rng.randrange(99)}{rng.choice('.?ab')}"))
    # long ones over many chunks; of the second, nearly all rows are cut off, so its chunks do not forget their ends
    rows += [(777, t, rng.choice(roles[:2]), f"t{t}{rng.choice('.b')}") for t in range(500)]
    rows += [(778, t, rng.choice(roles[:2]), f"t{t}") for t in range(200)]
    rows += [(779, t % 3, "user", "again.") for t in range(150)]
    return rows


@pytest.mark.parametrize("bits", [3, 13])
def test_repair(spark, monkeypatch, bits):
    monkeypatch.setattr(conversation_repair, "CHUNK_BITS", bits)
    rows = talks(random.Random(bits))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, id int").repartition(5)
    got = [tuple(r) for r in repair_conversations(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_repair(rows)


def test_repair_of_dropped_long_and_missing_rows(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "a."), (5001, 0, "user", "word " * 200_000 + "."), (5001, 1, "assistant", "ok."), (5002, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {tuple(r) for r in repair_conversations(df).collect()}
    assert got == brute_repair(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert repair_conversations(df.limit(0)).isEmpty()


def test_a_rerun_stops_where_vectors_differ_by_a_constant():
    machine = conversation_repair.Backward()
    other = (0, 3, 5, 0)
    assert machine.first("uauaua", conversation_repair.LAST, other) is None
    assert machine.run("uauaua", conversation_repair.LAST)[0] == machine.run("uauaua", other)[0]
    # rows that must be deleted never make two ends the same
    assert machine.first("1212", conversation_repair.LAST, other) == conversation_repair.LAST


# --- bounds of earlier operators ------------------------------------------------------

def test_short_benchmark_items_are_whole_lines(spark):
    from panelwright.llm.decontamination import drop_contaminated, find_passages
    bench = spark.createDataFrame([(1, "What is 2 + 2?"), (2, "Yes"), (3, "  \n "), (4, "yes"), (5, None)], "item_id long, text string")
    texts = ["intro\n  what is  2 + 2?\t\nend", "He asked what is 2 + 2? of me", "YES", "yes and no", "", None, "no\nYes\r\nyes"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in find_passages(docs, bench).collect())
    assert got == [(0, 1, 8, 23, 0), (2, 2, 0, 3, 0), (2, 4, 0, 3, 0), (6, 2, 3, 6, 0), (6, 2, 8, 11, 0), (6, 4, 3, 6, 0), (6, 4, 8, 11, 0)]
    assert {r.doc_id for r in drop_contaminated(docs, bench).collect()} == {1, 3, 4, 5}


def test_the_classifier_sample_is_bounded_by_rows_of_documents(spark, monkeypatch):
    from panelwright.llm import quality
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, grade, **k: seen.append((len(rows), sorted(grade.tolist()))))
    docs = spark.createDataFrame([(7, f"word{i}") for i in range(500)] + [(8, "a b"), (9, "c d"), (None, "x")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100, 400)] + [(7, 1, 0), (8, 0, 0), (9, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    quality.train(docs, labels, sample_rows=10)
    quality.train(docs, labels, sample_rows=2)
    assert seen[0] == (3, [0, 1, 2]) and seen[1][0] == 2
    assert quality.train(docs, labels.where("doc_id >= 100"), sample_rows=10) is None


def test_only_screened_features_come_to_the_driver(spark, monkeypatch):
    from panelwright.llm import quality
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 30)) + (" badword" if i % 3 == 0 else "") for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, grade, **k: seen.append(rows) or fit(rows, grade, **k))
    model = quality.train(docs, labels)
    assert len(seen[0]) == 120 and {x for r in seen[0] for x in r} == set(np.flatnonzero(model.weights))
    order = docs.join(labels, "doc_id").selectExpr("text", "if(quality = 0, 1, 2) AS grade", "xxhash64(doc_id) AS key").orderBy("key", "grade").collect()
    whole = fit([np.array(sorted(quality.features(r.text, quality.all_slots()))) for r in order], np.array([r.grade for r in order]))
    assert (whole.weights == model.weights).all() and (whole.thresholds == model.thresholds).all() and whole.weights.any()
