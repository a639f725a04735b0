"""Every operator against a plain Python version on small inputs."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwright.llm import decontamination, exact_dedup, html_text, line_dedup, ngram_join, packing, quality, sharding, token_counts, warc
from panelwright.llm.graph import components
from panelwright.llm.word_ids import WordIds, default_vocabulary

RNG = random.Random(7)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t) for i, t in zip(ids, texts)], "doc_id long, text string")


# --- n-gram join --------------------------------------------------------------

def near_copies():
    texts = []
    for _ in range(25):
        base = prose(80).split()
        texts.append(" ".join(base))
        for _ in range(RNG.randint(0, 4)):
            w = list(base)
            for _ in range(RNG.randint(0, 3)):
                w[RNG.randrange(len(w))] = RNG.choice(VOCAB)
            texts.append(" ".join(w))
    return texts + [texts[0], texts[0].upper(), "a b", "a b", "one two three", "", None, "?!"]


def brute_links(texts):
    sets = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                links[i].add(j)
                links[j].add(i)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        root[i] = min(seen)
    return links, root


@pytest.mark.parametrize("block_sets", [1024, 2])
def test_ngram_join_links_and_classes(spark, monkeypatch, block_sets):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block_sets)      # 2: components over many block pairs
    texts = near_copies()
    links, root = brute_links(texts)
    got = {r["id"]: r for r in ngram_join.jaccard_classes(table(spark, texts)).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(links[i]) for i in range(len(texts))}
    assert {i: r["class_id"] for i, r in got.items()} == dict(enumerate(root))
    assert {i for i, r in got.items() if r["lead"]} == set(root)
    kept = ngram_join.keep_one_per_class(table(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root))


def chains():
    """Sliding windows: neighbours are linked, texts further apart only share bands; steps too wide to be linked as well."""
    texts = []
    for step in (2, 2, 3, 6, 11):
        words = prose(300).split()
        texts += [" ".join(words[at:at + 60]) for at in range(0, 40 * step if step < 6 else 200, step)]
    return texts + texts[:3] + [None, ""]


@pytest.mark.parametrize("block_sets,rows", [(1024, 4), (3, 1)])     # one row a band: nearly every band hash holds several classes
def test_class_forest_joins_chains(spark, monkeypatch, block_sets, rows):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block_sets)
    texts = chains()
    root = brute_links(texts)[1]
    leads = ngram_join.class_forest(table(spark, texts), rows=rows).collect()
    assert sorted(r["id"] for r in leads) == sorted(set(root))


def test_band_count_meets_recall():
    b = ngram_join.band_count(0.8, 0.9999, 4)
    assert 1 - (1 - 0.8 ** 4) ** b >= 0.9999 > 1 - (1 - 0.8 ** 4) ** (b - 1)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(139, 200), (7, 7)]
    got = dict(components(spark.createDataFrame(pairs, "u long, v long")).collect())
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in [*range(100, 140), 200]}


# --- exact deduplication ------------------------------------------------------

@pytest.mark.parametrize("chunk_hash", [None, lambda c: F.length(c).cast("long"), lambda c: F.lit(1).cast("long")])
def test_exact_dedup(spark, chunk_hash):
    texts = [prose(n) for n in (3, 30, 300, 300)]
    texts += [texts[0], texts[2], "", None, "x" * 9000, "x" * 9000, texts[3][:-1] + "z", texts[3] + " ", "", "ab", "ba"]
    kw = {"chunk_hash": chunk_hash} if chunk_hash else {}
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(table(spark, texts), lo=20, hi=60, **kw).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), i == max(ids))
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_chunks_give_the_text_back_and_shift_with_it(spark):
    texts = [prose(400).replace(" a", ". A"), "x" * 5000, "é\n" * 700, "", " \n "]
    df = table(spark, texts).select("text", exact_dedup.chunks(F.col("text"), 50, 200).alias("c"))
    for t, c in df.collect():
        assert "".join(c) == t
    moved = table(spark, ["Some words before it. " + texts[0]]).select(exact_dedup.chunks(F.col("text"), 50, 200).alias("c")).first()["c"]
    first = df.first()["c"]
    assert len(set(moved) & set(first)) > len(first) / 2


# --- line deduplication -------------------------------------------------------

def edit1(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_lines(docs, least):
    seen, out = [], {}
    for i, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            s = line.strip(" ")
            if len(s) >= least:
                if any(edit1(s, x) for x in seen):
                    out.setdefault(i, []).append(p)
                seen.append(s)
    return out


def mutated(line):
    k, c = RNG.randrange(len(line)), RNG.choice("abcxyz")
    return RNG.choice([line[:k] + c + line[k + 1:], line[:k] + line[k + 1:], line[:k] + c + line[k:], line + c, c + line, line[1:]])


def test_line_dedup(spark):
    pool = [prose(RNG.choice([1, 2, 4, 8, 30, 300])) for _ in range(12)] + ["a" * 12, "ab" * 8]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(RNG.randint(0, 6)):
            line = RNG.choice(pool)
            for _ in range(RNG.choice([0, 0, 1, 1, 2])):
                line = mutated(line)
            lines.append(RNG.choice(["", " "]) + line)
        docs.append((i, "\n".join(lines)))
    docs.append((40, None))
    expected = brute_lines(docs, 10)
    df = table(spark, [t for _, t in docs], [i for i, _ in docs])
    got = {r["id"]: r["dropped"] for r in line_dedup.line_decisions(df, min_chars=10).collect()}
    assert got == expected and len(expected) > 10
    clean = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df, min_chars=10).collect()}
    for i, t in docs:
        assert clean[i] == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in expected.get(i, [])))


# --- decontamination ----------------------------------------------------------

def brute_edits(text, pattern):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_passages_against_full_alignment(spark):
    items = [prose(22) for _ in range(12)] + ["short one", None]
    texts, rng = [], random.Random(3)
    for k in range(60):
        s = list(rng.choice(items[:12]))
        for _ in range(rng.choice([0, 0, 2, 6, 10, 14, 25])):
            p, r = rng.randrange(len(s)), rng.random()
            s[p:p + 1] = [] if r < 0.3 else [rng.choice("klmnop")] if r < 0.7 else [s[p], rng.choice("klmnop")]
        texts.append(prose(rng.randint(0, 40), rng) + "\n" + "".join(s).upper() + "\t" + prose(rng.randint(0, 40), rng))
    texts += [prose(200), "", None, "ab " * 500]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    found = decontamination.find_passages(table(spark, texts), bench).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    index = decontamination.Index([(i, t) for i, t in enumerate(items) if t])
    expected = set()
    for pattern, item, edits in zip(index.patterns, index.item, index.edits):
        plain = "".join(map(chr, pattern))
        for i, t in enumerate(texts):
            if t and brute_edits(re.sub(r"\s", " ", t.lower()), plain) <= edits:
                expected.add((i, item))
    assert pairs == expected and 20 < len(expected) < 60
    for r in found:
        part = re.sub(r"\s", " ", texts[r["doc_id"]][r["start"]:r["end"]].lower())
        assert any(item == r["item_id"] and brute_edits(part, "".join(map(chr, p))) <= e
                   for p, item, e in zip(index.patterns, index.item, index.edits))
    kept = decontamination.drop_contaminated(table(spark, texts), bench).collect()
    assert {r["doc_id"] for r in kept} == set(range(len(texts))) - {i for i, _ in expected}


def test_benchmark_blocks_and_text_slices(spark, monkeypatch):
    items = [prose(20) for _ in range(9)]
    texts = [prose(50) + " " + x + " " + prose(50) for x in items] + [prose(300)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = sorted(map(tuple, decontamination.find_passages(table(spark, texts), bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 200)
    assert sorted(map(tuple, decontamination.find_passages(table(spark, texts), bench).collect())) == whole
    assert {r["doc_id"] for r in decontamination.drop_contaminated(table(spark, texts), bench).collect()} == {9}
    index = decontamination.Index(list(enumerate(items)))
    monkeypatch.setattr(decontamination, "SLICE_CHARS", 150)
    assert {t[:2] for t in decontamination.search_texts(texts, index)} == {(i, i) for i in range(9)}


# --- packing ------------------------------------------------------------------

def check_pieces(rows, ids_of):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for doc, ids in ids_of.items():
        parts = sorted(by_doc[doc], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in parts) == ids
        at = 0
        for r in parts:
            assert r["start"] == at and r["length"] * 4 == len(r["ids"]) and r["doc_tokens"] * 4 == len(ids)
            at += r["length"]
    for rows_ in by_seq.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == rows_[0]["sequence_tokens"] <= 4096 and at & (at - 1) == 0
    return by_seq


def test_packing_round_trip(spark):
    texts = [prose(RNG.choice([0, 1, 5, 40, 700, 3000])) for _ in range(60)] + ["", None, "Ünïcode <|endoftext|> É!", "x" * 30_000]
    rows = packing.pack_documents(table(spark, texts).repartition(3)).collect()
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(default_vocabulary())
    ids = {i: np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for i, t in enumerate(texts)}
    check_pieces(rows, ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 20_000), max_size=40))
def test_packer_any_lengths(lengths):
    p = packing.Packer(5 << 40)
    ids = {}
    for i, n in enumerate(lengths):
        ids[i] = np.arange(n, dtype="<u4").tobytes()
        p.add(i, ids[i])
    p.finish()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
    by_seq = check_pieces([dict(zip(names, r)) for r in p.rows], {i: x for i, x in ids.items() if x})
    assert sum(r[0]["sequence_tokens"] < 4096 for r in by_seq.values()) <= 12
    assert len(p.rows) <= len([n for n in lengths if n]) + len(by_seq)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 7, 64])
def test_a_class_fills_its_bins_with_whole_documents(k):
    size = 4096 // k
    p = packing.Packer(0)
    for i in range(3 * k):
        p.add(i, np.arange(size, dtype="<u4").tobytes())
        assert sum(len(b) for b in p.bins.values()) < k
    whole = {r[0] for r in p.rows if r[2] == size}
    assert len(p.rows) >= 2 * k and len(whole) >= 2 * k - 1
    p.finish()
    assert sum(r[2] for r in p.rows) == 3 * k * size


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_word_ids_equal_the_tokenizer(texts):
    enc = WORD_IDS
    for t, b in zip(texts, enc.encode(texts)):
        assert b == np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


WORD_IDS = WordIds(default_vocabulary())


# --- token counts -------------------------------------------------------------

def brute_tokens(word, scores):
    best = [(0, 0)]
    for d in range(1, len(word) + 1):
        options = []
        for s in range(d):
            piece = word[s:d]
            if piece in scores:
                options.append((best[s][0] + scores[piece], -(best[s][1] + 1)))
            elif s == d - 1:
                n = len(piece.encode("utf-8", "surrogatepass"))
                options.append((best[s][0] + n * token_counts.BYTE_SCORE, -(best[s][1] + n)))
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


SCORES = token_counts.load_scores(token_counts.default_vocabulary())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("the ingatonré▁漢\U0001f600\n"), max_size=30), max_size=5))
def test_token_counts_by_brute_force(texts):
    got = token_counts.Counter(SCORES).count(texts)
    assert got == [(len(t.split()), sum(brute_tokens("▁" + w, SCORES) for w in t.split())) for t in texts]


# --- quality ------------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        kind = rng.choice(["good", "good", "poor", "toxic"])
        words = prose(rng.randint(20, 200), rng).split()
        if kind == "poor":
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        if kind == "toxic":
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["vexolent", "grubbish", "snarlop"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if kind == "poor" else 1, int(kind == "toxic")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.grade_documents(docs, train).collect()}
    held = [(q == 1 and t == 0, got[i]["kept"]) for i, q, t in labels[600:]]
    assert len(got) == 900 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_prob"] <= 1 for r in got.values())
    model = quality.train(docs, train)
    assert model.thresholds[0] < model.thresholds[1]
    assert {r["doc_id"] for r in quality.select_quality(docs, train).collect()} == {i for i, r in got.items() if r["kept"]}


def test_ordinal_gradient_reaches_a_stationary_point():
    rng = np.random.default_rng(1)
    rows = [np.array([1] + ([2] if rng.random() < p else [])) for p in (0.9, 0.5, 0.1) for _ in range(200)]
    grade = np.repeat([0, 1, 2], 200)
    model = quality.fit(rows, grade, rounds=2000, ridge=1e-9)
    assert model.weights[2] < -1 and model.weights[1] == 0
    share = model.tails(np.array([0.0, model.weights[2]]))
    seen = np.array([[np.mean(grade[[(2 in r) == f for r in rows]] >= k) for k in (1, 2)] for f in (False, True)])
    assert np.abs(share - seen).max() < 0.05


# --- sharding -----------------------------------------------------------------

def plain_loss(params, rows, grade, ridge):
    """Penalised -log likelihood of the cumulative-link model, row by row."""
    *w, a, gap = params
    th = [-np.inf, a, a + np.exp(gap), np.inf]
    loss = ridge / 2 * sum(x * x for x in w)
    for r, g in zip(rows, grade):
        score = sum(w[i] for i in r)
        p = 1 / (1 + np.exp(-(th[g + 1] - score))) - 1 / (1 + np.exp(-(th[g] - score)))
        loss -= np.log(p)
    return loss


def test_ordinal_fit_equals_a_plain_newton_fit():
    """Three features, 90 rows; the minimum by Newton steps on differences of the plain loss."""
    rng = random.Random(21)
    rows, grade = [], []
    for _ in range(90):
        r = [i for i in range(3) if rng.random() < 0.35]
        rows.append(np.array(r, np.int64))
        grade.append(2 if not r else rng.choice([0, 0, 1, 2]) if 0 in r else rng.choice([0, 1, 1, 2]))
    grade = np.array(grade)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "MIN_Z", 0.0)
        model = quality.fit(rows, grade, rounds=3000, rate=0.01)
    x, h, n = np.array([0.0, 0.0, 0.0, -1.0, 0.5]), 1e-3, 5
    e = np.eye(n) * h

    def f(p):
        return plain_loss(p, rows, grade, 0.1)
    for _ in range(12):
        g = np.array([(f(x + e[i]) - f(x - e[i])) / (2 * h) for i in range(n)])
        hess = np.array([[(f(x + e[i] + e[j]) - f(x + e[i] - e[j]) - f(x - e[i] + e[j]) + f(x - e[i] - e[j])) / (4 * h * h)
                          for j in range(n)] for i in range(n)])
        step = np.linalg.solve(hess, g)
        x = x - step * min(1, 1 / np.abs(step).max())
    assert np.allclose(model.weights[:3], x[:3], atol=0.02) and (x[:3] < 0).all()
    assert np.allclose(model.thresholds, [x[3], x[3] + np.exp(x[4])], atol=0.02)


def test_shards_are_even_and_keep_groups(spark):
    texts = [f"solo {i}" for i in range(300)] + [f"pair {i // 2}" for i in range(200)] + ["big"] * 260 + [f"five {i // 5}" for i in range(100)] + [None, ""]
    rows = sharding.shard_documents(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    count = Counter(r["shard"] for r in rows)
    assert sorted(count) == list(range(8)) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(count[s]))
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["grown_shard"] is None and r["law"] == "rows"
    at = defaultdict(set)
    for r in rows:
        at[texts[r["doc_id"]]].add(r["shard"])
    split = sum(len(s) > 1 for t, s in at.items() if t and t.startswith(("pair", "five")))
    assert split <= 12 and len(at["big"]) <= 4          # 120 small groups; the large one needs at least 3 shards


def test_propagation_with_several_hubs(spark):
    links = [(i, f"h{i // 10}") for i in range(400)] + [(i, f"k{i // 50}") for i in range(400)]
    got = dict(sharding.propagate(spark.range(400).toDF("node"), spark.createDataFrame(links, "node long, hub string"), 4, 6).select("node", "shard").collect())
    cut = sum(len({got[i] for i in range(10 * k, 10 * k + 10)}) - 1 for k in range(40))
    assert len(got) == 400 and cut < 60 and max(Counter(got.values()).values()) < 200


def plain_rounds(links, shards, rounds, slack, first, draw, tie):
    """Rounds of label propagation in plain Python: every node by itself."""
    hubs = defaultdict(list)
    for n, h in links:
        hubs[h].append(n)
    hubs = {h: ns for h, ns in hubs.items() if len(ns) > 1}
    of = defaultdict(list)
    for h, ns in hubs.items():
        for n in ns:
            of[n].append(h)
    label, load = dict(first), [list(first.values()).count(s) for s in range(shards)]
    for turn in range(rounds):
        held = {h: [sum(label[n] == s for n in ns) + tie[h][s] for s in range(shards)] for h, ns in hubs.items()}
        like = {n: [float(sum(held[h][s] for h in of[n])) for s in range(shards)] for n in of}
        best = {n: v.index(max(v)) for n, v in like.items()}
        size = {n: int(np.floor(np.log2(max(sum(v), 1.0)))) for n, v in like.items()}
        wants = Counter((size[n], label[n], best[n]) for n in of if label[n] != best[n])
        if not wants:
            break
        quota = sharding._quotas(dict(wants), load, (1 + slack) * len(first) / shards)
        label.update({n: best[n] for n in of if label[n] != best[n] and draw[turn][min(of[n])] < quota[size[n], label[n], best[n]]})
        load = [list(label.values()).count(s) for s in range(shards)]
    return label


@pytest.mark.parametrize("part_rows", [1000, 7])
def test_rounds_equal_plain_propagation(spark, monkeypatch, part_rows):
    """Also where hubs are spread over parts, one of them with a third of all nodes."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(sharding, "PART_ROWS", part_rows)
    n, shards, rounds = 240, 4, 4
    links = [(i, "hot") for i in range(80)] + [(i, f"g{i // 6}") for i in range(40, n)] + [(i, f"x{i}") for i in range(0, n, 5)]
    unit = sharding._UNIT
    nodes = spark.range(n).toDF("node")
    hubs = spark.createDataFrame([(h,) for h in sorted({h for _, h in links})], "hub string")
    first = dict(nodes.select("node", F.pmod(F.xxhash64(F.lit("shard"), F.col("node")), F.lit(shards))).collect())
    tie = {r[0]: [x / (4.0 * unit) for x in r[1:]] for r in hubs.select(
        "hub", *[F.pmod(F.xxhash64(F.lit(s), F.col("hub")), F.lit(unit)) for s in range(shards)]).collect()}
    draw = [dict(hubs.select("hub", F.pmod(F.xxhash64(F.lit(t), F.col("hub")), F.lit(unit)) / F.lit(float(unit))).collect()) for t in range(rounds)]
    rows = sharding.propagate(nodes, spark.createDataFrame(links, "node long, hub string"), shards, rounds).collect()
    got = {r["node"]: r["shard"] for r in rows}
    assert len(rows) == n and got == plain_rounds(links, shards, rounds, sharding.SLACK, first, draw, tie)
    cut = [sum(label[i] != label[i + 1] for i in range(80, n - 1)) for label in (first, got)]
    assert cut[1] < cut[0]


# --- web pages ----------------------------------------------------------------

WEIGHTS = html_text.Weights({("word", "p|False", True): 5000, ("word", "h1|False", True): 300, ("word", "li|True", False): 900,
                             ("word", "div|False", False): 400, ("tag", "p", True): 300, ("tag", "h1", True): 30,
                             ("tag", "li", False): 300, ("tag", "a", False): 300, ("tag", "div", False): 90})


@pytest.mark.parametrize("html,expected", [
    ("<nav><ul><li><a href='/'>Home</a></li><li><a>News</a></li></ul></nav><article><h1>A title here</h1><p>First  one &amp; two.<br>Next\nline <b>bold</b>word.<p>Last.</article><footer>&copy; x y z</footer>",
     "A title here\nFirst one & two.\nNext line boldword.\nLast."),
    ("<article><p>One two three four.</p><div class='ad banner'>Buy this now</div><p>Five six seven.</p><form><label>Mail</label><input></form><script>var a='<p>';</script><style>p{}</style></article><section id=comments><p>I liked it a lot</p></section>",
     "One two three four.\nFive six seven."),
    ("<div id='cookie-notice'>We use cookies on this site</div><main><p>Text of &lt;the&gt; page&#33;</p><!-- <p>no</p> --></main><aside>More of it</aside>", "Text of <the> page!"),
    ("<p>Only text, cut in a ta<", "Only text, cut in a ta<"), ("<p>Only text, cut <b", "Only text, cut"), ("", ""), ("<nav><a>x</a></nav>", ""), ("plain words only", "plain words only")])
def test_main_text(html, expected):
    assert html_text.main_text(html, WEIGHTS) == expected


def words(n, stem="w"):
    return " ".join(f"{stem}{i}" for i in range(n))


@pytest.mark.parametrize("weights", [WEIGHTS, html_text.Weights({})])
def test_what_stands_in_an_article_does_not_cut_it(weights):
    for inner in ("<aside class='promo'>%s</aside>", "<div class='text-ad'><p>%s</p></div>", "<form><p>%s</p></form>", "<nav><ul><li>%s</li></ul></nav>",
                  "<div class='cookie-notice'>%s</div>", "<section id='comments'><article class='comment'><p>%s</p></article></section>",
                  "<div hidden><p>%s</p></div>", "<div style='display:none'>%s</div>", "<footer><p>%s</p></footer>"):
        page = f"<nav>menu</nav><article><p>{words(150)}</p>{inner % words(400, 'x')}<p>{words(151, 'z')}</p></article><footer>foot</footer>"
        assert html_text.main_text(page, weights) == words(150) + "\n" + words(151, "z")
    page = f"<article><p>x y</p><ul><li><a href='a'>l one</a></li><li>b</li></ul><p>q</p></article><div><p>{words(300)}</p></div>"
    assert html_text.main_text(page, weights) == "x y\nl one\nb\nq"


@pytest.mark.parametrize("name", ["comment-body", "main-nav", "main-menu", "mainNav", "post-footer", "entry-meta", "story-share", "content-sidebar",
                                  "article-comments", "text-ad"])
def test_any_word_of_a_name_takes_a_container_out(name):
    for page in (f"<article><p>{words(20)}</p><div class='{name}'>{words(90, 'n')}</div><p>{words(15, 'z')}</p></article>",
                 f"<div><p>{words(20)}</p><div class='{name}'><p>{words(90, 'n')}</p></div><p>{words(15, 'z')}</p></div>"):
        for weights in (WEIGHTS, html_text.Weights({})):
            assert html_text.main_text(page, weights) == f"{words(20)}\n{words(15, 'z')}"


@pytest.mark.parametrize("html,expected", [
    ("<header><p>Site</p></header><article><header><h1>Title</h1></header><p>x y z</p></article>", "Title\nx y z"),
    ("<article class='entry'><div class='article-header'><h1>T</h1></div>x</article>", "T\nx"),
    ("<body class='has-sidebar no-comments'><div id='page-wrapper'><article class='post category-ads'><p>x y z</p></article></div></body>", "x y z"),
    ("<form id='aspnetForm'><div class='content'><article><p>x y z</p></article></div></form>", "x y z"),
    ("<div class='content-sidebar-wrap'><main><p>x y z</p><div class='comment-body'>c</div></main></div>", "x y z"),
    ("<article><p>x y</p></article><section id='comments'><article class='comment'><p>I like it</p></article></section>", "x y"),
    ("<div class='sidebar'><article><p>teaser</p></article></div><p>x y z</p>", "x y z")])
def test_containers_around_and_in_an_article(html, expected):
    assert html_text.main_text(html, WEIGHTS) == expected


def test_container_names_are_learned(spark):
    """``x17`` and ``legal`` hold no article on pages with a mark; ``banner`` does."""
    marked = [(i, f"<div class='x17'><p>{words(9)}</p></div><div class='legal'>{words(9)}</div>"
                  f"<article><div class='banner'><p>{words(30)}</p></div><div class='post-{i}'>a</div></article>") for i in range(60)]
    df = spark.createDataFrame(marked, "page_id long, html string")
    weights = html_text.learn_weights(df)
    assert {"x", "legal"} <= weights.lean and "banner" not in weights.lean      # a name's letters count
    page = f"<div class='banner'><p>{words(15)}</p></div><div class='x17'><p>{words(50, 'n')}</p></div><p>{words(20, 'z')}</p>"
    assert html_text.main_text(page, weights) == f"{words(15)}\n{words(20, 'z')}"
    assert html_text.main_text(page, html_text.Weights({})) == f"{words(50, 'n')}\n{words(20, 'z')}"


def test_best_region_is_the_greatest_sum():
    page = "<p>a b c</p>" + "<ul><li><a>x</a></li></ul>" * 9 + "<p>d e f g h</p><p>i j</p>" + "<ul><li><a>x</a></li></ul>" * 9 + "<p>k</p>"
    assert html_text.main_text(page, WEIGHTS) == "d e f g h\ni j"
    entries = list(html_text.tokens(page))
    scores = [WEIGHTS.tag(v) if w == "tag" else WEIGHTS.word(c) * len(v.split()) for w, v, c, _ in entries]
    best = max(((sum(scores[i:j]), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    words = " ".join(v for w, v, _, _ in entries[best[1]:best[2]] if w == "words")
    assert words.split() == "d e f g h i j".split()


# --- WARC ---------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_path):
    big = "".join(RNG.choice("abcdefgh") for _ in range(200_000))
    pages = [(1, "http://a/x y\r\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", ""), (4, "u", None), (5, "u", big), (6, "u", "WARC/1.1\r\n\r\n"), (0, "u", "<p>é</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"))
    records = {r["page_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w"), keep_payload=True).collect()}
    got = {r["page_id"]: r for r in warc.resolve_revisits(warc.read_warc(spark, str(tmp_path / "w"))).collect()}
    for i, _, html in pages:
        raw = (html or "").encode()
        first = min(k for k, _, h in pages if (h or "") == (html or ""))
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == first else ("revisit", first))
        if i == first:
            assert bytes(records[i]["payload"]) == raw
    import gzip
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == 7          # a plain sequence of gzip members


def test_warc_reader_rejects_damage():
    good = warc.record(1, "u", b"payload")
    assert warc.parse_record(iter([good[:20], good[20:]]))["payload_bytes"] == 7
    for bad in (good[:-3], good.replace(b"payload\r\n", b"pAyload\r\n"), good + b"x", good.replace(b"WARC/1.1", b"XARC/1.1")):
        with pytest.raises(warc.BadRecord):
            warc.parse_record(iter([bad]))
    member = warc._member(good)
    with pytest.raises((warc.BadRecord, zlib.error)):
        [list(m) for m in warc.members(member + member[:-9])]
    assert [b"".join(m) for m in warc.members(member + warc._EMPTY_MEMBER + member)] == [good, b"", good]
