"""Cases in which an operator once did less than its whole job."""

import random

import corpus_pipeline
from panelwright.llm import decontamination, line_dedup

from .test_brute_force import brute_links, edit1, prose, table


def plain_lines(docs):
    """The lines stage: (id, text) of the documents that stay."""
    seen, out = [], []
    for i, text in docs:
        stay, new = [], False
        for line in text.split("\n"):
            s = line.strip(" ")
            gone = len(s) >= 30 and any(edit1(s, x) for x in seen if len(x) >= 30)
            new = new or bool(s) and not gone and s not in seen
            seen.append(s)
            if not gone:
                stay.append(line)
        if new or not text.strip(" \n"):
            out.append((i, "\n".join(stay)))
    return out


def corpus(rng):
    """Documents with short and long lines; exact copies, copies with a short
    line added or gone, and clean documents that hold known short lines."""
    common = ["All rights reserved.", "Haanth.", "Next page"]
    docs = []
    for _ in range(25):
        lines = [prose(rng.randint(8, 14), rng) for _ in range(rng.randint(2, 4))] + [prose(2, rng)[:20] for _ in range(2)]
        lines.append(rng.choice(common))
        rng.shuffle(lines)
        docs.append("\n".join(lines))
    copies = [rng.choice(docs) for _ in range(20)]
    copies += [rng.choice(docs) + "\n" + rng.choice(common) for _ in range(5)] + [docs[0] + "\nnever seen", "Haanth.", "", " \n"]
    return list(enumerate(docs + copies))


def test_pipeline_against_plain_python(spark, tmp_path):
    rng = random.Random(11)
    docs = corpus(rng)
    passage = prose(30, rng)
    docs.append((len(docs), prose(10, rng) + "\n" + passage))
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = plain_lines(docs)
    after = corpus_pipeline.lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {(r["doc_id"], r["text"]) for r in after.collect()} == set(left)
    root = brute_links([t for _, t in left])[1]
    expected = {i for k, (i, t) in enumerate(left) if root[k] == k and passage not in t}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == expected
    firsts = {}
    assert not {i for i, t in docs if firsts.setdefault(t, i) != i} & got     # no exact copy stays
    assert set(range(25)) <= got


def test_short_repeats_are_found(spark):
    texts = ["ab\nab\n\n " + "x" * 40, "cd\n ab \n\n" + "x" * 40, "cd.\n\t", None, "ab"]
    got = {r["id"]: (r["dropped"], r["short"]) for r in line_dedup.line_repeats(table(spark, texts)).collect()}
    assert got == {0: (None, [1]), 1: ([3], [1]), 4: (None, [0])}
    rows = line_dedup.short_repeats(table(spark, [*texts, "ab\nAll rights\nab"])).collect()
    assert {tuple(r) for r in rows} == {(0, 1, "1"), (1, 1, "1"), (4, 1, "0"), (5, 2, "0,2")}


def test_quotes_that_straddle_a_cut(spark):
    rng = random.Random(12)
    items = [(i, prose(rng.randint(18, 120), rng)) for i in range(20)]
    texts, expected = [], {}
    for i, item in items:
        for share, lo in ((0.8, 0.1), (0.5, 0.25)):
            a, n = int(lo * len(item)), max(80, int(share * len(item)))
            quote = item[a:a + n]
            if len(quote) == n:
                before = prose(30, rng) + " "
                expected[len(texts)] = (i, len(before), len(before) + n)
                texts.append(before + quote + " " + prose(30, rng))
    texts += [prose(300, rng), items[0][1] + " " + items[0][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.find_passages(table(spark, texts), bench).collect()
    assert sum(r["doc_id"] == len(texts) - 1 for r in rows) == 2
    assert {r["doc_id"] for r in rows} == {*expected, len(texts) - 1} and len(rows) == len(expected) + 2
    for r in rows:      # neighbouring patterns are one place, which reaches to within a step of the quote's ends
        if r["doc_id"] in expected:
            item, a, b = expected[r["doc_id"]]
            assert r["item_id"] == item and abs(r["start"] - a) <= 25 and abs(r["end"] - b) <= 25 and r["edits"] <= 10     # end patterns may hang over the quote
    kept = decontamination.drop_contaminated(table(spark, texts), bench).collect()
    assert [r["doc_id"] for r in kept] == [len(texts) - 2]
