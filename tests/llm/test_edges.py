"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing column names: every operator and pipeline stage gives its defined
result."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from panelwright.llm import catalog
from panelwright.llm.decontamination import find_passages
from panelwright.llm.exact_dedup import exact_dedup
from panelwright.llm.html_text import extract_text, learn_weights
from panelwright.llm.line_dedup import line_dedup, line_report, short_repeats
from panelwright.llm.ngram_join import jaccard_classes
from panelwright.llm.packing import pack_documents
from panelwright.llm.quality import grade_documents
from panelwright.llm.sharding import shard_documents
from panelwright.llm.token_counts import count_tokens
from panelwright.llm.warc import read_warc, resolve_revisits, write_warc

LONG = " ".join(f"word{i % 9973}" for i in range(60_000))
LINE = "a line that is long enough to be compared here"
# columns that operators use inside
CLASH = ["id", "tk", "row", "key", "n", "node", "shard", "hub", "dropped", "class_id", "line", "pos", "recipe", "chunks", "set_id",
         "grade", "tail", "l_id", "gone_key", "row_key", "lead_key", "had_text", "h1", "keep_id", "position", "_text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def edge_rows():
    rows = [(1, "", "en"), (2, None, None), (None, LINE, "en"), (None, None, None), (3, LONG, "en"), (4, LINE + "\n" + LINE, "en"),
            (5, "?!", "de"), (5, "?!", "de"), (6, "\n\n", "fr"), (7, "é漢\U0001f600 \x00\x1c\x85", "es"), (8, LONG + " end", "en"),
            (9, LINE, "en"), (9, LINE, "en"), (9, "other text of the same id", "en"), (10, " " + LINE, "en")]
    return [(i, t, g, "s", None if t is None else len(t)) + ("x",) * len(CLASH) for i, t, g in rows]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 0, 0), (4, 1, 0), (9, 1, 0), (9, 1, 0), (3, 1, None), (None, 1, 1), (5, None, 1), (777, 0, 0)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, quality int, toxic int, id string, text string")


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, LINE), (1, LINE), (None, "another passage of the test set, unseen elsewhere"), (3, None), (4, ""), (5, "short")]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, doc_id string")


OPERATORS = {
    "exact_dedup": exact_dedup, "line_dedup": line_dedup, "line_report": line_report, "jaccard_classes": jaccard_classes,
    "pack_documents": pack_documents, "shard_documents": shard_documents, "count_tokens": count_tokens,
}
PER_ROW = {"exact_dedup", "line_dedup", "line_report", "jaccard_classes", "shard_documents", "count_tokens"}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_edge_rows_and_empty_table(spark, edges, none, name):
    out = OPERATORS[name](edges).collect()
    if name in PER_ROW:
        assert len(out) == len(edge_rows())
    empty = OPERATORS[name](none)
    assert empty.collect() == [] and empty.columns == OPERATORS[name](edges).columns


def test_exact_dedup_cases(edges):
    rows = exact_dedup(edges).collect()
    line = [r for r in rows if r["keep_id"] == 9 and (r["doc_id"] is None or r["group_size"] > 1)]
    assert len(line) == 3 and {r["group_size"] for r in line} == {3} and sum(r["kept"] for r in line) == 1     # ids NULL, 9, 9
    empty = [r for r in rows if r["doc_id"] in (1, 2)]
    assert [r["keep_id"] for r in empty] == [2, 2] and empty[0]["group_size"] == 3


def test_line_dedup_cases(edges):
    clean = line_dedup(edges).select("doc_id", "text", *CLASH)
    got = {(r["doc_id"], r["text"]) for r in clean.collect()}
    # the row with the NULL id comes first and keeps the line
    assert {(None, LINE), (4, ""), (9, ""), (10, ""), (2, None), (None, None), (6, "\n\n"), (3, LONG)} <= got
    assert {r["doc_id"] for r in line_dedup(edges, drop_emptied=True).collect()} == {None, 1, 2, 3, 5, 6, 7, 8, 9}


def test_short_repeats_cases(spark, edges, none):
    found = short_repeats(edges)
    assert found.columns == ["doc_id", "n_short", "short"] == short_repeats(none).columns
    assert found.collect() == [] == short_repeats(none).collect()        # "?!" twice under one id is one document
    texts = [(None, "ab"), (1, "ab\n\n ab"), (1, "ab\n\n ab"), (1, "ab\ncd"), (2, None), (2, ""), (3, LONG + "\n\n cd "), (4, "cd" + " " * 40)]
    rows = spark.createDataFrame([(*r, *("x",) * len(CLASH)) for r in texts], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH))
    got = sorted(tuple(r) for r in short_repeats(rows).collect())
    assert got == [(1, 1, "0"), (1, 2, "0,2"), (3, 1, "2"), (4, 1, "0")]


def test_jaccard_cases(edges):
    rows = jaccard_classes(edges).collect()
    by = {(r["id"], r["tk"]): r for r in rows}
    assert sorted(r["class_size"] for r in rows if r["class_id"] == 9) == [1, 4, 4, 4, 4]      # the line: ids NULL, 9, 9, 10
    assert len(by) == len(rows) - 2
    assert next(r for r in rows if r["id"] == 8)["class_id"] == 3
    no_words = [r for r in rows if r["id"] in (1, 2, 5, 6)]
    assert {r["class_id"] for r in no_words} == {1}


def test_packing_keeps_every_row(edges):
    rows = pack_documents(edges).groupBy().agg(F.sum("length").alias("n")).first()
    counts = pack_documents(edges).filter("start = 0").count()
    assert counts == len(edge_rows()) and rows["n"] > 60_000


def test_quality_cases(spark, edges, none, labels):
    out = grade_documents(edges, labels).collect()
    assert len(out) == len(edge_rows()) and all(r["tail_prob"] is not None for r in out)
    nothing = grade_documents(edges, labels.limit(0)).collect()
    assert all(r["kept"] and r["tail_prob"] is None for r in nothing) and len(nothing) == len(edge_rows())
    assert grade_documents(none, labels).collect() == []


def test_passages_cases(edges, none, bench):
    rows = find_passages(edges, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(None, 1), (4, 1), (9, 1), (10, 1)}
    assert sum(r["doc_id"] == 4 for r in rows) == 2 and sum(r["doc_id"] == 9 for r in rows) == 2
    assert find_passages(none, bench).collect() == [] and find_passages(edges, bench.limit(0)).collect() == []


PAGES = [(1, "u", "<article><p>" + "w " * 50_000 + "</p></article>"), (2, None, None), (None, "u", ""), (3, "u", "<p>one two</p>"),
         (3, "u", "<p>one two</p>"), (None, None, None), (4, "u", "<"), (5, "u", "<p>one two</p>"), (None, "v", "<p>solo</p>")]
PAGE_SCHEMA = "page_id long, url string, html string, id string, key string, first string, text string"


def test_pages_cases(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in PAGES], PAGE_SCHEMA)
    out = extract_text(pages, learn_weights(pages)).collect()
    assert len(out) == len(PAGES) and {r["n_chars"] for r in out if r["page_id"] == 2} == {0}
    assert next(r for r in out if r["page_id"] == 1)["n_chars"] == 99_999
    none = pages.limit(0)
    assert extract_text(none, learn_weights(none)).collect() == []
    write_warc(pages, str(tmp_path / "a"))
    rows = resolve_revisits(read_warc(spark, str(tmp_path / "a"))).collect()
    assert len(rows) == len(PAGES)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in rows)
    assert kinds.count(("3", "response", None)) == 2 and ("5", "revisit", 3) in kinds and ("None", "revisit", 2) in kinds
    write_warc(none, str(tmp_path / "b"))
    assert read_warc(spark, str(tmp_path / "b")).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_edge_rows_and_empty_table(spark, edges, none, labels, bench, tmp_path, name, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, edges, str(tmp_path))
    rows = out.collect()
    if name != "packing":
        assert out.columns == edges.columns and out.dtypes == edges.dtypes and 0 < len(rows) <= len(edge_rows())
    assert stage(spark, none, str(tmp_path)).collect() == []


def test_registered_queries_return_rows(spark, small_dir):
    for name, fn in catalog.queries().items():
        out = fn(spark, small_dir)
        assert not any(isinstance(f.dataType, T.NullType) for f in out.schema) and out.count() > 0, name


def test_pipeline_against_its_stages(spark, small_dir):
    """The pipeline's rows: every piece belongs to a document that passes the
    four filters, in whole."""
    pieces = corpus_pipeline.run(spark, small_dir).collect()
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small_dir).cache()
    tokens = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    from tokenizers import Tokenizer

    from panelwright.llm.word_ids import default_vocabulary
    tk = Tokenizer.from_file(default_vocabulary())
    assert tokens == {r["doc_id"]: len(tk.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}
    total = {}
    for r in pieces:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == tokens
