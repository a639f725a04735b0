"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, scratch
from .conversation_repair import repair_conversations
from .decontamination import find_passages
from .exact_dedup import exact_dedup
from .html_text import extract_text, learn_weights
from .line_dedup import line_report, short_repeats
from .maxscore import top_k
from .ngram_join import jaccard_classes
from .packing import pack_documents, packed_digests
from .periodic_runs import periodic_runs
from .quality import grade_documents
from .sharding import shard_documents
from .token_counts import count_tokens
from .warc import read_warc, resolve_revisits, write_warc


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (jaccard_classes(read_table(spark, sf_dir, "documents"))
            .selectExpr("id AS doc_id", "class_id", "class_size", "n_links", "lead AS kept"))


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(pack_documents(read_table(spark, sf_dir, "documents")))


def op4_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op5_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract_text(pages, learn_weights(pages))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), path)
    return resolve_revisits(read_warc(spark, path))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read_table(spark, sf_dir, "documents"))


def op9_short_line_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short_repeats(read_table(spark, sf_dir, "documents"))


def op10_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_places"), F.min("start").alias("first_start"), F.max("end").alias("last_end"),
        F.min("edits").cast("long").alias("least_edits"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read_table(spark, sf_dir, "documents"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(read_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


SQL_OP1 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS gs FROM w),
s AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS gram FROM g),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
reach AS (SELECT doc_id, doc_id AS other FROM documents
          UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
c AS (SELECT doc_id, min(other) AS class_id, count(*) AS class_size FROM reach GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT c.doc_id, class_id, class_size, coalesce(k.n, 0) AS n_links, c.doc_id = class_id AS kept
FROM c LEFT JOIN k ON c.doc_id = k.doc_id"""

# The mark-up of the given pages, stated directly: blocks inside <article>.
SQL_OP6 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS b FROM pages),
t AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(b, '</?(h1|p|br)>'),
        lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '</?b>', '', 'g'),
          '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM a)
SELECT page_id, url, array_to_string(ls, chr(10)) AS text, length(array_to_string(ls, chr(10))) AS n_chars FROM t"""

SQL_OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p),
x AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, i * 5 + 1, 5))::INT) AS v FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((v[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM x"""

SQL_OP5 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

# One edit leaves the first or the last half of the shorter line untouched, so
# partners are looked up by equal halves and checked with levenshtein.
SQL_OP9 = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(len(ls))) AS pos, trim(unnest(ls), ' ') AS line FROM docs),
firsts AS (SELECT line, length(line) AS n, min({'d': doc_id, 'p': pos}) AS o FROM lines WHERE length(line) >= 30 GROUP BY line),
halves AS (
  SELECT line, n, o, h, 'f' AS side, left(line, h) AS half FROM (SELECT *, unnest(list_distinct([n // 2, (n - 1) // 2])) AS h FROM firsts)
  UNION ALL
  SELECT line, n, o, h, 'l', right(line, h) FROM (SELECT *, unnest(list_distinct([n // 2, (n - 1) // 2])) AS h FROM firsts)),
near AS (
  SELECT DISTINCT a.line FROM halves a JOIN halves b ON a.h = b.h AND a.side = b.side AND a.half = b.half
  WHERE b.o < a.o AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) <= 1),
gone AS (
  SELECT l.doc_id, l.pos FROM lines l JOIN firsts f ON l.line = f.line
  WHERE f.o <> {'d': l.doc_id, 'p': l.pos} OR f.line IN (SELECT line FROM near)),
per AS (SELECT doc_id, count(*) AS c, string_agg(pos, ',' ORDER BY pos) AS dropped FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(c, 0))::BIGINT AS n_kept, coalesce(dropped, '') AS dropped
FROM docs d LEFT JOIN per USING (doc_id)"""

SQL_OP9_SHORT = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(len(ls))) AS pos, trim(unnest(ls), ' ') AS line FROM docs),
firsts AS (SELECT line, min({'d': doc_id, 'p': pos}) AS o FROM lines WHERE length(line) BETWEEN 1 AND 29 GROUP BY line)
SELECT doc_id, count(*) AS n_short, string_agg(pos, ',' ORDER BY pos) AS short
FROM lines JOIN firsts USING (line) WHERE o <> {'d': doc_id, 'p': pos} GROUP BY doc_id"""

SQL_OP12 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INT AS rank, vec_id, score FROM k WHERE n <= 5"""

def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string expression in DuckDB, bit by bit."""
    eight = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda l: ascii(l)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {eight}), 4294967295)"


# Equal words of a text, paired by their distance, stated directly.
SQL_OP11 = rf"""
WITH h AS (SELECT doc_id, {_crc32("doc_id::VARCHAR")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
a AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE ws END AS ws FROM p),
w AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM d),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM same),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY doc_id, q, part),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t,
        min({{'l': -length, 's': start, 'p': period}}) AS b FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, -b.l AS length, b.p AS period, 1000 * -b.l // b.p AS exponent_milli,
       sha256(coalesce(r.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM documents LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _plus(state: str, cost: str, edit: str, line: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'l': {state}.l || {line}}}"


def _edit_steps() -> str:
    """Cheapest edits so far (cost, audit, lines) by the state they end in,
    row by row: after nothing (z), a system (s), a user (u), an assistant (a)."""
    own, cost = "chr(10) || role || ':' || text", "e"
    u = [f"CASE WHEN ini = 'u' THEN {_plus(x, cost, 'K', own)} ELSE {_plus(x, '1 + e', 'R', "chr(10) || 'user:' || text")} END" for x in "zsa"]
    a = f"CASE WHEN ini = 'a' THEN {_plus('u', cost, 'K', own)} ELSE {_plus('u', '1 + e', 'R', "chr(10) || 'assistant:' || text")} END"
    gone = {x: _plus(x, "2", "D", "''") for x in "zsua"}
    return f"""
SELECT conv_id, i, {gone["z"]} AS z0,
  CASE WHEN live AND ini = 's' THEN least({gone["s"]}, {_plus("z", cost, "K", own)}) ELSE {gone["s"]} END AS s0,
  CASE WHEN live THEN least({gone["u"]}, {", ".join(u)}) ELSE {gone["u"]} END AS u0,
  CASE WHEN live THEN least({gone["a"]}, {a}) ELSE {gone["a"]} END AS a0 FROM b"""


_USER_FIRST = ", ".join(_plus(x, "5", "I", "chr(10) || 'user:'") for x in ("z0", "s0", "a0"))
_OPEN = f"least(u0, {_USER_FIRST})"

SQL_OP13 = rf"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE h WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE h <> 0),
n AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
f AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN min(i) OVER (PARTITION BY conv_id, role, text) < i THEN 'duplicate'
    WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS ini,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'l': ''}} AS z0, {{'c': 1000000, 'a': '', 'l': ''}} AS s0,
    {{'c': 1000000, 'a': '', 'l': ''}} AS u0, {{'c': 1000000, 'a': '', 'l': ''}} AS a0 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT * FROM (
    WITH b AS (SELECT dp.conv_id, f.i, f.role, f.text, f.ini, fault NOT IN ('blank', 'duplicate') AS live, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS e,
      z0 AS z, s0 AS s, {_OPEN} AS u, least(a0, {_plus(f"({_OPEN})", "5", "I", "chr(10) || 'assistant:'")}) AS a
      FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1)
    {_edit_steps()})),
best AS (SELECT conv_id, least(z0, a0, {_plus(f"({_OPEN})", "5", "I", "chr(10) || 'assistant:'")}) AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS k FROM dp),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, x.c::BIGINT AS cost, x.a AS audit, sha256(substr(x.l, 2)) AS repaired_sha256
FROM best LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM best.conv_id WHERE k = 1"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_ngram_join": (op1_ngram_join, SQL_OP1),
    "op2_ordinal_quality": (op2_ordinal_quality, None),
    "op3_harmonic_packing": (op3_harmonic_packing, None),
    "op4_label_propagation_shards": (op4_label_propagation_shards, None),
    "op5_chunk_recipes": (op5_chunk_recipes, SQL_OP5),
    "op6_main_text": (op6_main_text, SQL_OP6),
    "op7_token_counts": (op7_token_counts, None),
    "op8_warc_round_trip": (op8_warc_round_trip, SQL_OP8),
    "op9_line_dedup": (op9_line_dedup, SQL_OP9),
    "op9_short_line_repeats": (op9_short_line_repeats, SQL_OP9_SHORT),
    "op10_benchmark_passages": (op10_benchmark_passages, None),
    "op11_periodic_runs": (op11_periodic_runs, SQL_OP11),
    "op12_exact_topk": (op12_exact_topk, SQL_OP12),
    "op13_conversation_repair": (op13_conversation_repair, SQL_OP13),
    "pipeline": (pipeline, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
