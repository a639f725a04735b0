"""Line deduplication over a deletion neighbourhood (DataFrame functions only).

Two lines are the same when at most one character is inserted, deleted or
replaced between them.  Every line that can have such a partner emits its
one-deletion variants as hashed keys; lines that meet under a key are within
the bound by construction, which a Levenshtein check of the texts confirms.

Keys are built so that a bucket never needs its pairs:

* replacement: (length, deleted position, remaining text).  All lines of such
  a bucket differ in that one character, so each is compared with the
  earliest only.
* insertion or deletion: a variant of the longer line meets the whole shorter
  line; a bucket is its variants against one whole text.

A line of n characters would cost n keys of n characters.  Two measures keep
that small: only lines that share a half with another line emit at all (one
edit leaves the first or the last half untouched), and a variant is hashed as
(short piece without one character, hash of the rest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, text_or_empty

MIN_CHARS = 30
PIECE = 32


def _halves(line: str, n: str) -> Column:
    """Hashes of the first and the last h characters, for each half length h
    at which a partner of length n - 1, n or n + 1 is compared."""
    lens = f"array_distinct(array(cast({n} div 2 AS int), cast(({n} - 1) div 2 AS int)))"
    return F.expr(f"""concat(transform({lens}, h -> struct(xxhash64('first', h, left({line}, h)) AS k, true AS first)),
                             transform({lens}, h -> struct(xxhash64('last', h, right({line}, h)) AS k, false AS first)))""")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("tk"), t.alias("text"))


def _lines(base: DataFrame, min_chars: int) -> DataFrame:
    """Lines of at least ``min_chars`` characters: place, text, 128-bit identity, length."""
    return (base.select("id", "tk", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .withColumn("line", F.trim("line")).withColumn("n", F.char_length("line")).filter(F.col("n") >= min_chars)
            .withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), F.col("line"))))


def _variants(lines: DataFrame) -> DataFrame:
    """One row per key: kind 0 replacement, 1 variant with a deletion, 2 whole line.

    ``first``/``last`` say which half is shared with another line; a variant
    is needed only where the line may differ, the other half.
    """
    def piece_len(n):
        return f"greatest({PIECE}, cast(ceil(sqrt({n})) AS int))"

    lines = lines.withColumn("p", F.expr(piece_len("n"))).withColumn("q", F.expr(piece_len("n + 1")))
    # an edit in the last half starts at the half's length, one in the first half ends before n minus it
    lines = lines.withColumn("lo", F.expr("if(last, 0, (n - 1) div 2 - 1)")).withColumn("hi", F.expr("if(first, n, n div 2 + 2)"))
    lines = lines.withColumn("pieces", F.expr("""
        transform(filter(sequence(0, cast((n - 1) div p AS int)), j -> (j + 1) * p > lo AND j * p < hi),
                  j -> struct(j AS j, substring(line, j * p + 1, p) AS piece,
                              xxhash64(left(line, j * p), substring(line, (j + 1) * p + 1)) AS rest))"""))
    keys = F.expr("""concat(
        flatten(transform(pieces, x -> transform(sequence(1, char_length(x.piece)), i -> struct(0 AS kind,
            xxhash64('replaced', n, x.j, i, x.rest, left(x.piece, i - 1), substring(x.piece, i + 1)) AS key)))),
        flatten(transform(pieces, x -> transform(sequence(1, char_length(x.piece)), i -> struct(1 AS kind,
            xxhash64('deleted', n - 1, x.j, x.rest, concat(left(x.piece, i - 1), substring(x.piece, i + 1))) AS key)))),
        transform(sequence(0, cast(n div q AS int)), j -> struct(2 AS kind,
            xxhash64('deleted', n, j, xxhash64(left(line, j * q), substring(line, j * q + q)),
                     substring(line, j * q + 1, q - 1)) AS key)))""")
    return lines.select("h1", "h2", "ord", F.explode(keys).alias("e")).select("h1", "h2", "ord", "e.kind", "e.key")


def _near_lines(base: DataFrame, distinct: DataFrame) -> DataFrame:
    """Distinct lines (h1, h2) that have an earlier line one edit away."""
    halves = distinct.select("h1", "h2", F.explode("halves").alias("h")).select("h1", "h2", "h.k", "h.first")
    shared = (halves.groupBy("k").agg(F.min("h1").alias("a"), F.max("h1").alias("b"))
              .filter("a <> b").select("k"))
    cand = (halves.join(shared, "k", "left_semi").groupBy("h1", "h2")
            .agg(F.max("first").alias("first"), F.max(~F.col("first")).alias("last")))
    # candidate texts are fetched from the document of the line's first place
    places = (distinct.join(cand, ["h1", "h2"])
              .groupBy(F.col("ord.id").alias("p_id"), F.col("ord.tk").alias("p_tk"))
              .agg(F.collect_list(F.struct("ord", "h1", "h2", "n", "first", "last")).alias("at")))
    here = F.col("id").eqNullSafe(F.col("p_id")) & (F.col("tk") == F.col("p_tk"))
    texts = store(base.join(places, here)
                  .select(F.split("text", "\n").alias("all"), F.explode("at").alias("x"))
                  .select("x.*", F.trim(F.expr("all[x.ord.pos]")).alias("line"))
                  .dropDuplicates(["h1", "h2"]), "candidate-lines")

    keys = _variants(texts)
    met = (keys.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, F.col("ord"))).alias(f"o{k}") for k in (0, 1, 2)],
                                   F.max(F.when(F.col("kind") == 0, F.col("ord"))).alias("m0"))
           .filter("o0 <> m0 OR (o1 IS NOT NULL AND o2 IS NOT NULL)"))
    partner = F.when(F.col("kind") == 0, F.col("o0")).when(F.col("kind") == 1, F.col("o2")).otherwise(F.col("o1"))
    pairs = (keys.join(met, "key").withColumn("earlier", partner).filter("earlier < ord")
             .select("h1", "h2", "earlier").distinct())
    left = texts.select("h1", "h2", "line")
    right = texts.select(F.col("ord").alias("earlier"), F.col("line").alias("earlier_line"))
    return (pairs.join(left, ["h1", "h2"]).join(right, "earlier")
            .filter(F.levenshtein("line", "earlier_line", 1).between(0, 1)).select("h1", "h2").distinct())


def line_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS) -> DataFrame:
    """Positions (from 0) of the lines that repeat an earlier one, per document.

    Lines are trimmed of blanks; the order is (id, position); empty lines do
    not count.  Returns ``id, tk`` (hash of the text) and two sorted lists,
    NULL if empty: ``dropped``, lines of ``min_chars`` characters and more
    that equal an earlier line of the table or are one edit away, and
    ``short``, shorter lines that equal an earlier one.  Documents without
    either have no row.
    """
    base = _keyed(docs, id_col, text_col)
    lines = _lines(base, 1)
    place = F.struct("id", "pos", "tk")
    long = F.col("n") >= min_chars
    distinct = store(lines.withColumn("halves", F.when(long, _halves("line", "n"))).groupBy("h1", "h2")
                     .agg(F.min(place).alias("ord"), F.count("*").alias("c"),
                          F.first("n").alias("n"), F.first("halves").alias("halves")), "distinct-lines")
    near = store(_near_lines(base, distinct.filter(long)), "near-lines").withColumn("near", F.lit(True))
    judged = (distinct.select("h1", "h2", "ord", "c").join(near, ["h1", "h2"], "left")
              .filter("c > 1 OR near").select("h1", "h2", "ord", "near"))
    out = (lines.select("id", "tk", "pos", "n", "h1", "h2").join(judged, ["h1", "h2"])
           .filter(F.col("near") | (F.col("ord") != place)))

    def positions(which):
        found = F.collect_set(F.when(which, F.col("pos")))
        return F.when(F.size(found) > 0, F.sort_array(found))
    return out.groupBy("id", "tk").agg(positions(long).alias("dropped"), positions(~long).alias("short"))


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_chars: int = MIN_CHARS) -> DataFrame:
    """Positions (from 0) of the lines to drop, per document.

    A line, trimmed of blanks, is dropped if an earlier line of the table, in
    the order (id, position), equals it or is one edit away; lines of under
    ``min_chars`` characters are never dropped.  Returns ``id, tk`` (hash of
    the text) and ``dropped`` (sorted positions) for documents that lose lines.
    """
    return line_repeats(docs, id_col, text_col, min_chars).filter("dropped IS NOT NULL").select("id", "tk", "dropped")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = MIN_CHARS, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with repeated lines taken out of the text; all columns stay.
    ``drop_emptied`` drops documents in which every line that is not blank is
    taken out or, below ``min_chars``, equals an earlier line of the table.

    * Kept lines keep their text, blanks and order.  A document without
      repeated lines is returned unchanged; one that loses every line has the
      empty text.
    * NULL text has no lines and stays NULL.  A NULL id sorts before others.
    * Rows that repeat id and text are one document and get the same result.
    * Columns of any name are allowed; an empty table gives an empty result.
    """
    gone = line_repeats(docs, id_col, text_col, min_chars)
    gone = gone.select(F.struct(F.col("id"), F.col("tk")).alias("gone_key"), "dropped", "short")
    t = F.col(text_col).cast("string")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("tk")).alias("row_key"))
    joined = packed.join(gone, (F.col("row_key.id").eqNullSafe(F.col("gone_key.id")))
                         & (F.col("row_key.tk") == F.col("gone_key.tk")), "left")
    row = F.col("row")
    parts = F.split(row[text_col].cast("string"), "\n")
    none = F.array().cast("array<int>")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.coalesce("dropped", none))
    clean = F.when(F.col("dropped").isNull(), row[text_col].cast("string")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    if drop_emptied:
        new = F.exists(F.array_except(kept, F.coalesce("short", none)), lambda i: F.length(F.trim(F.get(parts, i))) > 0)
        joined = joined.filter(F.col("gone_key").isNull() | new)
    return joined.select(*[(clean if c == text_col else row[c]).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_kept, dropped`` (positions as
    a comma-separated list, empty if none)."""
    gone = line_decisions(docs, id_col, text_col, min_chars).select(F.col("id").alias("g_id"), F.col("tk").alias("g_tk"), "dropped")
    base = _keyed(docs, id_col, text_col).select("id", "tk", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    lost = F.coalesce(F.col("dropped"), F.array().cast("array<int>"))
    return (base.join(gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("tk") == F.col("g_tk")), "left")
            .select(F.col("id").alias("doc_id"), "n_lines", (F.col("n_lines") - F.size(lost)).cast("long").alias("n_kept"),
                    F.array_join(lost, ",").alias("dropped")))


def short_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document that holds lines of under ``min_chars`` characters
    equal to an earlier line: ``doc_id, n_short`` (how many) and ``short``
    (positions as a comma-separated list).  They stay in the texts.

    * Lines are trimmed of blanks; blank lines do not count.  The order is
      (id, position), a NULL id first, so one of equal lines has no row.
    * NULL and empty texts have no lines.  Rows that repeat id and text are one
      document and have one row; other rows of an id are documents of their own.
    * Texts of any length are read whole; other columns are ignored; an empty
      table gives an empty result.
    """
    lines = _lines(_keyed(docs, id_col, text_col), 1).filter(F.col("n") < min_chars)
    place = F.struct("id", "pos", "tk")
    repeated = lines.groupBy("h1", "h2").agg(F.min(place).alias("ord"), F.count("*").alias("c")).filter("c > 1").drop("c")
    found = (lines.select("id", "tk", "pos", "h1", "h2").join(repeated, ["h1", "h2"]).filter(F.col("ord") != place)
             .groupBy("id", "tk").agg(F.sort_array(F.collect_set("pos")).alias("short")))
    return found.select(F.col("id").alias("doc_id"), F.size("short").cast("long").alias("n_short"),
                        F.array_join("short", ",").alias("short"))
