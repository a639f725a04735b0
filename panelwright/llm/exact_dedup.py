"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

Every text is cut at content-defined boundaries, so equal texts have equal
chunk lists.  A chunk's identifier is its 64-bit hash, verified against the
chunk texts: each distinct (hash, chunk) pair travels once, and a hash shared
by different chunks gets ordinals that tell them apart.  Texts are then
compared as ordered identifier lists; documents themselves never move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store, text_or_empty

CHUNK_MIN, CHUNK_MAX = 512, 4096


def chunks(text: Column, lo: int = CHUNK_MIN, hi: int = CHUNK_MAX) -> Column:
    """Cut ``text`` into chunks of ``lo`` to ``hi`` characters that end after
    the first white space behind a sentence end, else after any white space,
    else at ``hi``.  Boundaries depend on the chunk's own content only;
    concatenating the chunks gives the text.  An empty text has no chunks."""
    pattern = rf"(?s).{{{lo},{hi}}}?(?<=[.!?;:\n])\s|.{{{lo},{hi}}}?\s|.{{1,{hi}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                chunk_hash: Callable[[Column], Column] = lambda c: F.xxhash64(c),
                lo: int = CHUNK_MIN, hi: int = CHUNK_MAX) -> DataFrame:
    """Group equal texts and keep the row with the largest id of each group.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``.  No normalisation: texts are equal when identical.

    * NULL text counts as empty; all empty texts form one group.
    * A NULL id loses against any other; a group with only NULL ids has a NULL
      ``keep_id``.
    * Of rows that repeat both text and the kept id, exactly one is kept.
    * Columns other than the two named ones are ignored; an empty table gives
      an empty result.

    ``chunk_hash`` may be any function of the chunk: collisions are resolved.
    """
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    base = base.select("id", F.sha2("text", 256).alias("sha"), chunks(F.col("text"), lo, hi).alias("chunks"))
    rows = store(base.select("id", "sha", F.transform("chunks", lambda c: chunk_hash(c)).alias("recipe")), "recipes")

    pieces = base.select(F.explode("chunks").alias("chunk")).select(chunk_hash(F.col("chunk")).alias("h"), "chunk")
    shared = store(pieces.distinct().groupBy("h").count().filter("count > 1").select("h"), "ambiguous-hashes")
    fix_type = "array<struct<pos:int,ord:int>>"
    if shared.isEmpty():
        rows = rows.withColumn("fix", F.lit(None).cast(fix_type))
    else:
        occ = (base.select("id", "sha", F.posexplode("chunks").alias("pos", "chunk"))
               .withColumn("h", chunk_hash(F.col("chunk"))).join(shared, "h"))
        by_text = Window.partitionBy("h").orderBy("chunk")
        ords = occ.select("h", "chunk").distinct().withColumn("ord", F.row_number().over(by_text))
        fixes = (occ.join(ords, ["h", "chunk"]).groupBy(F.col("id").alias("f_id"), F.col("sha").alias("f_sha"))
                 .agg(F.sort_array(F.collect_set(F.struct("pos", "ord"))).alias("fix")))
        rows = rows.join(fixes, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("sha") == F.col("f_sha")), "left")

    # rows that repeat an id and its text are counted, then given back one by one
    counted = rows.groupBy("recipe", "fix", "id", "sha").agg(F.count("*").alias("n"))
    groups = (counted.groupBy(F.col("recipe").alias("g_recipe"), F.col("fix").alias("g_fix"))
              .agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size")))
    same = (F.col("recipe") == F.col("g_recipe")) & F.col("fix").eqNullSafe(F.col("g_fix"))
    return (counted.join(groups, same)
            .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
            .select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"),
                    (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                    F.col("sha").alias("text_sha256")))
