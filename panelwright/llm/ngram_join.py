"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

1. Every text becomes the set of its five-word n-grams (64-bit hashes of the
   lower-cased words).  Texts with the same set are copies: they are counted
   and represented once.
2. MinHash signatures are cut into bands; sets that share a band hash are
   candidates.  A bucket is a star of edges to its smallest member, not its
   pairs.  Row and band counts follow from the wanted recall.
3. Connected candidates are compared on their full sets.  A component is cut
   into blocks of bounded size; a task holds two blocks and gets all their
   intersections from one matrix product.  It returns link counts and a
   spanning forest (rows in proportion to the documents), never the pairs.
4. Classes are the components of the verified links.

Where only the classes matter, ``class_forest`` verifies a spanning part of the
links instead of all of them.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import mix, text_blocks, word_hashes
from .common import on_workers, store, text_or_empty
from .graph import components

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 4
BLOCK_GRAMS, BLOCK_SETS = 1 << 20, 1024


def band_count(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` values needed to meet a pair at ``threshold`` with
    probability ``recall``: 1 - (1 - t^rows)^bands >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def gram_arrays(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text, sorted.  A text of fewer words
    has one n-gram, all its words; one without words has none."""
    h, counts = word_hashes(texts)
    odd = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(len(h) - words + 1, 0)
    grams = np.zeros(n, np.uint64)
    for j in range(words):
        grams += h[j:j + n] * odd[j]
    grams = mix(grams)
    out, at = [], 0
    for c in counts:
        if c >= words:
            out.append(np.unique(grams[at:at + c - words + 1]))
        elif c:
            short = (h[at:at + c] * odd[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def _signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes (len(sets) × bands) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.zeros((len(sets), bands), np.uint64)
    seed = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    for b in range(bands):
        key = np.full(len(sets), np.uint64(b + 1))
        for r in range(rows):
            s = seed[b * rows + r]
            low = np.minimum.reduceat((flat ^ s) * (s | np.uint64(1)), starts)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, b] = key
    return out


def _describe(words: int, bands: int, rows: int):
    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in text_blocks(texts):
                sets = gram_arrays(texts[lo:hi], words)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = [[] for _ in sets]
                if full:
                    sig = _signatures([sets[i] for i in full], bands, rows).view(np.int64)
                    for i, k in zip(full, sig):
                        keys[i] = k
                yield pd.DataFrame({"id": pdf["id"].iloc[lo:hi].to_numpy(), "tk": pdf["tk"].iloc[lo:hi].to_numpy(),
                                    "grams": [len(s) for s in sets],
                                    "set_id": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], "bands": keys})
    return run


def _with_sets(words: int):
    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo, hi in text_blocks(texts):
                part = pdf.iloc[lo:hi].drop(columns="text")
                yield part.assign(grams=[s.tobytes() for s in gram_arrays(texts[lo:hi], words)])
    return run


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``left`` with those at ``right``."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, df = np.unique(flat, return_inverse=True, return_counts=True)
    col = np.where(df > 1, np.cumsum(df > 1) - 1, -1)[col]
    owner, col = owner[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    out = np.zeros((len(left), len(right)), np.int64)
    shared = int(col[-1]) + 1 if len(col) else 0
    width = max(64, min(shared, (1 << 22) // len(sets)))
    for lo in range(0, shared, width):
        a, b = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], col[a:b] - lo] = 1
        out += np.rint(m[left] @ m[right].T).astype(np.int64)
    return out


def _compare(threshold: Fraction):
    """Verify one task's pairs: (set_id, links in documents, smallest linked set of the task)."""
    num, den = threshold.numerator, threshold.denominator

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "set_id"], kind="stable").reset_index(drop=True)
        sets = [np.frombuffer(g, np.uint64) for g in pdf["grams"]]
        size = np.array([len(s) for s in sets], np.int64)
        docs = pdf["docs"].to_numpy(np.int64)
        block = pdf["block"].to_numpy()
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        links = np.zeros(len(sets), np.int64)
        root = np.arange(len(sets))
        if len(left) and len(right):
            common = _intersections(sets, left, right)
            linked = common * (num + den) >= num * (size[left][:, None] + size[right][None, :])
            if a == b:
                np.fill_diagonal(linked, False)
                links[left] = linked @ docs[right]
            else:
                links[left] = linked @ docs[right]
                links[right] = linked.T @ docs[left]
            while True:     # smallest reachable index, by rounds of neighbour minima
                low = root.copy()
                big = len(sets)
                low[left] = np.minimum(low[left], np.where(linked, root[right][None, :], big).min(axis=1))
                low[right] = np.minimum(low[right], np.where(linked, root[left][:, None], big).min(axis=0))
                low = low[low]
                if (low == root).all():
                    break
                root = low
        ids = pdf["set_id"].to_numpy()
        return pd.DataFrame({"set_id": ids, "links": links, "root": ids[root]})
    return run


def _candidates(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int):
    """The rows (id, tk, text), their sets (id, tk, set_id, …), the distinct sets
    (``node``, ``rep``, ``docs``, ``grams``, ``bands``) and the candidate
    component (``root``) of every set (``node``) that shares a band with another."""
    text = text_or_empty(text_col)
    base = on_workers(docs).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    described = store(base.mapInPandas(_describe(words, bands, rows),
                                       "id long, tk long, grams long, set_id string, bands array<long>"), "signatures")

    sets = store(described.groupBy("set_id").agg(
        F.min(_place()).alias("rep"), F.count("*").alias("docs"), F.first("grams").alias("grams"),
        F.first("bands").alias("bands")).withColumn("node", F.xxhash64("set_id")), "sets")

    keyed = sets.select("node", F.explode("bands").alias("key"))
    hubs = (keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other"))
            .filter("hub <> other").select("key", "hub"))
    edges = keyed.join(hubs, "key").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    return base, described, sets, components(edges, "candidates")


def _place() -> Column:
    """Order of rows: NULL ids last, then id, then text hash."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("tk"))


def _blocks(grams: Column, sets: Column) -> Column:
    """Blocks that so many sets with so many n-grams are cut into."""
    return F.ceil(F.greatest(grams / F.lit(BLOCK_GRAMS), sets / F.lit(BLOCK_SETS))).cast("int")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per input row: ``id, tk`` (hash of the text), ``set_id``,
    ``class_id`` (smallest id of its class), ``class_size`` (documents),
    ``n_links`` (other documents whose n-gram sets have a Jaccard similarity
    of at least ``threshold``) and ``lead`` (the row is its class's first, by
    id, then text hash).

    * Links are verified on the full sets; the banding misses a linked pair
      with probability 1 - ``recall`` at the threshold and less above it,
      and only if no chain of candidates joins the two.
    * Texts without words (NULL, empty, only signs) have the empty set and are
      copies of each other.
    * NULL ids sort last for ``lead``; a class with only NULL ids has a NULL
      ``class_id``.  Rows that repeat id and text are copies, all ``lead`` if
      one is.
    * Other columns are ignored; an empty table gives an empty result.
    """
    base, described, sets, cand = _candidates(docs, id_col, text_col, words, band_count(threshold, recall, rows), rows)
    members = store(sets.join(cand, "node").select("root", "set_id", "docs", "grams", F.col("rep.id").alias("r_id"),
                                                   F.col("rep.tk").alias("r_tk")), "members")
    blocks = members.groupBy("root").agg(_blocks(F.sum("grams"), F.count("*")).alias("k"))
    members = (members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("k")).cast("int"))
               .drop("grams"))
    here = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("tk") == F.col("r_tk"))
    texts = (base.join(members, here).dropDuplicates(["set_id"])
             .select("root", "set_id", "docs", "k", "block", "text"))
    loaded = texts.mapInPandas(_with_sets(words), "root long, set_id string, docs long, k int, block int, grams binary")
    tasks = (loaded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")))
    compare = _compare(Fraction(threshold).limit_denominator(10_000))
    found = store(tasks.select("root", "set_id", "docs", "block", "a", "b", "grams").groupBy("root", "a", "b")
                  .applyInPandas(compare, "set_id string, links long, root string"), "links")

    joined = components(found.select(F.col("set_id").alias("u"), F.col("root").alias("v")), "classes")
    counts = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    classed = (sets.select("set_id", "rep", "docs").join(counts, "set_id", "left")
               .join(joined.withColumnRenamed("node", "set_id"), "set_id", "left")
               .withColumn("root", F.coalesce("root", "set_id")))
    heads = classed.groupBy("root").agg(F.min("rep").alias("head"), F.sum("docs").alias("class_size"))
    per_set = classed.join(heads, "root").select(
        "set_id", F.col("head.id").alias("class_id"), "class_size", "head",
        (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    return (described.select("id", "tk", "set_id", _place().alias("place")).join(per_set, "set_id")
            .select("id", "tk", "set_id", "class_id", "class_size", "n_links", (F.col("place") == F.col("head")).alias("lead")))


def class_forest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                 threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """The first row of every class (``none, id, tk``: NULL id, id, text hash)
    in the order of ``jaccard_classes``, found without counting links.

    Only as many links are verified as it takes to join the classes:

    1. every block of a candidate component is compared in itself and with one
       set of the component, so work and rows grow with the component's size;
    2. in a component of several blocks, a band hash whose sets are then still
       of several classes is compared across its classes: the sets of its
       largest class meet the others, but not each other.  Band hashes of the
       same sets are compared once.

    A link is missed with probability 1 - ``recall`` at the threshold, and less
    above it, unless other links join its texts."""
    base, _, sets, cand = _candidates(docs, id_col, text_col, words, band_count(threshold, recall, rows), rows)
    compare = _compare(Fraction(threshold).limit_denominator(10_000))
    schema = "set_id string, links long, root string"

    members = sets.join(cand, "node").select("node", "root", "set_id", "grams", "rep")
    here = F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("tk") == F.col("rep.tk"))
    members = store(base.join(members, here).dropDuplicates(["set_id"])
                    .select("node", "root", "set_id", F.col("grams").alias("n"), "text"), "member-texts")

    parts = members.groupBy("root").agg(_blocks(F.sum("n"), F.count("*")).alias("k"), F.min("set_id").alias("lead"))
    near = (members.join(parts, "root").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("k")).cast("int"))
            .select("root", "set_id", "text", F.when(F.col("set_id") == F.col("lead"), F.sequence(F.lit(0), F.col("k") - 1))
                    .otherwise(F.array("own")).alias("at")))
    near = (near.mapInPandas(_with_sets(words), "root long, set_id string, at array<int>, grams binary")
            .withColumn("a", F.explode("at")))
    first = store(near.select("root", "set_id", F.lit(1).cast("long").alias("docs"), F.col("a").alias("block"), "a", F.col("a").alias("b"), "grams")
                  .groupBy("root", "a", "b").applyInPandas(compare, schema), "first-links").select("set_id", "root")

    joined = components(first.select(F.col("set_id").alias("u"), F.col("root").alias("v")), "first-classes")
    cut = parts.filter("k > 1").select("root")           # components of one block are compared in full
    classed = members.join(cut, "root", "left_semi").select("node", "set_id", "n").join(joined.withColumnRenamed("node", "set_id"), "set_id", "left")
    classed = classed.select("node", "set_id", "n", F.coalesce("root", "set_id").alias("class"))
    keyed = (sets.select("node", F.explode("bands").alias("key"))
             .join(classed, "node").select("key", "set_id", "n", "class"))
    h = F.xxhash64("set_id").cast("decimal(38,0)")
    shares = keyed.groupBy("key", "class").agg(F.count("*").alias("c"), F.sum("n").alias("g"), F.sum(h).alias("h"))
    mixed = (shares.groupBy("key").agg(F.max(F.struct("c", "g", "class")).alias("top"), F.sum("c").alias("c"), F.sum("g").alias("g"),
                                       F.sum("h").alias("h"), F.count("*").alias("classes")).filter("classes > 1")
             .groupBy("h", "c", "g").agg(F.min(F.struct("key", "top")).alias("one"))
             .select("one.key", "one.top.class", _blocks(F.col("one.top.g"), F.col("one.top.c")).alias("k_top"),
                     _blocks(F.col("g") - F.col("one.top.g"), F.col("c") - F.col("one.top.c")).alias("k_rest"))
             .withColumnRenamed("class", "top"))
    # blocks of the other classes are numbered first; those of the largest class meet them only
    slot = F.xxhash64("set_id", F.lit(1))
    across = keyed.join(mixed, "key").withColumn("in_top", F.col("class") == F.col("top")).select(
        "key", "set_id",
        F.when(F.col("in_top"), F.col("k_rest") + F.pmod(slot, F.col("k_top"))).otherwise(F.pmod(slot, F.col("k_rest"))).cast("int").alias("block"),
        F.sequence(F.lit(0), F.col("k_rest") - 1 + F.when(F.col("in_top"), 0).otherwise(F.col("k_top"))).alias("others"))
    again = (members.select("set_id", "text").join(across.select("set_id"), "set_id", "left_semi")
             .mapInPandas(_with_sets(words), "set_id string, grams binary"))
    across = (across.join(again, "set_id").withColumn("other", F.explode("others"))
              .select("key", "set_id", F.lit(1).cast("long").alias("docs"), "block", F.least("block", "other").alias("a"),
                      F.greatest("block", "other").alias("b"), "grams"))
    second = across.groupBy("key", "a", "b").applyInPandas(compare, schema).select("set_id", "root")

    found = components(first.union(second).select(F.col("set_id").alias("u"), F.col("root").alias("v")), "classes")
    return (sets.select("set_id", "rep").join(found.withColumnRenamed("node", "set_id"), "set_id", "left")
            .groupBy(F.coalesce("root", "set_id").alias("root")).agg(F.min("rep").alias("rep")).select("rep.*"))


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the smallest
    id.  All columns stay; see ``jaccard_classes`` for the defined cases."""
    leads = class_forest(docs, id_col, text_col, **options).select(F.struct("id", "tk").alias("lead_key"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("tk")).alias("key"))
    kept = packed.join(leads, F.col("key") == F.col("lead_key"), "left_semi").dropDuplicates(["key"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
