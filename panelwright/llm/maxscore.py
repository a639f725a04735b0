"""Exact top-k inner products by MaxScore over integer vectors.

A vector's components are its terms.  Candidates are dealt over shards of
bounded size; a shard keeps, per block of candidates, one posting list per
term and the list's least and greatest impact, which bound what the term can
add for a query.  Terms whose bounds together stay below the query's k-th best
score are non-essential: the essential postings are traversed for the whole
block, the others are probed, in falling order of their bounds, only for
candidates whose partial score plus the bounds left reaches that score.  Blocks
whose bound misses it are not opened.  The shards' lists are merged.

Queries stream past the shard, so a task holds one shard and one Arrow batch.
A shard compares equal vectors once and keeps the k + 1 smallest ids of each,
since no more can rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, store

SHARD_CELLS = 1 << 22        # components held by one shard
BLOCK = 8192                 # candidates that share term bounds
PROBE = 8                    # terms probed between two cuts
MERGE = 256                  # shard lists merged into one per round
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, vector`` (floor(scale · x) as longs, limited to their range);
    vectors that are NULL or hold a NULL or non-finite component are left out."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (vectors.select(F.col(id_col).alias("id"), x.alias("x")).where(F.col("x").isNotNull() & ~bad)
            .select("id", F.transform("x", lambda v: F.floor(F.lit(float(scale)) * v)).alias("vector")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, short ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _number_type(a: np.ndarray, b: np.ndarray):
    """The narrowest type in which every partial sum of a · b is exact."""
    top = [max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0 for m in (a, b)]
    bound = top[0] * top[1] * max(1, a.shape[1])
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


class Shard:
    """Postings of one shard; rows come in order of their ids."""

    def __init__(self, vectors: np.ndarray, copies: np.ndarray, k: int):
        self.k = k
        self.raw, inverse = np.unique(vectors, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        by_vector = np.argsort(inverse, kind="stable")
        self.members, self.copies = by_vector, copies
        self.first = np.searchsorted(inverse[by_vector], np.arange(len(self.raw) + 1))
        # candidates with the same strongest term lie together, so a block's bounds are tight
        if vectors.shape[1]:
            strongest = np.argmax(np.abs(self.raw), axis=1)
            sign = np.take_along_axis(self.raw, strongest[:, None], 1)[:, 0] < 0
            self.order = np.lexsort((sign, strongest))
        else:
            self.order = np.arange(len(self.raw))
        self.types: dict = {}

    def blocks(self, kind):
        if kind not in self.types:
            parts = [self.order[i:i + BLOCK] for i in range(0, len(self.order), BLOCK)]
            lists = [np.ascontiguousarray(self.raw[p].T.astype(kind)) for p in parts]
            low = np.array([x.min(axis=1) for x in lists], dtype=kind).reshape(len(lists), -1)
            high = np.array([x.max(axis=1) for x in lists], dtype=kind).reshape(len(lists), -1)
            self.types[kind] = parts, lists, low, high
        return self.types[kind]

    def search(self, query: np.ndarray) -> list[tuple[int, int]]:
        """The k + 1 best (score, row) of the shard, copies counted as rows."""
        kind = _number_type(self.raw, query[None, :])
        parts, lists, low, high = self.blocks(kind)
        q = query.astype(kind)
        first, second = low * q, high * q
        least, most = np.minimum(first, second), np.maximum(first, second)     # what a term adds, by block
        total = most.sum(axis=1) if most.shape[1] else np.zeros(len(parts), dtype=kind)
        falling = np.argsort(-(most.max(axis=0) - least.min(axis=0)), kind="stable")
        q = q[falling]
        best: list[tuple[int, int]] = []                         # (-score, row), sorted
        for b in np.argsort(-total, kind="stable"):
            needed = -best[self.k][0] if len(best) > self.k else None
            if needed is not None and total[b] < needed:
                break
            at = len(q)
            if needed is not None:
                # left[i]: most that terms from i on add; a candidate at its least in the first i terms reaches limit[i]
                left = np.append(np.cumsum(most[b][falling][::-1])[::-1], 0)
                limit = np.append(0, np.cumsum(least[b][falling])) + left
                at = int(np.argmax(limit < needed)) if limit[-1] < needed else len(q)
            alive = np.arange(len(parts[b]))
            score = q[:at] @ lists[b][falling[:at]] if at else np.zeros(len(alive), dtype=kind)
            while needed is not None:
                keep = np.flatnonzero(score + left[at] >= needed)
                alive, score = alive[keep], score[keep]
                if at == len(q) or not len(alive):
                    break
                upto = min(at + PROBE, len(q))
                score = score + q[at:upto] @ lists[b][falling[at:upto, None], alive]
                at = upto
            best = self._merge(best, score, parts[b][alive])
        return [(-s, row) for s, row in best]

    def _merge(self, best, score, vectors):
        lead = self.members[self.first[vectors]]
        if len(score) > self.k + 1:
            cut = np.partition(score, len(score) - self.k - 1)[len(score) - self.k - 1]
            near = np.flatnonzero(score >= cut)                  # ties of the last place: smaller rows go first
            chosen = near[np.lexsort((lead[near], -score[near]))][:self.k + 1]
        else:
            chosen = np.arange(len(score))
        new = []
        for i in chosen:
            v, room = vectors[i], self.k + 1
            for row in self.members[self.first[v]:self.first[v + 1]][:self.k + 1]:
                n = min(room, int(self.copies[row]))
                new += [(-int(score[i]), int(row))] * n
                room -= n
                if not room:
                    break
        return sorted(best + new)[:self.k + 1]


def _in_long(x: int) -> int:
    return max(-_LONG, min(_LONG, x))


def _search_shards(k: int, width: int, schema: pa.Schema):
    """Arrow batches sorted by (shard, is_query, id) to one row per query and shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, shard, ids, seen = None, [], None, None, {}
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(numbers)]):
                if hi == lo:
                    continue
                part = batch.slice(lo, hi - lo)
                if numbers[lo] != current:
                    current, waiting, shard, seen = numbers[lo], [], None, {}
                asks = int(np.sum(part.column("is_query").to_numpy(zero_copy_only=False)))
                if asks < len(part):
                    waiting.append(part.slice(0, len(part) - asks))
                if not asks or not waiting:
                    continue
                if shard is None:
                    held = pa.Table.from_batches(waiting).combine_chunks()
                    ids = held.column("id").combine_chunks()
                    shard = Shard(_matrix(held.column("vector").combine_chunks(), width), held.column("copies").to_numpy(), k)
                part = part.slice(len(part) - asks)
                lists, own = [], []
                for q in _matrix(part.column("vector"), width):
                    key = q.tobytes()
                    if key not in seen:
                        if len(seen) > 10_000:
                            seen.clear()
                        seen[key] = shard.search(q), _in_long(sum(int(x) * int(x) for x in q))
                    lists.append(seen[key][0])
                    own.append(seen[key][1])
                rows = [r for found in lists for _, r in found]
                entry = pa.StructArray.from_arrays(
                    [pa.array([-_in_long(s) for found in lists for s, _ in found], pa.int64()),
                     ids.take(pa.array(rows, pa.int64())).is_null(), ids.take(pa.array(rows, pa.int64()))], ["down", "none", "id"])
                offsets = np.cumsum([0, *map(len, lists)])
                found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entry)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("shard"), part.column("id"), part.column("copies"),
                     pa.array(own, pa.int64()), found.cast(schema.field("found").type)], schema=schema)
    return run


def top_k(vectors: DataFrame, queries, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that meets the condition
    ``queries`` (a Column on ``id``), the ``k`` other rows of the greatest
    inner product of ``floor(scale * x)``, ties to the smaller id.

    NULL vectors and vectors with a NULL or non-finite component take no part.
    Vectors of unequal length count as filled up with zeros; an empty vector
    scores 0.  A NULL id is a candidate ranked after the others of its score,
    and a query only if the condition says so.  Repeated rows are rows: each
    is a query and a candidate for the others.  Components and scores are
    limited to the range of long; scores beyond it are ordered as the limit.
    Fewer candidates than ``k`` are all returned; other columns are ignored;
    an empty table gives an empty result.

    Every query meets every shard, as its block of the work; a query's lists,
    k + 1 rows each, are merged ``MERGE`` shards at a time.
    """
    rows = quantised(vectors, id_col, vector_col, scale).groupBy("id", "vector").agg(F.count("*").alias("copies"))
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "maxscore-rows")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    n, width = size["n"], size["width"]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n * max(width, 1) // SHARD_CELLS), min(cores, -(-n // 1024)))
    candidates = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).withColumn("is_query", F.lit(False))
    asked = (rows.where(queries).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
             .withColumn("is_query", F.lit(True)))
    stream = (candidates.unionByName(asked).repartition(shards, "shard")
              .sortWithinPartitions("shard", "is_query", F.col("id").asc_nulls_last(), "row")
              .select("shard", "is_query", "row", "id", "copies", "vector"))
    kind = rows.schema["id"].dataType
    ddl = (f"row long, shard long, id {kind.simpleString()}, copies long, own long, "
           f"found array<struct<down: long, none: boolean, id: {kind.simpleString()}>>")
    lists = _lists(on_workers(stream), k, width, ddl)
    while True:
        lists = lists.groupBy("row", F.floor(F.col("shard") / MERGE).alias("shard")).agg(
            F.first("id").alias("id"), F.first("copies").alias("copies"), F.first("own").alias("own"),
            F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
        shards = -(-shards // MERGE)
        if shards == 1:
            break
    # the query's own row is one of its list; without it, the list is k long at most
    me = F.array_position(F.transform("found", lambda x: (x["down"] == -F.col("own")) & x["id"].eqNullSafe(F.col("id"))), True)
    others = F.filter("found", lambda x, i: i + 1 != F.col("me"))
    out = lists.withColumn("me", me).withColumn("found", F.slice(others, 1, k))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(F.col("id").alias("query_id"), F.posexplode("found").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.down")).alias("score"))


def _lists(stream: DataFrame, k: int, width: int, ddl: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return stream.mapInArrow(_search_shards(k, width, to_arrow_schema(StructType.fromDDL(ddl))), ddl)
