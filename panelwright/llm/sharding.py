"""Sharding by balanced label propagation.

Documents that share a group are linked.  Starting from hashed shards, every
round counts the shards of each document's neighbours (an aggregation per
group and a join back), lets documents ask for the shard that holds most of
them, and grants moves under capacity quotas: what comes into a shard beyond
what leaves it must fit its room.
Only the shard-by-shard request matrices reach the driver.  The links of a
large group are spread over parts by node, and its counts are repeated for
every part, so no task gets a whole large group.

A last pass makes the counts exact: rows are ordered by shard, with linked
groups in the middle of each shard and single documents at its ends, numbered
by a distributed sort, and cut into equal ranges, so a cut seldom meets a
group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, text_or_empty

SHARDS, ROUNDS, SLACK = 8, 4, 0.2
HUB_PARTS, PART_ROWS = 1024, 1000
_UNIT = 1 << 20


def _quotas(wants: dict[tuple[int, int, int], int], load: list[int], capacity: float) -> dict[tuple[int, int, int], float]:
    """Share granted of the requests (size class, from shard, to shard).

    Documents with few neighbours come first, as large groups may not fit
    anyway.  Moves in and out of a shard offset each other; where what remains
    is more than the capacity, the requests for that shard are cut evenly.  A
    group of half a shard or more is granted whole: the final cut lays what a
    shard cannot hold into the next."""
    shards = range(len(load))
    load, share = list(load), {}
    for c in sorted({c for c, _, _ in wants}):
        ask = {(a, b): n for (k, a, b), n in wants.items() if k == c}
        grant = {ab: float(n) for ab, n in ask.items()}
        for _ in range(0 if 2 ** (c + 1) >= capacity else 2 * len(load)):
            for b in shards:
                come = sum(n for (_, t), n in grant.items() if t == b)
                go = sum(n for (f, _), n in grant.items() if f == b)
                over = load[b] + come - go - capacity
                if over > 0 and come > 0:
                    for a in shards:
                        if (a, b) in grant:
                            grant[a, b] *= max(0.0, 1 - over / come)
        for (a, b), n in grant.items():
            load[b] += n
            load[a] -= n
        share.update({(c, a, b): grant[a, b] / n for (a, b), n in ask.items()})
    return share


def _spread(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of hubs with several nodes, as ``(node, hub, salt)``, and the
    hubs of more than one part, ``(hub, parts)``.

    A part is a ``HUB_PARTS``-th of all links, or ``PART_ROWS`` if that is
    more, so fewer than ``HUB_PARTS`` hubs have several parts, and all of them
    together under twice that number of parts."""
    sizes = store(links.groupBy("hub").count().filter("count > 1"), "shard-hubs")
    total = sizes.agg(F.sum("count")).first()[0] or 0
    part = max(PART_ROWS, total / HUB_PARTS)
    large = store(sizes.filter(F.col("count") > part).select("hub", F.ceil(F.col("count") / part).cast("int").alias("parts")),
                  "shard-large-hubs")
    salted = (links.join(F.broadcast(large), "hub", "left")     # under HUB_PARTS rows
              .withColumn("salt", F.pmod(F.xxhash64(F.lit("part"), F.col("node")), F.coalesce("parts", F.lit(1))).cast("int")))
    return salted.select("node", "hub", "salt").join(_per_part(sizes.select("hub"), large), ["hub", "salt"]), large


def _per_part(hubs: DataFrame, large: DataFrame) -> DataFrame:
    """A row of ``hubs`` for every part of its hub, with its ``salt``."""
    return (hubs.join(F.broadcast(large), "hub", "left")        # under HUB_PARTS rows
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts"))


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS,
              slack: float = SLACK) -> DataFrame:
    """``nodes(node)`` and ``links(node, hub)`` → ``(node, shard)``.

    Nodes of a hub are neighbours; a node may have several hubs.  No shard is
    granted moves beyond (1 + ``slack``) of an even share."""
    links, large = _spread(links.filter("hub IS NOT NULL"))
    links = store(links, "shard-links")
    first = F.pmod(F.xxhash64(F.lit("shard"), F.col("node")), F.lit(shards)).cast("int")
    linked = store(links.groupBy("node").agg(F.min("hub").alias("main")).withColumn("shard", first), "shard-labels")
    nodes = nodes.select("node", first.alias("shard"))

    def per_shard(df):
        return [dict(df.groupBy("shard").count().collect()).get(s, 0) for s in range(shards)]    # one row per shard

    load = per_shard(nodes)
    alone = [a - b for a, b in zip(load, per_shard(linked))]
    capacity = (1 + slack) * sum(load) / shards

    for turn in range(rounds):
        at = links.join(linked.select("node", "shard"), "node")
        tie = [F.pmod(F.xxhash64(F.lit(s), F.col("hub")), F.lit(_UNIT)) / F.lit(4.0 * _UNIT) for s in range(shards)]
        held = at.groupBy("hub").agg(*[F.sum((F.col("shard") == s).cast("long")).alias(f"n{s}") for s in range(shards)])
        held = _per_part(held.select("hub", *[(F.col(f"n{s}") + tie[s]).alias(f"n{s}") for s in range(shards)]), large)
        liking = links.join(held, ["hub", "salt"]).groupBy("node").agg(*[F.sum(f"n{s}").alias(f"n{s}") for s in range(shards)])
        most = F.greatest(*[F.col(f"n{s}") for s in range(shards)])
        best = F.coalesce(*[F.when(F.col(f"n{s}") == most, F.lit(s)) for s in range(shards)])
        near = sum((F.col(f"n{s}") for s in range(shards)), F.lit(0.0))
        size = F.floor(F.log2(F.greatest(near, F.lit(1.0)))).cast("int")
        asked = store(linked.join(liking.select("node", best.alias("best"), size.alias("size")), "node"), "shard-requests")
        wants = {(r["size"], r["shard"], r["best"]): r["count"]      # at most shards² rows for each power of two
                 for r in asked.filter("shard <> best").groupBy("size", "shard", "best").count().collect()}
        if not wants:
            break
        quota = _quotas(wants, load, capacity)

        def code(c, a, b):
            return (c * shards + a) * shards + b
        share = F.create_map(*[x for k, q in quota.items() for x in (F.lit(code(*k)), F.lit(float(q)))])
        granted = F.element_at(share, code(F.col("size"), F.col("shard"), F.col("best")))
        # a group moves as one
        draw = F.pmod(F.xxhash64(F.lit(turn), F.col("main")), F.lit(_UNIT)) / F.lit(float(_UNIT))
        moves = (F.col("shard") != F.col("best")) & (draw < granted)
        linked = store(asked.select("node", "main", F.when(moves, F.col("best")).otherwise(F.col("shard")).cast("int").alias("shard")),
                       "shard-labels")
        load = [a + b for a, b in zip(alone, per_shard(linked))]
    out = nodes.join(linked.select(F.col("node").alias("l_node"), F.col("shard").alias("l_shard"), "main"),
                     F.col("node") == F.col("l_node"), "left")
    return out.select("node", F.coalesce("l_shard", "shard").alias("shard"), "main")


def number_rows(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add the row's position (from 0) in the order given: a range-partitioned
    sort, partition sizes, and their running sum (one row per partition)."""
    from pyspark.sql import Window
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = store(sorted_.withColumn(f"_{name}", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(f"_{name}", 33)
    sizes = placed.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    return (placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")     # one row per partition
            .withColumn(name, F.col("_offset") + F.col(f"_{name}").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_part", "_offset", f"_{name}"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                    rounds: int = ROUNDS) -> DataFrame:
    """Put every row into a shard so that shard counts differ by at most one
    and rows of equal text are together where the counts allow.

    Returns one row per input row: ``doc_id, size`` (UTF-8 bytes + 1),
    ``text_crc32, law`` ("rows"), ``shard, slot`` (gapless from 0) and
    ``grown_shard`` (NULL: this law has none).

    * NULL text has no bytes, so size 1, and is grouped with the empty text.
    * NULL and repeated ids are rows like others.  A group larger than a shard
      fills neighbouring shards.
    * Other columns are ignored; an empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    rows = store(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                             F.crc32(text).alias("text_crc32"), F.md5(text).alias("hub"),
                             F.monotonically_increasing_id().alias("node")), "shard-rows")
    labels = propagate(rows.select("node"), rows.select("node", "hub"), shards, rounds)
    table = rows.join(labels, "node")
    single = F.when(F.col("main").isNotNull(), 1).otherwise(F.pmod(F.xxhash64("node"), F.lit(2)) * 2)
    placed = number_rows(table.withColumn("phase", single),
                         [F.col("shard"), F.col("phase"), F.coalesce("main", F.lit("")), F.col("node")])
    total = F.lit(rows.count())
    base, extra = F.floor(total / shards), total % shards
    wide = extra * (base + 1)
    p = F.col("position")
    shard = F.when(p < wide, F.floor(p / (base + 1))).otherwise(extra + F.floor((p - wide) / F.greatest(base, F.lit(1)))).cast("int")
    start = F.least(F.col("new"), extra) * (base + 1) + F.greatest(F.col("new") - extra, F.lit(0)) * base
    return (placed.withColumn("new", shard)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("new").alias("shard"),
                    (p - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
