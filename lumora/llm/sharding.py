"""Balanced label propagation: documents move towards their neighbours' shards as far as quotas allow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.llm.common import documents, written

SHARDS, ROUNDS, SLACK, DEGREE = 40, 6, 0.02, 256
#: Groups over one LARGE-th of a shard are placed one by one; there are fewer than about LARGE * shards of them.
LARGE = 16
#: Characters at either end of a text by which texts are linked.
END = 64


def _draw(*salt) -> Column:
    """A uniform number of [0, 1) that depends on the node and `salt` alone."""
    return F.pmod(F.xxhash64("node", *[F.lit(s) for s in salt]), F.lit(1 << 30)) / float(1 << 30)


def equal_text_links(nodes: DataFrame) -> DataFrame:
    """Links (src, dst) that join all nodes of equal `text_key` to a tree: to the first of up to DEGREE nodes, and these
    firsts to the first of all. So no node has many links, whatever the size of its group, and links are fewer than nodes."""
    groups = nodes.groupBy("text_key").agg(F.count("*").alias("n"), F.min("node").alias("root")).filter("n > 1")
    sub = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / DEGREE))
    members = nodes.select("node", "text_key").join(groups, "text_key").select("node", "text_key", "root", sub.alias("sub"))
    firsts = members.groupBy("text_key", "sub").agg(F.min("node").alias("first"), F.first("root").alias("root"))
    leaves = members.join(firsts.select("text_key", "sub", "first"), ["text_key", "sub"]).select(F.col("first").alias("src"), F.col("node").alias("dst"))
    # Roots of very many subgroups: these hang in a chain of levels instead of on the one root.
    order = Window.partitionBy("text_key", F.pmod(F.xxhash64("first"), F.lit(64))).orderBy("first")
    chained = firsts.withColumn("up", F.coalesce(F.lag("first").over(order), F.col("root")))
    return leaves.union(chained.select(F.col("up").alias("src"), F.col("first").alias("dst"))).filter("src <> dst")


def near_text_links(texts: DataFrame) -> DataFrame:
    """Links of different texts (node, head, tail) that begin or end alike."""
    ways = [equal_text_links(texts.select("node", F.col(k).alias("text_key")).filter("text_key IS NOT NULL")) for k in ("head", "tail")]
    return ways[0].union(ways[1])


def plan_groups(groups: list[tuple], size: list[int]) -> tuple[dict, dict, list[int]]:
    """Where the large groups (key, n) go: the shard of each that fits whole, the pieces (shard, n) of each that fits in
    none, and the room that is left. The largest come first, each to the shard of most room."""
    room, whole, pieces = list(size), {}, {}
    for key, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        s = max(range(len(room)), key=room.__getitem__)
        if n <= room[s]:
            whole[key] = s
            room[s] -= n
            continue
        pieces[key] = []
        while n:
            s = max(range(len(room)), key=room.__getitem__)
            k = min(n, room[s])
            pieces[key].append((s, k))
            room[s], n = room[s] - k, n - k
    return whole, pieces, room


def lay_out(size: list[int], pieces: list[list[tuple[int, int]]], grouped: list[int], single: list[int]) -> list[tuple[int, int, int]]:
    """Runs (first rank, shard, first slot) over rows in this order: the divided groups, the other groups by label, the
    single rows by label. What exceeds the shard of its label goes where most room is; groups are cut only there."""
    runs, at, used, free = [], 0, [0] * len(size), list(size)

    def lay(s: int, n: int):
        nonlocal at
        if n:
            runs.append((at, s, used[s]))
            at, used[s] = at + n, used[s] + n

    for s, n in (piece for group in pieces for piece in group):
        lay(s, n)
        free[s] -= n
    for counts in (grouped, single):
        fit = [min(g, f) for g, f in zip(counts, free)]
        free = [f - n for f, n in zip(free, fit)]
        ends = [u + n for u, n in zip(used, fit)]
        for s, n in enumerate(fit):
            lay(s, n)
            over = counts[s] - n
            while over:
                to = max(range(len(free)), key=free.__getitem__)
                k = min(over, free[to])
                # Behind the rows that the shard's own take.
                runs.append((at, to, ends[to]))
                at, ends[to], free[to], over = at + k, ends[to] + k, free[to] - k, over - k
        used[:] = ends
    return runs


def propagate(nodes: DataFrame, links: DataFrame, room: list[int], rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """`nodes` (node, seed, rows, ...) with a `label`, a shard: linked nodes share one where quotas allow.

    A node with a `seed` stays there. Another starts in a shard drawn by itself, with the `room` of the shards as weights.
    In each round a node asks for the shard that most of its neighbours are in; of those who ask for a shard, a part drawn by hash may move, so that no shard exceeds its quota of (1 + slack) * rows / shards, and half of
    them at most, so that two neighbours do not change places for ever. Only counts by pair of shards reach the driver.
    """
    shards = len(room)
    both = written(links.union(links.select("dst", "src")).toDF("src", "node"), "links")
    cuts = F.array(*[F.lit(float(c)) for c in np.cumsum(room) / max(sum(room), 1)])
    drawn = F.least(F.size(F.filter(cuts, lambda c: c <= _draw("start"))), F.lit(shards - 1))
    labels = written(nodes.select("node", "rows", F.col("seed").isNotNull().alias("held"), F.coalesce("seed", drawn).cast("int").alias("label")), "labels")
    quota = (1 + slack) * (labels.agg(F.sum("rows")).first()[0] or 0) / shards
    for turn in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("src"), F.col("label").alias("vote")), "src").groupBy("node", "vote").agg(F.count("*").alias("n"))
        own = labels.select("node", F.col("label").alias("vote"), F.lit(0).alias("n"))
        tally = votes.unionByName(own).groupBy("node", "vote").agg(F.sum("n").alias("n"), F.max(F.col("n") == 0).alias("here"))
        # More votes first, then staying, then the lower shard.
        want = tally.groupBy("node").agg(F.max(F.struct("n", "here", -F.col("vote"))).alias("w"), F.max(F.when(F.col("here"), F.col("vote"))).alias("label"))
        wish = F.when(F.col("held"), F.col("label")).otherwise(-F.col("w")["col3"])
        asked = written(want.join(labels.select("node", "rows", "held"), "node").select("node", "rows", "held", "label", wish.alias("want")), "asked")
        demand = {(r.label, r.want): r.n for r in asked.groupBy("label", "want").agg(F.sum("rows").alias("n")).collect()}
        if all(a == b for a, b in demand):
            break
        size = [sum(n for (a, _), n in demand.items() if a == s) for s in range(shards)]
        into = [sum(n for (a, b), n in demand.items() if b == s != a) for s in range(shards)]
        room = [max(0.0, quota - n) for n in size]
        part = [min(1.0, room[s] / into[s]) if into[s] else 0.0 for s in range(shards)]
        # What surely leaves a shard makes room for as many; one more pass over the parts suffices for that.
        leave = [sum(n * part[b] for (a, b), n in demand.items() if a == s != b) for s in range(shards)]
        part = [min(1.0, (room[s] + leave[s]) / into[s]) if into[s] else 0.0 for s in range(shards)]
        allowed = F.array(*[F.lit(min(p, 0.5)) for p in part])[F.col("want")]
        labels = written(asked.select("node", "rows", "held", F.when(_draw(turn) < allowed, F.col("want")).otherwise(F.col("label")).cast("int").alias("label")), "labels")
    return nodes.join(labels.select("node", "label"), "node")


def numbered(df: DataFrame, order: list) -> DataFrame:
    """`df` with `rank`, its place from 0 in the order of unique `order`; no task sees more than its range of rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    # One row for each shuffle partition.
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("rank", F.col("_before") + within).drop("_at", "_part", "_before")


def shard_documents(docs: DataFrame, links=near_text_links, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Every row of `docs` in one of `shards` shards by the law `rows`: counts differ by one at most.

    All rows of one text are one node, so they move together; large groups are placed by size and stay. `links` makes links
    (src, dst) of the nodes (node, text_key, head, tail): by these, propagation brings texts that begin or end alike to one
    shard, as far as it has room. Then groups and single rows are laid out by label, so that only groups over a shard's size
    are divided, and those that overfill one where single rows are too few to even it out. A null text counts as empty
    with size 16; repeated rows are rows of their own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    ends = [F.when(F.length(text) >= END, F.xxhash64(x)).alias(k) for k, x in (("head", F.substring(text, 1, END)), ("tail", F.substring(text, -END, END)))]
    base = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"), *ends)
    nodes = written(base.withColumn("id", F.monotonically_increasing_id()), "nodes")
    total = nodes.count()
    size = [-(-(s + 1) * total // shards) - -(-s * total // shards) for s in range(shards)]
    texts = written(nodes.groupBy("text_key").agg(F.count("*").alias("rows"), F.min("id").alias("node"), F.min("head").alias("head"), F.min("tail").alias("tail")), "texts")
    large = texts.filter((F.col("rows") > 1) & (F.col("rows") * LARGE > min(size))).select("text_key", "rows").collect()
    whole, pieces, room = plan_groups([(bytes(r.text_key), r.rows) for r in large], size)
    placed = [(k, s, None) for k, s in whole.items()] + [(k, p[0][0], i) for i, (k, p) in enumerate(pieces.items())]
    known = F.broadcast(spark.createDataFrame(placed, "text_key binary, seed int, divided int"))
    seeded = texts.join(known, "text_key", "left")
    labels = propagate(seeded, links(texts), room, rounds).select("text_key", "rows", "divided", "label")
    labelled = written(nodes.select("id", "doc_id", "size", "text_crc32", "text_key").join(labels, "text_key"), "labelled")
    some = F.when(F.col("divided").isNotNull(), 0).when(F.col("rows") > 1, 1).otherwise(2)
    laid = labelled.withColumn("side", some).withColumn("run", F.coalesce("divided", "label"))
    counts = {(r.side, r.run): r["count"] for r in laid.filter("side > 0").groupBy("side", "run").count().collect()}
    runs = lay_out(size, list(pieces.values()), *[[counts.get((side, s), 0) for s in range(shards)] for side in (1, 2)])
    laid = laid.withColumnRenamed("id", "node")
    ranked = numbered(laid, ["side", "run", "text_key", "node"])
    table = F.array(*[F.struct(*[F.lit(x).cast("long").alias(k) for k, x in zip(("at", "shard", "slot"), r)]) for r in runs or [(0, 0, 0)]])
    of = F.element_at(F.filter(table, lambda r: r["at"] <= F.col("rank")), -1)
    return (
        ranked.withColumn("of", of)
        .withColumn("slot", F.col("of.slot") + F.col("rank") - F.col("of.at"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("of.shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "text_key", "label")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir)).drop("text_key", "label")


QUERIES = {"op4_sharding": op4_sharding}
SQL: dict[str, str] = {}
