"""Jaccard join of word n-gram sets by vertical partitioning.

All n-grams have one global order: those of few documents first, inside a class by hash. The order is cut into fragments.
Two sets that reach the threshold share an n-gram of their prefixes, so each fragment holds the documents of its prefix
n-grams and counts partial overlaps; sums over the fragments bound the overlap of a pair, and what may reach the threshold is
verified on the texts. Equal sets are one node from the start.

A set also has a sketch: for each of SKETCH classes of n-grams whether it has an odd number of them. Two sketches differ in
no more places than the sets differ in n-grams, so a pair whose sketches differ in more than the threshold allows cannot
reach it. Every fragment decides this alike, so a pair that is left out is left out of all sums.

Components need no more links than connect them. First each node is verified against the TRIED nodes that it shares most
prefix n-grams with among the hubs of its lists, the first nodes of a list that those behind them may link to; this is repeated
between the components so found. Only pairs between components are then counted in full. Where the number of links is asked for, this first step is left out and
all pairs are counted and verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import commonest, documents, written
from lumora.llm.components import components
from lumora.llm.flat import SPACES
from lumora.llm.packs import BASE1, BASE2, BYTES1, MIX2, NO_ID, Pack, bucketed, mixed, packed, powers, pressed, released, unpressed, window_hashes, with_answers

#: A document set's prefix order puts n-grams of HEAVY documents and more last; at most HEAVY_KEPT of these are told apart.
HEAVY, HEAVY_KEPT, TOGETHER, AT_ONCE = 64, 1 << 16, 512, 1 << 18
FRAGMENT_BYTES, SKETCH, HUBS, TRIED, ROUNDS = 32 << 20, 512, 4, 2, 2


def gram_sets(texts: bytes, starts: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text in `texts`; shorter texts have their whole sequence as one."""
    data = np.frombuffer(texts.lower(), np.uint8)
    gap = SPACES[data]
    start, end = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])), np.flatnonzero(gap & ~np.concatenate([[True], gap[:-1]]))
    up, down = powers(BASE1, len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES1[data] * up[: len(data)])])
    words = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    grams = mixed(window_hashes(words, n, BASE2))
    first = np.searchsorted(start, starts)
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(mixed(window_hashes(words[a:b], b - a, BASE2) + np.uint64(b - a), MIX2) if b > a else np.zeros(0, np.uint64))
    return out


def sets_of(pack: Pack, n: int, limit: int = 1 << 19) -> list[np.ndarray]:
    """The n-gram sets of a pack's texts, some texts at a time."""
    out, lo = [], 0
    while lo < len(pack.ids):
        hi = max(lo + 1, int(np.searchsorted(pack.starts, pack.starts[lo] + limit, "right")) - 1)
        out += gram_sets(pack.data[pack.starts[lo] : pack.starts[hi]], pack.starts[lo : hi + 1] - pack.starts[lo], n)
        lo = hi
    return out


def signature(grams: np.ndarray) -> int:
    return int(mixed(np.array([mixed(grams, MIX2).sum(dtype=np.uint64) + np.uint64(len(grams))]))[0].astype(np.int64))


def prefix_size(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def node_of(pack: int, k) -> int:
    return (pack << 23) + k


def sketch(grams: np.ndarray) -> np.ndarray:
    """The parities of the classes of a set's n-grams, as 64-bit words."""
    odd = np.bincount((grams >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view("<u8")


def may_link(n: np.ndarray, sketches: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sets numbered `a` and `b` may reach the threshold, by their sizes and sketches."""
    both = n[a] + n[b]
    least = -(-percent * both // (100 + percent))
    fit = np.flatnonzero(np.minimum(n[a], n[b]) >= least)
    differ = np.bitwise_count(sketches[np.broadcast_to(a, both.shape)[fit]] ^ sketches[b[fit]]).sum(1, dtype=np.int64)
    out = np.zeros(len(both), bool)
    out[fit] = differ <= (both - 2 * least)[fit]
    return out


def _postings(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """key and number of the set of each posting in one fragment, by key and node, and of the sets node, n and sketch; of
    equal sets only the first node is left."""
    keys, at, nodes, sigs, sizes, sketches, base = [], [], [], [], [], [], 0
    for blob in blobs:
        cut = int.from_bytes(blob[:8], "little")
        k, i = unpressed(blob[8 : 8 + cut], "<u8", "<u4")
        node, sig, n, odd = unpressed(blob[8 + cut :], "<i8", "<i8", "<u4", f"V{SKETCH // 8}")
        keys.append(k)
        at.append(i.astype(np.int64) + base)
        nodes.append(node)
        sigs.append(sig)
        sizes.append(n)
        sketches.append(odd)
        base += len(node)
    node, sig, n = (np.concatenate(x) for x in (nodes, sigs, sizes))
    order = np.lexsort((node, sig))
    new = np.concatenate([[True], sig[order][1:] != sig[order][:-1]])
    lead = np.empty(len(node), np.int64)
    lead[order] = node[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    key, i = np.concatenate(keys), np.concatenate(at)
    keep = lead[i] == node[i]
    key, i = key[keep], i[keep]
    order = np.lexsort((node[i], key))
    return key[order], i[order], node, n.astype(np.int64), np.concatenate(sketches).view("<u8").reshape(len(node), -1)


def _verified(packs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach the threshold. Each text goes to the groups of its pairs, a group being a
    node b with up to about TOGETHER partners, so that a node of very many pairs is spread over groups."""
    many = pairs.groupBy("b").agg(F.count("*").alias("m"))
    spread = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("m") / TOGETHER)).alias("part"))
    wanted = spread.select(F.col("a").alias("node"), "b", "part").union(spread.select("b", "b", "part").distinct())
    asked = wanted.groupBy(F.shiftright("node", 23).alias("pack")).agg(F.collect_list(F.struct("node", "b", "part")).alias("of"))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        of = pa.concat_arrays([c.flatten() for c in right.column("of").chunks]) if right.num_rows else None
        if of is None or not left.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "text": pa.array([], pa.binary())})
        p, pack, press = left.column("pack")[0].as_py(), Pack.open(left.column("blob")[0].as_py()), zstandard.ZstdCompressor(3).compress
        some, which = np.unique(of.field("node").to_numpy(), return_inverse=True)
        texts = pa.array([press(pack.text(k - (p << 23))) for k in some.tolist()], pa.binary())
        return pa.table({"node": of.field("node"), "b": of.field("b"), "part": of.field("part"), "text": texts.take(pa.array(which))})

    texts = packs.select("pack", "blob").groupBy("pack").cogroup(asked.groupBy("pack")).applyInArrow(both, "node long, b long, part long, text binary")

    def compare(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        hub = table.column("b")[0].as_py()
        raw = [zstandard.ZstdDecompressor().decompress(t) for t in table.column("text").to_pylist()]
        sets = gram_sets(b"\n".join([*raw, b""]), np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw])]), n)
        mine = sets[nodes.index(hub)]
        linked = []
        for node, s in zip(nodes, sets):
            if node != hub:
                shared = len(np.intersect1d(mine, s, assume_unique=True))
                if 100 * shared >= percent * (len(mine) + len(s) - shared) and shared:
                    linked.append(node)
        return pa.table({"a": pa.array(linked, pa.int64()), "b": pa.array([hub] * len(linked), pa.int64())})

    return texts.groupBy("b", "part").applyInArrow(compare, "a long, b long")


def _runs(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Cuts a row of sizes into runs of about `limit` in sum; a larger one is a run of its own."""
    ends, out, lo = np.cumsum(sizes), [], 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        out.append((lo, hi))
        lo = hi
    return out


def _nearest_hubs(packs: DataFrame, candidates: DataFrame, n: int, percent: int) -> DataFrame:
    """The links of each node to the hubs that it shares most prefix n-grams with."""
    counted = candidates.groupBy("node", "hub").agg(F.sum("c").alias("c"))
    nearest = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "hub"))), 1, TRIED)
    star = counted.groupBy(F.col("node").alias("a")).agg(nearest.alias("hubs")).select("a", F.explode("hubs.hub").alias("b"))
    return written(_verified(packs, written(star, "star"), n, percent), "near")


def _labelled(listed: DataFrame, links: DataFrame) -> DataFrame:
    return listed.select("part", "key", "node").join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))


class Crossing:
    """The lists of one fragment whose nodes are not all of one component: postings (key, i) by key and i, where i numbers
    the sets by label and node."""

    def __init__(self, postings: pa.Table, described: pa.Table, percent: int):
        key, node, label = (postings.column(c).to_numpy() for c in ("key", "node", "label"))
        some, first, which, here = np.unique(node, return_index=True, return_inverse=True, return_counts=True)
        # Sets are numbered by label and node.
        order = np.lexsort((some, label[first]))
        self.node, self.label = some[order], label[first][order]
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        found = described.column("node").to_numpy()
        by = np.argsort(found)
        at = by[np.searchsorted(found, self.node, sorter=by)] if len(by) else by
        self.n = described.column("n").to_numpy()[at]
        self.sketches = np.frombuffer(b"".join(described.column("sketch").take(pa.array(at)).to_pylist()), "<u8").reshape(len(at), SKETCH // 64)
        self.elsewhere = prefix_size(self.n, percent) - here[order]
        i = number[which]
        order = np.lexsort((i, key))
        self.key, self.i = key[order], i[order]

    def hubs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(set, hub) for each posting with a hub: in each list the first set is the hub of those of other labels that may
        link to it, the first of those left the next one, HUBS times."""
        left, found = np.arange(len(self.i)), []
        for _ in range(HUBS):
            if not len(left):
                break
            new = np.concatenate([[True], self.key[left][1:] != self.key[left][:-1]])
            head = left[np.flatnonzero(new)][np.cumsum(new) - 1]
            near = (self.label[self.i[head]] != self.label[self.i[left]]) & may_link(self.n, self.sketches, self.i[head], self.i[left], percent)
            found.append((self.i[left[near]], self.i[head[near]]))
            left = left[~new & ~near]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (left, left)

    def pairs(self, percent: int) -> tuple[np.ndarray, ...]:
        """(x, y, c) for the pairs of sets of different labels that may link: how many postings they share here."""
        ends = np.append(np.flatnonzero(self.key[1:] != self.key[:-1]) + 1, len(self.key))
        # Postings of one label follow each other: all later ones of a list are partners of another label.
        label = self.label[self.i]
        same = np.append(np.flatnonzero((self.key[1:] != self.key[:-1]) | (label[1:] != label[:-1])) + 1, len(self.key))
        place = np.arange(len(self.key))
        behind = same[np.searchsorted(same, place, "right")] if len(place) else place
        times = (ends[np.searchsorted(ends, place, "right")] if len(place) else place) - behind
        held, sums, waiting = [], np.zeros((0, 3), np.int64), 0

        def merged():
            rows = np.concatenate([*held, sums])
            rows = rows[np.argsort(rows[:, 0] * len(self.node) + rows[:, 1], kind="stable")]
            new = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])) if len(rows) else np.zeros(0, np.int64)
            out = rows[new]
            if len(new):
                out[:, 2] = np.add.reduceat(rows[:, 2], new)
            return out

        for lo, hi in _runs(times, AT_ONCE):
            x = np.repeat(place[lo:hi], times[lo:hi])
            y = behind[x] + np.arange(len(x)) - np.repeat(np.cumsum(times[lo:hi]) - times[lo:hi], times[lo:hi])
            x, y = self.i[x], self.i[y]
            near = may_link(self.n, self.sketches, x, y, percent)
            held.append(np.stack([x[near], y[near], np.ones(near.sum(), np.int64)], 1))
            waiting += len(held[-1])
            if waiting > AT_ONCE:
                sums, held, waiting = merged(), [], 0
        return tuple(merged().T)


def _crossing(labelled: DataFrame) -> DataFrame:
    """The postings (part, key, node, label) of lists with several labels."""
    mixed_lists = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return written(labelled.join(mixed_lists.select("key"), "key"), "crossing")


def link_documents(docs: DataFrame, n: int = 4, percent: int = 85, more: str | None = None, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """The packs of `docs`, and per row node, doc_id, n_shingles, component_id: the smallest doc_id that links reach,
    and component: the least node of those that differ in text, which no two components share.

    Two texts link when their sets of n-grams of words, A-Z lower-cased, have a Jaccard similarity of `percent` in a hundred
    or more. A text of fewer words has its whole sequence as one n-gram. Null, empty and wordless texts have no n-grams and
    are alone in their component. Repeated rows are rows of their own. An empty table gives an empty result. N-grams are
    compared by 64 bits. A null doc_id counts as greater than all others. With `every` all pairs are compared and n_links is
    the number of linked pairs of rows in the component, copies included; their number may be quadratic in its rows.
    """
    packs = packed(docs, more)
    fragments = max(1, (packs.agg(F.sum("n_bytes")).first()[0] or 0) // FRAGMENT_BYTES)

    def describe(batches):
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pack = Pack.open(blob)
                sets = sets_of(pack, n)
                every, times = np.unique(np.concatenate(sets), return_counts=True)
                common = times > 1
                about = np.array([len(s) for s in sets]), np.array([signature(s) for s in sets], np.int64)
                rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (node_of(p, np.arange(len(sets))), pack.ids, *about)], ["node", "doc_id", "n", "sig"])
                grams = pa.StructArray.from_arrays([pa.array(every[common].astype(np.int64)), pa.array(times[common], pa.int64())], ["gram", "c"])
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (rows, grams)]
                yield pa.RecordBatch.from_arrays(lists, ["docs", "grams"])
        released()

    told = written(packs.select("pack", "blob").mapInArrow(describe, "docs array<struct<node: long, doc_id: long, n: long, sig: long>>, grams array<struct<gram: long, c: long>>"), "told")
    rows = told.select(F.inline("docs"))
    common = told.select(F.inline("grams")).groupBy("gram").agg(F.sum("c").alias("c")).filter(F.col("c") >= HEAVY)
    heavy = commonest(common, "gram", "c", HEAVY_KEPT).collect()
    grams = np.array([r.gram for r in heavy], np.int64).astype(np.uint64)
    order = np.argsort(grams)
    level = np.log2(np.array([r.c for r in heavy], float) / HEAVY + 1).astype(np.uint64)
    shared = packs.sparkSession.sparkContext.broadcast((grams[order], np.minimum(level[order], np.uint64(15))))

    def post(batches):
        grams, level = shared.value
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pack = Pack.open(blob)
                seen, keys, docs = {}, [], []
                for k, s in enumerate(sets_of(pack, n)):
                    sig = signature(s)
                    if not len(s) or sig in seen:
                        continue
                    seen[sig] = k, len(s), sketch(s)
                    key = mixed(s, MIX2) >> np.uint64(4)
                    if len(grams):
                        at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                        key |= np.where(grams[at] == s, level[at], np.uint64(0)) << np.uint64(60)
                    size = prefix_size(len(s), percent)
                    keys.append(np.partition(key, size - 1)[:size])
                    docs.append(np.full(size, k))
                if not keys:
                    continue
                key, doc = np.concatenate(keys), np.concatenate(docs)
                # Fragments are ranges of the order spread evenly by another hash; a gram's list lies in one fragment.
                place = mixed(key)
                order = np.argsort(place, kind="stable")
                out, of = [], {k: (sig, size, odd) for sig, (k, size, odd) in seen.items()}
                for b, (_, k, d) in bucketed(place[order], fragments, key[order], doc[order]):
                    mine, at = np.unique(d, return_inverse=True)
                    by = np.argsort(k, kind="stable")
                    first = pressed(k[by], at[by].astype(np.uint32))
                    table = pressed(node_of(p, mine.astype(np.int64)), np.array([of[x][0] for x in mine.tolist()], np.int64), np.array([of[x][1] for x in mine.tolist()], np.uint32), np.stack([of[x][2] for x in mine.tolist()]).view(f"V{SKETCH // 8}").ravel())
                    out.append((b, len(first).to_bytes(8, "little") + first + table))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.binary())], ["fragment", "blob"])
        released()

    def lists(table: pa.Table) -> pa.Table:
        key, i, node, n, sketches = _postings(table.column("blob").to_pylist())
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        key, i, first = (x[np.repeat(size > 1, size)] for x in (key, i, np.repeat(start, size)))
        hub, left = np.full(len(i), -1), np.arange(len(i))
        for _ in range(HUBS):
            # The first of those left in each list is their hub; who may not link to it waits for the next.
            new = np.concatenate([[True], first[left][1:] != first[left][:-1]]) if len(left) else np.zeros(0, bool)
            head = left[np.flatnonzero(new)][np.cumsum(new) - 1] if len(left) else left
            near = ~new & may_link(n, sketches, i[head], i[left], percent)
            hub[left[near]] = node[i[head[near]]]
            left = left[~new & ~near]
        hubs = pa.array(hub, pa.int64(), mask=hub < 0)
        released()
        sets = np.unique(i)
        none, part = pa.nulls(len(sets), pa.int64()), pa.array([table.column("fragment")[0].as_py()] * (len(i) + len(sets)), pa.int64())
        both = lambda a, b: pa.chunked_array([a, b])
        cols = {"key": both(pa.array(key.astype(np.int64)), none), "node": both(pa.array(node[i]), pa.array(node[sets])), "n": both(pa.array(n[i]), pa.array(n[sets])), "hub": both(hubs, none)}
        return pa.table({"part": part, **cols, "sketch": both(pa.nulls(len(i), pa.binary()), pa.array([x.tobytes() for x in sketches[sets]], pa.binary()))})

    posted = packs.select("pack", "blob").mapInArrow(post, "fragment long, blob binary")
    both = written(posted.groupBy("fragment").applyInArrow(lists, "part long, key long, node long, n long, hub long, sketch binary"), "lists")
    listed, about = both.filter("sketch IS NULL").drop("sketch"), both.filter("sketch IS NOT NULL").select("part", "node", "n", "sketch")

    def more_hubs(table: pa.Table, described: pa.Table) -> pa.Table:
        at = Crossing(table, described, percent)
        i, hub = at.hubs(percent)
        pair, c = np.unique(i * max(len(at.node), 1) + hub, return_counts=True)
        i, hub = pair // max(len(at.node), 1), pair % max(len(at.node), 1)
        return pa.table({"node": pa.array(at.node[i], pa.int64()), "hub": pa.array(at.node[hub], pa.int64()), "c": pa.array(c, pa.int64())})

    def pairs(table: pa.Table, described: pa.Table) -> pa.Table:
        at = Crossing(table, described, percent)
        node, size = at.node, at.n
        x, y, c = at.pairs(percent)
        # What a pair can share in other fragments is bounded by what the prefix of either has there.
        rest = np.maximum(*(size[k] - prefix_size(size[k], percent) for k in (x, y)))
        keep = (c + np.minimum(at.elsewhere[x], at.elsewhere[y]) + rest) * (100 + percent) >= percent * (size[x] + size[y])
        x, y, c = x[keep], y[keep], c[keep]
        x, y = np.where(node[x] < node[y], y, x), np.where(node[x] < node[y], x, y)
        released()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("a", "b", "a_n", "b_n", "c"), (node[x], node[y], size[x], size[y], c))})

    near, labelled = None, listed.select("part", "key", "node", F.col("node").alias("label"))
    if not every:
        near = _nearest_hubs(packs, listed.filter("hub IS NOT NULL").select("node", "hub", F.lit(1).alias("c")), n, percent)
        labelled = _labelled(listed, near)
    crossing = _crossing(written(labelled, "labelled"))
    for _ in range(0 if every else ROUNDS):
        found = crossing.groupBy("part").cogroup(about.groupBy("part")).applyInArrow(more_hubs, "node long, hub long, c long")
        more = _nearest_hubs(packs, found, n, percent)
        if more.isEmpty():
            break
        near = near.union(more)
        crossing = _crossing(written(_labelled(listed, near), "labelled"))
    partial = crossing.groupBy("part").cogroup(about.groupBy("part")).applyInArrow(pairs, "a long, b long, a_n long, b_n long, c long")
    summed = partial.groupBy("a", "b", "a_n", "b_n").agg(F.sum("c").alias("c"))
    # Shared n-grams beyond the prefixes lie in the rest of the set whose prefix ends first.
    rest = F.greatest(*[F.expr(f"{s} - ({s} - ({percent} * {s} + 99) div 100 + 1)") for s in ("a_n", "b_n")])
    possible = summed.filter((F.col("c") + rest) * (100 + percent) >= percent * (F.col("a_n") + F.col("b_n"))).select("a", "b")
    far = _verified(packs, written(possible, "possible"), n, percent)
    links = written(far if every else near.union(far), "all")
    joined = components(links)

    classes = rows.filter("n > 0").groupBy("sig", "n").agg(F.min("node").alias("lead"), F.min("doc_id").alias("least"), F.count("*").alias("m"))
    named = classes.join(joined.toDF("lead", "label"), "lead", "left").withColumn("label", F.coalesce("label", "lead"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    final = named.join(smallest, "label").select("sig", "n", "component_id", "label")
    counted = []
    if every:
        # Links of copies, and of each pair of linked sets as many as they have pairs of rows.
        ends = named.select("lead", "label", "m")
        across = links.join(ends.toDF("a", "label", "a_m"), "a").join(ends.select("lead", "m").toDF("b", "b_m"), "b")
        parts = across.select("label", (F.col("a_m") * F.col("b_m")).alias("n_links")).union(named.select("label", F.expr("m * (m - 1) div 2")))
        final = final.join(parts.groupBy("label").agg(F.sum("n_links").alias("n_links")), "label")
        counted = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    out = rows.join(final, ["sig", "n"], "left").select(
        "node",
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.expr(f"nullif(coalesce(component_id, doc_id), {NO_ID}L)").alias("component_id"),
        F.coalesce("label", "node").alias("component"),
        *counted,
    )
    return packs, out


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(documents(spark, sf_dir))[1].drop("node", "component")


def op8_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op8_ngram_join, with the number of links in each component."""
    return link_documents(documents(spark, sf_dir), every=True)[1].drop("node", "component")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(list_slice(words, i, i + 3), ' '))) END AS grams FROM w),
c AS (SELECT list_sort(grams) AS grams, min(doc_id) AS lead, list(doc_id) AS ids FROM s WHERE len(grams) > 0 GROUP BY 1),
g AS (SELECT lead, len(grams) AS n, unnest(grams) AS gram FROM c),
rare AS (SELECT gram FROM g GROUP BY gram HAVING count(*) BETWEEN 2 AND 1000000),
p AS (
  SELECT a.lead AS a, b.lead AS b, a.n AS an, b.n AS bn, count(*) AS k
  FROM g a JOIN rare USING (gram) JOIN g b ON a.gram = b.gram AND a.lead < b.lead AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2, 3, 4),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (an + bn - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, seen) AS (SELECT lead, lead FROM c UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
of AS (SELECT unnest(ids) AS doc_id, lead FROM c)
SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN of USING (doc_id) LEFT JOIN m ON m.node = of.lead
"""

QUERIES = {"op8_ngram_join": op8_ngram_join, "op8_ngram_links": op8_ngram_links}
SQL = {"op8_ngram_join": OP8_SQL}
