"""Repeated byte strings by suffix arrays built with linear grouping.

Every 50-byte string chooses the least hash of its 20-byte parts as its anchor, so equal strings have equal anchors. A run of
strings with one anchor is a segment. Segments of anchors that two documents share meet in one bucket, where the suffix array
of an anchor's distinct segments puts equal strings next to each other. A segment that many documents share counts once.
Anchors are many and their segments short, so the suffix arrays of all anchors are built side by side, one group of each at
a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from lumora.llm.common import documents
from lumora.llm.packs import BASE1, BASE2, BYTES1, MIX2, NO_ID, Pack, bucketed, buckets_for, exchange, mixed, packed, powers, pressed, released, sliding, unpressed, window_hashes, with_answers
from lumora.llm.substring_dedup import _gathered, _member, _shared

LENGTH, PART = 50, 20
#: Bytes of the longer anchors that divide the strings of one anchor.
PARTS = (35, 42, 46, 48)
#: Bytes of segments that are looked at together; strings of more symbols than LONG are sorted one by one.
AT_ONCE, LONG = 1 << 20, 250


def grouped_suffixes(s: list[int]) -> list[int]:
    """The suffix array of `s`, whose last symbol is its least and unique.

    First, groups of suffixes with equal first symbols are processed in descending order. Each suffix of a group finds the
    nearest one before it of a smaller group; those found split off their groups, the more often found the higher. In the
    end a group's suffixes share their longest Lyndon prefix. Second, the suffixes found from already placed ones, one place
    to the left and on along the pointers, are placed at the front of their groups: no renaming, no recursion.
    """
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, start = [0] * n, [0] * n
    at = 0
    for k, i in enumerate(order):
        if k and s[i] != s[order[k - 1]]:
            at = k
        place[i], start[i] = k, at
    size = {}
    for i in start:
        size[i] = size.get(i, 0) + 1
    prev = [-1] * n
    end = n
    while end:
        low = start[order[end - 1]]
        found: dict[int, int] = {}
        for i in sorted(order[low:end]):
            p = i - 1
            while p >= 0 and start[p] >= low:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        if found:
            times: dict[int, list[int]] = {}
            for p, c in found.items():
                times.setdefault(c, []).append(p)
            for c in sorted(times, reverse=True):
                moved: dict[int, list[int]] = {}
                for p in times[c]:
                    moved.setdefault(start[p], []).append(p)
                for old, ps in moved.items():
                    new = old + size[old] - len(ps)
                    for k, p in enumerate(ps):
                        # Exchange p with what stands at the place it moves to.
                        to = old + size[old] - 1 - k
                        other, here = order[to], place[p]
                        order[to], order[here] = p, other
                        place[p], place[other] = to, here
                    for p in ps:
                        start[p] = new
                    size[new] = len(ps)
                    if new != old:
                        size[old] -= len(ps)
        end = low
    out, front, done = [0] * n, {}, [False] * n
    out[0], done[n - 1] = n - 1, True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = start[j]
            to = front.get(g, g)
            out[to], front[g], done[j] = j, to + 1, True
            j = prev[j]
    return out


def grouped_suffixes_of(s: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """As `grouped_suffixes` for the strings between `cuts`, side by side: the places in `s` of all suffixes, string by string.

    Each step takes the highest group left of every string, so there are as many steps as the string of most groups has.
    """
    n, m, base = len(s), len(cuts) - 1, cuts[:-1]
    string = np.repeat(np.arange(m), np.diff(cuts))
    order = np.lexsort((s, string))
    place, start = np.empty(n, np.int64), np.empty(n, np.int64)
    place[order] = np.arange(n)
    new = np.concatenate([[True], (s[order][1:] != s[order][:-1]) | (string[order][1:] != string[order][:-1])])
    first = np.flatnonzero(new)
    start[order] = first[np.cumsum(new) - 1]
    size = np.zeros(n, np.int64)
    size[first] = np.diff(np.append(first, n))
    prev, moving, end, live = np.full(n, -1), np.zeros(n, bool), cuts[1:].copy(), np.arange(m)
    while len(live):
        top, begin = end[live], base[live]
        low = start[order[top - 1]]
        count = top - low
        own = np.repeat(np.arange(len(live)), count)
        i = order[low[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)]
        lowest, begin = low[own], begin[own]
        p = i - 1
        walk = np.flatnonzero((p >= begin) & (start[p] >= lowest))
        while len(walk):
            q = p[walk]
            # Pointers of this very group are not set yet: go on one place to the left.
            q = np.where(start[q] == lowest[walk], q - 1, prev[q])
            p[walk] = q
            walk = walk[(q >= begin[walk]) & (start[q] >= lowest[walk])]
        p[p < begin] = -1
        prev[i] = p
        found = np.sort(p[p >= 0])
        if len(found):
            new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            q, times = found[new], np.diff(np.append(new, len(found)))
            by = np.lexsort((times, start[q]))
            q, times, old = q[by], times[by], start[q[by]]
            heads = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
            moved = np.diff(np.append(heads, len(q)))
            of, groups = np.repeat(np.arange(len(heads)), moved), old[heads]
            tail = groups + size[groups] - moved
            to = tail[of] + np.arange(len(q)) - heads[of]
            split = np.concatenate([[True], (old[1:] != old[:-1]) | (times[1:] != times[:-1])])
            parts = np.flatnonzero(split)
            # Those that stand where others move to take the places that these leave.
            here, stood = place[q], order[to]
            moving[q] = True
            stay, left = stood[~moving[stood]], here[here < tail[of]]
            moving[q] = False
            order[left], place[stay] = stay, left
            order[to], place[q] = q, to
            size[groups] -= moved
            start[q] = to[parts][np.cumsum(split) - 1]
            size[to[parts]] = np.diff(np.append(parts, len(q)))
        end[live] = low
        live = live[low > base[live]]
    out, front, done, last = np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool), cuts[1:] - 1
    out[base], done[last] = last, True
    size, live = np.diff(cuts), np.arange(m)
    for k in range(int(size.max(initial=0))):
        live = live[size[live] > k]
        j = out[base[live] + k] - 1
        j = j[j >= base[live]]
        j = j[~done[j]]
        while len(j):
            to = front[start[j]]
            out[to], done[j] = j, True
            front[start[j]] = to + 1
            j = prev[j]
            j = j[j >= 0]
            j = j[~done[j]]
    return out


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 0 .. 1 1 .. by `counts`, and the number of each entry among its equals."""
    own = np.repeat(np.arange(len(counts)), counts)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)


def least_by_window(data: np.ndarray, offset: np.ndarray, size: np.ndarray, anchor: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For the `length`-byte strings of each segment, one segment behind the other, the least document that has the string in
    a segment of the same anchor. Segments are distinct and in the order of their anchors."""
    windows = size - length + 1
    out = np.repeat(doc, windows)
    first = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    group = np.cumsum(first) - 1
    some = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(some):
        return out
    # The string of an anchor: its segments, each closed by 1, and a 0. The bytes are 2 and more.
    first, group = first[some], np.cumsum(first[some]) - 1
    begin = np.cumsum(size[some] + 1) - size[some] - 1 + group
    own, k = spread(size[some])
    s = np.zeros(int(begin[-1] + size[some][-1] + 2), np.int32)
    s[begin[own] + k] = data[offset[some][own] + k] + np.int32(2)
    s[begin + size[some]] = 1
    cuts = np.append(begin[first], len(s))
    owner = np.repeat(np.arange(len(some)), np.diff(np.append(begin, len(s))))
    fits = np.arange(len(s)) - begin[owner] < windows[some][owner]
    long = np.diff(cuts) > LONG
    if long.any():
        parts = [np.array(grouped_suffixes(s[a:b].tolist())) + a if x else None for a, b, x in zip(cuts, cuts[1:], long)]
        short = np.flatnonzero(~long)
        if len(short):
            own, k = spread(np.diff(cuts)[short])
            at = cuts[short][own] + k
            sorted_at = at[grouped_suffixes_of(s[at], np.concatenate([[0], np.cumsum(np.diff(cuts)[short])]))]
            ends = np.cumsum(np.diff(cuts)[short])
            for g, a, b in zip(short, np.concatenate([[0], ends]), ends):
                parts[g] = sorted_at[a:b]
        order = np.concatenate(parts)
    else:
        order = grouped_suffixes_of(s, cuts)
    order = order[fits[order]]
    raw = offset[some][owner[order]] + order - begin[owner[order]]
    text = np.lib.stride_tricks.sliding_window_view(data, length)[raw]
    new = np.concatenate([[True], (text[1:] != text[:-1]).any(1) | (group[owner[order]][1:] != group[owner[order]][:-1])])
    least = np.minimum.reduceat(doc[some][owner[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    where = np.cumsum(windows) - windows
    out[where[some][owner[order]] + order - begin[owner[order]]] = least
    return out


def divided(data: np.ndarray, offset: np.ndarray, size: np.ndarray, anchor: np.ndarray, doc: np.ndarray, length: int, part: int):
    """Divides the strings of each anchor that has several segments by a longer one, the least hash of their parts of `part`
    bytes; equal strings agree in it. Gives the distinct shorter segments (data, first byte, bytes, anchor, least document)
    in the order of their anchors, and the function that turns least documents of their strings into those of the strings
    given."""
    windows = size - length + 1
    out = np.repeat(doc, windows)
    group = np.cumsum(np.concatenate([[True], anchor[1:] != anchor[:-1]])) - 1
    some = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(some):
        return data[:0], some, some, anchor[:0], doc[:0], lambda found: out
    own, k = spread(size[some])
    flat = data[offset[some][own] + k]
    least = sliding(mixed(window_hashes(BYTES1[flat], part, BASE2), MIX2), length - part + 1, np.minimum)
    at = np.flatnonzero(k < windows[some][own])
    own = own[at]
    key = mixed(least[at]) ^ mixed(anchor[some])[own]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])]))
    runs = np.diff(np.append(new, len(at)))
    begin, key, n = at[new], key[new], runs + length - 1
    low, high = _keys(flat, begin, n)
    by = np.lexsort((high, low, key))
    differs = np.concatenate([[True], (key[by][1:] != key[by][:-1]) | (low[by][1:] != low[by][:-1]) | (high[by][1:] != high[by][:-1])])
    one, ids = by[differs], np.minimum.reduceat(doc[some][own[new]][by], np.flatnonzero(differs))
    which = np.empty(len(by), np.int64)
    which[by] = np.cumsum(differs) - 1

    def back(found: np.ndarray) -> np.ndarray:
        where = np.cumsum(n[one] - length + 1) - n[one] + length - 1
        run, place = spread(runs)
        string, k = spread(windows[some])
        out[(np.cumsum(windows) - windows)[some][string] + k] = found[where[which][run] + place]
        return out

    return flat, begin[one], n[one], key[one], ids, back


def least_divided(data: np.ndarray, offset: np.ndarray, size: np.ndarray, anchor: np.ndarray, doc: np.ndarray, length: int = LENGTH, parts: tuple[int, ...] = PARTS) -> np.ndarray:
    """As `least_by_window`, with the strings of each anchor divided by longer anchors of `parts[0]` bytes, and by those of
    the next of `parts` where more than LONG symbols stay together. So suffix arrays are short, whatever the number of
    segments around a common anchor, and hold only segments that have much in common."""
    levels, leaves = [], []
    for part in parts:
        data, offset, size, anchor, doc, back = divided(data, offset, size, anchor, doc, length, part)
        group = np.cumsum(np.concatenate([[True], anchor[1:] != anchor[:-1]])[: len(anchor)]) - 1
        long = np.bincount(group, size + 1)[group] > LONG if part != parts[-1] else np.zeros(len(size), bool)
        own, k = spread(size[~long])
        leaves.append((data[offset[~long][own] + k], size[~long], anchor[~long], doc[~long]))
        levels.append((back, np.repeat(long, size - length + 1)))
        if not long.any():
            break
        offset, size, anchor, doc = offset[long], size[long], anchor[long], doc[long]
    text, n, key, ids = (np.concatenate(x) for x in zip(*leaves))
    found = least_by_window(text, np.cumsum(n) - n, n, key, ids, length) if len(n) else ids
    below, end = ids[:0], len(found)
    for back, inside in reversed(levels):
        every = np.empty(len(inside), doc.dtype)
        begin = end - int((~inside).sum())
        every[inside], every[~inside] = below, found[begin:end]
        below, end = back(every), begin
    return below


class Strings:
    """A pack's `length`-byte strings: `valid` where one lies in one text, and their anchors."""

    def __init__(self, pack: Pack, bits: int):
        data = np.frombuffer(pack.data, np.uint8)
        values = BYTES1[data]
        n = max(0, len(data) - LENGTH + 1)
        self.doc = np.repeat(np.arange(len(pack.ids)), np.diff(pack.starts))
        ends = pack.starts[1:][self.doc[:n]] - 1
        self.valid = np.arange(n) + LENGTH <= ends
        anchors = mixed(window_hashes(values, PART, BASE1), MIX2)
        least = sliding(anchors, LENGTH - PART + 1, np.minimum)[:n] if n else anchors[:0]
        # Low bits are left out as far as chance equality stays rare; anchors only choose what is compared.
        self.anchor = (mixed(least) >> np.uint64(64 - bits)) << np.uint64(64 - bits)

    def segments(self, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(anchor, text number, first byte, bytes) of the runs of strings of one text with one anchor, of all or of the
        wanted anchors."""
        at = np.flatnonzero(self.valid)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (self.anchor[at[1:]] != self.anchor[at[:-1]]) | (self.doc[at[1:]] != self.doc[at[:-1]])])) if len(at) else at
        first, last = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at
        if wanted is not None:
            some = _member(self.anchor[first] >> np.uint64(1), wanted)
            first, last = first[some], last[some]
        return self.anchor[first], self.doc[first], first, last - first + LENGTH


def _keys(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash for each segment."""
    out = []
    for base in (BASE1, BASE2):
        up, down = powers(base, len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES1[data] * up[: len(data)])])
        out.append(mixed((sums[first + size] - sums[first]) * down[first] + size.astype(np.uint64)))
    return out[0], out[1]


def _packed_segments(anchor: np.ndarray, least: np.ndarray, most: np.ndarray, size: np.ndarray, text: bytes) -> bytes:
    table = pressed(anchor, least, most, size.astype(np.uint32))
    return len(table).to_bytes(8, "little") + table + zstandard.ZstdCompressor(3).compress(text)


def _answers(packs: list[int], blobs: list[bytes]) -> dict[int, bytes]:
    tables, texts, at = [], [], 0
    for blob in blobs:
        cut = 8 + int.from_bytes(blob[:8], "little")
        anchor, least, most, size = unpressed(blob[8:cut], "<u8", "<i8", "<i8", "<u4")
        text = zstandard.ZstdDecompressor().decompress(blob[cut:])
        size = size.astype(np.int64)
        tables.append((anchor, least, most, size, at + np.cumsum(size) - size))
        texts.append(text)
        at += len(text)
    anchor, least, most, size, offset = (np.concatenate(x) for x in zip(*tables))
    data = np.frombuffer(b"".join(texts), np.uint8)
    del texts
    pack = np.repeat(np.array(packs), [len(t[0]) for t in tables])
    order = np.argsort(anchor, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
    # Whole anchors, about AT_ONCE bytes together.
    run = np.add.reduceat(size[order], heads).cumsum() // AT_ONCE
    cuts = np.append(heads[np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))], len(order))
    found: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for lo, hi in zip(cuts, cuts[1:]):
        rows = order[lo:hi]
        own, k = spread(size[rows])
        part = data[offset[rows][own] + k]
        n, begin = size[rows], np.cumsum(size[rows]) - size[rows]
        low, high = _keys(part, begin, n)
        by = np.lexsort((high, low, anchor[rows]))
        new = np.concatenate([[True], (anchor[rows][by][1:] != anchor[rows][by][:-1]) | (low[by][1:] != low[by][:-1]) | (high[by][1:] != high[by][:-1])])
        one = by[new]
        doc = np.minimum.reduceat(least[rows][by], np.flatnonzero(new))
        by_window = least_divided(part, begin[one], n[one], anchor[rows][one], doc)
        windows = n[one] - LENGTH + 1
        where = np.cumsum(windows) - windows
        smallest = np.minimum.reduceat(by_window, where)
        which = np.empty(len(rows), np.int64)
        which[by] = np.cumsum(new) - 1
        late = np.flatnonzero(smallest[which] < most[rows])
        late = late[np.argsort(pack[rows[late]], kind="stable")]
        own, k = spread(windows[which[late]])
        flat = by_window[where[which[late]][own] + k]
        ends = np.concatenate([[0], np.cumsum(windows[which[late]])])
        # One cut for each pack, as a bucket hears from all of them.
        of, keys = pack[rows[late]], anchor[rows[late]] >> np.uint64(1)
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
        for a, b in zip(starts, np.append(starts[1:], len(of))):
            mine = late[a:b]
            found.setdefault(int(of[a]), []).append((keys[a:b], low[mine], high[mine], windows[which[mine]], flat[ends[a] : ends[b]]))
    out = {}
    for p, parts in found.items():
        anchors, low, high, sizes, flat = (np.concatenate(x) for x in zip(*parts))
        table = pressed(anchors, low, high, sizes.astype(np.uint32))
        out[p] = len(table).to_bytes(8, "little") + table + pressed(np.concatenate([[0], flat]))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: what is left of the UTF-8 text).

    Removed are bytes covered by a 50-byte string that also starts in a document with a smaller doc_id. Null texts count as
    empty, and shorter texts keep all. Rows of equal doc_id remove nothing from each other; a null doc_id counts as greater
    than all others. An empty table gives an empty result.
    """
    packs = packed(docs)
    n = buckets_for(packs)
    total = packs.agg({"n_bytes": "sum"}).first()[0] or 1
    bits = min(63, int(total).bit_length() + 16)

    def seeds(batches):
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pack = Pack.open(blob)
                strings = Strings(pack, bits)
                at = np.flatnonzero(strings.valid)
                # One place of each run is enough.
                at = at[np.concatenate([[True], (np.diff(strings.anchor[at]) != 0) | (np.diff(strings.doc[at]) != 0)])] if len(at) else at
                key, doc = strings.anchor[at] >> np.uint64(1), strings.doc[at]
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
                keys = key[new] * np.uint64(2) + (doc[new] != doc[np.append(new[1:], len(key)) - 1]).astype(np.uint64)
                found = [(b, p, pressed(x)) for b, (x,) in bucketed(keys, n)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["bucket", "pack", "blob"])
        released()

    asked = "bucket long, pack long, blob binary"
    shared = exchange(packs.select("pack", "blob").mapInArrow(seeds, asked), _shared)

    def send(p: int, pack: Pack, blobs: list[bytes]) -> pa.Table:
        (wanted,) = _gathered(blobs, "<u8")
        data = np.frombuffer(pack.data, np.uint8)
        anchor, text, first, size = Strings(pack, bits).segments(wanted)
        found = []
        if len(anchor):
            low, high = _keys(data, first, size)
            order = np.lexsort((high, low, anchor))
            a, x, y = anchor[order], low[order], high[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            ids = pack.ids[text[order]]
            least, most, one = np.minimum.reduceat(ids, new), np.maximum.reduceat(ids, new), order[new]
            for b, (mine, at) in bucketed(a[new], n, np.arange(len(new))):
                own, k = spread(size[one[at]])
                found.append((b, p, _packed_segments(mine, least[at], most[at], size[one[at]], data[first[one[at]][own] + k].tobytes())))
        cols = list(zip(*found)) or [(), (), ()]
        return pa.table({"bucket": pa.array(cols[0], pa.int64()), "pack": pa.array(cols[1], pa.int64()), "blob": pa.array(cols[2], pa.binary())})

    least = exchange(with_answers(packs, shared, send, asked), _answers)

    def remove(p: int, pack: Pack, blobs: list[bytes]) -> pa.Table:
        edge, tables, flats = np.zeros(len(pack.data) + LENGTH + 1, np.int32), [], []
        for blob in blobs:
            cut = 8 + int.from_bytes(blob[:8], "little")
            tables.append(unpressed(blob[8:cut], "<u8", "<u8", "<u8", "<u4"))
            flats.append(unpressed(blob[cut:], "<i8")[0][1:])
        if tables:
            anchors, low, high, sizes = (np.concatenate(x) for x in zip(*tables))
            sizes, least = sizes.astype(np.int64), np.concatenate(flats)
            _, text, first, size = Strings(pack, bits).segments(np.unique(anchors))
            x, y = _keys(np.frombuffer(pack.data, np.uint8), first, size)
            order = np.lexsort((high, low))
            at = order[np.minimum(np.searchsorted(low[order], x), len(order) - 1)]
            known = np.flatnonzero((low[at] == x) & (high[at] == y))
            own, k = spread(sizes[at[known]])
            mins = least[(np.cumsum(sizes) - sizes)[at[known]][own] + k]
            late = (first[known][own] + k)[mins < pack.ids[text[known]][own]]
            edge += np.bincount(late, minlength=len(edge)).astype(np.int32) - np.bincount(late + LENGTH, minlength=len(edge)).astype(np.int32)
        gone = np.cumsum(edge)[: len(pack.data)] > 0
        data, rows = np.frombuffer(pack.data, np.uint8), []
        for a, b in zip(pack.starts, pack.starts[1:] - 1):
            cut = gone[a:b]
            kept = data[a:b][~cut].tobytes() if cut.any() else pack.data[a:b]
            spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
            rows.append((int(b - a), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows))
        ids = pa.array(pack.ids, pa.int64(), mask=pack.ids == NO_ID)
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()
        return pa.table({"doc_id": ids} | {k: pa.array(c, t) for k, c, t in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), cols, kinds)})

    return with_answers(packs, least, remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
SQL: dict[str, str] = {}
