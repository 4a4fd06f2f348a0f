"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

The embedding walks over a string by random steps that depend on the symbol read, so that strings at a small edit distance
give outputs at a small Hamming distance; sampled positions of the output are the keys of a hash table of items. Symbols are
words. A window enters the hash tables only if it holds as many word pairs of the items as any passage within the allowed
distance must hold; this bound is exact and loses nothing. What shares a key is aligned exactly.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import repeat
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import documents, small_batches

#: Allowed word edits for each item word; items of fewer words than LEAST match as whole sequences, without edits.
TOLERANCE, LEAST = 0.2, 5
WALKS, SAMPLED, RECALL = 4, 3, 0.99
BLOCK_BYTES = 1 << 19
#: These don't count at either side of a word, in items and in texts; words of these alone are none.
EDGES = ".,;:!?"
#: Scripts without spaces: short items with one of these match by characters.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_NO_EDGES = str.maketrans("", "", EDGES)


def words_of(text: str) -> tuple[list[str], np.ndarray | None]:
    """The words without EDGES, and their places among the runs between spaces if these hold more."""
    words = [w.strip(EDGES) for w in text.lower().split()]
    if all(words):
        return words, None
    return [w for w in words if w], np.flatnonzero([bool(w) for w in words])


def characters_of(text: str) -> tuple[str, np.ndarray]:
    """All characters but EDGES and spaces, and where each run between spaces ends among them."""
    runs = [w.translate(_NO_EDGES) for w in text.lower().split()]
    return "".join(runs), np.cumsum([len(w) for w in runs])


class Block:
    """The hash tables of a bounded block of items."""

    def __init__(self, items: list[tuple[int, str]], tolerance: float = TOLERANCE):
        self.vocab: dict[str, int] = {}
        self.items, short = [], []
        for item, text in sorted(items):
            words = words_of(text or "")[0]
            if 0 < len(words) < LEAST:
                short.append((item, text, words))
            elif words:
                self.items.append((item, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]), int(tolerance * len(words))))
        self.unspaced: dict[str, list[tuple[int, str]]] = defaultdict(list)
        spaced = []
        for item, text, words in short:
            if UNSPACED.search(text):
                chars = characters_of(text)[0]
                self.unspaced[chars[:2]].append((item, chars))
            else:
                spaced.append((item, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]))
        self.size = len(self.vocab) + 1
        self.levels, self.ends = self.trie(spaced)
        pairs = [s[:-1] * self.size + s[1:] for _, s, _ in self.items]
        owned = np.unique(np.array([(c, k) for k, p in enumerate(pairs) for c in p.tolist()], np.int64).reshape(-1, 2), axis=0)
        self.pairs, first = np.unique(owned[:, 0], return_index=True)
        self.owned, self.owner = np.append(first, len(owned)), owned[:, 1]
        # An edit costs a passage two of its pairs at most, also where it pushes one out of the window. A pair that an
        # item repeats is counted once for each place of it in the window, so no more than the text has is asked for.
        self.need = np.array([len(s) - 1 - 2 * edits for _, s, edits in self.items], np.int64)
        self.lengths: dict[int, list[int]] = defaultdict(list)
        for k, (_, s, _) in enumerate(self.items):
            self.lengths[len(s)].append(k)
        # steps[j >> 6] holds 64 steps, from j on, of each walk and symbol as bits; walks over shorter items take the first
        # of the same steps. The symbol behind a window has none.
        rng = np.random.default_rng(5)
        turns = -(-3 * max(self.lengths, default=0) // 64)
        self.steps = rng.integers(0, 1 << 64, (turns, WALKS, self.size + 1), np.uint64)
        self.steps[:, :, self.size] = 0
        self.steps = self.steps.reshape(turns, WALKS * (self.size + 1))
        self.tables = {}
        for n, ks in self.lengths.items():
            edits = int(tolerance * n)
            # The Hamming distance of the outputs is taken as six times the edit distance.
            same = max(0.1, 1 - 6 * edits / (3 * n)) ** SAMPLED
            turns = ceil(log(1 - RECALL) / log(1 - same)) if same < 1 else 1
            draws = [(t % WALKS, np.sort(rng.choice(3 * n, min(SAMPLED, 3 * n), replace=False))) for t in range(turns)]
            symbols = np.array([self.items[k][1] for k in ks])
            outs = self.embed(symbols)
            tables = []
            for w, at in draws:
                table = defaultdict(list)
                for k, key in zip(ks, self.keys(outs[:, w], at)):
                    table[key].append(k)
                tables.append((w, at, dict(table)))
            self.tables[n] = tables

    def trie(self, short: list[tuple[int, list[int]]]) -> tuple[list, dict[int, list[int]]]:
        """Of each level the sorted codes state * size + symbol and the states they lead to; the items that end in a state."""
        steps: list[dict[int, int]] = [{} for _ in range(max((len(s) for _, s in short), default=0))]
        ends, states = defaultdict(list), 0
        for item, symbols in short:
            state = 0
            for level, x in zip(steps, symbols):
                code = state * self.size + x
                if code not in level:
                    states += 1
                    level[code] = states
                state = level[code]
            ends[state].append(item)
        return [(np.array(sorted(level)), np.array([level[c] for c in sorted(level)])) for level in steps], dict(ends)

    def embed(self, windows: np.ndarray) -> np.ndarray:
        """CGK: output j is the symbol at the walk's place, which then moves on or stays by a random bit of (j, symbol).

        All walks go together; the result is by output, walk and window. The symbol behind a window has no step, so that a
        walk ends there."""
        rows, n = windows.shape
        flat = np.concatenate([windows, np.full((rows, 1), self.size)], 1).ravel()
        at, out = np.tile(np.arange(0, rows * (n + 1), n + 1), (WALKS, 1)), np.empty((3 * n, WALKS, rows), np.int64)
        own = np.arange(WALKS)[:, None] * (self.size + 1)
        for j in range(3 * n):
            flat.take(at, out=out[j], mode="clip")
            at += ((self.steps[j >> 6].take(out[j] + own) >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)
        return out

    def keys(self, out: np.ndarray, at: np.ndarray) -> list[int]:
        key = np.zeros(out.shape[1], np.int64)
        for j in at:
            key = key * (self.size + 1) + out[j]
        return key.tolist()

    def symbols(self, words: list[str]) -> np.ndarray:
        """Each word's number, 0 for words that no item has."""
        return np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, first word, words, distance) of the best place of each item within its distance in a whole text; words
        are counted between spaces."""
        words, place = words_of(text)
        x = self.symbols(words)
        found = self.find_long(x) + self.find_short(x)
        if place is not None:
            found = [(item, int(place[a]), int(place[a + n - 1] - place[a]) + 1, d) for item, a, n, d in found]
        return found + self.find_unspaced(text)

    def find_short(self, x: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The first place of each short item."""
        found, at, state = [], np.arange(len(x)), np.zeros(len(x), np.int64)
        for k, (codes, to) in enumerate(self.levels):
            inside = at + k < len(x)
            at, state = at[inside], state[inside]
            code = state * self.size + x[at + k]
            near = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[near] == code
            at, state = at[hit], to[near[hit]]
            some, first = np.unique(state, return_index=True)
            found += [(item, a, k + 1, 0) for s, a in zip(some.tolist(), at[first].tolist()) for item in self.ends.get(s, ())]
        return found

    def find_unspaced(self, text: str) -> list[tuple[int, int, int, int]]:
        """The first place of each short item of a script without spaces, by characters. Where an item starts or ends with
        a letter or digit of another script, no such one of the same word may precede or follow."""
        if not self.unspaced or not UNSPACED.search(text):
            return []
        chars, ends = characters_of(text)
        borders, found = {0, *ends.tolist()}, []

        def inside(k: int) -> bool:
            return k not in borders and all(c.isalnum() and not UNSPACED.match(c) for c in chars[k - 1 : k + 1])

        for head in self.unspaced.keys() & ({chars[k : k + 2] for k in range(len(chars))} | set(chars)):
            for item, needle in self.unspaced[head]:
                a = chars.find(needle)
                while a >= 0 and (inside(a) or inside(a + len(needle))):
                    a = chars.find(needle, a + 1)
                if a >= 0:
                    first, last = (int(np.searchsorted(ends, k, "right")) for k in (a, a + len(needle) - 1))
                    found.append((item, first, last - first + 1, 0))
        return found

    def find_long(self, x: np.ndarray) -> list[tuple[int, int, int, int]]:
        if not self.items or len(x) < 2:
            return []
        code = x[:-1] * self.size + x[1:]
        code[(x[:-1] == 0) | (x[1:] == 0)] = -1
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        where = np.flatnonzero(self.pairs[at] == code)
        pair, owners = at[where], self.owned[at[where] + 1] - self.owned[at[where]]
        item = self.owner[np.repeat(self.owned[pair] - np.cumsum(owners) + owners, owners) + np.arange(owners.sum())]
        where = np.repeat(where, owners)
        likely = np.flatnonzero(np.bincount(item, minlength=len(self.items)) >= self.need)
        wanted: dict[int, set[int]] = defaultdict(set)
        for k in likely.tolist():
            n, need, p = len(self.items[k][1]), self.need[k], where[item == k]
            for first, last in zip(p.tolist(), p[need - 1 :].tolist()):
                if last - first <= n - 2:
                    wanted[n].update(range(max(0, last - n + 2), first + 1))
        places: dict[int, list[int]] = defaultdict(list)
        for n, all_starts in wanted.items():
            tables = self.tables[n]
            starts = np.array(sorted(all_starts))
            full = np.concatenate([x, np.zeros(n, np.int64)])
            for lo in range(0, len(starts), 4096):
                some = starts[lo : lo + 4096]
                windows = full[some[:, None] + np.arange(n)]
                outs = self.embed(windows)
                for w, drawn, table in tables:
                    for s, key in zip(some.tolist(), self.keys(outs[:, w], drawn)):
                        for k in table.get(key, ()):
                            places[k].append(s)
        found = []
        for k, starts in sorted(places.items()):
            item, s, edits = self.items[k]
            best, done = None, -1
            starts = sorted(set(starts))
            if (same := [a for a in starts if x[a] == s[0] and np.array_equal(x[a : a + len(s)], s)]):
                starts, best = [], (item, same[0], len(s), 0)
            for start in starts:
                if start < done:
                    continue
                low = max(0, start - edits)
                done = start + len(s)
                part = x[low : done + len(s) + edits]
                # Each edit costs the item one of its words at most.
                if sum((Counter(s.tolist()) & Counter(part.tolist())).values()) < len(s) - edits:
                    continue
                got = align(s, part)
                if got[0] <= edits and (best is None or got[0] < best[3]):
                    best = item, low + got[1], got[2] - got[1], got[0]
            if best:
                found.append(best)
        return found


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """The least edit distance between `item` and a part of `words`, and where that part starts and ends (Sellers)."""
    item, words = item.tolist(), words.tolist()
    row = [(0, j) for j in range(len(words) + 1)]
    for i, a in enumerate(item, 1):
        new = [(i, row[0][1])]
        for j, b in enumerate(words, 1):
            new.append(min((row[j - 1][0] + (a != b), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1])))
        row = new
    end = min(range(len(row)), key=lambda j: (row[j][0], j))
    return row[end][0], row[end][1], end


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items in blocks of about `block_bytes`, one at a time on the driver; null texts are no items."""
    small_batches(benchmark.sparkSession)
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        yield Block([(r.item_id, r.text) for r in rows])


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row (doc_id, item_id, start, n_words, distance) for each document and item it holds, at the best place.

    An item of n words matches a part of a text at a word edit distance of int(TOLERANCE * n) at most, one of fewer than
    LEAST words as a whole sequence; case and marks of EDGES around a word don't count. Null and empty texts and items match nothing, repeated rows match each, and empty
    tables give an empty result. A benchmark beyond one block is searched block by block, each against all documents.
    """
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    out = None
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                found = [(k, *f) for k, t in enumerate(batch.column(1)) for f in shared.value.find(t.as_py() or "")]
                if found:
                    at, *cols = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c) for c in cols)], ["doc_id", "item_id", "start", "n_words", "distance"])

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, start long, n_words long, distance long")
        out = part if out is None else out.unionByName(part)
    return out


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no passage of `benchmark`."""
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared, at=docs.columns.index("text")):
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.find(t.as_py() or "") for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op3_decontamination": op3_decontamination}
SQL: dict[str, str] = {}
