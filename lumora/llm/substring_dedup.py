"""Repeated passages by seed and extend: winnowed anchors join documents, shared anchors are extended to windows both ways.

Every window of 13 words holds the least of its 5-word hashes as an anchor, so equal windows have equal anchors. Anchors that
two documents share are the seeds. Around a seed the windows that chose it reach up to 8 words to either side; those that
also start in a document with a smaller id are joined to maximal repeats, and their words are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import documents
from lumora.llm.flat import SPACES
from lumora.llm.packs import BASE1, BASE2, BYTES1, MIX1, MIX2, NO_ID, Pack, bucketed, buckets_for, exchange, mixed, packed, powers, pressed, released, sliding, unpressed, window_hashes, with_answers

WINDOW, ANCHOR = 13, 5
REACH = WINDOW - ANCHOR + 1


class Words:
    """A pack's words as 64-bit hashes, and its windows: `valid` where a window lies in one document."""

    def __init__(self, pack: Pack):
        data = np.frombuffer(pack.data, np.uint8)
        gap = SPACES[data]
        self.start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        self.end = np.flatnonzero(gap & ~np.concatenate([[True], gap[:-1]]))
        up, down = powers(BASE1, len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES1[data] * up[: len(data)])])
        self.hash = mixed((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, pack.starts)
        self.doc = np.repeat(np.arange(len(pack.ids)), np.diff(self.first))
        n = max(0, len(self.hash) - WINDOW + 1)
        self.valid = self.doc[:n] == self.doc[WINDOW - 1 :] if n else np.zeros(0, bool)

    def anchors(self) -> np.ndarray:
        """For each window its anchor's hash."""
        return mixed(sliding(mixed(window_hashes(self.hash, ANCHOR, BASE2), MIX2), REACH, np.minimum))[: len(self.valid)]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window a 64-bit and a 32-bit hash of its words."""
        one = mixed(window_hashes(self.hash, WINDOW, BASE2))
        two = mixed(window_hashes(mixed(self.hash, MIX2), WINDOW, BASE1), MIX1)
        return one, (two >> np.uint64(32)).astype(np.uint32)


def _shared(packs: list[int], blobs: list[bytes]) -> dict[int, bytes]:
    """Anchors (63 bits, the lowest tells that the pack has it in two documents) that lie in two documents."""
    lists = [unpressed(b, "<u8")[0] for b in blobs]
    both = np.concatenate(lists)
    owner = np.repeat(np.arange(len(packs)), [len(x) for x in lists])
    key = both >> np.uint64(1)
    order = np.argsort(key, kind="stable")
    key, owner, twice = key[order], owner[order], (both[order] & np.uint64(1)).astype(bool)
    same = key[1:] == key[:-1]
    keep = np.flatnonzero(twice | np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    # Sorted once by pack, not searched once for each: a bucket hears from all packs.
    keep = keep[np.argsort(owner[keep], kind="stable")]
    cuts = np.searchsorted(owner[keep], np.arange(len(packs) + 1))
    return {p: pressed(key[keep[a:b]]) for p, a, b in zip(packs, cuts, cuts[1:]) if a < b}


def _least(packs: list[int], blobs: list[bytes]) -> dict[int, bytes]:
    """For the windows that a pack has, the smallest id of a document that has them, where that is in another pack."""
    parts = [unpressed(b, "<u8", "<u4", "<i8") for b in blobs]
    one, two, doc = (np.concatenate(x) for x in zip(*parts))
    owner = np.repeat(np.arange(len(packs)), [len(p[0]) for p in parts])
    order = np.lexsort((doc, two, one))
    one, two, doc, owner = one[order], two[order], doc[order], owner[order]
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = {}
    late = np.flatnonzero(least < doc)
    late = late[np.argsort(owner[late], kind="stable")]
    cuts = np.searchsorted(owner[late], np.arange(len(packs) + 1))
    for k, p in enumerate(packs):
        if cuts[k] < cuts[k + 1]:
            at = late[cuts[k] : cuts[k + 1]]
            out[p] = pressed(one[at], two[at], least[at])
    return out


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _gathered(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    """All answers to a pack, in order of the first array: buckets are ranges of it."""
    parts = [unpressed(b, *kinds) for b in blobs]
    parts.sort(key=lambda p: p[0][0])
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, k) for k in kinds]


def repeated_windows(pack: Pack, words: Words, blobs: list[bytes]) -> np.ndarray:
    """Marks the windows that also start in a document with a smaller id, in this pack or by the answers from others."""
    one, two = words.windows()
    at = np.flatnonzero(words.valid)
    order = at[np.lexsort((two[at], one[at]))]
    late = np.zeros(len(words.valid), bool)
    if len(order):
        ids = pack.ids[words.doc[order]]
        new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
        least = np.minimum.reduceat(ids, np.flatnonzero(new))[np.cumsum(new) - 1]
        late[order] = least < ids
    far, far_two, least = _gathered(blobs, "<u8", "<u4", "<i8")
    if len(far):
        k = np.minimum(np.searchsorted(far, one), len(far) - 1)
        # Equal 64-bit halves follow each other; step over those whose other half differs.
        k = np.where((far[k] == one) & (far_two[k] != two) & (k + 1 < len(far)), np.minimum(k + 1, len(far) - 1), k)
        late |= words.valid & (far[k] == one) & (far_two[k] == two) & (least[k] < pack.ids[words.doc[: len(late)]])
    return late


def remove_repeats(docs: DataFrame, more: str | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by spaces, kept_text, more.

    kept_text is the text itself where nothing is removed, else its kept runs of words joined by spaces. Null texts count as
    empty, and texts of fewer than 13 words keep all. Rows of equal doc_id don't remove anything from each other; a null
    doc_id counts as greater than all others. An empty table gives an empty result. Windows are compared by 96 bits.
    """
    packs = packed(docs, more)
    n = buckets_for(packs)

    def seeds(batches):
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pack = Pack.open(blob)
                words = Words(pack)
                at = np.flatnonzero(words.valid)
                key = words.anchors()[at] >> np.uint64(1)
                order = np.lexsort((words.doc[at], key))
                key, doc = key[order], words.doc[at][order]
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
                last = np.append(new[1:], len(key)) - 1
                keys = key[new] * np.uint64(2) + (doc[new] != doc[last]).astype(np.uint64)
                found = [(b, p, pressed(x)) for b, (x,) in bucketed(keys, n)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["bucket", "pack", "blob"])
        released()

    asked = "bucket long, pack long, blob binary"
    shared = exchange(packs.select("pack", "blob").mapInArrow(seeds, asked), _shared)

    def extend(p: int, pack: Pack, blobs: list[bytes]) -> pa.Table:
        words = Words(pack)
        (seen,) = _gathered(blobs, "<u8")
        at = np.flatnonzero(words.valid & _member(words.anchors() >> np.uint64(1), seen))
        one, two = (x[at] for x in words.windows())
        ids = pack.ids[words.doc[at]]
        order = np.lexsort((ids, two, one))
        one, two, ids = one[order], two[order], ids[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, bool)
        found = [(b, p, pressed(*x)) for b, x in bucketed(one[new], n, two[new], ids[new])]
        cols = list(zip(*found)) or [(), (), ()]
        return pa.table({"bucket": pa.array(cols[0], pa.int64()), "pack": pa.array(cols[1], pa.int64()), "blob": pa.array(cols[2], pa.binary())})

    least = exchange(with_answers(packs, shared, extend, asked), _least)

    def remove(p: int, pack: Pack, blobs: list[bytes]) -> pa.Table:
        words = Words(pack)
        edge = np.zeros(len(words.hash) + 1, np.int64)
        at = np.flatnonzero(repeated_windows(pack, words, blobs))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        gone = np.cumsum(edge)[:-1] > 0
        rows = []
        for k, (a, b) in enumerate(zip(words.first, words.first[1:])):
            kept, text = np.flatnonzero(~gone[a:b]) + a, pack.text(k)
            if len(kept) < b - a:
                runs = np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1) if len(kept) else []
                text = b" ".join(pack.data[words.start[r[0]] : words.end[r[-1]]] for r in runs)
            rows.append((b - a, b - a - len(kept), hashlib.sha256(b" ".join(text.split())).hexdigest(), text.decode()))
        cols = list(zip(*rows))
        ids = pa.array(pack.ids, pa.int64(), mask=pack.ids == NO_ID)
        return pa.table({"doc_id": ids, "n_words": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "kept_sha256": pa.array(cols[2]), "kept_text": pa.array(cols[3]), "more": pa.array([m.decode() for m in pack.more])})

    return with_answers(packs, least, remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, more string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS x
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
late AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY x) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM late),
one AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM one ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op7_substring_dedup": op7_substring_dedup}
SQL = {"op7_substring_dedup": OP7_SQL}
