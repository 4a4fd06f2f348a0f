"""Documents in compressed packs, and hash lists exchanged between packs and buckets.

A pack holds some megabytes of whole texts. Packs are written once; what they have in common is found by sending each
bucket of the hash range the distinct hashes of every pack, and the answer back to the packs it concerns. A hash that a
third of all documents hold reaches its bucket once for each pack, not once for each document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import small_batches, written

_LIBC = ctypes.CDLL(None)


def released() -> None:
    """Gives freed memory back to the system: worker processes stay, and several of them share one executor's memory."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


PACK_BYTES, BUCKET_BYTES = 1 << 20, 32 << 20
#: Stands for a null doc_id, which is thereby greater than all others.
NO_ID = (1 << 63) - 1
MIX1, MIX2, BASE1, BASE2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0x5851F42D4C957F2D, 0xDA942042E4DD58B5))
BYTES1 = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def mixed(h: np.ndarray, by: np.uint64 = MIX1) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * by
    return h ^ (h >> np.uint64(32))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base modulo 2 ** 64, and their inverses; kept up to what an ordinary pack needs."""
    held = _POWERS.get(int(base))
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 18)
        held = tuple(np.full(size, x, np.uint64) for x in (base, pow(int(base), -1, 1 << 64)))
        for x in held:
            x[0] = 1
            np.cumprod(x, out=x)
        if size <= 2 * PACK_BYTES:
            _POWERS[int(base)] = held
    return held


def window_hashes(values: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """For each place the hash of the `size` values from there on."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
    n = len(values) - size + 1
    return (sums[size:] - sums[:n]) * down[:n]


def sliding(x: np.ndarray, size: int, what: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each `size` neighbours, from the place on."""
    done, out = 1, x
    while done < size:
        step = min(done, size - done)
        out = what(out[: len(out) - step], out[step:])
        done += step
    return out


def pressed(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as compressed byte planes. A sorted first array is kept as differences."""
    planes = []
    for k, x in enumerate(arrays):
        x = np.diff(x, prepend=x.dtype.type(0)) if not k else x
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(1).compress(b"".join(planes))


def unpressed(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for k, size in zip(kinds, sizes):
        x = np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).ravel()
        out.append(np.cumsum(x, dtype=x.dtype) if not out else x)
        at += n * size
    return out


class Pack:
    """`ids`, where each text starts in `data` (UTF-8, each text closed by a line feed), and one further string per text."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, data: bytes, more: list[bytes]):
        self.ids, self.starts, self.data, self.more = ids, starts, data, more

    @staticmethod
    def press(ids: list[int], texts: list[bytes], more: list[bytes]) -> bytes:
        sizes = np.array([[len(t) for t in texts], [len(t) for t in more]], "<i8")
        head = np.array([len(ids)], "<i8").tobytes() + np.array(ids, "<i8").tobytes() + sizes.tobytes()
        return zstandard.ZstdCompressor(6).compress(head + b"\n".join([*texts, b""]) + b"".join(more))

    @staticmethod
    def open(blob: bytes) -> Pack:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        ids, sizes = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", 2 * n, 8 + 8 * n).reshape(2, n)
        at = 8 + 24 * n
        end = at + int(sizes[0].sum()) + n
        cuts = end + np.concatenate([[0], np.cumsum(sizes[1])])
        return Pack(ids, np.concatenate([[0], np.cumsum(sizes[0] + 1)]), raw[at:end], [raw[a:b] for a, b in zip(cuts, cuts[1:])])

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.starts[k + 1] - 1]


def packed(docs: DataFrame, more: str | None = None) -> DataFrame:
    """The written packs (pack, n_bytes, blob) of `docs` with doc_id and text, and of the string column `more`."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary"), (F.col(more) if more else F.lit("")).cast("binary"))

    def run(batches):
        n = TaskContext.get().partitionId() << 17
        ids, texts, extra, size = [], [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([size]), pa.array([Pack.press(ids, texts, extra)], pa.binary())], ["pack", "n_bytes", "blob"])

        for batch in batches:
            for doc, text, x in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and size + len(text) > PACK_BYTES:
                    yield out()
                    n, size = n + 1, 0
                    ids, texts, extra = [], [], []
                ids.append(doc)
                texts.append(text)
                extra.append(x)
                size += len(text) + 1
        if ids:
            yield out()
        ids, texts, extra = [], [], []
        released()

    return written(rows.mapInArrow(run, "pack long, n_bytes long, blob binary"), "packs")


def buckets_for(packs: DataFrame) -> int:
    return max(1, (packs.agg(F.sum("n_bytes")).first()[0] or 0) // BUCKET_BYTES)


def bucketed(keys: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Cuts arrays, sorted by 64-bit `keys`, into the ranges of `n` buckets."""
    bounds = np.array([(k << 64) // n for k in range(1, n)], np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    for b in range(n):
        if cuts[b] < cuts[b + 1]:
            yield b, [x[cuts[b] : cuts[b + 1]] for x in (keys, *arrays)]


def exchange(asked: DataFrame, answer: Callable[[list[int], list[bytes]], dict[int, bytes]]) -> DataFrame:
    """`asked` (bucket, pack, blob) -> (pack, blob): `answer` sees one bucket's packs and blobs and answers some packs."""

    def run(table: pa.Table) -> pa.Table:
        got = answer(table.column("pack").to_pylist(), table.column("blob").to_pylist())
        released()
        return pa.table({"pack": pa.array(list(got), pa.int64()), "blob": pa.array(list(got.values()), pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "pack long, blob binary")


def with_answers(packs: DataFrame, answers: DataFrame, run: Callable[[int, Pack, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """`run` on every pack with the answers that it got."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = right.column("blob").to_pylist()
        out = pa.concat_tables([run(p, Pack.open(b), blobs) for p, b in zip(left.column("pack").to_pylist(), left.column("blob").to_pylist())])
        released()
        return out

    return packs.select("pack", "blob").groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(both, schema)


REST = "_rest"


def with_rest(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns of `docs` as one JSON string, for the `more` of `packed`."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if others else F.lit("{}")
    return docs.select("doc_id", "text", rest.alias(REST))


def from_rest(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Undoes `with_rest`: doc_id, text and `more` of `rows` in the columns of `like`."""
    others = [f for f in like.schema.fields if f.name not in ("doc_id", "text")]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    parsed = rows.withColumn("_o", F.from_json("more", kind)) if others else rows
    return parsed.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_o.`{c}`").alias(c) for c in like.columns])


def rows_of(packs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, text and more of the documents of `nodes` (pack << 23 | place)."""
    wanted = nodes.groupBy(F.shiftright("node", 23).alias("pack")).agg(F.collect_list(F.col("node").bitwiseAND((1 << 23) - 1)).alias("at"))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        released()
        at = sorted(k for part in right.column("at").to_pylist() for k in part)
        ids, texts, more = [], [], []
        for blob in left.column("blob").to_pylist() if at else ():
            pack = Pack.open(blob)
            ids += [None if pack.ids[k] == NO_ID else int(pack.ids[k]) for k in at]
            texts += [pack.text(k).decode() for k in at]
            more += [pack.more[k].decode() for k in at]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "more": pa.array(more, pa.string())})

    return packs.select("pack", "blob").groupBy("pack").cogroup(wanted.groupBy("pack")).applyInArrow(both, "doc_id long, text string, more string")
