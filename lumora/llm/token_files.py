"""Token ids in Arrow files of fixed-size lists: equal-length sequences and their masks at zero copy.

A block is a run of documents in ascending doc_id order. Its file `block-N-<attempt>.arrow` holds the ids of its documents,
end ids included, cut into sequences of equal length; the mask is false on the padding of the block's last sequence.
Next to it `.index.arrow` says where each document starts in the block. All batches but the last have the same number of
sequences, so sequence k is row k % rows of batch k // rows.
"""

from __future__ import annotations

import gc
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.llm.bpe import MARKS, PLAIN, SPACE, pieces, vocabulary
from lumora.llm.common import blocks_for, documents, id_and_text, shared_dir, written

#: The pattern by which byte-level vocabularies split a text before their merges, with White_Space written out.
TOKENS = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"""
SEQUENCE, ROWS, END_ID = 1024, 64, 2
BLOCK_BYTES, CACHE_RUNS, AT_ONCE = 16 << 20, 500_000, 1_000

_LOADED: dict[str, "ByteBpe"] = {}


class ByteBpe:
    """The library's byte-level tokenizer with a bounded cache of pre-tokens, each encoded by the library once."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size()
        self.split = regex.compile(TOKENS).findall
        self.wide = re.compile(f"[{SPACE}][{SPACE}]").search
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _raw(self, tokens: list[str]) -> list[bytes]:
        """The ids of each pre-token. A row of pre-tokens that each start with their only space is split at these spaces
        again, so such ones go to the library in rows of AT_ONCE; it tells which pre-token each id belongs to."""
        out: list[bytes] = [b""] * len(tokens)
        spaced = [k for k, t in enumerate(tokens) if t[0] == " " and len(t) > 1 and t[1] != " "]
        for at in (spaced[k : k + AT_ONCE] for k in range(0, len(spaced), AT_ONCE)):
            e = self.library.encode("".join([tokens[k] for k in at]), add_special_tokens=False)
            raw, of = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids)
            ends = (4 * np.cumsum(np.bincount(of, minlength=len(at)))).tolist()
            start = 0
            for k, end in zip(at, ends):
                out[k] = raw[start:end]
                start = end
        others = [k for k, x in enumerate(out) if not x]
        for k, e in zip(others, self.library.encode_batch_fast([tokens[k] for k in others], add_special_tokens=False)):
            out[k] = array("I", e.ids).tobytes()
        return out

    def _learn(self, missing: set[str]) -> None:
        """Adds the ids of runs behind a space: of letters, of letters and then MARKS, and of any other kind."""
        runs, older, letters, marked, odd = self.runs, self.older, set(), [], []
        for r in missing:
            if r in older:
                runs[r] = older[r]
                continue
            word = r.rstrip(MARKS)
            if not word.isalpha():
                odd.append(r)
                continue
            if word not in runs:
                if word in older:
                    runs[word] = older[word]
                else:
                    letters.add(word)
            if len(word) < len(r):
                marked.append((r, word, r[len(word) :]))
        runs.update(zip(letters, self._raw([" " + w for w in letters])))
        split = {r: self.split(" " + r) for r in odd}
        ids = self._by_token(set().union(*split.values(), (m for _, _, m in marked)))
        runs.update([(r, runs[word] + ids[marks]) for r, word, marks in marked])
        runs.update([(r, b"".join([ids[t] for t in ts])) for r, ts in split.items()])

    def _by_token(self, tokens: set[str]) -> dict[str, bytes]:
        listed = list(tokens)
        return dict(zip(listed, self._raw(listed)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        A token with a space before it starts at that space, so a text without adjacent white space is cut at its spaces
        into runs that are looked up whole; a full cache becomes the older one, from which runs come back as they are met. Texts with special tokens or
        characters beyond the plain ones go through the library whole, the others by pre-tokens, each once a call.
        """
        out: list[bytes | None] = [None] * len(texts)
        runs, tokens = {}, {}
        for k, text in enumerate(texts):
            if not PLAIN.match(text) or any(s in text for s in self.specials):
                out[k] = self._whole(text)
            elif self.wide(text):
                tokens[k] = self.split(text)
            else:
                runs[k] = text.split(" ")
        used = set().union(*runs.values())
        if len(self.runs) > CACHE_RUNS:
            self.runs, self.older = {}, self.runs
        self._learn(used.difference(self.runs))
        heads = {k: self.split(r[0]) for k, r in runs.items()}
        ids = self._by_token(set().union(*heads.values(), *tokens.values()))
        for k, ts in tokens.items():
            out[k] = b"".join([ids[t] for t in ts])
        known = self.runs.__getitem__
        for k, r in runs.items():
            del r[0]
            out[k] = b"".join([*[ids[t] for t in heads[k]], *map(known, r)])
        return out


def tokenizer(path: str) -> ByteBpe:
    if path not in _LOADED:
        # Very many short lists live for one call and none is part of a cycle.
        gc.set_threshold(200_000, 20, 20)
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    folder = re.sub(r"^file:/+", "/", folder)
    return fs.FileSystem.from_uri(folder)


class BlockWriter:
    """Writes one block; `add` takes a document's ids. Nothing but the current batch is held."""

    def __init__(self, store: fs.FileSystem, path: str, dtype: str, sequence: int = SEQUENCE, rows: int = ROWS):
        self.kind, self.sequence, self.rows = np.dtype(dtype), sequence, rows
        self.schema = pa.schema({"ids": pa.list_(pa.from_numpy_dtype(self.kind), sequence), "mask": pa.list_(pa.bool_(), sequence)}, {"sequence": str(sequence), "rows": str(rows)})
        self.index = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()})
        self.sinks = [store.open_output_stream(path), store.open_output_stream(f"{path}.index.arrow")]
        self.files = [ipc.new_file(s, x) for s, x in zip(self.sinks, (self.schema, self.index))]
        self.parts, self.held, self.total, self.docs = [], 0, 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.parts.append(ids.astype(self.kind))
        self.held += len(ids)
        full = self.sequence * self.rows
        if self.held >= full:
            flat = np.concatenate(self.parts)
            for k in range(0, len(flat) - full + 1, full):
                self._batch(flat[k : k + full], full)
            rest = flat[len(flat) // full * full :]
            self.parts, self.held = [rest], len(rest)
        if len(self.docs) >= 10_000:
            self._index()

    def _batch(self, ids: np.ndarray, n: int) -> None:
        mask = pa.array(np.arange(len(ids)) < n)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.sequence) for x in (pa.array(ids), mask)]
        self.files[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def _index(self) -> None:
        cols = [pa.array(x, pa.int64()) for x in zip(*self.docs)]
        self.files[1].write_batch(pa.RecordBatch.from_arrays(cols, schema=self.index))
        self.docs = []

    def close(self) -> int:
        if self.held:
            flat = np.concatenate(self.parts)
            self._batch(np.pad(flat, (0, -len(flat) % self.sequence)), len(flat))
        if self.docs:
            self._index()
        for f, s in zip(self.files, self.sinks):
            f.close()
            s.close()
        return self.total


class BlockReader:
    """Random access to a block: the file is mapped where the store is local, and sequences are views of it."""

    def __init__(self, store: fs.FileSystem, path: str):
        local = isinstance(store, fs.LocalFileSystem)
        self.file, self.index = (ipc.open_file(pa.memory_map(p) if local else store.open_input_file(p)) for p in (path, f"{path}.index.arrow"))
        meta = self.file.schema.metadata
        self.sequence, self.rows = int(meta[b"sequence"]), int(meta[b"rows"])

    def sequence_at(self, k: int) -> tuple[np.ndarray, pa.Array]:
        batch = self.file.get_batch(k // self.rows)
        at = k % self.rows * self.sequence
        return batch.column(0).values.slice(at, self.sequence).to_numpy(), batch.column(1).values.slice(at, self.sequence)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, its start in the block and its ids; one batch of sequences is looked at at a time."""
        full, at, flat = self.sequence * self.rows, -1, None
        for k in range(self.index.num_record_batches):
            for doc, start, n in zip(*(c.to_pylist() for c in self.index.get_batch(k).columns)):
                parts, pos, end = [], start, start + n
                while pos < end:
                    if pos // full != at:
                        at = pos // full
                        flat = self.file.get_batch(at).column(0).values.to_numpy()
                    parts.append(flat[pos - at * full : end - at * full])
                    pos += len(parts[-1])
                yield doc, start, parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_token_files(docs: DataFrame, path: str, end_id: int = END_ID, sequence: int = SEQUENCE) -> DataFrame:
    """Writes the ids of all documents, each closed by `end_id`, in ascending doc_id order into the shared folder.

    Returns the manifest: block, path, n_tokens, n_docs and `before`, the ids of all earlier blocks. A repeated task writes
    files of its own, and only those of the task that Spark keeps are named. Null texts count as empty; rows of equal
    doc_id follow each other ordered by text, a null doc_id comes first; an empty table gives no blocks.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    rows = id_and_text(docs)
    ranged = rows.repartitionByRange(blocks_for(rows, BLOCK_BYTES), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        bpe, out, n = tokenizer(path), None, 0
        dtype = "<u2" if max(bpe.size, end_id + 1) <= 1 << 16 else "<u4"
        block = TaskContext.get().partitionId()
        store, base = _store(folder)
        name = f"{base}/block-{block:07d}-{uuid.uuid4().hex}.arrow"
        tail = np.array([end_id], "<u4")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rows in pieces(texts):
                out = out or BlockWriter(store, name, dtype, sequence)
                for k, x in zip(rows, bpe.encode([texts[k] for k in rows])):
                    out.add(ids[k], np.concatenate([np.frombuffer(x, "<u4"), tail]))
                n += len(rows)
        if out:
            total = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (block, name, total, n)], ["block", "path", "n_tokens", "n_docs"])

    manifest = written(ranged.mapInArrow(run, "block long, path string, n_tokens long, n_docs long"), "manifest")
    before = F.sum("n_tokens").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("before", F.coalesce(before, F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, read back from the files: doc_id, start among all ids, n_tokens and the CRC-32 of its ids as u32."""
    spark = manifest.sparkSession
    store_uri = shared_dir(spark)

    def run(batches):
        store, _ = _store(store_uri)
        for batch in batches:
            for row in batch.to_pylist():
                docs = [(d, row["before"] + s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in BlockReader(store, row["path"]).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*docs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.repartition(n, "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")))


QUERIES = {"op9_token_files": op9_token_files}
SQL: dict[str, str] = {}
