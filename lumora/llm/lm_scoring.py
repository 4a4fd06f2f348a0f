"""A class-factored gated recurrent language model in numpy, and the smoothed unigram base beside it.

p(word | history) = p(class | state) * p(word | class). The recurrent network predicts the class of the next word; inside a
class the smoothed count decides. The most frequent words are classes of their own, all others share classes by their
ending. Counts come from all training documents. Each pass trains one copy of the network per partition and averages the
copies in Spark, so that the driver only ever holds one set of parameters.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from zlib import crc32

from lumora.llm.bpe import pieces
from lumora.llm.common import commonest, documents, id_and_text, written

END = b""
FREQUENT, SINGLE, ENDINGS = 1 << 17, 64, 64
CLASSES = SINGLE + ENDINGS
HIDDEN, WINDOW, TRAIN_ROWS, PASSES, RATE = 16, 16, 512, 2, 0.01
#: States whose class scores are held at once; they fit the cache of a core.
BLOCK = 1024
DISTINCT_AT_ONCE, AT_ONCE, SCORED_AT_ONCE = 100_000, 4_000_000, 8_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def tokens_of(text: str) -> list[bytes]:
    """Lower-cases A-Z alone and splits at space and the controls 9 to 13, which is what bytes do."""
    return [*text.encode().lower().split(), END]


def ending(word: bytes) -> int:
    return crc32(word[-2:]) % ENDINGS


class Gru:
    """Parameters: X class -> gate inputs, U state -> gates, V state -> class scores, b their offsets. Gates: update, reset, new."""

    SHAPES = {"X": (CLASSES + 1, 3 * HIDDEN), "U": (HIDDEN, 3 * HIDDEN), "V": (HIDDEN, CLASSES), "b": (CLASSES,)}

    def __init__(self, flat: np.ndarray | None = None):
        sizes = [int(np.prod(s)) for s in self.SHAPES.values()]
        if flat is None:
            flat = np.random.default_rng(7).normal(0, 0.1, sum(sizes))
            flat[-CLASSES:] = 0
        self.flat = np.array(flat, np.float32)
        cuts = np.cumsum([0, *sizes])
        self.p = {k: self.flat[a:b].reshape(s) for (k, s), a, b in zip(self.SHAPES.items(), cuts, cuts[1:])}
        self.m, self.v, self.t = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

    def run(self, x: np.ndarray, h: np.ndarray, kept: list | None = None) -> np.ndarray:
        """The states after each step, time first, from the gate inputs `x` of their classes; `kept` takes the gates."""
        U, out = self.p["U"], np.empty((len(x), len(h), HIDDEN), np.float32)
        for t in range(len(x)):
            g = h @ U
            zr = x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, gn = zr[:, :HIDDEN], g[:, 2 * HIDDEN :]
            n = zr[:, HIDDEN:] * gn
            n += x[t, :, 2 * HIDDEN :]
            np.tanh(n, out=n)
            if kept is not None:
                kept.append((zr, n, gn))
            h = np.subtract(h, n, out=out[t])
            h *= z
            h += n
        return out

    def exps(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The exponentials of the class scores of each state and their sums. States lie between -1 and 1, so where no score
        can be large none is taken off before; else they are doubles, so that small ones do not vanish."""
        out = h @ self.p["V"]
        out += self.p["b"]
        if not float((np.abs(self.p["V"]).sum(0) + np.abs(self.p["b"])).max()) < 60:
            out = out.astype(np.float64)
            out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        return out, out @ np.ones(CLASSES, out.dtype)

    def window(self, prev: np.ndarray, target: np.ndarray, live: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One truncated window, time first: carries the state over its end and the gradient not. Updates by Adam. Scores and
        the gradients of what is not recurrent are taken of BLOCK states at once, whichever step they belong to."""
        kept: list = []
        states = self.run(self.p["X"][prev], h, kept)
        olds = np.concatenate([h[None], states[:-1]]).reshape(-1, HIDDEN)
        flat_h, flat_target = states.reshape(-1, HIDDEN), target.ravel()
        share = live.ravel() / np.float32(max(1.0, float(live.sum())))
        g = {k: np.zeros(s, np.float32) for k, s in self.SHAPES.items()}
        dhs = np.empty_like(flat_h)
        for k in range(0, len(flat_h), BLOCK):
            d, total = self.exps(flat_h[k : k + BLOCK])
            w = share[k : k + BLOCK]
            d *= (w / total)[:, None]
            d[np.arange(len(d)), flat_target[k : k + BLOCK]] -= w
            g["V"] += flat_h[k : k + BLOCK].T @ d
            g["b"] += np.ones(len(d), np.float32) @ d
            dhs[k : k + BLOCK] = d @ self.p["V"].T
        dhs, back, U = dhs.reshape(states.shape), np.zeros_like(h), self.p["U"].T
        das, dgs = (np.empty((len(prev), len(h), 3 * HIDDEN), np.float32) for _ in range(2))
        for t in range(len(prev) - 1, -1, -1):
            zr, n, gn = kept[t]
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            old = states[t - 1] if t else h
            dh = dhs[t] + back
            keep = dh * z
            dn = (dh - keep) * (1 - n * n)
            da, dg = das[t], dgs[t]
            da[:, :HIDDEN] = keep * (old - n) * (1 - z)
            dr = dn * r
            da[:, HIDDEN : 2 * HIDDEN] = dr * gn * (1 - r)
            da[:, 2 * HIDDEN :] = dn
            dg[:, : 2 * HIDDEN] = da[:, : 2 * HIDDEN]
            dg[:, 2 * HIDDEN :] = dr
            back = dg @ U
            back += keep
        g["U"] = olds.T @ dgs.reshape(-1, 3 * HIDDEN)
        # Small numbers are sorted by their digits.
        order = np.argsort(prev.ravel().astype(np.uint16), kind="stable")
        times = np.bincount(prev.ravel(), minlength=CLASSES + 1)
        classes = np.flatnonzero(times)
        g["X"][classes] = np.add.reduceat(das.reshape(-1, 3 * HIDDEN)[order], (np.cumsum(times) - times)[classes])
        flat = np.concatenate([g[k].ravel() for k in self.SHAPES])
        flat *= min(1.0, 1.0 / (float(np.sqrt((flat**2).sum())) + 1e-9))
        self.t += 1
        self.m += 0.1 * (flat - self.m)
        self.v += 0.01 * (flat * flat - self.v)
        self.flat -= RATE * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)
        return states[-1]

    def windows(self, docs: list[np.ndarray]):
        """(rows still going, their classes, which of these are before the end) of each window over documents side by side, the
        longest first."""
        size = np.array([len(d) for d in docs])
        flat, at = np.concatenate(docs), np.cumsum(size) - size
        for start in range(0, int(size[0]), WINDOW):
            n = int((size > start).sum())
            t = start + np.arange(min(WINDOW, int(size[0]) - start))[:, None]
            yield n, flat[np.minimum(at[None, :n] + t, len(flat) - 1)], (t < size[None, :n]).astype(np.float32)

    def train(self, docs: list[np.ndarray]) -> int:
        """Goes once through whole documents, TRAIN_ROWS side by side, the longest first."""
        docs = sorted(docs, key=len, reverse=True)
        for k in range(0, len(docs), TRAIN_ROWS):
            some = docs[k : k + TRAIN_ROWS]
            h, last = np.zeros((len(some), HIDDEN), np.float32), np.full(len(some), CLASSES)
            for n, target, live in self.windows(some):
                h = self.window(np.concatenate([last[None, :n], target[:-1]]), target, live, h[:n])
                last = target[-1]
        return int(sum(map(len, docs)))

    def log10(self, docs: list[np.ndarray]) -> np.ndarray:
        """The log10 probability of each document's classes, the state carried from its start to its end."""
        order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
        h, last, out = np.zeros((len(docs), HIDDEN), np.float32), np.full(len(docs), CLASSES), np.zeros(len(docs))
        for n, target, live in self.windows([docs[k] for k in order]):
            states = self.run(self.p["X"][np.concatenate([last[None, :n], target[:-1]])], h[:n])
            flat, classes, logs = states.reshape(-1, HIDDEN), target.ravel(), np.empty(target.size)
            for k in range(0, len(flat), BLOCK):
                e, total = self.exps(flat[k : k + BLOCK])
                logs[k : k + BLOCK] = np.log(np.maximum(e[np.arange(len(e)), classes[k : k + BLOCK]], np.finfo(e.dtype).tiny) / total)
            out[:n] += (logs.reshape(target.shape) * live).sum(0)
            h, last = states[-1], target[-1]
        result = np.zeros(len(docs))
        result[order] = out / np.log(10)
        return result


def count_words(rows: DataFrame) -> DataFrame:
    """word (binary; empty: the end), its ending class and its count n over all of `rows`."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            words = list(held)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(map(ending, words), pa.int32()), pa.array(held.values(), pa.int64())], ["word", "ending", "n"])
            held.clear()

        for batch in batches:
            for some in pieces(texts := batch.column(1).to_pylist()):
                held.update(" ".join([texts[k] for k in some]).encode().lower().split())
                held[END] += len(some)
                if len(held) > DISTINCT_AT_ONCE:
                    yield from flush()
        if held:
            yield from flush()

    return rows.mapInArrow(run, "word binary, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))


def _indexed(texts: list[str], index: dict[bytes, int]) -> list[tuple[np.ndarray, Counter]]:
    """Per text its tokens' numbers (FREQUENT + ending class for words without one) and the counts of those words."""
    out = []
    for text in texts:
        words = tokens_of(text)
        ids = list(map(index.get, words))
        rare: Counter = Counter()
        if None in ids:
            tail = [k for k, i in enumerate(ids) if i is None]
            rare.update([words[k] for k in tail])
            number = {w: FREQUENT + ending(w) for w in rare}
            for k in tail:
                ids[k] = number[words[k]]
        out.append((np.array(ids, np.int64), rare))
    return out


def score_documents(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """Trains on the documents that are not held out and scores all of them, whole.

    Per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, both log10. Null and empty
    texts consist of their end alone. A null doc_id is not held out. Repeated rows are scored each. Without training
    documents every word is unknown and the network stays untrained.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs).withColumn("held_out", held_out(F.col("doc_id")))
    learn = rows.filter(~F.col("held_out"))
    counts = written(count_words(learn), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    norm = total + 0.5 * (distinct + 1)
    top = sorted(commonest(counts, "word", "n", FREQUENT).collect(), key=lambda r: (-r.n, bytes(r.word)))
    index = {bytes(r.word): k for k, r in enumerate(top)}
    log_count = np.log10(np.array([r.n for r in top] + [0] * (FREQUENT - len(top) + ENDINGS)) + 0.5)
    # Classes: the most frequent words alone, the end among them wherever it ranks; the others by ending.
    single = {bytes(r.word) for r in top[: SINGLE - 1]} | {END}
    numbers = {w: k for k, w in enumerate(sorted(single))}
    class_of = np.array([numbers.get(bytes(r.word), SINGLE + r.ending) for r in top] + [0] * (FREQUENT - len(top)) + [SINGLE + k for k in range(ENDINGS)])
    mass = np.full(CLASSES, 0.5)
    for e, n, v in counts.filter(~F.col("word").isin([bytearray(w) for w in single])).groupBy("ending").agg(F.sum("n"), F.count("*")).collect():
        mass[SINGLE + e] = n + 0.5 * (v + 1)
    n_of = {bytes(r.word): r.n for r in top}
    for w, k in numbers.items():
        mass[k] = n_of.get(w, 0) + 0.5
    shared = spark.sparkContext.broadcast((index, log_count, class_of, np.log10(mass)))

    params = Gru().flat
    for turn in range(passes):

        def train(batches, params=params):
            index, _, class_of, _ = shared.value
            model, seen = Gru(params), 0
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for some in pieces(texts, AT_ONCE):
                    seen += model.train([class_of[ids] for ids, _ in _indexed([texts[k] for k in some], index)])
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([model.flat.astype(float).tolist()]), pa.array([float(seen)])], ["p", "w"])

        mine = learn.filter(F.pmod(F.xxhash64("doc_id"), F.lit(passes)) == turn)
        trained = mine.mapInArrow(train, "p array<double>, w double").select("w", F.posexplode("p").alias("k", "x"))
        mean = trained.groupBy("k").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x")).collect()
        if mean:
            params = np.zeros_like(params)
            params[[r.k for r in mean]] = [r.x for r in mean]

    def pooled(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SCORED_AT_ONCE:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def score(batches):
        index, log_count, class_of, log_mass = shared.value
        model, n = Gru(params), TaskContext.get().partitionId() << 33
        for table in pooled(batches):
            texts = table.column(1).to_pylist()
            for some in pieces(texts, SCORED_AT_ONCE):
                found = _indexed([texts[k] for k in some], index)
                classes = [class_of[ids] for ids, _ in found]
                fit = model.log10(classes)
                ends = np.cumsum([0, *(len(rare) for _, rare in found)])
                words = pa.array([w for _, rare in found for w in rare], pa.binary())
                times = pa.array([k for _, rare in found for k in rare.values()], pa.int64())
                cols = [
                    pa.array(range(n, n + len(some)), pa.int64()),
                    *(table.column(c).take(pa.array(some)).combine_chunks() for c in (0, 2)),
                    pa.array([len(ids) for ids, _ in found], pa.int64()),
                    pa.array([float(log_count[ids[ids < FREQUENT]].sum()) for ids, _ in found]),
                    pa.array([float(x - log_mass[c].sum()) for x, c in zip(fit, classes)]),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([words, times], ["word", "n"])),
                ]
                n += len(some)
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "held_out", "n_tokens", "common", "fit", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = written(rows.mapInArrow(score, f"row long, doc_id {kind}, held_out boolean, n_tokens long, common double, fit double, rare array<struct<word: binary, n: long>>"), "scored")
    rare = scored.select("row", F.inline("rare").alias("word", "times"))
    log_c = F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)
    looked = rare.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(F.sum(F.col("times") * log_c).alias("tail"), F.sum(F.when(F.col("n").isNull(), F.col("times"))).alias("unknown"))
    logs = F.col("common") + F.coalesce(F.col("tail"), F.lit(0.0))
    return (
        scored.drop("rare")
        .join(looked, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_tokens") - F.coalesce(F.col("unknown"), F.lit(0))).alias("n_known"),
            F.lit(int(total)).alias("train_tokens").cast("long"),
            (logs - F.col("n_tokens") * float(np.log10(norm))).alias("base_score"),
            (logs + F.col("fit")).alias("score"),
        )
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


QUERIES = {"op10_lm_scoring": op10_lm_scoring}
SQL: dict[str, str] = {}
