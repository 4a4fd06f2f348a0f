"""Quality by weak labels: expectation-maximisation weighs heuristic labellers, a hashed linear scorer learns their verdict.

Labellers are ranges of counts that vote good, bad or not at all. Only the counts of vote patterns over all documents reach
the driver, at most 3 ** labellers of them. The posteriors of a bounded sample train the scorer, which then sees every text.
Counts and features are taken from flat arrays of some texts at once; no step is made for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import documents, id_and_text, written
from lumora.llm.flat import Texts, flat, pieces_of, span_hashes
from lumora.llm.packs import MIX2, mixed, released
from lumora.llm.quality_rules import STOP_WORDS, WINDOW

#: Documents whose posterior trains the scorer (in expectation); the only bounded sample here.
SAMPLE = 8_000
DIMENSIONS, EPOCHS, RATE, KEEP = 1 << 15, 12, 0.3, 0.5

#: name, count, what it is a share of, least words, good when in, bad when in; ranges are closed, None is open.
LABELLERS = (
    ("symbols", "symbols", "words", 1, (None, 0.02), (0.25, None)),
    ("stop_words", "stop", "words", 20, (0.12, None), (None, 0.03)),
    ("repeats", "repeat_words", "words", 1, (None, 0.1), (0.5, None)),
    ("distinct", "distinct", "words", 20, (0.25, None), (None, 0.12)),
    ("stutter", "adjacent", "words", 1, (None, 0.05), (0.25, None)),
    ("exclamations", "bangs", "words", 1, (None, 0.05), (0.4, None)),
    ("bars", "bars", "words", 1, (None, 0.05), (0.3, None)),
    ("lines", "dup_lines", "lines", 1, (None, 0.2), (0.6, None)),
    ("word_length", "chars", "words", 1, (3.0, 9.0), (None, 1.5)),
)
PLACES = 3 ** np.arange(len(LABELLERS))

#: Longer shapes are hashed in pieces of PIECE kinds of character.
PIECE, SHAPE_WEIGHT = 64, 3.0
SHARES = ("adjacent", "top", "old", "bare")
_EXTRA = np.array([[crc32(f"f{name}{k}".encode()) % DIMENSIONS for k in range(11)] for name in SHARES])
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))


_STOP, _BAR = _hashes(list(dict.fromkeys(STOP_WORDS))), _hashes(["|"])[0]


def counts(texts: Texts) -> dict[str, np.ndarray]:
    """What the labellers look at, per text. Words are told apart by 48 bits of a hash; stop words by A-Z lower-cased."""
    low = Texts(texts.data, texts.cuts, lower=True).hash
    distinct, top, adjacent = texts.repetition()
    lines, dup_lines = texts.lines()
    return {
        "words": texts.n_words,
        "chars": texts.counted(texts.inside & ((texts.data & 0xC0) != 0x80)),
        "symbols": texts.counted(_SYMBOLS[texts.data]),
        "bangs": texts.counted(texts.data == ord("!")),
        "stop": texts.words_counted(_STOP[np.minimum(np.searchsorted(_STOP, low), len(_STOP) - 1)] == low),
        "bars": texts.words_counted(texts.hash == _BAR),
        "repeat_words": texts.repeated_words(WINDOW),
        "distinct": distinct,
        "top": top,
        "adjacent": adjacent,
        "lines": lines,
        "dup_lines": dup_lines,
    }


def votes(n: dict[str, np.ndarray]) -> np.ndarray:
    """The vote pattern of each text as a number of base 3, one digit for each labeller: 0 bad, 1 good, 2 none. A text
    without words gets no vote."""
    out = np.zeros(len(n["words"]), np.int64)
    for place, (_, count, of, least, good, bad) in zip(PLACES, LABELLERS):
        share = n[count] / np.maximum(n[of], 1)
        counted = (n["words"] >= least) & (n[of] > 0)
        inside = [counted & (share >= (-np.inf if low is None else low)) & (share <= (np.inf if high is None else high)) for low, high in (good, bad)]
        out += place * np.where(inside[1], 0, np.where(inside[0], 1, 2))
    return out


def digits(patterns: np.ndarray) -> np.ndarray:
    return np.asarray(patterns, np.int64)[:, None] // PLACES % 3


def accuracies(patterns: dict[int, int], rounds: int = 50) -> tuple[float, np.ndarray]:
    """The share of good documents and p[class, labeller, vote], by expectation-maximisation from a majority vote."""
    table = digits(list(patterns))
    n = np.array(list(patterns.values()), float)
    good = 1 / (1 + np.exp(-2.0 * ((table == 1).sum(1) - 3.0 * (table == 0).sum(1))))
    for _ in range(rounds):
        prior = (n @ good + 1) / (n.sum() + 2)
        p = np.array([[[((table[:, k] == v) * n * w).sum() + 0.1 for v in range(3)] for k in range(len(LABELLERS))] for w in (1 - good, good)])
        p /= p[:, :, :2].sum(2, keepdims=True)
        p[:, :, 2] = 1  # a labeller that does not vote says nothing
        good = posterior(table, prior, p)
    return prior, p


def posterior(table: np.ndarray, prior: float, p: np.ndarray) -> np.ndarray:
    logs = [np.log(x) + np.log(p[c])[np.arange(len(LABELLERS)), table].sum(1) for c, x in ((0, 1 - prior), (1, prior))]
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))


class Features:
    """The hashed features of some texts: shares of words, of word shapes, and how often the commonest words repeat."""

    def __init__(self, texts: Texts, n: dict[str, np.ndarray] | None = None):
        distinct, top, adjacent = (n[k] for k in ("distinct", "top", "adjacent")) if n else texts.repetition()
        self.texts, total = texts, texts.n_words
        self.total = np.maximum(total, 1)
        self.word_at = (mixed(texts.hash, MIX2) % np.uint64(DIMENSIONS)).astype(np.int64)
        word, share, shape = texts.shapes(PIECE)
        self.shape_text, self.shape_x, self.shape_at = texts.text[word], SHAPE_WEIGHT * share, (shape % np.uint64(DIMENSIONS)).astype(np.int64)
        self.shape_first = np.searchsorted(self.shape_text, np.arange(texts.rows + 1))
        # Shares of repetition: none of them is high in a short text only for being short.
        again = (adjacent, np.maximum(top, 1) - 1, total - distinct)
        tenths = [(np.minimum(k, total) / np.maximum(total, 20) * 10).astype(np.int64) for k in again] + [10 * (total == 0)]
        self.extra = np.stack([e[t] for e, t in zip(_EXTRA, tenths)], 1)

    def linear(self, w: np.ndarray) -> np.ndarray:
        """The sum of each text's features times `w`."""
        n = self.texts.rows
        words, shapes = np.bincount(self.texts.text, w[self.word_at], n), np.bincount(self.shape_text, w[self.shape_at] * self.shape_x, n)
        return (words + shapes) / self.total + w[self.extra].sum(1)

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The features of text `k`: where they lie, in ascending order, and their values."""
        a, b = self.texts.first[k : k + 2]
        c, d = self.shape_first[k : k + 2]
        at = np.concatenate([self.word_at[a:b], self.shape_at[c:d], self.extra[k]])
        x = np.concatenate([np.full(b - a, 1 / self.total[k]), self.shape_x[c:d] / self.total[k], np.ones(len(SHARES))])
        places, back = np.unique(at, return_inverse=True)
        return places, np.bincount(back, x)


def features(text: str) -> dict[int, float]:
    at, x = Features(Texts(*flat(text))).of(0)
    return dict(zip(at.tolist(), x.tolist()))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by AdaGrad, a fixed order of rows and a fixed seed."""
    w, b, seen, seen_b = np.zeros(DIMENSIONS), 0.0, np.full(DIMENSIONS, 1e-3), 1e-3
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            g = 1 / (1 + np.exp(-np.clip(w[at] @ x + b, -30, 30))) - y
            seen[at] += (g * x) ** 2
            seen_b += g * g
            w[at] -= RATE * g * x / np.sqrt(seen[at])
            b -= RATE * g / np.sqrt(seen_b)
    return w, b


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The scorer's weights. Vote patterns are counted over all documents; about `sample` documents train the scorer, drawn
    and ordered by a hash of the row, so that neither depends on how rows lie in partitions."""
    n = docs.count()
    if not n:
        return np.zeros(DIMENSIONS), 0.0
    bound = int(min(1.0, sample / n) * (1 << 30))
    drawn = id_and_text(docs).select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("draw"))

    def look(batches):
        held = np.zeros(3 ** len(LABELLERS), np.int64)
        names = ["pattern", "n", "draw", "at", "x"]
        for batch in batches:
            draw = batch.column(1).to_numpy()
            for lo, hi, data, cuts in pieces_of(batch.column(0)):
                texts = Texts(data, cuts)
                some = counts(texts)
                pattern = votes(some)
                held += np.bincount(pattern, minlength=len(held))
                chosen = np.flatnonzero(draw[lo:hi] < bound)
                if len(chosen):
                    described = Features(texts, some)
                    found = [described.of(k) for k in chosen]
                    cols = [pa.array(pattern[chosen]), pa.array([0] * len(chosen)), pa.array(draw[lo:hi][chosen])]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([at.astype("<u2").tobytes() for at, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())], names)
        seen = np.flatnonzero(held)
        none = [pa.nulls(len(seen), t) for t in (pa.int64(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[seen]), *none], names)
        released()

    looked = written(drawn.mapInArrow(look, "pattern long, n long, draw long, at binary, x binary"), "votes")
    patterns = {r.pattern: r.n for r in looked.filter("at IS NULL").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    prior, p = accuracies(dict(sorted(patterns.items())))
    belief = dict(zip(patterns, posterior(digits(list(patterns)), prior, p)))
    rows = looked.filter("at IS NOT NULL").select("draw", "pattern", "at", "x").collect()
    rows.sort(key=lambda r: (r.draw, r.pattern, r.at))
    return train([(np.frombuffer(r.at, "<u2"), np.frombuffer(r.x, "<f4"), belief[r.pattern]) for r in rows])


def probabilities(column: pa.Array, w: np.ndarray, b: float) -> np.ndarray:
    """How probably each text is good. The column has no nulls."""
    z = [Features(Texts(data, cuts)).linear(w) for _, _, data, cuts in pieces_of(column)]
    return 1 / (1 + np.exp(-np.clip(np.concatenate([*z, np.zeros(0)]) + b, -30, 30)))


def classify(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """Per row of `docs`: doc_id, text (null: empty), score (the probability that the text is good) and kept.

    Null texts count as empty; empty texts and texts without words have features of their own, and are scored like all
    others. Very long texts are read whole. An empty table gives an empty result. Repeated rows get equal scores, and so do
    equal texts of other ids; a null doc_id is kept as it is. Columns other than doc_id and text are left behind, whatever
    their names.
    """
    w, b = fit(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast((w, b))

    def score(batches):
        for batch in batches:
            p = probabilities(batch.column(1), *shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array(p >= keep, pa.bool_())], [*batch.schema.names, "score", "kept"])

    rows = id_and_text(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, text string, score double, kept boolean")


def without_rejected(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """The rows of `docs`, all columns, that `classify` keeps."""
    w, b = fit(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast((w, b))

    def run(batches, at=docs.columns.index("text")):
        for batch in batches:
            yield batch.filter(pa.array(probabilities(batch.column(at).fill_null(""), *shared.value) >= keep, pa.bool_()))
        released()

    return docs.mapInArrow(run, docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir)).select("doc_id", "score", "kept")


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
SQL: dict[str, str] = {}
