"""BPE encoding and decoding by depth-first traversal of a trie of distinct words.

The encoding of a word is the encoding of a prefix plus one last token, so each trie node needs only its last token:
the one token that ends there, and that the last token before it does not merge with. Words that share a prefix share
the nodes, and hence the work, of that prefix.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lumora.llm.common import documents, id_and_text
from lumora.llm.packs import released

#: White_Space in the sense of Unicode, as the tokenizer's patterns understand it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Texts of these characters only need no Unicode normalisation and have a stable letter classification.
PLAIN = regex.compile(r"[\x00-\x1B\x20-ɏ‐-‧]*+\Z")
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
CACHE_WORDS, KEPT_WORDS, CACHE_JOINS, NEVER = 150_000, 400_000, 400_000, float("inf")
#: Longer words are filled from the left, so that no recursion follows their length.
DEEP = 200
#: Marks that are no letters, digits or apostrophes; what stands before them in a run is split alone.
MARKS = ".,;:!?#$%&*+-/<=>@^_|~()[]{}\"`\\"
END = "</w>"
SHORT = [2, 1]


def byte_alphabet() -> dict[str, str]:
    """The printable stand-in of each byte in vocabulary files -> the byte as a Latin-1 character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(hidden)}


class WordBpe:
    """A word-end BPE vocabulary in the JSON format of the tokenizers library. Words here are byte strings shown in Latin-1."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.specials = {t["content"]: str(t["id"]) for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.alphabet = alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.token = {str(i): t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.inner, self.final = {}, {}
        for t, i in vocab.items():
            if t in self.specials:
                continue
            body, table = (t[: -len(END)], self.final) if t.endswith(END) else (t, self.inner)
            if all(c in alphabet for c in body):
                table["".join(alphabet[c] for c in body)] = i
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.strings = {i: (s, table) for table in (self.inner, self.final) for s, i in table.items()}
        self.sizes = [self._sizes(self.inner), self._sizes(self.final)]
        self.text = {i: str(i) for i in vocab.values()}
        self.joins: dict[tuple[int, int], bool] = {}
        self.built: dict[int, tuple | None] = {}
        self.runs: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.most = CACHE_WORDS

    @staticmethod
    def _sizes(table: dict[str, int]) -> dict[str, list[int]]:
        """For each ending of three characters the lengths of tokens with it, the longest first."""
        sizes: dict[str, set[int]] = {}
        for s in table:
            if len(s) > 2:
                sizes.setdefault(s[-3:], {*SHORT}).add(len(s))
        return {end: sorted(ns, reverse=True) for end, ns in sizes.items()}

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def base(self, t: int) -> list[int]:
        """The symbols of a token's characters, none where one of them is no symbol."""
        s, table = self.strings.get(t, ("", self.final))
        if not s or s[-1] not in table or not all(c in self.inner for c in s[:-1]):
            return []
        return [*[self.inner[c] for c in s[:-1]], table[s[-1]]]

    def edges(self, t: int) -> tuple[list[tuple[int, float]], list[tuple[int, float]]] | None:
        """The symbols at the left and at the right edge of `t` while plain BPE builds it, each with the rank of the
        merge that ends it; None where BPE does not build `t` from its own characters. Ranks only rise on the way, as a
        merge is listed after those that make its parts."""
        if t not in self.built:
            symbols = self.base(t)
            left, right = [], []
            while len(symbols) > 1:
                pairs = [self.merges.get(p, (NEVER, 0)) for p in zip(symbols, symbols[1:])]
                rank, new = min(pairs)
                if rank == NEVER:
                    break
                at = pairs.index((rank, new))
                if at == 0:
                    left.append((symbols[0], rank))
                if at == len(symbols) - 2:
                    right.append((symbols[-1], rank))
                symbols[at : at + 2] = [new]
            self.built[t] = ([*left, (t, NEVER)], [*right, (t, NEVER)]) if symbols == [t] else None
        return self.built[t]

    def stands(self, before: int, last: int) -> bool:
        """Whether `last` stays a token of its own after `before` (-1: at the start of a word): no pair of symbols that
        meet at the border while both are built merges before one of them is used up; the left one goes first on ties."""
        key = before, last
        if (known := self.joins.get(key)) is None:
            edge, known = self.edges(last), False
            if edge and before < 0:
                known = True
            elif edge:
                known = not any(m[0] < dx and m[0] <= dy for x, dx in self.edges(before)[1] for y, dy in edge[0] if (m := self.merges.get((x, y))))
            if len(self.joins) > CACHE_JOINS:
                self.joins.clear()
            self.joins[key] = known
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, str]:
        """Each word's ids, joined by spaces. In ascending order words go depth-first through their trie: tokens[d] and sizes[d]
        are the last token of the first d characters and its length, kept as far as the next word shares them. A state is
        found when a token behind it asks for it, so of a node's ancestors only those where tokens may end are visited."""
        inner, final, joins, stands = self.inner, self.final, self.joins, self.stands
        (inner_sizes, final_sizes), text, out = self.sizes, self.text, {}
        tokens, sizes, path, word = [-1], [0], "", ""

        def last(n: int) -> int:
            for size in inner_sizes.get(word[n - 3 : n], SHORT) if n > 2 else SHORT:
                at = n - size
                if at >= 0 and (t := inner.get(word[at:n])) is not None:
                    before = tokens[at]
                    key = last(at) if before is None else before, t
                    if joins[key] if key in joins else stands(*key):
                        tokens[n], sizes[n] = t, size
                        return t
            raise ValueError(f"no token ends {word[:n]!r}")

        for word in sorted(words):
            n, same = len(word), 0
            for a, b in zip(path, word):
                if a != b:
                    break
                same += 1
            # The last character of the word before was no inner one.
            del tokens[same + 1 :], sizes[same + 1 :]
            tokens += [None] * (n - same)
            sizes += [0] * (n - same)
            path = word
            if n > DEEP:
                for d in range(1, n):
                    if tokens[d] is None:
                        last(d)
            for size in final_sizes.get(word[-3:], SHORT):
                at = n - size
                if at >= 0 and (t := final.get(word[at:])) is not None:
                    before = tokens[at]
                    key = last(at) if before is None else before, t
                    if joins[key] if key in joins else stands(*key):
                        break
            else:
                raise ValueError(f"no token ends {word!r}")
            ids = [text[t]]
            while at:
                ids.append(text[tokens[at]])
                at -= sizes[at]
            ids.reverse()
            out[word] = " ".join(ids)
        return out

    def split(self, run: str) -> list[str]:
        """The words of a lower-case run of plain characters without white space, as keys of `runs`."""
        word = run.rstrip(MARKS)
        if word.isalpha():
            words = [run] if len(word) == len(run) else [word, run[len(word) :]]
        else:
            words = WORDS.findall(run)
        return words if run.isascii() else [w if w.isascii() else " " + w.encode().decode("latin-1") for w in words]

    def runs_of(self, text: str) -> list[str]:
        """What a text without special tokens consists of, as keys of `runs`: no word crosses white space. Texts beyond
        the plain characters are normalised and split by the library. A leading space marks a word in bytes."""
        if PLAIN.match(text):
            return text.lower().split()
        normal = self.library.normalizer.normalize_str(text)
        return [" " + "".join(map(self.alphabet.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def learn(self, runs: set[str]) -> None:
        """Adds the ids of new runs. A full cache becomes the older one, from which runs come back as they are met, so the
        size of both is bounded and frequent runs stay."""
        if len(self.runs) > self.most:
            self.runs, self.older = {}, self.runs
            new = runs
        else:
            new = runs.difference(self.runs)
        known, older, split, words, marked = self.runs, self.older, {}, {}, []
        for r in new:
            if r in older:
                known[r] = older[r]
            elif r[0] == " ":
                words[r] = r[1:]
            elif (word := r.rstrip(MARKS)).isalpha():
                words[word] = word if word.isascii() else word.encode().decode("latin-1")
                if len(word) < len(r):
                    marks = r[len(word) :]
                    words[marks] = marks
                    marked.append((r, word, marks))
            else:
                split[r] = ws = self.split(r)
                words.update([(w, w[1:] if w[0] == " " else w) for w in ws])
        for w in words.keys() & known.keys():
            del words[w]
        coded = self.encode_words(set(words.values()))
        known.update([(key, coded[w]) for key, w in words.items()])
        known.update([(r, f"{known[word]} {known[marks]}") for r, word, marks in marked])
        known.update([(r, " ".join([known[w] for w in ws])) for r, ws in split.items()])

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text in decimal, joined by spaces. Strings of special tokens give their ids."""
        parts = [self.special.split(t) if self.special and "<|" in t else [t] for t in texts]
        split = [[self.runs_of(p) for p in ps[::2]] for ps in parts]
        runs = set().union(*(r for rs in split for r in rs))
        if not runs.issubset(self.runs):
            self.learn(runs)
        out = []
        for ps, rs in zip(parts, split):
            ids = [" ".join(map(self.runs.__getitem__, r)) for r in rs]
            for k, special in enumerate(ps[1::2]):
                ids.insert(2 * k + 1, self.specials[special])
            out.append(" ".join(filter(None, ids)))
        return out

    def decode(self, ids: str) -> str:
        """Without a decoder in its file the library joins the tokens with spaces; so does this."""
        return " ".join(map(self.token.__getitem__, ids.split(" "))) if ids else ""


_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One for each worker process and file; its word caches are bounded by twice `most` and a batch."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def pieces(texts: Iterable, chars: int = 2_000_000) -> Iterator[list[int]]:
    """Row numbers in runs of about `chars` characters, so that a run's words stay small in memory."""
    run, n = [], 0
    for k, text in enumerate(texts):
        run.append(k)
        n += len(text)
        if n >= chars:
            yield run
            run, n = [], 0
    if run:
        yield run


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False, stays: bool = False) -> DataFrame:
    """Encodes and decodes every whole text. With `stays` a worker process keeps the tokenizer for its next task, with up to
    twice KEPT_WORDS words.

    One row for each row of `docs`: doc_id, n_tokens, the SHA-256 of the decimal ids joined by spaces and of the decoded
    text; with `with_ids` also both as `ids` and `decoded`. Null texts count as empty: no tokens. Other columns are left
    behind; an empty table gives an empty result.
    """
    more = ", ids string, decoded string" if with_ids else ""

    def run(batches):
        bpe = tokenizer(path)
        bpe.most = KEPT_WORDS if stays else CACHE_WORDS
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for rows in pieces(texts):
                ids = bpe.encode([texts[k] for k in rows])
                back = [bpe.decode(x) for x in ids]
                cols = [
                    batch.column(0).take(pa.array(rows)),
                    pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
                    *([pa.array(ids), pa.array(back)] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])
        # A worker process goes on to other stages, which need the memory.
        del bpe
        if not stays:
            _LOADED.clear()
            released()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}"
    return id_and_text(docs).mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), stays=True)


QUERIES = {"op5_bpe": op5_bpe}
SQL: dict[str, str] = {}
