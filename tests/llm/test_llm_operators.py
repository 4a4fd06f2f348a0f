"""Each operator on a small table with nulls, empty, long, equal and repeated texts, and columns whose names clash."""

import hashlib
import pickle
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from lumora.llm import bpe, decontamination, lm_scoring, ngram_join, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, n_words long, node long, label int, pack long, score double"


def corpus():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdeé ño'") for _ in range(rng.randint(2, 7))).strip() or "x" for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = make(120)
    near = base.split()
    near[7] = "changed"
    rows = [None, "", "  \n", "One two", "one TWO", base, base, " ".join(near), make(60) + "\n" + base[:300] + "\n" + make(40), make(5000), "a" * 3000, "ab " * 400, "<|endoftext|> x <|startoftext|>"]
    rows += [make(rng.randint(1, 200)) for _ in range(25)] + ["line here again\n" * 9]
    return [(k, t) for k, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, 7, 7, 7, 7, 0.5) for k, t in corpus()], CLASH).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def by_id(df):
    rows = {r.doc_id: r for r in df.collect()}
    assert len(rows) == len(corpus())
    return rows


def test_rules(docs, empty):
    got = by_id(quality_rules.apply_rules(docs))
    for k, t in corpus():
        words = WORD.findall(t or "")
        wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        marked = {j for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (got[k].n_words, got[k].word_chars, got[k].n_repeat_words) == (len(words), sum(map(len, words)), len(marked))
        assert got[k].base_failed == (len(words) < 20 or 100 * len(marked) > 30 * len(words))
    assert quality_rules.apply_rules(empty).count() == 0


def test_classifier(docs, empty):
    got = by_id(quality_classifier.classify(docs))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5].score == got[6].score
    assert quality_classifier.without_rejected(docs).columns == docs.columns
    assert quality_classifier.classify(empty).count() == 0


def test_classifier_agrees_with_held_out_labels(spark):
    got = quality_classifier.op2_quality_classifier(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = got.join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in both) / len(both) > 0.97


def test_classifier_reads_whole_words():
    heaviest = lambda w: max((f := quality_classifier.features(w)), key=f.get)
    assert heaviest("a" * 64) != heaviest("a" * 64 + "1" * 9)
    long, other = "a1" * 100, "a1" * 99 + "-B"
    pieces = [{at for at, x in quality_classifier.features(w).items() if x != 1.0} for w in (long, other)]
    assert len(pieces[0] | pieces[1]) > len(pieces[0]) > 1


def test_decontamination(spark, docs, empty):
    words = corpus()[5][1].split()
    changed = [*words[30:60]]
    changed[9] = "other"
    items = spark.createDataFrame([(1, " ".join(changed)), (2, None), (3, ""), (4, "not in any of these texts at all here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_passages(docs, items).collect()}
    assert {(5, 1), (6, 1), (7, 1)} <= got and all(i == 1 for _, i in got)
    assert decontamination.without_passages(docs, items).count() == len(corpus()) - len(got)
    assert decontamination.find_passages(empty, items).count() == 0
    assert decontamination.find_passages(docs, items.limit(0)).count() == 0


def test_decontamination_of_marks_and_short_items(spark):
    items = ["1 , 2 , 3 , 4 , 5 , 6", "wait... what?! ,foo goes , ... on", "Which one?", "什么是机器学习?", "5年 计划"]
    texts = [f"so it {items[0]} ends", f"then {items[1]} and on", "see which one, then", "he said (which one)", "他问 他:什么是机器学习?后来", "第15年计划", "第5年 计划", ", , ."]
    found = decontamination.find_passages(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string"),
    ).collect()
    assert {tuple(r) for r in found} == {(0, 0, 2, 11, 0), (1, 1, 1, 7, 0), (2, 2, 1, 2, 0), (4, 3, 1, 1, 0), (6, 4, 0, 2, 0)}


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.4:
            words[at] = f"zz{rng.randrange(99)}"
        elif kind < 0.7 and len(words) > 2:
            del words[at]
        else:
            words.insert(at, f"zz{rng.randrange(99)}")
    return words


def test_decontamination_recall_against_exhaustive_search():
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([5, 8, 12, 20, 40] * 6)]
    block, wanted, found = decontamination.Block(items), set(), set()
    for t in range(120):
        words = items[t % 30][1].split()
        middle = edited(words, int(0.2 * len(words)) + t % 2, rng)
        text = [rng.choice(vocab) for _ in range(30)] + middle + [rng.choice(vocab) for _ in range(30)]
        x = block.symbols(text)
        wanted |= {(t, k) for k, s, edits in block.items if decontamination.align(s, x)[0] <= edits}
        found |= {(t, f[0]) for f in block.find(" ".join(text))}
    assert found <= wanted and len(found) >= 0.99 * len(wanted) and len(wanted) > 60


def test_decontamination_tables_stay_small():
    rng = random.Random(2)
    items = [(k, " ".join(f"w{rng.randrange(20000)}" for _ in range(5 + k * 394 // 299))) for k in range(300)]
    assert len(pickle.dumps(decontamination.Block(items))) < 100_000_000


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, shards=4).collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 4
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    text = dict(corpus())
    assert all((r.size, r.text_crc32) == (len((text[r.doc_id] or "").encode()) + 16, zlib.crc32((text[r.doc_id] or "").encode())) for r in rows)
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_by_propagation(spark):
    # 150 families of six different texts, tied by common ends; without links or rounds they lie apart.
    texts = [f"{'begin' if m < 4 else 'other'} {k} ".ljust(70, ".") + f"{k} {m} middle" + f" end {k} {m if m < 3 else 3}".rjust(70, ".") for k in range(150) for m in range(6)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3)

    def pairs(**how):
        rows = sharding.shard_documents(docs, shards=6, **how).collect()
        assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(6) for k in range(150)]
        of = {r.doc_id: r.shard for r in rows}
        return sum(of[6 * k + i] == of[6 * k + j] for k in range(150) for i in range(6) for j in range(i))

    moved, drawn = pairs(), pairs(rounds=0)
    unlinked = pairs(links=lambda nodes: nodes.limit(0).selectExpr("node AS src", "node AS dst"))
    assert moved > 2 * drawn and moved > 2 * unlinked


def test_sharding_keeps_thousands_of_copies_together(spark):
    texts = ["copied"] * 2500 + ["over a shard"] * 4000 + [f"group {k}" for k in range(200) for _ in range(5)] + [f"single {k}" for k in range(4500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = sharding.shard_documents(docs, shards=4).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(4) for k in range(3000)]
    of = {}
    for r in rows:
        of.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert {t: len(s) for t, s in of.items() if len(s) > 1} == {"over a shard": 2}


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = bpe.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = by_id(bpe.encode_decode(docs, path, with_ids=True))
    for k, t in corpus():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k].ids == " ".join(map(str, ids)) and got[k].n_tokens == len(ids)
        assert got[k].decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty, path).count() == 0


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_dedup.grouped_suffixes(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_arrays_side_by_side():
    rng = random.Random(2)
    strings = [[rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 60))] + [0] for _ in range(400)] + [[1] * 200 + [0], [1, 2] * 90 + [0]]
    cuts = np.cumsum([0, *map(len, strings)])
    want = [a + i for a, s in zip(cuts.tolist(), strings) for i in sorted(range(len(s)), key=lambda i: s[i:])]
    assert suffix_dedup.grouped_suffixes_of(np.concatenate(strings), cuts).tolist() == want


def test_least_document_of_each_window(monkeypatch):
    rng = random.Random(5)
    segments = sorted({(rng.randint(0, 5), bytes(rng.choice(b"ab") for _ in range(rng.randint(4, 30)))) for _ in range(60)} | {(9, b"alone")})
    size = np.array([len(x) for _, x in segments])
    doc = np.array([rng.randint(0, 20) for _ in segments])
    data, offset, anchor = np.frombuffer(b"".join(x for _, x in segments), np.uint8), np.cumsum(size) - size, np.array([a for a, _ in segments])
    want = [min(d for (b, y), d in zip(segments, doc.tolist()) if a == b and x[k : k + 4] in y) for a, x in segments for k in range(len(x) - 3)]
    for long in (1 << 13, 100):
        monkeypatch.setattr(suffix_dedup, "LONG", long)
        assert suffix_dedup.least_by_window(data, offset, size, anchor, doc, 4).tolist() == want


def test_strings_of_a_common_anchor_are_divided(monkeypatch):
    rng = random.Random(6)
    common = bytes(rng.choice(b"abcdef") for _ in range(20))
    sides = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(12)]
    segments = sorted({rng.choice(sides)[rng.randint(0, 9) :] + common + rng.choice(sides)[: rng.randint(12, 40)] for _ in range(400)})
    size = np.array([len(x) for x in segments])
    doc = np.array([rng.randint(0, 999) for _ in segments])
    least = {}
    for x, d in zip(segments, doc.tolist()):
        for k in range(len(x) - 49):
            least[x[k : k + 50]] = min(d, least.get(x[k : k + 50], d))
    want = [least[x[k : k + 50]] for x in segments for k in range(len(x) - 49)]
    built, real = [], suffix_dedup.least_by_window
    monkeypatch.setattr(suffix_dedup, "least_by_window", lambda *a: built.append(a) or real(*a))
    data, offset, anchor = np.frombuffer(b"".join(segments), np.uint8), np.cumsum(size) - size, np.zeros(len(segments), np.uint64)
    assert suffix_dedup.least_divided(data, offset, size, anchor, doc).tolist() == want
    ((_, _, sizes, anchors, _, _),) = built
    # One string of all segments before; now none is long.
    assert int(size.sum()) > 20_000 > 20 * max(Counter(np.repeat(anchors, sizes).tolist()).values())
    long = suffix_dedup.PARTS[:1]
    assert suffix_dedup.least_divided(data, offset, size, anchor, doc, 50, long).tolist() == want
    alone = suffix_dedup.least_divided(data, offset, size, np.arange(len(segments), dtype=np.uint64), doc)
    assert alone.tolist() == np.repeat(doc, size - 49).tolist()


def test_bucket_of_very_many_packs():
    # Each pack's answer is cut out of one sorted list. Where each scans all anchors of the bucket, this takes far longer.
    packs = list(range(12_000))
    blobs = [substring_dedup.pressed(np.array([2 * p, 2 * p + 24_000, *range(10**6 + 200 * p, 10**6 + 200 * p + 160, 2)], "<u8")) for p in packs]
    blobs[7] = substring_dedup.pressed(np.array([2 * 6, 61_001], "<u8"))
    began = time.process_time()
    got = substring_dedup._shared(packs, blobs)
    assert time.process_time() - began < 4
    assert {p: substring_dedup.unpressed(b, "<u8")[0].tolist() for p, b in got.items() if p in (6, 7)} == {6: [6], 7: [6, 30_500]}


def test_suffix_dedup(docs, empty):
    got, seen = by_id(suffix_dedup.remove_repeats(docs)), set()
    for k, t in corpus():
        b = (t or "").encode()
        own = [b[i : i + 50] for i in range(len(b) - 49)]
        gone = {j for i, w in enumerate(own) if w in seen for j in range(i, i + 50)}
        seen.update(own)
        kept = bytes(x for j, x in enumerate(b) if j not in gone)
        assert (got[k].n_removed, bytes(got[k].kept)) == (len(gone), kept)
        assert got[k].n_spans == sum(j - 1 not in gone for j in gone)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup(docs, empty):
    got, seen = by_id(substring_dedup.remove_repeats(docs)), set()
    for k, t in corpus():
        words = WORD.findall(t or "")
        own = [tuple(words[i : i + 13]) for i in range(len(words) - 12)]
        gone = {j for i, w in enumerate(own) if w in seen for j in range(i, i + 13)}
        seen.update(own)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_ngram_join(docs, empty):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = {}
    for k, t in corpus():
        w = WORD.findall((t or "").translate(low))
        sets[k] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if r == old else r for k, r in root.items()}
    got = by_id(ngram_join.link_documents(docs)[1])
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {k: (len(sets[k]), root[k]) for k in sets}
    assert root[7] == 5 and ngram_join.link_documents(empty)[1].count() == 0


def test_ngram_links_are_counted_inside_components(spark):
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(120)]
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(0, 120, 20)] + [" ".join(base)] * 3 + [" ".join(base[:110])]
    texts += [" ".join(str(rng.random()) for _ in range(40)), "", None, "alone", "alone"]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()} for w in ((t or "").split() for t in texts)]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.link_documents(docs, every=True)[1].collect()}
    plain = {r.doc_id: r.component_id for r in ngram_join.link_documents(docs)[1].collect()}
    assert {k: c for k, (c, _) in got.items()} == plain
    assert {k: n for k, (_, n) in got.items()} == {k: sum(plain[a] == plain[k] for a, _ in links) for k in plain}
    assert got[0][1] > 20


def test_one_of_each_with_repeated_and_null_ids(spark):
    import corpus_pipeline

    rng = random.Random(3)
    a, b, c, d, e = (" ".join(str(rng.random()) for _ in range(30)) for _ in range(5))
    rows = [(1, a), (1, b), (2, a), (None, b), (3, ""), (3, ""), (None, c), (None, c), (None, d), (4, d), (7, e), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text or "") for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    want = [(1, a), (1, b), (None, b), (3, ""), (3, ""), (None, c), (None, c), (None, d), (4, d), (7, e), (None, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    path = bpe.vocabulary("byte_bpe_50k.json")
    library, start = Tokenizer.from_file(path), 0
    manifest = token_files.write_token_files(docs, path, sequence=64)
    got = by_id(token_files.read_token_files(manifest))
    flat = []
    for k, t in corpus():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        flat += ids.tolist()
    block = manifest.orderBy("block").first()
    store, _ = token_files._store(block.path.rsplit("/", 1)[0])
    ids, mask = token_files.BlockReader(store, block.path).sequence_at(1)
    assert ids.tolist() == flat[64:128] and all(mask.to_pylist())
    assert token_files.read_token_files(token_files.write_token_files(empty, path)).count() == 0


def test_lm_scoring(docs, empty):
    got = by_id(lm_scoring.score_documents(docs))
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    tokens = {k: [*WORD.findall((t or "").translate(low)), "\n"] for k, t in corpus()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    c = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    total = sum(c.values())
    for k, ws in tokens.items():
        base = sum(np.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in ws)
        assert (got[k].held_out, got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (held[k], len(ws), sum(w in c for w in ws), total)
        assert abs(got[k].base_score - base) < 1e-6 and got[k].score < 0
    assert lm_scoring.score_documents(empty).count() == 0


def test_null_and_repeated_ids(spark):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(80))
    rows = [(1, text), (1, text), (1, text + " more"), (None, text), (None, None), (None, "other"), (2, ""), (2, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = {
        "rules": quality_rules.apply_rules(docs),
        "classifier": quality_classifier.classify(docs),
        "sharding": sharding.shard_documents(docs, shards=3),
        "bpe": bpe.encode_decode(docs, bpe.vocabulary("word_bpe_49k.json")),
        "bytes": suffix_dedup.remove_repeats(docs),
        "words": substring_dedup.remove_repeats(docs),
        "join": ngram_join.link_documents(docs)[1],
        "scores": lm_scoring.score_documents(docs),
    }
    want = Counter(k for k, _ in rows)
    got = {name: df.collect() for name, df in made.items()}
    assert {name: Counter(r.doc_id for r in rs) for name, rs in got.items()} == dict.fromkeys(made, want)
    # A null id counts as greater than all others, so it loses what document 1 has; equal ids lose nothing to each other.
    assert sorted((r.doc_id or 0, r.n_removed) for r in got["words"]) == [(0, 0), (0, 0), (0, 80), (1, 0), (1, 0), (1, 0), (2, 0), (2, 0)]
    assert {r.component_id for r in got["join"] if r.n_shingles > 10} == {1}


def test_bpe_states_are_found_only_where_asked_for():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return dict.get(self, *a)

    coder, rng = bpe.WordBpe(bpe.vocabulary("word_bpe_49k.json")), random.Random(4)
    coder.inner = Counted(coder.inner)
    parts = ["the", "in", "er", "an", "qu", "tion", "ea", "st", "w", "x", "bl", "ou"]
    words = {"".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(2000)} | {"thea" * 80}
    for word, ids in coder.encode_words(words).items():
        assert ids == " ".join(map(str, coder.library.encode(word, add_special_tokens=False).ids))
    assert Counted.asked < sum(map(len, words))


def test_bpe_cache_is_bounded_and_keeps_what_is_met_again():
    coder = bpe.WordBpe(bpe.vocabulary("word_bpe_49k.json"))
    coder.most = 40
    for k in range(30):
        text = "The common words, again; don't " + " ".join(f"w{k}x{j}é" for j in range(20))
        assert coder.encode([text]) == [" ".join(map(str, coder.library.encode(text, add_special_tokens=False).ids))]
    assert len(coder.runs) + len(coder.older) < 2 * (40 + 150) and "again;" in coder.runs


@pytest.mark.parametrize("scale", [1, 100])
def test_lm_scores_many_states_at_once_and_as_step_by_step(monkeypatch, scale):
    rng, model = np.random.default_rng(3), lm_scoring.Gru()
    texts = [rng.integers(0, lm_scoring.CLASSES, n) for n in (1, 40, 16, 17, 333)]
    calls, real = [], lm_scoring.Gru.exps
    monkeypatch.setattr(lm_scoring.Gru, "exps", lambda self, h: calls.append(len(h)) or real(self, h))
    model.train(texts)
    model.p["V"] *= scale
    got = model.log10(texts)
    # 333 steps for each of the two, in windows of 16.
    assert len(calls) <= 2 * -(-333 // lm_scoring.WINDOW) and max(calls) > len(texts)
    p, size = {k: x.astype(float) for k, x in model.p.items()}, lm_scoring.HIDDEN
    for text, score in zip(texts, got):
        h, prev, want = np.zeros(size), lm_scoring.CLASSES, 0.0
        for c in text:
            x, g = p["X"][prev], h @ p["U"]
            z, r = (1 / (1 + np.exp(-(x[k : k + size] + g[k : k + size]))) for k in (0, size))
            n = np.tanh(x[2 * size :] + r * g[2 * size :])
            h, prev = n + z * (h - n), c
            s = h @ p["V"] + p["b"]
            want += s[c] - s.max() - np.log(np.exp(s - s.max()).sum())
        assert score == pytest.approx(want / np.log(10), rel=1e-4)


def test_lm_gradients_lower_the_loss():
    model, text = lm_scoring.Gru(), np.tile(np.arange(5), 200)
    before = model.log10([text])[0]
    for _ in range(4):
        model.train([text] * 8)
    assert model.log10([text])[0] > 0.1 * before


def test_token_file_runs_stay_through_a_full_cache(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_RUNS", 50)
    coder = token_files.ByteBpe(bpe.vocabulary("byte_bpe_50k.json"))
    sent, real = [], coder._raw
    monkeypatch.setattr(coder, "_raw", lambda tokens: sent.extend(tokens) or real(tokens))
    texts = ["x" + "".join(f" common{c}" for c in "abcdefgh"), "x" + "".join(f" filler{a}{b}" for a in "abcdefgh" for b in "abcdefgh"), "x other"]
    for text in [texts[0], texts[1], texts[2], texts[0]]:
        assert coder.encode([text]) == [np.array(coder.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert sum(t.startswith(" common") for t in sent) == 8 and len(coder.runs) < 50
