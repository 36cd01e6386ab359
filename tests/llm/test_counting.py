"""Language-model scores, periodic runs and collocations against brute force, and on odd rows."""

import hashlib
import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from assayline.llm import catalog, collocations, periodic, suffix_tree

pytest.importorskip("public_tokenizers")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    None, "", " \n\t ", "one", "a a a a a a a", "x y x y x y x y z", "One TWO one two one two one two one two", "é É é É é É é É é",
    "a b c. a b c! a b c? a b, c", "a\x1cb a\x1cb", "na " * 400, "the cat. " * 30, "the cat sat, " * 30,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], "x") for i, t in enumerate(TEXTS)]
    rows += [(4, "a a a a a a a", "en", "again"), (None, "a b a b a b a b", None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, score string")


# ---- periodic runs


def runs_by_brute_force(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            smallest = not any(all(words[k] == words[k + r] for k in range(i, j + q - r)) for r in range(1, q))
            if j + q - i >= max(6, 4 * q) and smallest:
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def without_repeats(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(300):
        texts = []
        for _ in range(rng.integers(1, 5)):
            words = [chr(97 + c) for c in rng.integers(0, rng.integers(1, 5), rng.integers(0, 50))]
            if len(words) > 3 and rng.random() < 0.5:
                a, p = int(rng.integers(0, len(words))), int(rng.integers(1, 5))
                words = [w if i < a else words[min(a + (i - a) % p, len(words) - 1)] for i, w in enumerate(words)]
            texts.append(words)
        got = list(periodic.runs_and_rest([" ".join(w).encode() for w in texts]))
        for words, (runs, rest) in zip(texts, got):
            expected = runs_by_brute_force(words)
            assert [tuple(r.values()) for r in runs] == expected
            assert rest.decode() == without_repeats(words, expected)


def test_periodic_query(spark, folder):
    got = {r["doc_id"]: tuple(r)[1:] for r in catalog.QUERIES["op12_periodic_runs"](spark, folder).collect()}
    for doc in spark.read.parquet(f"{folder}/documents.parquet").collect():
        words, h = (doc["text"] or "").encode().split(), zlib.crc32(str(doc["doc_id"]).encode())
        words, n, g = [w.decode() for w in words], len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        (found, rest), = periodic.runs_and_rest([" ".join(words).encode()])
        runs = [tuple(r.values()) for r in found]
        if n < 150:
            assert runs == runs_by_brute_force(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        sha = [hashlib.sha256(x).hexdigest() for x in (listed.encode(), rest)]
        assert got[doc["doc_id"]] == (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def test_runs_of_odd_tables(docs, nothing):
    found = periodic.periodic_runs(docs, "text", ("doc_id", "text")).collect()
    assert len(found) == docs.count()
    for r in found:
        words = (r["text"] or "").encode().split()
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == runs_by_brute_force(words)
    assert periodic.periodic_runs(nothing).count() == 0


def test_long_texts_of_one_word():
    (runs, rest), = periodic.runs_and_rest([b"na " * 100_000])
    assert [tuple(r.values()) for r in runs] == [(0, 100_000, 1)] and rest == b"na"


# ---- collocations


def phrases_by_brute_force(rows, least, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for cut in ".,;:!?\x0b\x0c\r":
            text = (text or "").translate(A_TO_Z).replace(cut, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for (lang, *phrase), a in counts.items():
        phrase = tuple(phrase)
        if len(phrase) == 1 or a < least:
            continue
        holders = [b for (other, *p), b in counts.items() if other == lang and len(p) == 3 > len(phrase) and b >= least and phrase in (tuple(p[:2]), tuple(p[1:]))]
        if any(100 * b >= 50 * a for b in holders):
            continue
        cuts = [(math.floor(Fraction(1_000_000 * a * a, counts[lang, *phrase[:k]] * counts[lang, *phrase[k:]])), k) for k in range(1, len(phrase))]
        score, k = min(cuts)
        out.append((lang, " ".join(phrase), a, counts[lang, *phrase[:k]], counts[lang, *phrase[k:]], totals[lang], score))
    ranked = []
    for lang in totals:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(best, 1)]
    return sorted(ranked)


@pytest.mark.parametrize("burst, most", [(4096, 1 << 19), (3, 20)])
def test_collocations_equal_brute_force(spark, docs, monkeypatch, burst, most):
    monkeypatch.setattr(collocations, "BURST", burst)
    rng = np.random.default_rng(4)
    words = ["the", "cat", "sat", "On", "é", "mat.", "a\x01", "end!\n"]
    rows = [(" ".join(rng.choice(words, 60)), ["en", "fr", None][i % 3]) for i in range(40)]
    rows += [(r["text"], r["lang"]) for r in docs.collect()]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    for least, top in ((3, 5), (10, 2000)):
        got = sorted(tuple(r) for r in collocations.collocations(df, least=least, top=top, most=most).collect())
        assert got == phrases_by_brute_force(rows, least, top)


def test_subtrees_are_spilled_whole(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 2)
    trie = collocations.HatTrie()
    trie.add(np.array([1, 2, 3, 1, 2, 4, 1, 5, 6, 2, 0, 0]))
    assert type(trie.root[1]) is collocations.Burst and trie.entries == 10
    assert trie.largest(0.1) == [1] or len(trie.root[2]) >= 3
    before = trie.entries
    first, keys, counts = trie.take([1])
    assert set(first) == {1} and counts.sum() == 3 and trie.entries == before - len(keys) and 1 not in trie.root


def test_collocations_of_odd_tables(nothing, spark):
    assert collocations.collocations(nothing).count() == 0
    once = spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")
    assert collocations.collocations(once).count() == 0
    huge = spark.createDataFrame([(5_000_000_000, 6_000_000_000, 7_000_000_000)], "a long, l long, r long")
    exact = huge.select(collocations._score(huge["a"], huge["l"], huge["r"]).alias("s")).first()["s"]
    assert exact == 1_000_000 * 5_000_000_000**2 // (6_000_000_000 * 7_000_000_000)


# ---- language model


def test_language_model_query(spark, folder):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op11_lm_scoring"](spark, folder).collect()}
    docs = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b""] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held_out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    counts = Counter(w for d, words in docs.items() if not held_out[d] for w in words)
    n, v = sum(counts.values()), len(counts)
    gains = []
    for d, words in docs.items():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out[d], len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-12)
        if held_out[d]:
            gains.append(r["score"] - r["base_score"])
    assert sum(gains) > 0


@pytest.fixture(scope="module")
def patterned(spark):
    rng = np.random.default_rng(6)
    verses = ["red fish swims home", "the old man sleeps", "the old dog barks", "left turn north", "right turn south"]
    rows = [(i, " ".join(rng.choice(verses, 6))) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_probabilities_add_up_to_one(patterned):
    model, _ = suffix_tree.train(patterned)
    every = np.arange(len(model.counts))  # number 0 stands for one unknown word
    assert len(model.two.keys) and (model.two.rest > 0).any() and (model.one.rest > 0).any()
    histories = {(int(k) >> 17, int(k) & ((1 << 17) - 1)) for k in model.two.keys} | {(0, c) for c in range(model.contexts + 1)}
    for second, first in histories:
        own, rest = model.probabilities(np.full(len(every), second), np.full(len(every), first), every)
        assert (own + rest * model.root(every)).sum() == pytest.approx(1.0, abs=1e-9)


def test_longer_contexts_predict_better(patterned, spark):
    model, words = suffix_tree.train(patterned)
    probe = spark.createDataFrame(
        [(1, "the old man sleeps"), (2, "sleeps man old the"), (3, "never seen before"), (4, None), (5, "left turn north"), (6, "left turn south")],
        "doc_id long, text string",
    )
    got = {r["doc_id"]: r for r in suffix_tree.scored(probe, model, words).collect()}
    assert got[1]["score"] > got[2]["score"] and got[1]["score"] > got[1]["base_score"]
    assert got[5]["score"] > got[6]["score"] + 1 and got[5]["base_score"] == pytest.approx(got[6]["base_score"], abs=0.2)
    assert got[3]["n_known"] == 1 and got[4]["n_tokens"] == 1


def test_texts_taken_twice_have_the_same_candidates(patterned):
    few = patterned.where("doc_id < 6")
    once, twice = (suffix_tree.train(docs)[0] for docs in (few, few.union(few)))
    assert once.contexts == twice.contexts == len(once.hashes)  # so few tokens that a single occurrence is enough
    assert once.two.keys.tolist() == twice.two.keys.tolist()


def test_rare_words_have_their_own_counts(patterned, spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"red fish w{i % 50} swims") for i in range(200)], "doc_id long, text string")
    whole, words = suffix_tree.train(texts)
    expected = {r["doc_id"]: r["base_score"] for r in suffix_tree.scored(texts, whole, words).collect()}
    monkeypatch.setattr(suffix_tree, "LEAST_WORD", 10)  # the numbered words are no longer frequent
    model, words = suffix_tree.train(texts)
    got = {r["doc_id"]: r for r in suffix_tree.scored(texts, model, words).collect()}
    assert len(model.hashes) < len(whole.hashes)
    assert all(r["base_score"] == pytest.approx(expected[d]) and r["n_known"] == 5 for d, r in got.items())


def test_language_model_of_odd_tables(docs, nothing):
    model, words = suffix_tree.train(docs)
    assert suffix_tree.scored(docs, model, words).count() == docs.count()
    empty, none = suffix_tree.train(nothing)
    assert {r["score"] for r in suffix_tree.scored(docs, empty, none).collect()} == {0.0}
    assert suffix_tree.scored(nothing, model, words).count() == 0


def scores_by_brute_force(learnt, texts):
    """log10 probabilities by the tree of all contexts of one and two words."""
    tokens = lambda text: [*(text or "").encode().lower().split(), b""]
    roots, entries = Counter(), {}
    for words in map(tokens, learnt):
        history = [None, b"", *words]
        for i, word in enumerate(words):
            roots[word] += 1
            for context in [(history[i + 1],), (history[i], history[i + 1])][: 1 if i == 0 else 2]:
                entries.setdefault(context, Counter())[word] += 1
    total = sum(roots.values()) + len(roots) + 1

    def chance(context, word, stays):
        if not context:
            return (roots[word] + 1) / total
        below = chance(context[1:], word, stays)
        if context not in entries or not stays(context):
            return below
        n = entries[context]
        return (max(n[word] - 0.5, 0) + 0.5 * len(n) * below) / sum(n.values())

    def gains(context):
        n = entries[context]
        every = [(k, chance(context, w, lambda c: True), chance(context[1:], w, lambda c: True)) for w, k in n.items()]
        return sum(k * math.log(a / b) for k, a, b in every) >= 0.02 * sum(n.values())

    states = {c for c in entries if gains(c)}
    states |= {c[1:] for c in states if len(c) == 2}
    out = []
    for words in map(tokens, texts):
        history = [None, b"", *words]
        out.append(sum(math.log10(chance((history[i], history[i + 1])[i == 0 :], w, states.__contains__)) for i, w in enumerate(words)))
    return out, states


@pytest.mark.parametrize("kind", ["verses", "chance", "lengths"])
@pytest.mark.parametrize("limits", [{}, {"WORD_BITS": 3, "GROUP": 64, "HOT": 20, "BUFFER": 100, "REMEMBERED": 5}, {"WORD_BITS": 4, "GROUP": 32, "GROUPS": 5, "HOT": 20, "BUFFER": 100}])
def test_scores_equal_brute_force(spark, monkeypatch, kind, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffix_tree, name, value, raising=False)
    rng = np.random.default_rng(8)
    if kind == "verses":
        verses = ["red fish swims home", "the old man sleeps", "The old dog barks", "left turn north", "right turn south"]
        rows = [(i, " ".join([*rng.choice(verses, 12), f"w{i % 40}", f"once{i}"])) for i in range(150)]
    else:
        rows = [(i, " ".join(rng.choice(["a", "b"], 12 if kind == "lengths" else rng.geometric(1 / 12) - 1))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "never seen"), (1002, "never seen"), (None, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = suffix_tree.held_out()
    held_out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    expected, states = scores_by_brute_force([t for d, t in rows if not held_out(d)], [t for _, t in rows])
    assert ((b"a",) in states) == (kind == "lengths")  # by chance "a" fails the test; with lengths it fails, but a longer context stays
    model, counts = suffix_tree.train(docs.where(~kept))
    found = [suffix_tree.scored(docs, model, counts)]
    found += [suffix_tree.scored(docs, model, counts, learnt=~kept)] if hasattr(suffix_tree, "states") else []
    for df in found:
        got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["score"]) for r in df.collect())
        wanted = sorted(((d is None, d or 0), s) for (d, _), s in zip(rows, expected))
        assert [d for d, _ in got] == [d for d, _ in wanted]
        assert [s for _, s in got] == pytest.approx([s for _, s in wanted], rel=1e-9, abs=1e-9)


def test_texts_that_occur_twice_are_told_apart(spark):
    rng = np.random.default_rng(9)
    vocabulary = np.array([f"w{k}" for k in range(300)])
    texts = [" ".join(rng.choice(vocabulary, 220)) for _ in range(10_000)]  # over two million tokens
    rows = [*enumerate(texts), *enumerate(texts[:25], len(texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model, words = suffix_tree.train(docs)
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in suffix_tree.scored(docs, model, words).collect()}
    twice = {*range(25), *range(len(texts), len(rows))}
    assert min(got[d] for d in twice) > max(s for d, s in got.items() if d not in twice)


def test_columns_travel_unchanged():
    for column in ([], [0], [0, 0], [5, 1 << 40, -3], list(range(300)), [0.5, -1e300]):
        x = np.array(column, "float64" if 0.5 in column else "int64")
        (got, other) = suffix_tree.unpacked(suffix_tree.packed(x, x[:1]))
        assert got.tolist() == x.tolist() and other.tolist() == x[:1].tolist()
