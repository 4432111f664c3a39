"""Class-based language model, divergence audit and vector codes against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tastegrid.llm import classlm, divergence, triecodes

# --- class-based language model --------------------------------------------------------


def likelihood_of(classes, text, c):
    pairs = np.zeros((c, c), np.int64)
    np.add.at(pairs, (classes[text[:-1]], classes[text[1:]]), 1)
    return classlm.likelihood(pairs), pairs


def test_gains_of_moves():
    rng = np.random.default_rng(5)
    c, words = 5, 12
    text = rng.integers(0, words, 400)
    text[50:80] = 3  # a word that follows itself
    classes = rng.integers(0, c, words)
    _, pairs = likelihood_of(classes, text, c)
    before, after = np.zeros((words, c), np.int64), np.zeros((words, c), np.int64)
    np.add.at(before, (text[1:], classes[text[:-1]]), 1)
    np.add.at(after, (text[:-1], classes[text[1:]]), 1)
    selfs = np.bincount(text[1:][text[1:] == text[:-1]], minlength=words)
    gains = classlm.move_gains(pairs, classes, before, after, selfs)
    for w in range(words):
        at = []
        for b in range(c):
            moved = classes.copy()
            moved[w] = b
            at.append(likelihood_of(moved, text, c)[0])
        assert np.allclose(gains[w] - gains[w, classes[w]], np.array(at) - at[classes[w]])


def corpus(n=300):
    rng = random.Random(11)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    rows = []
    for i in range(n):
        text = " \t".join(x for _ in range(rng.randrange(1, 12)) for x in (rng.choice(nouns), rng.choice(verbs)))
        rows.append((i, text.upper() if i % 3 else text, "x"))
    return rows + [(900, None, "x"), (901, "", "x"), (902, " \n\x0b ", "x"), (903, "ÄÖ ünknown word", "x"),
                   (903, "ÄÖ ünknown word", "x"), (None, "n1 v1", "x"), (904, "n1 v2 " * 5000, "x")]


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def scored(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return classlm.class_scores(df, out, **options)


def tokens(text):
    raw = (text or "").encode().lower().split()
    return [*raw, classlm.END]


def test_class_scores(spark, monkeypatch):
    rows = corpus()
    made = []
    real = classlm.train
    monkeypatch.setattr(classlm, "train", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    got = sorted(map(tuple, scored(spark, rows, classes=8, rounds=4).collect()), key=repr)
    model = made[0]
    learn = [tokens(t) for i, t, _ in rows if not held(i)]
    c = Counter(w for t in learn for w in t)
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.vocabulary) == (n, v)
    # one part: places follow the digests of all words
    every = {w for _, t, _ in rows for w in tokens(t)}
    place = {w: i for i, w in enumerate(sorted(every, key=xxhash.xxh3_128_digest))}
    codes = np.frombuffer(model.classes.first()["cls"], np.uint8)
    cls = {w: codes[i] for w, i in place.items()}
    assert all((cls[w] < 8) == (w in c) for w in every) and [w for w in every if cls[w] == 0] == [classlm.END]
    sizes = Counter()
    for w, k in c.items():
        sizes[cls[w]] += k
    pairs = Counter((a, b) for t in learn for a, b in zip([cls[t[-1]], *[cls[w] for w in t]], [cls[w] for w in t]))
    once = sum(k == 1 for k in c.values())
    unknown = (once + 1) / (n + once + 1)

    def p(a, b):
        if b == 8:
            return unknown
        kinds = sum(x == a for x, _ in pairs)
        total = sum(k for (x, _), k in pairs.items() if x == a)
        share = sizes[b] / n
        return (1 - unknown) * ((pairs[a, b] + kinds * share) / (total + kinds) if total else share)

    memo, want = {}, []
    for i, t, _ in rows:
        seq = tokens(t)
        score, base, last = 0.0, 0.0, 0
        for w in seq:
            k = last, cls[w]
            memo[k] = memo.get(k) or p(*k)
            score += math.log10(memo[k]) + (math.log10(c[w] / sizes[cls[w]]) if w in c else 0)
            base += math.log10((c[w] + 1) / (n + v + 1))
            last = cls[w]
        want.append((i, held(i), len(seq), sum(w in c for w in seq), n, base, score))
    want.sort(key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want])
    assert np.allclose((10 ** model.transition).sum(1), 1)
    assert model.history[-1] > model.history[0]
    # nouns and verbs alternate: words of texts that training has not seen are foreseen better than by frequency
    out = [g for g in got if g[1] and g[2] > 1]
    assert out and sum(g[6] for g in out) > sum(g[5] for g in out)


def test_class_scores_by_any_blocks_and_parts(spark, monkeypatch):
    rows = corpus(120)
    one = sorted(map(tuple, scored(spark, rows, classes=6, rounds=2).collect()), key=repr)
    many = sorted(map(tuple, scored(spark, rows, classes=6, rounds=2, block_bytes=200).collect()), key=repr)
    assert [a[:5] for a in one] == [b[:5] for b in many]
    assert np.allclose([a[5:] for a in one], [b[5:] for b in many])
    monkeypatch.setattr(classlm, "PART_WORDS", 20)  # other draws of halves, the same counts
    parts = sorted(map(tuple, scored(spark, rows, classes=6, rounds=2, block_bytes=500).collect()), key=repr)
    assert [a[:5] for a in one] == [b[:5] for b in parts]
    assert np.allclose([a[5] for a in one], [b[5] for b in parts])


def test_class_scores_without_rows_or_training(spark):
    assert scored(spark, []).count() == 0
    only = next(i for i in range(100) if held(i))
    rows = scored(spark, [(only, "a b", "x"), (only, None, "x")]).collect()
    assert sorted(tuple(r) for r in rows) == [(only, True, 1, 0, 0, 0.0, 0.0), (only, True, 3, 0, 0, 0.0, 0.0)]


# --- divergence audit --------------------------------------------------------------------


def audit(rows, min_docs, top):
    import re
    docs = [(x or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for t, x, s in rows]
    in_docs, uses, groups = defaultdict(Counter), defaultdict(Counter), {(x, s) for x, s, _ in docs}
    for x, s, words in docs:
        in_docs[x].update(set(words))
        uses[x, s].update(words)
    out = []
    for lang in {x for x, _ in groups}:
        kept = [w for w, k in in_docs[lang].items() if k >= min_docs]
        v = len(kept)

        def shares(count):
            n = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 2) // (n + 2 * v) for w in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole = sum((uses[g] for g in groups if g[0] == lang), Counter())
        q, p = shares(whole), {s: shares(uses[lang, s]) for x, s in groups if x == lang}
        for s in p:
            for part, items in (("pair", [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in p if o != s]),
                                ("term", [(f(p[s][w], q[w]), w) for w in kept if uses[lang, s][w] and p[s][w] > q[w]])):
                items.sort(key=lambda i: (-i[0], i[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items)
                        if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("bits", [64, 3])
def test_divergence(spark, bits):
    rng = random.Random(2)
    words = [f"w{c}é" for c in "abcdefghijkl"] + ["Ab", "aB", "z"]
    rows = [(" ".join(rng.choice(words[k % 4:]) for _ in range(rng.randrange(0, 9))), rng.choice(["en", "de", None]),
             rng.choice(["s1", "s1", "s1", "s2", None, ""])) for k in range(150)]
    rows += [rows[0]] * 60 + [(None, "en", "none"), ("", "fr", "s1"), ("1 2 \x00_[{", "fr", "s2"), ("rare", "xx", "s"), (None, None, None)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "text string, lang string, source string, term string, n int")
    got = divergence.divergence(df, min_docs=6, top=4, bits=bits)
    assert sorted(map(tuple, got.collect())) == audit(rows, 6, 4)
    assert [t for _, t in got.dtypes] == ["string"] * 4 + ["bigint", "int"]


def test_divergence_without_rows_or_terms(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.divergence(empty).count() == 0
    rows = spark.createDataFrame([("a", "en", "x"), ("b", "en", "y")], empty.schema)
    assert sorted(map(tuple, divergence.divergence(rows).collect())) == [
        ("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


# --- vector codes --------------------------------------------------------------------------


def test_walk(monkeypatch):
    monkeypatch.setattr(triecodes, "LEAVES", 8)
    rng = np.random.default_rng(3)
    for high in (3, 50):
        x = np.unique(rng.integers(-high, high, (300, 4)), axis=0)
        book = rng.integers(-high, high, (7, 4))
        code, far = triecodes.walk(x, book)
        d = ((x[:, None] - book) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (far == d.min(1)).all()


def codes_by_hand(rows, parts, entries, rounds, scale):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))
    x = np.stack([np.floor(scale * r[2]).astype(np.int64).reshape(parts, -1) for r in rows])
    books = x[:entries].transpose(1, 0, 2).copy()
    near = lambda k: ((x[:, k, None] - books[k]) ** 2).sum(2)
    for _ in range(rounds):
        for k in range(parts):
            at = near(k).argmin(1)
            for e in np.unique(at):
                mine = x[at == e, k]
                books[k, e] = mine.sum(0) // len(mine)
    d = [near(k) for k in range(parts)]
    error = sum(a.min(1) for a in d)
    labels = Counter()
    for r, e in zip(rows, error):
        labels[r[1]] += int(e)
    return sorted(((r[0], "".join(f"{a[i].argmin():02x}" for a in d), int(error[i]), labels[r[1]],
                    triecodes.codebook_digest(books)) for i, r in enumerate(rows)), key=repr)


def test_trie_codes(spark, monkeypatch):
    monkeypatch.setattr(triecodes, "LEAVES", 16)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(240, 6)).round(3)
    x[30:120] = x[5]  # more than a third of all rows are one vector
    rows = [(1000 - i, [None, "a", "b"][i % 3], v) for i, v in enumerate(x)]
    rows += [(7, "a", x[3]), (7, "a", x[3]), (7, "b", x[4]), (None, "c", x[6])]
    odd = [(1, "a", None), (2, "a", []), (3, "a", [1.0, None, 1.0, 1.0, 1.0, 1.0]), (4, "a", [float("nan")] * 6),
           (5, "a", [float("inf")] * 6), (6, "a", [1.0] * 3), (8, "a", [1.0] * 5)]
    df = spark.createDataFrame([(i, l, v.tolist(), "clash") for i, l, v in rows] + [(*o, "clash") for o in odd],
                               "vec_id long, label string, embedding array<double>, code string")
    got = triecodes.trie_codes(df, parts=3, entries=5, rounds=4, scale=64)
    assert sorted(map(tuple, got.collect()), key=repr) == codes_by_hand(rows, 3, 5, 4, 64)
    few = df.filter("vec_id IN (1000, 999, 1, 2)")
    assert sorted(map(tuple, triecodes.trie_codes(few, parts=2).select("vec_id", "code", "error").collect())) == [
        (999, "0000", 0), (1000, "0101", 0)]
    assert triecodes.trie_codes(df.filter("vec_id < 6"), parts=3).count() == 0
