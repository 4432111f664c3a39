"""Document operators against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")

from tastegrid.llm import (  # noqa: E402
    bpe, common, components, jaccard, licenses, mixing, quality, repeats, sharding, shingles, tokencount)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, first int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi".split())
                    + rng.choice(["", "s", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [prose(rng, rng.randint(1, 400)) for _ in range(60)]
    out += [out[3], out[3], out[4].upper(), out[5] + " tail", "x " + out[6], out[7][:len(out[7]) // 2] + out[8]]
    out += [None, "", "  \n\t ", "one", "ONE", "a b c d", "a b c d e", "\x0b odd \x1c gap ", "é" * 500, "ab" * 4000]
    out += ["line one here\nline one here\n\nlast", prose(rng, 30) + "\n" + "### $$$ " * 20, prose(rng, 6000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "é", None][i % 7 % 4], 0, "clash", i, i)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_statistics(docs, texts):
    for r in quality.statistics(docs).collect():
        t = texts[r.id] or ""
        w = WORD.findall(t)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_outliers_go_and_the_rest_stays(spark, empty):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows = []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        if i % 10 == 0:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words), "en", f"s{i % 2}", 0, "", 0, 0))
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r.id: r.kept for r in quality.judged(df).collect()}
    assert all(kept[i] == (i % 10 != 0) for i in kept) and len(kept) == 400
    assert {r.doc_id for r in quality.kept_documents(df).collect()} == {i for i in kept if kept[i]}
    assert quality.judged(empty).count() == 0


def test_empty_texts_do_not_end_the_pipeline(spark):
    """Null, empty and blank texts of a language and source that form a group, under ANSI arithmetic."""
    import corpus_pipeline
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(60, 300)), "en", "s", 0, "", 0, 0) for i in range(80)]
    rows += [(100 + i, t, "en", "s", 0, "", 0, 0) for i, t in enumerate([None, "", " \n\t ", "one"])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    want = {r.id for r in quality.judged(df).filter("kept").collect()}
    assert want and max(want) < 80
    assert {r.doc_id for r in quality.kept_documents(df).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, df, "").collect()} == want


def test_estimate_is_the_weighted_one(spark):
    """With no floor to speak of, the start and the steps reach the covariance of the clean rows."""
    rng = np.random.default_rng(3)
    x = rng.multivariate_normal([3000, 2000, 1500, 1000], np.diag([400.0, 500, 600, 500]) ** 2 / 1.0, 4000)
    x[:400] += 4000
    x = np.clip(x, 0, quality.GRID).round()
    rows = spark.createDataFrame([("g", *map(int, r)) for r in x], "grp string, x0 long, x1 long, x2 long, x3 long")
    e = quality.estimates(rows).first()
    clean = x[400:].mean(0)
    assert np.allclose([e.m0, e.m1, e.m2, e.m3], clean, rtol=0.03)


def test_repetition_alone_rejects(spark):
    """Repeated words and repeated lines below the base rules, in a group that has neither."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    rows = []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(100, 300))]
        text = "\n".join(" ".join(words[k:k + 5]) for k in range(0, len(words), 5))
        if i % 100 == 0:  # 48 % of the words repeat
            text += "\n" + " ".join(words[:len(words) // 3])
        elif i % 100 == 1:  # lines of one word repeat: no window of three words does
            text += "".join(f"\nyes\n{w}" for w in rng.sample(vocabulary, len(words) // 4))
        rows.append((i, text, "en", "s", 0, "", 0, 0))
    out = quality.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert not any(r.base_failed for r in out)
    assert {r.id for r in out if not r.kept} == {i for i in range(400) if i % 100 < 2}


def _mcd_brute(x, floors, rng):
    """Least determinant of many random starts, with the same floors and consistency factor, then reweighted."""
    def fit(rows, factor):
        c = factor * np.cov(rows.T, bias=True)
        np.fill_diagonal(c, np.maximum(np.diag(c), floors ** 2))
        return rows.mean(0), c

    def far(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    best = None
    for _ in range(200):
        m, c = fit(x[rng.choice(len(x), 6, replace=False)], 1.0)
        for _ in range(30):
            d = far(m, c)
            m, c = fit(x[np.argsort(d)[:len(x) // 2]], quality.HALF_CONSISTENCY)
        if best is None or np.linalg.det(c) < np.linalg.det(best[1]):
            best = m, c
    return far(*fit(x[far(*best) <= quality.WEIGHED_IN], 1.0))


def test_verdicts_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    mix = np.array([[300, 0, 0, 0], [120, 250, 0, 0], [60, 40, 200, 0], [0, 0, 0, 150.0]])
    x = rng.normal(size=(600, 4)) @ mix.T + [2000, 2500, 3000, 2500]
    x[:150] = rng.normal(size=(150, 4)) * 60 + [3500, 1000, 5500, 4000]  # a tight group of outliers
    x = np.clip(x, 0, quality.GRID).round()
    rows = spark.createDataFrame(
        [(i, "g", *map(int, r)) for i, r in enumerate(x)], "id long, grp string, x0 long, x1 long, x2 long, x3 long")
    got = {r.id: r.d for r in quality._distance(rows, quality.estimates(rows), "d").collect()}
    want = _mcd_brute(x, np.array(quality.FLOORS), rng)
    assert {i for i, d in got.items() if d > quality.CUTOFF} == set(np.flatnonzero(want > quality.CUTOFF))
    assert np.allclose([got[i] for i in range(600)], want, rtol=0.15)


def test_permutation(spark):
    from pyspark.sql import functions as F
    for n in (1, 2, 7, 100, 1023):
        out = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p"))
        assert sorted(r.p for r in out.collect()) == list(range(n))


def water_fill(sizes, weights, share=1.5, cap=2.0):
    total, live, target = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while live:
        w = sum(weights[i] for i in live)
        over = [i for i in live if total * weights[i] / w >= cap * sizes[i]]
        if not over:
            for i in live:
                target[i] = total * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
        total -= sum(cap * sizes[i] for i in over)
        live -= set(over)
    return target


def test_mix(spark, docs, texts, empty):
    stream, slots = mixing.plan(common.keep(mixing.records(docs), "t"), block_words=8)
    rows = mixing.taken_words(stream, slots, 8).collect()
    again = mixing.taken_words(*mixing.plan(common.keep(mixing.records(docs.repartition(5)), "t"), block_words=8), 8).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert len(rows) == docs.count()
    by = collections.defaultdict(list)
    for r in docs.select("doc_id", "source").collect():
        by[r.source].append(r.doc_id)
    names = sorted((s for s in by if s is not None)) + [None]
    size = {s: sum(len(WORD.findall(texts[i] or "")) for i in by[s]) for s in names}
    want = dict(zip(names, water_fill([size[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])))
    source = {i: s for s in by for i in by[s]}
    taken = collections.Counter()
    for r in rows:
        s = source[r.id]
        assert r.size == len(WORD.findall(texts[r.id] or "")) and r.source_size == size[s]
        assert r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 * 8 + 0.02 * want[s] for s in names)
    mixed = mixing.mixed_documents(docs, stream, slots, 8).collect()
    words = collections.Counter()
    for r in mixed:
        assert r.text in (texts[r.doc_id] or "") or set(WORD.findall(r.text)) <= set(WORD.findall(texts[r.doc_id]))
        words[source[r.doc_id]] += len(WORD.findall(r.text))
    assert all(words[s] <= taken[s] * 1.1 + 20 for s in names)
    assert mixing.taken_words(*mixing.plan(common.keep(mixing.records(empty), "t"))).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: find(v) for e in edges for v in e if e[0] != e[1]} | {v: find(v) for v in got}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_brute(t):
    w = tuple(re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split())
    return {w[i:i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else ({w} if w else set())


def test_jaccard_components(spark, docs, texts, empty):
    rng = random.Random(9)
    more = list(texts)
    base = prose(rng, 300).split()
    for k in range(60):  # a chain of near copies, a few words apart
        base = list(base)
        base[rng.randrange(300)] = f"new{k}"
        more.append(" ".join(base))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(more)] + [(0, more[0])], "doc_id long, text string")
    sets = [shingle_brute(t) for t in more]
    root = list(range(len(more)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(more)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rows = jaccard.similar_components(df).collect()
    assert len(rows) == len(more) + 1
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id)) for r in rows)
    kept = [r.doc_id for r in jaccard.one_of_each(df).collect()]
    assert sorted(kept) == sorted({find(i) for i in range(len(more))})
    assert jaccard.similar_components(empty).count() == 0


def test_tree_finds_every_pair():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(5, 60)).astype(np.uint64)) for _ in range(90)]
    sets += [np.unique(np.concatenate([s[:-1], s[:1] + np.uint64(1)])) for s in sets]
    points = jaccard._folded([jaccard.point_of(s) for s in sets])
    n = np.array([len(s) for s in sets])
    found = {tuple(sorted(p)) for i, j, _ in jaccard.tree_pairs(points, n, np.arange(len(sets)), np.ones(len(sets), bool))
             for p in zip(i.tolist(), j.tolist())}
    want = {(a, b) for b in range(len(sets)) for a in range(b)
            if 175 * np.minimum(points[a], points[b]).sum() >= 75 * (n[a] + n[b])}
    assert found == want and len(want) >= 60


def test_shingles(texts):
    for t in texts:
        assert len(shingles.shingle_set(t)) == len(shingle_brute(t))


def test_sharding(spark, docs, texts, empty):
    out, slots = sharding.assign(common.keep(sharding.records(docs), "t"), 4)
    rows = out.collect()
    assert len(rows) == docs.count()
    shards = collections.defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        shards[r.shard].append(r)
    assert all(sorted(x.position for x in s) == list(range(len(s))) for s in shards.values())
    load = [sum(x.size for x in shards[k]) for k in range(4)]
    assert max(load) - min(load) <= max(r.size for r in rows)
    sizes = {r.vslot: r.bytes for r in slots.collect()}
    now = {r.vslot: r.shard for r in slots.collect()}
    grown = sharding.rebalanced_map(now, sizes, 5)
    assert set(grown) == set(now) and set(grown.values()) <= set(range(5))
    even = {v: 10 for v in range(100)}
    four = sharding.balanced_map(even, 4)
    five = sharding.rebalanced_map(four, even, 5)
    assert collections.Counter(five.values()) == dict.fromkeys(range(5), 20)
    assert all(five[v] in (four[v], 4) for v in even)
    three = sharding.rebalanced_map(four, even, 3)
    assert set(three.values()) == {0, 1, 2} and all(three[v] == four[v] for v in even if four[v] < 3)
    assert sharding.assign(common.keep(sharding.records(empty), "t"), 4)[0].count() == 0


def test_token_counts(docs, texts, empty):
    from tokenizers import Tokenizer
    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    odd = [*texts, "it's <|endoftext|> x<|endoftext|>", "a  b", "a \n b", "\xa0 x \u3000y", "日本 語 。"]
    assert tokencount.count_batch(odd, path) == [len(t.encode(x or "", add_special_tokens=False)) for x in odd]
    for r in tokencount.token_counts(docs, path).collect():
        want = len(t.encode(texts[r.doc_id] or "", add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), want, want > 512)
    assert tokencount.token_counts(empty, path).count() == 0


def test_byte_bpe(docs, texts, empty):
    import tiktoken
    path = public.path("byte_bpe_multi_50k.tiktoken")
    vocab = bpe.vocabulary(path, public.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    rng = random.Random(1)
    odd = ["".join(rng.choice(" \n\t abcdeéñ12,.'s\x1c\x85 日") for _ in range(rng.randint(1, 90))) for _ in range(400)]
    for t, packed in zip(odd, bpe.encode_texts(odd, vocab)):
        assert np.frombuffer(packed, "<u4").tolist() == own.encode_ordinary(t)
    for r in bpe.digests(docs, path, public.PATTERN).collect():
        t = texts[r.doc_id] or ""
        ids = own.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    encoded = bpe.encode(docs, path, public.PATTERN)
    back = bpe.decode(encoded, path, public.PATTERN).collect()
    assert all(bytes(r.bytes) == (texts[r.doc_id] or "").encode() for r in back)
    assert all(r.same for r in bpe.round_trip(docs, path, public.PATTERN).collect())
    assert bpe.digests(empty, path, public.PATTERN).count() == 0


def test_packed_points():
    """What a set takes to its trees: a few bits a group, with nothing lost, wide counts included."""
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 60, 500, 5000)]
    sets.append(np.arange(70_000, dtype=np.uint64) << np.uint64(40))
    for s in sets:
        point = jaccard.point_of(s)
        packed = jaccard._packed(point)
        assert (jaccard._unpacked(packed, len(s)) == point).all()
        assert len(s) < 500 or 2 * len(packed) < point.nbytes


def test_repeats(spark, docs, texts, empty):
    rng = random.Random(8)
    passage = prose(rng, 60)
    more = [*texts, "x" * 1000, "y" * 199, "z" * 200, "ü" * 300]
    more += [prose(rng, rng.randint(5, 200)) + passage[rng.randint(0, 60):] + prose(rng, 90) for _ in range(25)]
    raws = [(t or "").encode() for t in more] + [(more[0]).encode()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(more)] + [(0, more[0])], "doc_id long, text string")
    count = collections.Counter(r[k:k + 200] for r in raws for k in range(len(r) - 199))
    want = {}
    for i, r in enumerate(raws[:-1]):
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if count[r[k:k + 200]] > 1:
                gone[k:k + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        rest = bytes(b for b, g in zip(r, gone) if not g)
        want[i] = (len(r), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    got = repeats.digests(df).collect()
    assert len(got) == len(raws)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)
    assert sum(v[1] > 0 for v in want.values()) > 20
    assert repeats.digests(empty).count() == 0
    kept = {r.doc_id: r.text for r in repeats.without_repeats(docs).collect()}
    assert len(kept) == len(texts) and kept[0] == ""


def test_repeats_pieces(spark):
    """Of a text only the bytes of its open contents go on, once where contents overlap."""
    rng = random.Random(9)
    text = "ü" + prose(rng, 600)
    raw = text.encode()
    todo = [{"xa": x, "xb": -x, "lo": lo, "hi": hi, "n": 1} for x, lo, hi in ((3, 1500, 1500), (1, 10, 40), (2, 41, 90))]
    kind = "text string, todo array<struct<xa: long, xb: long, lo: int, hi: int, n: long>>"
    pieces = repeats._pieces(spark.createDataFrame([(text, todo)], kind), 200)
    assert sorted(bytes(r.piece) for r in pieces.collect()) == sorted([raw[10:290], raw[1500:1700]])
    got = repeats._suffixes(pieces, 200, np.full(1 << 15, 255, np.uint8)).collect()
    want = {(x["xa"], i - x["lo"]): repeats._halves(raw[i:i + 200]) for x in todo for i in range(x["lo"], x["hi"] + 1)}
    assert len(got) == len(want) and {(r.xa, r.off): (r.wa, r.wb) for r in got} == want
    assert {(r.wa, r.wb) for r in repeats._suffixes(pieces, 200).collect()} == set(want.values())


def test_licenses(spark, docs, empty):
    rng = random.Random(6)
    rows = [(1, prose(rng, 80) + " " + licenses.TEMPLATES["GPL-3.0"] + " " + prose(rng, 500)),
            (2, licenses.TEMPLATES["BSD-clause"].upper() + "\n" + licenses.TEMPLATES["MIT"]), (3, None), (4, ""),
            (5, "license"), (6, prose(rng, 5000) + " licensed under the   Apache License, version 2.0.")]
    got = {(r.id, r.template): r.containment for r in licenses.scanned(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "GPL-3.0"): 100, (2, "BSD-clause"): 100, (2, "MIT"): 100, (6, "Apache-2.0"): 100}
    assert licenses.scanned(docs).count() == 0 and licenses.scanned(empty).count() == 0


def test_whole_licences_and_relatives(spark):
    """Licences that no given table holds: whole texts get their own name, relatives are not taken for each other."""
    rng = random.Random(8)
    rows, want = [], {}
    for i, (name, body) in enumerate(sorted(licenses.TEXTS.items())):
        rows.append((i, prose(rng, 90) + " " + body + " " + prose(rng, 40)))
        want[i] = {name}
    more = [("This work is licensed under a Creative Commons Attribution 4.0", "CC-BY-4.0"),
            ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
            ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
            ("This work is licensed under the GNU General Public License, version 9.", None),
            ("the license of this software is a copyright of the program", None)]
    for i, (text, name) in enumerate(more, 100):
        rows.append((i, prose(rng, 70) + " " + text + " " + prose(rng, 30)))
        want[i] = {name} - {None}
    got = {i: set() for i in want}
    for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.id].add(r.template)
    assert got == want
