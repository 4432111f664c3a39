"""Vector and URL operators against brute force, the registered queries against SQL, and the pipeline."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from tastegrid.llm import knn, queries, urls  # noqa: E402
from tests.oracle import compare, duck  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_top_k(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 6)).round(2)
    x[100:400] = x[100]  # a third of all rows are one vector: ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    data = knn.whole_numbers(df)
    assert data.count() == 700
    got = {}
    for r in knn.top_k(data, data.filter("id % 7 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    v = np.floor(256 * x).astype(int)
    assert len(got) == 100
    for q, best in got.items():
        order = sorted((i for i in range(700) if i != q), key=lambda i: (-(v[q] @ v[i]), i))[:5]
        assert [best[k + 1] for k in range(5)] == [(i, v[q] @ v[i]) for i in order]
    few = data.filter("id < 3")
    assert knn.top_k(few, few, 5).count() == 6
    assert knn.top_k(data.filter("id < 0"), data, 5).count() == 0


def test_top_k_of_mixed_widths_and_many_blocks(spark, monkeypatch):
    """Vectors of a rarer width take no part; small blocks and parts leave the result as it is."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(i, v) for i, v in zip(range(300, 320), [[], [1.0], [9.0] * 5, [9.0] * 3] * 5)]
    data = knn.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    monkeypatch.setattr(knn, "BLOCK_ROWS", 2)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.top_k(data, data.filter("id % 20 = 0"), 3).collect()}
    v = np.floor(256 * x).astype(int)
    want = {}
    for q in range(0, 300, 20):
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-(v[q] @ v[i]), i))[:3]
        want |= {(q, k + 1): (i, v[q] @ v[i]) for k, i in enumerate(order)}
    assert got == want


def reference(u):
    """Host, path and rule of a URL, read off the text."""
    if u is None or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(d + p, v) for d, p, v in urls.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return host, path, max(fits, key=lambda x: len(x[0]), default=None)


def test_urls(spark):
    rng = random.Random(3)
    rows = [None, "", "no url", "http://", "HTTP://A.Example.ORG/es/1?x#y", "http://org", "http://x.org?/de/", "a://b://c/d",
            "http://example.org/en/1", "http://notexample.org/en/1", "http://x.com/fr/", "http://x.com/fr", "http://ÄB.com/de/ü\nz"]
    rows += [f"http://bad.com/de/{rng.randrange(10**6)}" for _ in range(300)]
    rows += [f"http://bad.com/new/{rng.randrange(10**6)}" for _ in range(5)]
    rows += [f"http://good.com/fr/{w}-{rng.randrange(10**6)}/a/b/c/d" for w in "xyz" for _ in range(30)]
    rows += [f"http://good.com/other/{k}" for k in range(9)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(rows)], "page_id long, url string, host string")
    got = urls.filtered(df).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, best = reference(rows[r.id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        if best:
            assert r.verdict == best[1]
        elif "://bad.com/new/" in (rows[r.id] or ""):
            assert r.verdict == "block"  # its host has nothing but blocked pages
        else:
            assert r.verdict == "allow"
    assert urls.filtered(df.limit(0)).count() == 0


@pytest.mark.parametrize("others", [5, 30, 31, 400])
def test_url_branches_do_not_depend_on_their_number(spark, others):
    """A labelled branch keeps its verdict however many further words its host has."""
    rows = [f"http://x.com/de/{w}" for w in "abcdef" for _ in range(10)] + [f"http://x.com/fr/{w}" for w in "abcdef" for _ in range(10)]
    rows += ["http://x.com/de"] + [f"http://x.com/word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(others)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r.id]: r for r in urls.filtered(df).collect()}
    assert got["http://x.com/de"].verdict == "block" and got["http://x.com/de"].rule is None
    assert got["http://x.com/wordaa"].verdict == "allow" and got["http://x.com/wordaa"].template.endswith("*")


def test_url_branch_far_down(spark):
    """Branches at depth six are told apart, and a very long path ends the tree where nothing splits."""
    rules = (("y.com", "/p/q/r/s/bad/", "block"), ("y.com", "/p/q/r/s/good/", "allow"))
    rows = [f"http://y.com/p/q/r/s/{w}/{c}" for w in ("bad", "good") for c in "abcde" for _ in range(10)]
    rows += ["http://y.com/p/q/r/s/bad", "http://y.com/p/q/r/s/good", "http://y.com/" + "deep/" * 3000, None, ""]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.id: r for r in urls.filtered(df, rules).collect()}
    assert len(got) == len(rows)
    assert [got[100].verdict, got[101].verdict] == ["block", "allow"]
    assert got[0].template != got[60].template and got[0].purity > 0.9 and got[60].purity < 0.1


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, queries.QUERIES[name], queries.ORACLES.get(name)) == []


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = docs.count()
    for name, step in corpus_pipeline.STAGES:
        rows = step(spark, docs, FOLDER)
        if name != "encode":
            assert rows.columns == list(corpus_pipeline.COLUMNS)
        docs = corpus_pipeline.keep(rows, f"test-{name}")
        if name in ("quality_rules", "near_duplicates"):
            assert 0 < docs.count() <= seen and docs.count() == docs.select("doc_id").distinct().count()
            seen = docs.count()
        elif name == "repeated_strings":
            assert docs.count() == seen
    assert docs.filter("NOT same").count() == 0 and docs.count() > 0
