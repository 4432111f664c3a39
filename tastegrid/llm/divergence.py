"""Source divergence audit with late string materialization.

Terms are counted by 64-bit digests: the texts are read once, what each task counted is written with the
strings beside the digests, and every sum after that reads and shuffles the fixed-width columns only. Strings
are read again for the digests that stay: their least and greatest string tell whether a digest stands for
several terms, and only such digests are split and counted by string. The report gets its texts by a join with
the rows that it keeps.

A document without a text, language or source has an empty one. Terms are runs of ASCII letters and characters
outside ASCII, with A-Z lower-cased. Every row is a document of its own, repeated rows and ids too. Other
columns are not looked at. A table without rows gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tastegrid.llm.common import bit_filter, has_bit
from tastegrid.session import stage

#: Bytes of a term as they count; every other byte ends one. Bytes from 128 on belong to characters outside ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A task hands on what it has counted once it holds so many (group, term) entries.
HELD = 400_000
#: Size of the filter in front of the join that looks strings up; with more terms it only lets more through.
FILTER_BITS = 1 << 24
#: p = 1 + floor(UNIT * (count + 2) / (N + 2 V))
UNIT = 1_000_000_000

COUNTS = "lang string, source string, digest long, term string, n long, n_docs long"


def term_counts(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(lang, source, digest, term, n, n_docs) as each task counted them: a term has a row of every task at least.

    ``bits`` shortens the digest, for tests of digests that several terms share.
    """
    mask = (1 << bits) - 1

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (uses, in_docs) in held.items():
            terms = list(uses)
            digests = [xxhash.xxh64_intdigest(t) & mask for t in terms]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                pa.array([d - (1 << 64) if d >> 63 else d for d in digests], pa.int64()),
                pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(uses.values()), pa.int64()),
                pa.array([in_docs[t] for t in terms], pa.int64()),
            ], names=["lang", "source", "digest", "term", "n", "n_docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = text.encode().translate(_FOLD).split()
                if found:
                    uses, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                    uses.update(found)
                    in_docs.update(set(found))
            if sum(len(uses) for uses, _ in held.values()) > HELD:
                yield from flush(held)
                held = {}
        yield from flush(held)

    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(run, COUNTS)


def _share(n: str, total: str) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)); decimals, as the product may pass 64 bits."""
    whole = lambda c: f"CAST({c} AS DECIMAL(20,0))"
    return F.expr(f"1 + ({UNIT}BD * ({whole(n)} + 2BD)) div ({whole(total)} + 2BD * {whole('terms')})")


def _apart(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)); p, q are at most UNIT + 1, so 64 bits hold the square."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def kept_counts(counted: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """((lang, source, digest, twin, n), (lang, digest, twin, term)) of the terms in ``min_docs`` documents of their lang.

    ``twin`` is empty but for digests that several terms of a lang share; there it is the term itself.
    """
    key = ["lang", "digest"]
    sums = stage(counted.groupBy("lang", "source", "digest").agg(
        F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")), "digest-sums")
    # a digest of several terms counts at least the documents of each, so none is lost here
    often = stage(sums.groupBy(*key).agg(F.sum("n_docs").alias("n_docs"))
                 .filter(F.col("n_docs") >= min_docs).select(*key), "digests")
    seen = counted.sparkSession.sparkContext.broadcast(
        bit_filter(often.select(F.col("digest").alias("k")), "k", FILTER_BITS))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def distinct(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).group_by(names).aggregate([])  # a term has a row of each source
            return rows.select(names).to_batches()

        names, held = ["lang", "digest", "term"], []
        for b in batches:
            held.append(b.filter(pa.array(has_bit(seen.value, b.column(1).to_numpy()))))
            if sum(x.num_rows for x in held) > HELD:
                yield from distinct(held)
                held = []
        if held:
            yield from distinct(held)

    strings = counted.select("lang", "digest", "term").mapInArrow(maybe, "lang string, digest long, term string")
    ends = stage(strings.join(often, key).groupBy(*key).agg(
        F.min("term").alias("least"), F.max("term").alias("most")), "digest-ends")
    shared = ends.filter("least <> most").select(*key)
    whole = sums.join(ends.filter("least = most").select(*key), key).select(
        "lang", "source", "digest", F.lit("").alias("twin"), "n")
    named = ends.filter("least = most").select(*key, F.lit("").alias("twin"), F.col("least").alias("term"))
    if shared.isEmpty():
        return whole, named
    apart = stage(counted.join(shared, key).groupBy("lang", "source", "digest", F.col("term").alias("twin")).agg(
        F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")), "split-digests")
    stays = apart.groupBy("lang", "digest", "twin").agg(F.sum("n_docs").alias("d")).filter(
        F.col("d") >= min_docs).select("lang", "digest", "twin")
    split = apart.join(stays, ["lang", "digest", "twin"]).select("lang", "source", "digest", "twin", "n")
    return whole.unionByName(split), named.unionByName(stays.withColumn("term", F.col("twin")))


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs.

    Part ``pair``: the distance to every other source of the lang, summed over the lang's kept terms. Part
    ``term``: the ``top`` terms that are more frequent in the group than in the lang, by the same measure.
    Values are whole numbers; equal ones rank by the item's UTF-8 bytes.
    """
    key, group = ["lang", "digest", "twin"], ["lang", "source"]
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in group]).distinct()
    counted = stage(term_counts(docs, bits), "term-counts")
    kept, texts = kept_counts(counted, min_docs)
    kept, texts = stage(kept, "kept-counts"), stage(texts, "kept-terms")

    terms = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    sums = kept.groupBy(*group).agg(F.sum("n").alias("total"))
    totals = stage(groups.join(sums, group, "left").join(terms, "lang", "left").select(
        *group, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
        .withColumn("none", F.when(F.col("terms") > 0, _share("0", "total"))), "group-totals")
    langs = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))

    held = kept.join(totals, group).withColumn("p", _share("n", "total"))
    held = stage(held.select(*key, "source", "n", "terms", "p", "none"), "shares")

    # terms of a group against its lang; strings are joined to the rows that can rank
    in_lang = held.groupBy(*key).agg(F.sum("n").alias("lang_n")).join(langs, "lang")
    higher = held.join(in_lang, key).withColumn("q", _share("lang_n", "lang_total")).filter("p > q").select(
        *key, "source", F.expr(_apart("p", "q")).alias("value"))
    by_value = W.partitionBy(*group).orderBy(F.desc("value"))
    first = higher.withColumn("at", F.rank().over(by_value)).filter(F.col("at") <= top).drop("at")
    term_part = first.join(texts, key).select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    # pairs of sources: a sum over all kept terms as corrections of what two groups without any term give,
    # so only terms that occur are joined
    a, b = totals.select("lang", F.col("source").alias("a"), F.col("none").alias("za"), "terms"), totals.select(
        "lang", F.col("source").alias("b"), F.col("none").alias("zb"))
    base = F.expr(f"CASE WHEN terms > 0 THEN terms * ({_apart('za', 'zb')}) ELSE 0 END")
    pairs = a.join(b, "lang").filter("a <> b")
    alone = held.groupBy("lang", "source", "p", "none").agg(F.count(F.lit(1)).alias("m"))
    one = alone.join(b, "lang").filter("source <> b").groupBy("lang", F.col("source").alias("a"), "b").agg(
        F.sum(F.expr(f"m * (({_apart('p', 'zb')}) - ({_apart('none', 'zb')}))")).alias("one"))
    left = held.select(*key, F.col("source").alias("a"), F.col("p").alias("pa"), F.col("none").alias("za"))
    right = held.select(*key, F.col("source").alias("b"), F.col("p").alias("pb"), F.col("none").alias("zb"))
    both = left.join(right, key).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(F.expr(
        f"({_apart('pa', 'pb')}) - ({_apart('pa', 'zb')}) - ({_apart('za', 'pb')}) + ({_apart('za', 'zb')})")).alias("both"))
    one, both = stage(one, "one-sided"), stage(both, "two-sided")
    mirror = one.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("one").alias("other"))
    swapped = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "both"))
    ab = ["lang", "a", "b"]
    value = base + sum((F.coalesce(c, F.lit(0)) for c in ("one", "other", "both")), F.lit(0))
    pair_part = pairs.join(one, ab, "left").join(mirror, ab, "left").join(swapped, ab, "left").select(
        "lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))

    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pair_part).unionByName(ranked(term_part).filter(F.col("rank") <= top))


def op12_divergence_audit(spark, folder: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{folder}/documents.parquet").select("lang", "source", "text"))


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS MATERIALIZED (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
cl AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
nl AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(n.total, 0) + 2 * v.v) AS BIGINT) AS p
  FROM g JOIN kept k ON g.lang = k.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
q AS (
  SELECT cl.lang, cl.term, CAST(1 + (1000000000 * (cl.n + 2)) // (nl.total + 2 * v.v) AS BIGINT) AS q
  FROM cl JOIN nl ON cl.lang = nl.lang JOIN v ON v.lang = cl.lang),
s AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, CAST(((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS BIGINT)
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
