"""Quality rules by robust multivariate outliers: a minimum-covariance-determinant estimate per language and source.

Each document has four transformed statistics (word length, symbols, repeated words, repeated lines)
on a whole-number grid. Per group, the half of the documents with the smallest distances gives centre
and covariance. Concentration steps repeat that from several starts (medians with median deviations,
all rows, and subsets drawn by a digest of the statistics); the start with the least determinant goes on until no
determinant falls any more, and then all documents within the 97.5 % distance are weighed in. A
document goes when its squared Mahalanobis distance is beyond the 99.99 % point. Sums over the grid are
whole numbers, so results do not depend on the order of rows. Groups of fewer than ``MIN_DOCS``
documents are pooled per language, and what is still small over all languages. A variance is never below
``FLOORS`` squared: most documents hold no symbol and no repeated line, and half of a group would have
a determinant of 0. A floor replaces a smaller variance and is not added to a greater one.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tastegrid.llm.common import keep, words

MIN_DOCS = 50
#: Starts that are subsets, each a fraction 1 / SUBSETS of a group, besides the two starts of whole groups.
SUBSETS = 3
#: Concentration steps of every start, and at most of the best one.
FIRST_STEPS, MOST_STEPS = 2, 20
#: The grid of a statistic has whole numbers up to this.
GRID = 8191
#: Least standard deviation of each statistic, in grid units (1/1000): about the noise of counts in texts of 150 words.
FLOORS = (60.0, 60.0, 100.0, 60.0)
# Fixed values of the chi-square distribution with 4 degrees of freedom.
HALF_CONSISTENCY = 2.109  # 0.5 / P(chi2_6 <= median of chi2_4): half the rows understate the covariance
WEIGHED_IN = 11.143  # 97.5 %
CUTOFF = 23.513  # 99.99 %
FEATURES = ("x0", "x1", "x2", "x3")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               keys: tuple[str, str] = ("lang", "source"), carry: Column | None = None) -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row.

    ``carry`` is a column that goes along, as ``_carry``.

    A null or empty text has zeros and fails. Windows of three words are compared by a 64-bit hash
    within their text; they are sorted once, so a long text costs n log n.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    more = [] if carry is None else [carry.alias("_carry")]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(keys[0]).alias("lang"), F.col(keys[1]).alias("source"), *more,
        words(text_col).alias("_w"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"))
    w = F.col("_w")
    rows = rows.withColumn("_h", F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(w) - 2),
        lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))))
    ordered = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ordered))
    s = F.col("_s")
    again = F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]))
    rows = rows.withColumn("_at", F.sort_array(F.transform(again, lambda e: e["i"])))
    at = F.col("_at")
    covered = F.aggregate(
        F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
        F.lit(0), lambda a, x: a + x)
    out = rows.select(
        "id", "lang", "source", *[c for c in ("_carry",) if more], F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return out.withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _features(stats: DataFrame) -> DataFrame:
    # a text without words, which the base rules drop, may come along here: nothing is divided by 0
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    raw = (F.log(F.col("word_chars") / n), F.log(1 + F.col("n_symbols") / n),
           F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_dup_lines") / n))
    return stats.select("*", *[
        F.least(F.greatest(F.round(1000 * r), F.lit(0)), F.lit(GRID)).cast("long").alias(x)
        for r, x in zip(raw, FEATURES)])


def _groups(rows: DataFrame) -> DataFrame:
    """(_l, _s, grp) of every language and source: the two, or the pool that small groups fall into."""
    name = lambda *c: F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), x), F.lit("")) for x in c])
    counts = rows.groupBy(F.col("lang").alias("_l"), F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    small = counts.filter(F.col("_n") < MIN_DOCS).groupBy(F.col("_l").alias("_l2")).agg(F.sum("_n").alias("_n2"))
    return keep(counts.join(small, F.col("_l").eqNullSafe(F.col("_l2")), "left").select(
        "_l", "_s", F.when(F.col("_n") >= MIN_DOCS, name(F.col("_l"), F.col("_s")))
        .when(F.col("_n2") >= MIN_DOCS, name(F.col("_l"))).otherwise(F.lit("")).alias("grp")), "groups")


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_l", "_s")


def _estimate(rows: DataFrame, factor: float, keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Per key: means m0.. and the Cholesky factor l00, l10, l11, .. of the covariance, with ``logdet``."""
    p = range(len(FEATURES))
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(FEATURES)]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i in p for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *products)

    def covariance(i: int, j: int) -> Column:
        c = factor * (F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n"))
        return F.greatest(c, F.lit(FLOORS[i] ** 2)) if i == j else c

    out = out.select(*keys, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in p], *[
        covariance(i, j).alias(f"c{i}{j}") for i in p for j in range(i + 1)])
    return _factored(out, keys)


def _factored(out: DataFrame, keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    p = range(len(FEATURES))
    for i in p:
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # the floor keeps the pivots away from 0
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = sum((2 * F.log(f"l{i}{i}") for i in p), F.lit(0.0))
    return out.select(*keys, *[f"m{i}" for i in p], *[f"l{i}{j}" for i in p for j in range(i + 1)], logdet.alias("logdet"))


def _distance(rows: DataFrame, estimate: DataFrame, name: str) -> DataFrame:
    """Rows with their squared Mahalanobis distance; once for each start if the estimates have some."""
    own = rows.columns + [c for c in ("start",) if c in estimate.columns]
    out = rows.join(estimate, "grp")
    for i, x in enumerate(FEATURES):
        z = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    d = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(FEATURES))), F.lit(0.0))
    return out.select(*own, d.alias(name))


def _bin(d: Column) -> Column:
    """Distances on a logarithmic grid of some thousand values, so that an exact median stays small."""
    return F.floor(F.log2(d + 0.001) * 128).cast("long")


def _starts(rows: DataFrame) -> DataFrame:
    """(grp, start, ..): an estimate of medians, one of all rows, and SUBSETS of rows that a digest picks."""
    half, p = F.lit(0.5), range(len(FEATURES))
    middle = keep(rows.groupBy("grp").agg(*[F.percentile(x, half).alias(f"m{i}") for i, x in enumerate(FEATURES)]), "medians")
    spread = rows.join(middle, "grp").groupBy("grp").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in p],
        *[F.percentile(F.abs(F.col(x) - F.col(f"m{i}")), half).alias(f"d{i}") for i, x in enumerate(FEATURES)])
    by_median = _factored(spread.select("grp", F.lit(-2).alias("start"), *[f"m{i}" for i in p], *[
        (F.greatest(F.pow(1.4826 * F.col(f"d{i}"), 2), F.lit(FLOORS[i] ** 2)) if i == j else F.lit(0.0)).alias(f"c{i}{j}")
        for i in p for j in range(i + 1)]), ("grp", "start"))
    everything = _estimate(rows.withColumn("start", F.lit(-1)), 1.0, ("grp", "start"))
    # rows with equal statistics are in the same subset, whatever their order or partition
    dealt = rows.withColumn("start", F.pmod(F.xxhash64(*FEATURES), F.lit(SUBSETS)).cast("int"))
    return by_median.unionByName(everything).unionByName(_estimate(dealt, 1.0, ("grp", "start")))


def _concentrated(rows: DataFrame, now: DataFrame) -> DataFrame:
    """The estimate of the half of each group (and start) with the smallest distances."""
    keys = tuple(c for c in ("grp", "start") if c in now.columns)
    far = _distance(rows, now, "d").withColumn("bin", _bin(F.col("d")))
    cut = keep(far.groupBy(*keys).agg(F.percentile("bin", F.lit(0.5)).alias("cut")), "cut")
    return keep(_estimate(far.join(cut, list(keys)).filter("bin <= cut"), HALF_CONSISTENCY, keys), "half")


def estimates(rows: DataFrame) -> DataFrame:
    """The reweighted minimum-covariance-determinant estimate of every ``grp`` of rows with FEATURES."""
    now = keep(_starts(rows), "starts")
    for _ in range(FIRST_STEPS):
        now = _concentrated(rows, now)
    least = F.row_number().over(Window.partitionBy("grp").orderBy("logdet", "start"))  # a row per start
    best = keep(now.withColumn("_r", least).filter("_r = 1").drop("_r", "start"), "best")
    for _ in range(MOST_STEPS):
        after = _concentrated(rows, best)
        old = best.select("grp", F.col("logdet").alias("_old"))
        falls = after.join(old, "grp").filter(F.col("logdet") < F.col("_old") - 1e-9).limit(1).count()
        if not falls:
            break
        # a group whose determinant no longer falls keeps what it has
        better = after.join(old, "grp").filter(F.col("logdet") < F.col("_old")).drop("_old")
        best = keep(better.unionByName(best.join(better.select("grp"), "grp", "left_anti")), "best")
    return keep(_estimate(_distance(rows, best, "d").filter(F.col("d") <= WEIGHED_IN), 1.0), "reweighted")


def fitted(stats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, groups, estimates) of written :func:`statistics`: what passes the base rules, grouped, and the fits."""
    passed = _features(stats.filter(~F.col("base_failed")))
    groups = _groups(passed)
    rows = keep(_grouped(passed, groups), "features")
    return rows, groups, estimates(rows)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """:func:`statistics` of every row with ``distance`` (null where the base rules fail) and ``kept``.

    Estimates are made of the documents that pass the base rules. An empty table gives no rows; null
    languages and sources are groups of their own.
    """
    stats = keep(statistics(docs, id_col, text_col, keys), "statistics")
    rows, _, fits = fitted(stats)
    passed = _distance(rows, fits, "distance").withColumn("kept", F.col("distance") <= CUTOFF)
    failed = stats.filter("base_failed").select("*", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return passed.select(*failed.columns).unionByName(failed)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    The statistics are made twice: once for the estimates, and once more along with the rows, which meet
    the estimates of their group only. So no text is moved, and rows that share an id are judged apart.
    """
    _, groups, fits = fitted(keep(statistics(docs, id_col, text_col, keys), "statistics"))
    rows = statistics(docs, id_col, text_col, keys, F.struct(*[F.col(c) for c in docs.columns]))
    rows = _distance(_grouped(_features(rows), groups), fits, "distance")
    # the whole condition needs the estimates: parts of it would be pushed down into the text functions
    ok = F.when(F.col("base_failed"), F.lit(None)).otherwise(F.col("distance")) <= CUTOFF
    return rows.filter(ok).select("_carry.*")


def op1_quality_rules(spark, folder: str) -> DataFrame:
    """Base statistics and verdict of all documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return judged(docs).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "distance")
