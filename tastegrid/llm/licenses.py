"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

A template and a text are read as lower-case words without punctuation. The template's words make
overlapping shingles, and every window of a text that has the template's length is compared with it:
bands of minimal shingle hashes retrieve (window, template) pairs, and a pair counts when at least ``CONTAINED``
percent of the template's shingles stand in the window. Windows are as long as the template and begin
at every half of it, over the whole text, so a passage of the template's length lies in a pair of
neighbouring windows joined to one.

Templates are statements, notices and the whole licence texts of the folder ``license_texts`` (named by SPDX id).
Only windows that hold as many shingles of templates as a match needs are looked at. There are few of them
at the lengths of whole texts, and these are compared with every template of their length without bands.
Statements are so short that a share of their shingles also fits their relatives: the phrase that names
the licence (``NAMED``) must stand in the window in full. Where templates that are alike or parts of each
other match at one place, only the one that fits best is given.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tastegrid.llm.common import GAP, keep

# Widely used license statements and notices, and the whole texts.
STATEMENTS = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                 "and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the "
                  "GNU General Public License as published by the Free Software Foundation",
    "BSD-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA": "This work is licensed under a Creative Commons Attribution-ShareAlike License",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0-statement": "Released under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This work is licensed under the Mozilla Public License, version 2.0.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
                      "the MPL was not distributed with this file, You can obtain one at",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "ISC": "Released under the ISC License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: The phrase of a statement that tells its licence from its relatives. All its shingles must be in the window.
NAMED = {
    "MIT": "MIT License", "Apache-2.0": "Apache License, Version 2.0", "GPL-3.0": "GNU General Public License, version 3",
    "GPL-notice": "GNU General Public License", "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-SA": "Commons Attribution-ShareAlike", "CC-BY-4.0": "Commons Attribution 4.0",
    "CC-BY-SA-4.0": "Commons Attribution-ShareAlike 4.0", "CC-BY-NC-4.0-long": "Commons Attribution-NonCommercial 4.0",
    "CC-BY-4.0-short": "CC BY 4.0", "CC-BY-SA-4.0-short": "CC BY-SA 4.0", "CC-BY-ND-4.0-short": "CC BY-ND 4.0",
    "CC0-1.0-statement": "CC0 1.0", "GPL-2.0": "GNU General Public License, version 2",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1", "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3", "MPL-2.0": "Mozilla Public License, version 2.0",
    "MPL-2.0-notice": "Mozilla Public License, v. 2.0", "BSD-2-Clause": "BSD 2-Clause", "BSD-3-Clause": "BSD 3-Clause",
    "ISC": "ISC License",
}
TEXTS = {f"{p.stem}-text": p.read_text(encoding="utf-8")
         for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
TEMPLATES = STATEMENTS | TEXTS
#: Bits of the table of the templates' shingles, of which there are less than 30,000.
BITS = 1 << 20
#: Words of a template from which its windows are compared without bands.
LONG = 60
WIDTH = 2
CONTAINED = 75
#: Bands of minimal hashes, and hashes to a band. A window whose similarity to the template is s is retrieved with
#: probability 1 - (1 - s^HASHES)^BANDS. A window of 2 lengths that holds 3/4 of the template has s >= 0.27,
#: and 48 bands of one hash miss it with probability under 3e-7.
BANDS, HASHES = 48, 1
SEED = 20_261


def license_words(text: str | Column) -> Column:
    """Words in lower case without leading and trailing punctuation; null and blank texts have none."""
    col = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}.\x20\x09-\x0D-]+|[.-]+(?=[\x20\x09-\x0D]|$)", " ")
    return F.filter(F.split(plain, GAP), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """64-bit hashes of WIDTH neighbouring words, in order."""
    n = F.size(words) - (WIDTH - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(
        *[F.element_at(words, i + k) for k in range(WIDTH)]))).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column) -> Column:
    """One hash per band of the minimal hashes of a window."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[
        F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b * HASHES + (SEED + r)))) for r in range(HASHES)]))


def templates(spark: SparkSession, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """(template, words, size, wanted, named): the words, their number, the distinct shingles and those that must be there."""
    rows = spark.createDataFrame(
        [(k, v, NAMED.get(k, "")) for k, v in sorted(texts.items())], "template string, body string, phrase string")
    # (the words are a column of their own, else they would be made anew for every shingle)
    rows = rows.select("template", license_words("body").alias("words"), license_words("phrase").alias("_named")).repartition(1)
    return rows.select("template", "words", F.size("words").alias("size"),
                       F.array_distinct(_shingles(F.col("words"))).alias("wanted"),
                       F.array_distinct(_shingles(F.col("_named"))).alias("named"))


def telling_words(words: list[str]) -> set[str]:
    """Words of a template, the longest first, of which a text that contains enough of it holds at least one.

    A text may miss a share of the distinct shingles; the words returned are in more shingles than that.
    """
    pairs = {tuple(words[i:i + WIDTH]) for i in range(len(words) - WIDTH + 1)}
    holds: dict[str, set[tuple[str, ...]]] = {}
    for p in pairs:
        for w in p:
            holds.setdefault(w, set()).add(p)
    # of a whole text, the words with the most shingles first, but no short ones: they are in every text
    long = len(words) >= LONG
    order = sorted(holds, key=lambda w: (long and len(w) < 7, -len(holds[w]) if long else 0, -len(w), w))
    out: set[str] = set()
    met: set[tuple[str, ...]] = set()
    for w in order:
        if len(met) * 100 > (100 - CONTAINED) * len(pairs):
            break
        out.add(w)
        met |= holds[w]
    return out


def scanned(docs: DataFrame, texts: dict[str, str] = TEMPLATES, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(id, template, containment, first_word, n_windows) of every document and template found in it.

    ``containment`` is the greatest percentage of the template's shingles in one window, ``first_word`` where the
    first such window begins (from 0). Rows that share an id are scanned apart and merged per id. Texts
    without a match, null and empty ones among them, have no row.
    """
    spark = docs.sparkSession
    known = templates(spark, texts).collect()  # the given templates
    # least shingles that a match of each length has
    least: dict[int, int] = {}
    for r in known:
        n = -(-CONTAINED * len(r["wanted"]) // 100)
        least[r["size"]] = min(n, least.get(r["size"], n))
    # most texts hold no word that a match needs, and are not taken apart
    needed = set().union(*[telling_words(r["words"]) for r in known])
    needed = sorted(w for w in needed if not any(x != w and x in w for x in needed))
    # (as an element of an array the lower-cased text is made once, not for every word)
    listed = F.split(F.lit(" ".join(needed)), " ")
    may = F.exists(F.array(F.lower(F.col(text_col))), lambda t: F.exists(listed, lambda w: t.contains(w)))
    rows = docs.filter(may).select(F.col(id_col).alias("id"), license_words(text_col).alias("_w")).withColumn("_h", _shingles(F.col("_w")))
    # where a shingle of a template stands, or a few in a hundred others: a table of bits is one literal, a list of
    # thousands of values is not, and what is let through meets the exact step
    bits = [0] * (BITS // 64)
    for r in known:
        for x in r["wanted"]:
            bits[x >> 6 & BITS // 64 - 1] |= 1 << (x & 63)
    table = F.split(F.lit(",".join(str(b - (b >> 63 << 64)) for b in bits)), ",").cast("array<bigint>")

    def met(x: Column) -> Column:
        return F.bit_get(F.get(table, F.shiftright(x, 6).bitwiseAND(BITS // 64 - 1).cast("int")),
                         x.bitwiseAND(63).cast("int")) == 1

    hits = F.filter(F.transform("_h", lambda x, i: F.when(met(x), i)), lambda i: i.isNotNull())
    # no filter on the hits: it would be pushed down and make the words anew for every shingle. Exploding the windows drops texts without hits.
    # rows that share an id are told apart by a number for the row
    near = rows.select("id", "_h", hits.alias("_hits")).withColumn("_row", F.monotonically_increasing_id())

    def starts(n: int) -> Column:
        """Windows of 2 n shingles at every n-th one that hold enough hits: the last needed one is before the end."""
        def at(i: Column, j: Column) -> Column:
            last, block = F.get(F.col("_hits"), j + F.lit(max(least[n], 1) - 1)), F.floor(i / n)
            return F.filter(F.array(*[
                F.struct(F.lit(n).alias("size"), (F.greatest(b, F.lit(0)) * n).cast("int").alias("at"), last.alias("last"))
                for b in (block, block - 1)]), lambda w: w["last"] < w["at"] + 2 * n)
        found = F.flatten(F.transform("_hits", at))
        return F.array_distinct(F.transform(found, lambda w: F.struct(w["size"].alias("size"), w["at"].alias("at"))))

    spans = F.flatten(F.array(*[starts(n) for n in sorted(least)]))
    windows = near.select("id", "_row", "_h", F.explode(spans).alias("s")).select(
        "id", "_row", "s.size", "s.at", F.array_distinct(F.slice("_h", F.col("s.at") + 1, 2 * F.col("s.size"))).alias("shingles"))

    def codes(shingles: str) -> Column:
        return F.when(F.col("size") >= LONG, F.array(F.lit(0).cast("bigint"))).otherwise(_bands(F.col(shingles)))

    banded = windows.select("id", "_row", "size", "at", "shingles", F.posexplode(codes("shingles")).alias("band", "code"))
    index = spark.createDataFrame(
        [(r["template"], r["size"], r["wanted"], r["named"]) for r in known],
        "template string, size int, wanted array<bigint>, named array<bigint>").select(
        "template", "size", "wanted", "named", F.posexplode(codes("wanted")).alias("band", "code"))
    # the index has BANDS rows at most per given template
    pairs = banded.join(F.broadcast(index), ["size", "band", "code"]).select(
        "id", "_row", "template", "size", "at", "shingles", "wanted", "named")
    contained = F.floor(100 * F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted")).cast("long")
    places = keep(pairs.withColumn("containment", contained).filter(
        (F.col("containment") >= CONTAINED) & (F.size(F.array_except("named", "shingles")) == 0)
    ).groupBy("id", "_row", "template", "size", "at").agg(F.max("containment").alias("containment")), "license-places")
    return (
        _best(places, known).groupBy("id", "template").agg(
            F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_word"),
            F.count_distinct("at").alias("n_windows"))
    )


def _best(places: DataFrame, known: list) -> DataFrame:
    """Matches without those that a relative at the same place explains better.

    A template that another one holds gives way to it; two that hold each other (versions of a text) are
    decided by containment, then by length.
    """
    sets = {r["template"]: set(r["wanted"]) for r in known}
    inside = {(a, b) for a in sets for b in sets if a != b and sets[a]
              and 100 * len(sets[a] & sets[b]) >= CONTAINED * len(sets[a])}
    if not inside:
        return places
    spark = places.sparkSession
    # pairs of the given templates
    kin = F.broadcast(spark.createDataFrame([(a, b, (b, a) in inside) for a, b in sorted(inside)],
                                            "template string, _other string, _mutual boolean"))
    other = places.select("id", "_row", *[F.col(c).alias(f"_{c}") for c in ("template", "size", "at", "containment")])
    rivals = places.join(kin, "template").join(
        other.withColumnRenamed("_template", "_other"), ["_row", "_other"]).filter(
        (F.col("at") < F.col("_at") + 2 * F.col("_size")) & (F.col("_at") < F.col("at") + 2 * F.col("size"))
        & (~F.col("_mutual") | (F.struct("_containment", "_size", "_other") > F.struct("containment", "size", "template"))))
    return places.join(rivals.select("_row", "template", "at").distinct(), ["_row", "template", "at"], "left_anti")


def op10_license_scan(spark, folder: str) -> DataFrame:
    """License statements in all documents: one row per document and template found."""
    return scanned(spark.read.parquet(f"{folder}/documents.parquet")).withColumnRenamed("id", "doc_id")
