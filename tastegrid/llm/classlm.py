"""Language-model scores by Brown's class-based bigrams, trained by the exchange algorithm.

Texts are cut into words once and written as blocks of bounded size: every token as a number among the words of
its block, and a 128-bit digest of each of these words. Digests are dealt into parts by hash; a part numbers its
words, counts them over all blocks, and from then on tells blocks whatever they need to know of their words
(classes, counts) and gathers what blocks have found out about them. Blocks and parts exchange packed arrays, so
texts are never shuffled by word, and a word of a third of all tokens is one entry of each block like any other.

Exchange: with the classes of a round, a word's context is its number of neighbours of every class, before and
after it. From its context and the matrix of class pairs alone (classes x classes numbers, whatever the corpus is)
each word works out how the likelihood changes by a move to each class, and takes the best. Words move in halves
drawn by hash, as words that attract each other would otherwise swap places for ever. The round with the best
likelihood is kept.

The model: P(w | v) = P(class w | class v) * P(w | class w). Emissions are relative frequencies. Transitions are
class pairs smoothed by Witten and Bell with class frequencies. A word that training has not met is one more class
that holds the share of words met once; ends of texts are a class of their own and stand before every first word.
The probabilities of all known words and the unknown one add up to 1 after any word.

A null text is empty and has an end only; a null id counts as the empty text where training rows are drawn.
Repeated rows and ids are rows of their own; other columns are not looked at. Without training rows every word is
unknown and all scores are 0; a table without rows gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.session import drop, stage

#: The end of a text as a word; words hold no white space. It is word 0 of every block.
END = b"\n"
#: Bytes of text in a block, unless one text is longer.
BLOCK_BYTES = 8_000_000
#: Words of all blocks in a part, by expectation.
PART_WORDS = 1 << 19
#: Words whose moves are worked out at once, and entries of contexts that wait to be summed.
CHUNK, WAIT = 1024, 1 << 21


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [a.tobytes() for a in arrays]


def _array(value: pa.Scalar | bytes, kind: type) -> np.ndarray:
    return np.frombuffer(value if isinstance(value, bytes) else value.as_buffer() or b"", kind)


def _thin(a: np.ndarray, rising: bool = False) -> bytes:
    """Numbers below 2^32 byte by byte, all first bytes first, so that files and shuffles compress them well;
    of rising ones the steps."""
    a = np.diff(a, prepend=0) if rising else a
    return np.ascontiguousarray(a, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _thick(value: pa.Scalar, rising: bool = False) -> np.ndarray:
    planes = _array(value, np.uint8).reshape(4, -1)
    a = np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)
    return np.cumsum(a) if rising else a


# --- blocks --------------------------------------------------------------------------

BLOCKS = "block long, ids array<long>, held binary, sizes binary, tokens binary, digests binary, uses binary"


def _block(number: int, ids: pa.Array, held: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    """Texts as numbers of a vocabulary of their own; ``uses`` counts words in rows that are not held out."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, offsets = found.flatten(), found.offsets.to_numpy()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False).astype(bool)
    before = np.concatenate([[0], np.cumsum(real)])
    words = before[offsets[1:]] - before[offsets[:-1]]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    sizes = (words + 1).astype(np.int32)
    tokens = np.zeros(int(sizes.sum()), np.int32)
    tokens[np.arange(words.sum()) + np.repeat(np.arange(len(words)), words)] = coded.indices.to_numpy() + 1
    names = [END, *coded.dictionary.cast(pa.binary()).to_pylist()]
    uses = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(names)).astype(np.int64)
    packed = [held.tobytes(), _thin(sizes), _thin(tokens), b"".join(map(xxhash.xxh3_128_digest, names)), _thin(uses)]
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in packed]],
        names=["block", "ids", "held", "sizes", "tokens", "digests", "uses"])


def blocks(docs: DataFrame, held_out: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of BLOCKS over (doc_id, text); blocks are numbered by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        waiting: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            return _block(number, rows.column(0), rows.column(1).to_numpy(zero_copy_only=False).astype(bool), rows.column(2))

        for batch in batches:
            length = pc.binary_length(batch.column(2)).to_numpy()
            lo = 0
            while lo < batch.num_rows:
                room = int(np.searchsorted(np.cumsum(length[lo:]), block_bytes - size, side="right"))
                if room or not size:
                    part = batch.slice(lo, max(room, 1))
                    waiting.append(part)
                    size += int(length[lo:lo + part.num_rows].sum())
                    lo += part.num_rows
                if lo < batch.num_rows:
                    yield flush()
                    number, waiting, size = number + 1, [], 0
        if waiting:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"),
                       F.coalesce("text", F.lit("")).alias("text"))
    return stage(rows.mapInArrow(run, BLOCKS), "lm-blocks")


# --- words ---------------------------------------------------------------------------

WORDS = "part int, block long, at binary, place binary, counts binary, end int"


def numbered_words(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((part, block, at, place), (part, counts, end)).

    The words of a part have places by the order of their digests. ``at`` and ``place``: of the words of a
    block that belong to the part, their numbers in the block and in the part. ``counts``: uses of each word in
    training rows, 0 for those that only other rows have. ``end``: the place of the end of texts, or -1.
    """
    total = texts.agg(F.coalesce(F.sum(F.length("digests") / 16), F.lit(0.0))).first()[0]
    parts = max(1, int(-(-total // PART_WORDS)))
    last = np.frombuffer(xxhash.xxh3_128_digest(END), ">u8")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, digests, uses in zip(*batch.columns):
                d, n = _array(digests, ">u8").reshape(-1, 2), _thick(uses)
                part = (d[:, 1] % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable").astype(np.int32)
                cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
                packed = [(_thin(at, True), d[at].tobytes(), _thin(n[at])) for at in np.split(order, cuts[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(part[order][cuts]), pa.array([block.as_py()] * len(cuts), pa.int64()),
                    *[pa.array(x, pa.binary()) for x in zip(*packed)]], names=["part", "block", "at", "digests", "uses"])

    def number(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        digests = [_array(x, ">u8").reshape(-1, 2).astype(np.uint64) for x in rows["digests"]]
        d, n = np.concatenate(digests), np.concatenate([_thick(x) for x in rows["uses"]])
        order = np.lexsort((d[:, 1], d[:, 0]))
        new = np.concatenate([[True], (d[order][1:] != d[order][:-1]).any(1)])
        place = np.empty(len(d), np.int32)
        place[order] = np.cumsum(new) - 1
        words = d[order][new]
        counts = np.bincount(place, n, len(words)).astype(np.int64)  # exact below 2^53
        end = np.flatnonzero((words == last.astype(np.uint64)).all(1))
        cuts = np.cumsum([len(x) for x in digests])[:-1]
        k = len(digests)
        return pa.table({
            "part": pa.array([rows["part"][0].as_py()] * (k + 1), pa.int32()),
            "block": pa.array([*rows["block"].to_pylist(), None], pa.int64()),
            "at": pa.array([*rows["at"].to_pylist(), None], pa.binary()),
            "place": pa.array([*map(_thin, np.split(place, cuts)), None], pa.binary()),
            "counts": pa.array([None] * k + _pack(counts), pa.binary()),
            "end": pa.array([None] * k + [int(end[0]) if len(end) else -1], pa.int32()),
        })

    dealt = texts.select("block", "digests", "uses").mapInArrow(
        deal, "part int, block long, at binary, digests binary, uses binary")
    both = stage(dealt.groupBy("part").applyInArrow(number, WORDS), "lm-words")
    return (both.filter("block IS NOT NULL").select("part", "block", "at", "place"),
            both.filter("block IS NULL").select("part", "counts", "end"))


def told(slots: DataFrame, facts: DataFrame, **kinds: type) -> DataFrame:
    """(part, block, at, place, ...): what parts know of the words of each block, from arrays by place."""
    names = list(kinds)

    def run(of_blocks: pa.Table, of_part: pa.Table) -> pa.Table:
        known = {c: _array(of_part[c][0], kinds[c]) for c in names}
        for c in names:
            column = [known[c][_thick(p)].tobytes() for p in of_blocks["place"]]
            of_blocks = of_blocks.append_column(c, pa.array(column, pa.binary()))
        return of_blocks

    return slots.groupBy("part").cogroup(facts.groupBy("part")).applyInArrow(
        run, "part int, block long, at binary, place binary, " + ", ".join(f"{c} binary" for c in names))


def _spread(rows: pa.Table, values: list[np.ndarray]) -> np.ndarray:
    """One array over the words of a block from what its parts have told."""
    out = np.empty(sum(map(len, values)), values[0].dtype)
    out[np.concatenate([_thick(x, True) for x in rows["at"]])] = np.concatenate(values)
    return out


# --- exchange ------------------------------------------------------------------------

def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(pairs: np.ndarray) -> float:
    """The part of the log likelihood that depends on the classes."""
    return float(xlogx(pairs).sum() - xlogx(pairs.sum(1)).sum() - xlogx(pairs.sum(0)).sum())


def move_gains(pairs: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray, selfs: np.ndarray) -> np.ndarray:
    """(words, classes): the likelihood with a word in each class, above that with it in no class.

    ``pairs``: numbers of class pairs; ``own``: the words' classes; ``before``, ``after``: (words, classes)
    numbers of neighbours by class; ``selfs``: how often the word follows itself, which both contain.
    """
    n, c = before.shape
    rows = np.arange(n)
    left, right = before.astype(np.int64), after.astype(np.int64)
    left[rows, own] -= selfs
    right[rows, own] -= selfs  # neighbours other than the word itself
    gains = np.zeros((n, c))
    without = pairs[own, own] - left[rows, own] - right[rows, own] - selfs  # the own class's diagonal cell
    for near, far, table in ((right, left, pairs), (left, right, pairs.T)):
        # cells (b, x): what the word adds, as a member of b, before (or after) its neighbours of class x
        w, x = np.nonzero(near)
        add = near[w, x]
        other = x != own[w]
        e, y, a = w[other], x[other], add[other]
        if len(e):
            # the same (class, number) of neighbours is met again and again
            kinds, which = np.unique(y * (int(a.max()) + 1) + a, return_inverse=True)
            of, plus = np.divmod(kinds, int(a.max()) + 1)
            cell = table[:, of].T
            change = xlogx(cell + plus[:, None]) - xlogx(cell)
            change[np.arange(len(of)), of] = 0  # the diagonal is below
            change = change[which]
            now = table[own[e], y]
            change[np.arange(len(e)), own[e]] = xlogx(now) - xlogx(now - a)
            first = np.flatnonzero(np.diff(e, prepend=-1))
            gains[e[first]] += np.add.reduceat(change, first)
        h = w[~other]
        cell = table[:, own[h]].T - far[h]  # neighbours of the class that the word has left
        cell[np.arange(len(h)), own[h]] = without[h]
        change = xlogx(cell + add[~other][:, None]) - xlogx(cell)
        change[np.arange(len(h)), own[h]] = 0
        gains[h] += change
    diagonal = np.repeat(np.diag(pairs)[None, :], n, 0)
    diagonal[rows, own] = without
    gains += xlogx(diagonal + left + right + selfs[:, None]) - xlogx(diagonal)
    for total, part in ((pairs.sum(1), right), (pairs.sum(0), left)):
        size = part.sum(1) + selfs
        rest = np.repeat(total[None, :], n, 0)
        rest[rows, own] -= size
        gains -= xlogx(rest + size[:, None]) - xlogx(rest)
    return gains


#: Contexts are sums by key: place * classes + class, of the neighbours before (0) and after (1) the word;
#: side 2 has the numbers of times that a word follows itself, by place * classes.
SIDES, CLASSES = (0, 1, 2), 3
CONTEXT = "part int, " + ", ".join(f"k{s} binary, n{s} binary" for s in SIDES) + ", cls binary"


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, v = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(k, kind="stable")
    k, v = k[order], v[order]
    first = np.flatnonzero(np.diff(k, prepend=-1))
    return k[first], np.add.reduceat(v, first) if len(first) else v


def contexts(texts: DataFrame, slots: DataFrame, current: DataFrame, classes: int) -> DataFrame:
    """Rows of CONTEXT with the neighbours of all words in the training texts, under the classes of a round."""

    def look(block: pa.Table, words: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if block.num_rows:
            classes_of = [_array(x, np.uint8) for x in words["cls"]]
            cls = _spread(words, classes_of).astype(np.int64)
            place = _spread(words, [_thick(x) for x in words["place"]])
            part = _spread(words, [np.full(len(x), p.as_py(), np.int32) for p, x in zip(words["part"], classes_of)])
            tokens, sizes = _thick(block["tokens"][0]), _thick(block["sizes"][0])
            learn = np.repeat(~_array(block["held"][0], bool), sizes)
            before = np.concatenate([[0], tokens[:-1]])[learn]  # the first token of a text follows the end of another
            tokens = tokens[learn]
            twice = tokens[tokens == before]
            for side, codes in zip(SIDES, (tokens * classes + cls[before], before * classes + cls[tokens], twice * classes)):
                codes, n = np.unique(codes, return_counts=True)
                at, x = np.divmod(codes, classes)
                order = np.argsort(part[at], kind="stable")
                home = part[at[order]]
                cuts = np.flatnonzero(np.diff(home, prepend=-1))
                keys, n = (place[at] * classes + x)[order], n[order]
                for lo, hi in zip(cuts, np.append(cuts[1:], len(home))):
                    by = lo + np.argsort(keys[lo:hi])
                    out.append((home[lo], side, _thin(keys[by], True), _thin(n[by])))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["part", "side", "k", "n"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}

        def flush() -> pa.RecordBatch:
            row = [pa.array([part], pa.int32())]
            for s in SIDES:
                k, n = _summed(*held[s]) if s in held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                row += [pa.array([x], pa.binary()) for x in (_thin(k, True), n.tobytes())]
            row.append(pa.array([held[CLASSES]], pa.binary()))
            return pa.RecordBatch.from_arrays(row, names=["part", *[f"{c}{s}" for s in SIDES for c in "kn"], "cls"])

        for batch in batches:
            for p, side, k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if part is not None and p != part:
                    yield flush()
                    held = {}
                part = p
                if side == CLASSES:
                    held[side] = k.as_py()
                    continue
                keys, sums = held.setdefault(side, ([], []))
                keys.append(_thick(k, True))
                sums.append(_thick(n))
                if len(keys) > 1 and sum(map(len, keys[1:])) > max(WAIT, len(keys[0])):
                    held[side] = tuple([x] for x in _summed(keys, sums))
        if part is not None:
            yield flush()

    words = told(slots, current, cls=np.uint8)
    found = texts.select("block", "held", "sizes", "tokens").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(
        look, "part int, side int, k binary, n binary")
    own = current.select("part", F.lit(CLASSES).alias("side"), F.col("cls").alias("k"), F.lit(None).cast("binary").alias("n"))
    return stage(found.unionByName(own).repartition("part").sortWithinPartitions("part").mapInArrow(gather, CONTEXT), "contexts")


def class_pairs(context: DataFrame, classes: int) -> np.ndarray:
    """Numbers of class pairs; classes x classes values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for k, n, cls in zip(*batch.columns):
                place, x = np.divmod(_thick(k, True), classes)
                np.add.at(table, x * classes + _array(cls, np.uint8)[place], _array(n, np.int64))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], names=["cell", "n"])

    rows = context.select("k0", "n0", "cls").mapInArrow(run, "cell long, n long").groupBy(
        "cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(classes * classes, np.int64)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out.reshape(classes, classes)


def exchange(context: DataFrame, pairs: np.ndarray, half: int) -> DataFrame:
    """(part, cls) after the moves of the words in ``half``; the end keeps class 0 to itself."""
    classes = len(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            moved = []
            for i in range(rows.num_rows):
                cls = _array(rows["cls"][i], np.uint8).copy()
                sides = [(_thick(rows[f"k{s}"][i], True), _array(rows[f"n{s}"][i], np.int64)) for s in SIDES]
                for lo in range(0, len(cls), CHUNK):
                    size = min(CHUNK, len(cls) - lo)
                    table = np.zeros((3, size * classes), np.int64)
                    for s, (k, n) in enumerate(sides):
                        a, b = np.searchsorted(k, (lo * classes, (lo + size) * classes))
                        table[s, k[a:b] - lo * classes] = n[a:b]
                    table = table.reshape(3, size, classes)
                    own = cls[lo:lo + size].astype(np.int64)
                    # places follow digests, so their parity is a draw by hash
                    may = np.flatnonzero((own > 0) & (own < classes) & (np.arange(lo, lo + size) % 2 == half))
                    if len(may):
                        gains = move_gains(pairs, own[may], table[0][may], table[1][may], table[2][may, 0])
                        gains[:, 0] = -np.inf
                        stay = gains[np.arange(len(may)), own[may]]
                        better = gains.max(1) > stay + 1e-6
                        cls[lo + may[better]] = gains.argmax(1)[better]
                moved.append(cls.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(moved, pa.binary())], names=["part", "cls"])

    return context.mapInArrow(run, "part int, cls binary")


def first_classes(facts: DataFrame, classes: int) -> DataFrame:
    """(part, cls): 0 for the end, a class for each of the most frequent words, the last for all other known
    words, and ``classes`` for words without a use in training."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts, end in zip(*batch.columns):
                c = _array(counts, np.int64).copy()
                if end.as_py() >= 0:
                    c[end.as_py()] = 0
                top = np.argsort(-c, kind="stable")[:classes]
                top = top[c[top] > 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * len(top), pa.int32()), pa.array(top), pa.array(c[top])], names=["part", "place", "c"])

    often = facts.mapInArrow(best, "part int, place long, c long").orderBy(F.desc("c"), "part", "place").limit(classes - 2)
    own = {(r["part"], r["place"]): i + 1 for i, r in enumerate(often.collect())}  # fewer than ``classes``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, counts, end in zip(*batch.columns):
                c = _array(counts, np.int64)
                cls = np.where(c > 0, classes - 1, classes).astype(np.uint8)
                for (p, place), k in own.items():
                    if p == part.as_py():
                        cls[place] = k
                if end.as_py() >= 0 and c[end.as_py()]:
                    cls[end.as_py()] = 0
                out.append(cls.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["part", "cls"])

    return facts.mapInArrow(run, "part int, cls binary")


# --- the model -----------------------------------------------------------------------

@dataclass
class ClassModel:
    """``classes``: (part, cls) of all words; ``sizes``: tokens of each class; ``transition``: log10 P(class |
    class before), the last class that of unknown words; ``history``: the likelihood of each round."""
    classes: DataFrame
    sizes: np.ndarray
    transition: np.ndarray
    tokens: int
    vocabulary: int
    history: list[float]


def transitions(pairs: np.ndarray, once: int) -> np.ndarray:
    total, k = int(pairs.sum()), len(pairs)
    unknown = (once + 1) / (total + once + 1)
    share = pairs.sum(0) / max(total, 1)
    kinds, n = (pairs > 0).sum(1)[:, None], pairs.sum(1)[:, None]
    known = np.where(n > 0, (pairs + kinds * share) / np.maximum(n + kinds, 1), share)
    p = np.zeros((k + 1, k + 1))
    p[:k, :k] = known * (1 - unknown)
    p[k, :k] = share * (1 - unknown)
    p[:, k] = unknown
    return np.log10(np.maximum(p, 1e-300))  # classes without a word are never looked up


def train(texts: DataFrame, slots: DataFrame, facts: DataFrame, classes: int = 64, rounds: int = 4) -> ClassModel:
    """Exchange clustering of all words of the training texts. At most 254 classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.concatenate([_array(x, np.int64) for x in batch.column(0)] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(x)]) for x in (c.sum(), (c > 0).sum(), (c == 1).sum())], names=["tokens", "words", "once"])

    totals = facts.select("counts").mapInArrow(count, "tokens long, words long, once long").agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words", "once")]).first()
    current = stage(first_classes(facts, classes), "classes")
    best, history = None, []
    for k in range(rounds + 1):
        context = contexts(texts, slots, current, classes)
        pairs = class_pairs(context, classes)
        history.append(likelihood(pairs))
        if best is None or history[-1] > best[0]:
            best = history[-1], current, pairs
        if k < rounds:
            current = stage(exchange(context, pairs, k % 2), "classes")
        drop(context)
    _, current, pairs = best
    return ClassModel(current, pairs.sum(0), transitions(pairs, totals[2]), totals[0], totals[1], history)


def class_scores(docs: DataFrame, held_out: Column, classes: int = 64, rounds: int = 4,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows that are not held out. Scores are log10 probabilities of a text with its end;
    ``base_score`` is that of single words with one added to each count.
    """
    texts = blocks(docs, held_out, block_bytes)
    slots, facts = numbered_words(texts)
    model = train(texts, slots, facts, classes, rounds)
    transition, tokens, whole = model.transition, model.tokens, model.tokens + model.vocabulary + 1
    sizes = np.append(model.sizes, 1)

    def score(block: pa.Table, words: pa.Table) -> pa.Table:
        ids, held, n = block["ids"][0].values, _array(block["held"][0], bool), _thick(block["sizes"][0])
        cls, c = _spread(words, [_array(x, np.uint8) for x in words["cls"]]), _spread(words, [_array(x, np.int64) for x in words["counts"]])
        emission = np.where(c > 0, np.log10(np.maximum(c, 1) / sizes[cls]), 0)
        at = _thick(block["tokens"][0])
        starts = np.cumsum(n) - n
        now = cls[at]
        before = np.concatenate([cls[:1], now[:-1]])
        total = lambda x: np.add.reduceat(x[at], starts)
        return pa.table({
            "doc_id": ids, "held_out": pa.array(held), "n_tokens": pa.array(n),
            "n_known": pa.array(total((c > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(n), tokens, np.int64)),
            "base_score": pa.array(total(np.log10((c + 1) / whole))),
            "score": pa.array(np.add.reduceat(transition[before, now] + emission[at], starts)),
        })

    words = told(slots, model.classes.join(facts, "part"), cls=np.uint8, counts=np.int64)
    return texts.select("block", "ids", "held", "sizes", "tokens").groupBy("block").cogroup(
        words.groupBy("block")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
               "base_score double, score double")


def op11_class_lm(spark, folder: str) -> DataFrame:
    """Held out: crc32 of the id leaves 2 by 7."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return class_scores(docs.select("doc_id", "text"), number % 7 == 2)
