"""Substring dedup: repeated paragraphs and passages.

Paragraphs (lines of WORDS words or more) are compared by the Jaccard likeness of their
5-word shingles: MinHash signatures are cut into bands tuned for high recall at LIKE,
paragraphs that meet in a band are paired, every pair is verified on the exact shingle sets,
and components of verified links are the classes. Passages are runs of WORDS words or more that
stand elsewhere too, whatever the lines: of each such run the least hash of GRAM words is
its seed; neighbouring runs with one seed are a block, and blocks whose seeds repeat are
compared, whole where they are equal and run by run where they differ. Neighbouring repeated
runs are joined.

Equal paragraphs are one node from the start. Buckets of a band are compared in three rounds:
its members are compared with its least, then, where that leaves several components, with a
few neighbours, and at last all pairs that are not in one component by then.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from barloom.llm.components import connected_components
from barloom.session import checkpointed, forget, freed_shuffles, shared_folder, ship_package

#: Least words of a reported passage, and likeness of near copies.
WORDS = 25
LIKE = 0.8
SHINGLE = 5
#: 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.995 of pairs at likeness 0.8 meet, and nearly all above.
BANDS, ROWS = 10, 4
#: Members before it in a bucket that a member is compared with in the second round.
REACH = 8
#: Words of a seed.
GRAM = 10
#: Bits of a paragraph's sketch.
SKETCH = 512
#: Ids of paragraphs up to which they are broadcast to fetch texts (8 bytes each).
FEW = 1_000_000
#: Bytes of text handled at once in a worker.
BLOCK = 1_000_000
#: Shingles handled at once for bands: they stay in a core's cache.
GROUP = 8_192
_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RNG = np.random.default_rng(5)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_G = _RNG.integers(1, 1 << 63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

UNITS = pa.schema(
    [("doc_id", pa.int64()), ("line", pa.int32()), ("piece", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int32()), ("uid", pa.int64()), ("bands", pa.list_(pa.int64())), ("text", pa.string())]
)
SEEDED = pa.schema(
    [("doc_id", pa.int64()), ("t", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("seed", pa.int64()), ("block", pa.int64()), ("goes", pa.bool_()), ("covered", pa.bool_()), ("windows", pa.list_(pa.int64()))]
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= _M
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


#: Powers for blocks of the usual size, made once a worker.
_TABLES: list[np.ndarray] = []


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial of ``values`` with a 0 before it, and the factors that scale a difference to its start."""
    n = len(values)
    if n >= 2 * BLOCK:
        power, back = _powers(_M, n + 1), _powers(_INVERSE, n + 1)
    else:
        if not _TABLES:
            _TABLES.extend((_powers(_M, 2 * BLOCK), _powers(_INVERSE, 2 * BLOCK)))
        power, back = _TABLES[0], _TABLES[1][: n + 1]
    total = np.zeros(n + 1, np.uint64)
    np.multiply(values, power[:n], out=total[1:])
    np.cumsum(total, out=total)
    return total, back


def _weighted(word: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """At each place the hash of as many values as there are ``factors`` (fewer values: none)."""
    m = max(0, len(word) - len(factors) + 1)
    out = word[:m] * factors[0]
    for j in range(1, len(factors)):
        out += word[j : m + j] * factors[j]
    return _mixed(out)


def _over(choose: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """At each place what ``choose`` (minimum, maximum) takes of the ``width`` values from it."""
    out, has = values, 1
    while has < width:
        step = min(has, width - has)
        out, has = choose(out[:-step], out[step:]), has + step
    return out


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of the ranges that start at ``first``, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Tokens:
    """Words of a block of documents: hashes, bytes, lines and documents, with running sums for hashes of word ranges."""

    def __init__(self, texts: list[str]) -> None:
        lowered = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        self.raw = b"\n".join([*lowered, b""])
        data = np.frombuffer(self.raw, np.uint8)
        doc_ends = np.cumsum(np.fromiter((len(b) + 1 for b in lowered), np.int64, len(lowered)))
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total, back = _sums(data.astype(np.uint64) + np.uint64(1))
        self.word = _mixed((total[self.end] - total[self.start]) * back[self.start])
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        self.line = lines[self.start]
        self.place = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with each byte
        doc_start = np.concatenate([[0], doc_ends[:-1]])
        self.doc = np.searchsorted(doc_ends, self.start, "right")
        self.before = self.place[doc_start] - ((data[doc_start] & 0xC0) != 0x80) if len(data) else np.zeros(0, np.int64)
        self.lines_before = lines[doc_start]
        self.spoken, self.scale = _sums(self.word)

    def uid(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the word ranges [a, b)."""
        return _mixed((self.spoken[b] - self.spoken[a]) * self.scale[a] + (b - a).astype(np.uint64)).view(np.int64)

    def line_in(self, a: np.ndarray) -> np.ndarray:
        """Lines, counted within their documents, on which the words ``a`` stand."""
        return self.line[a] - self.lines_before[self.doc[a]]

    def span(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the word ranges [a, b) within their documents."""
        before = self.before[self.doc[a]]
        return self.place[self.start[a]] - 1 - before, self.place[self.end[b - 1] - 1] - before

    def least_grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of the GRAM words at each word, the least of those within the WORDS words from it, and whether a document has that many."""
        n = len(self.word)
        if n < WORDS:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        gram = _weighted(self.word, _G)
        return gram, _over(np.minimum, gram, WORDS - GRAM + 1), self.doc[: n - WORDS + 1] == self.doc[WORDS - 1 :]


def units(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
    """Paragraphs (piece -1, with bands and text) of a block of documents; offsets in code points."""
    return _paragraph_rows(ids, Tokens(texts))


def _paragraph_rows(ids: list[int | None], t: Tokens) -> pa.RecordBatch:
    first = np.flatnonzero(np.diff(t.line, prepend=-1))
    count = np.diff(np.append(first, len(t.line)))
    wide = np.flatnonzero(count >= WORDS)
    a, b = first[wide], first[wide] + count[wide]
    bands = _bands(t.word, a, count[wide])
    text = [t.raw[x:y].decode("utf-8", "replace") for x, y in zip(t.start[a].tolist(), t.end[b - 1].tolist())]
    start, end = t.span(a, b)
    numbers = [t.line_in(a), np.full(len(a), -1), start, end, b - a, t.uid(a, b)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids[i] for i in t.doc[a].tolist()], pa.int64()),
            *[pa.array(c.astype(k)) for c, k in zip(numbers, (np.int32, np.int32, np.int64, np.int64, np.int32, np.int64))],
            pa.ListArray.from_arrays(pa.array((np.arange(len(a) + 1) * BANDS).astype(np.int32)), pa.array(bands.ravel())),
            pa.array(text, pa.string()),
        ],
        schema=UNITS,
    )


def _seed_rows(ids: list[int | None], t: Tokens) -> pa.RecordBatch:
    """Seeds (piece 0, uid the hash of GRAM words): every place that is least in some WORDS words of its document, whatever the lines.

    Equal runs of WORDS words have equal seeds, so a run that repeats has only seeds that repeat.
    """
    gram, least, whole = t.least_grams()
    beyond = np.zeros(WORDS - GRAM if len(least) else 0, np.uint64)
    most = _over(np.maximum, np.concatenate([beyond, np.where(whole, least, np.uint64(0)), beyond]), WORDS - GRAM + 1)
    at = np.flatnonzero((gram == most) & (most > 0))
    nulls = [pa.nulls(len(at), UNITS.field(k).type) for k in range(len(UNITS))]
    nulls[0] = pa.array([ids[i] for i in t.doc[at].tolist()], pa.int64())
    nulls[2] = pa.array(np.zeros(len(at), np.int32))
    nulls[6] = pa.array(gram[at].view(np.int64))
    return pa.RecordBatch.from_arrays(nulls, schema=UNITS)


def _bands(word: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Band keys of the paragraphs that start at ``first`` and have ``count`` words.

    Hashes of shingles are mixed already: an odd factor for each of the BANDS * ROWS orders is enough.
    """
    out = np.empty((len(first), BANDS), np.int64)
    if not len(first):
        return out
    shingle, sizes = _weighted(word, _C), count - SHINGLE + 1
    ends = np.cumsum(sizes)
    least = np.empty((BANDS * ROWS, len(first)), np.uint64)
    at = 0
    while at < len(first):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + GROUP, "right")))
        chosen, offsets = shingle[_spread(first[at:to], sizes[at:to])], ends[at:to] - sizes[at:to] - done
        scaled = np.empty_like(chosen)
        for i, factor in enumerate(_A):
            np.multiply(chosen, factor, out=scaled)
            np.minimum.reduceat(scaled, offsets, out=least[i, at:to])
        at = to
    for k in range(BANDS):
        key = np.full(len(first), k, np.uint64)
        for r in range(ROWS):
            key = _mixed(key * _M + least[k * ROWS + r])
        out[:, k] = key.view(np.int64)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], pa.RecordBatch]]:
    """First column, texts and rows of each batch (doc_id, text, ...), cut into blocks of about BLOCK."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        at = size = 0
        for i, t in enumerate(texts):
            if i > at and size + len(t) > BLOCK:
                yield ids[at:i], texts[at:i], batch.slice(at, i - at)
                at, size = i, 0
            size += len(t)
        if at < len(texts):
            yield ids[at:], texts[at:], batch.slice(at)


def _unit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts, _ in _blocks(batches):
        t = Tokens(texts)
        yield _paragraph_rows(ids, t)
        yield _seed_rows(ids, t)


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Elements of all lists (a null list has none), and the row that each is of."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), lists.flatten()


def _numbers(rows: pa.StructArray, name: str) -> np.ndarray:
    """A field that is never null; whole numbers as 64 bits."""
    values = rows.field(name)
    return values.to_numpy(zero_copy_only=False).astype(bool if pa.types.is_boolean(values.type) else np.int64, copy=False)


def _ids(rows: pa.StructArray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A field of ids that may be null: numbers (null: 0), and which are null."""
    values = rows.field(name)
    return values.fill_null(0).to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)


class Marks:
    """Which words of a block of documents stand in repeated paragraphs (start, words, uid, kept, least), one list a document."""

    def __init__(self, t: Tokens, bounds: np.ndarray, paragraphs: pa.Array) -> None:
        n = len(t.word)
        self.covered, self.dropped, self.stays = (np.zeros(n, bool) for _ in range(3))
        #: End of the paragraph a word is in, if that repeats an earlier one word for word.
        self.copy_end = np.zeros(n, np.int64)
        of, own = _flat(paragraphs)
        start, words, uid, kept, least = (_numbers(own, c) for c in ("start", "words", "uid", "kept", "least"))
        a = np.clip(np.searchsorted(t.place[t.start] - 1, start + t.before[of]), bounds[of], bounds[of + 1])
        # rows that repeat a doc_id may have another text: the paragraph must be in this one
        held = np.flatnonzero(a + words <= bounds[of + 1])
        held = held[t.uid(a[held], a[held] + words[held]) == uid[held]]
        a, words, kept, least = (x[held] for x in (a, words, kept, least))
        at = _spread(a, words)
        kept, copied = np.repeat(kept, words), ~np.repeat(least, words)
        self.covered[at], self.dropped[at[~kept]], self.stays[at[kept]] = True, True, True
        self.copy_end[at[copied]] = np.repeat(a + words, words)[copied]

    def bare_before(self) -> np.ndarray:
        """Words before each that no repeated paragraph has."""
        return np.concatenate([[0], np.cumsum(~self.covered)])


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks whose seed repeats, from (doc_id, text, t, seeds, paragraphs).

    A block is a row of neighbouring runs of WORDS words with one least hash: ``at`` is the
    first word, ``size`` the number of runs, ``block`` the hash of all its words, ``windows``
    those of the runs. A block inside a paragraph that repeats word for word is left to the
    paragraph's first occurrence.
    """
    for ids, texts, batch in _blocks(batches):
        t = Tokens(texts)
        _, least, whole = t.least_grams()
        if not len(least):
            continue
        bounds = np.searchsorted(t.doc, np.arange(len(ids) + 1))
        marks = Marks(t, bounds, batch.column(4))
        # a seed that repeats is listed by each document that has it, so all lists of a block can be one
        seeds = batch.column(3).flatten().to_numpy(zero_copy_only=False)
        turns = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        wanted = np.repeat(np.isin(least[turns].view(np.int64), seeds), np.diff(np.append(turns, len(least))))
        wanted &= whole
        before = np.concatenate([[False], wanted[:-1] & (least[1:] == least[:-1]) & (t.doc[: len(least)][1:] == t.doc[: len(least)][:-1])])
        first = np.flatnonzero(wanted & ~before)
        if not len(first):
            continue
        number = np.cumsum(wanted & ~before) - 1  # of the block that a wanted window is in
        size = np.bincount(number[wanted], minlength=len(first))
        alone = marks.copy_end[: len(least)] < np.arange(len(least)) + WORDS
        keep = np.flatnonzero(np.bincount(number[wanted], alone[wanted], len(first)) > 0)
        first, size = first[keep], size[keep]
        end = first + size + WORDS - 1
        bare, goes = marks.bare_before(), np.concatenate([[0], np.cumsum(marks.dropped)])
        offsets, at = np.concatenate([[0], np.cumsum(size)]), _spread(first, size)
        keys = batch.column(2).to_numpy(zero_copy_only=False)
        of = t.doc[first]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in of.tolist()], pa.int64()),
                pa.array(keys[of].astype(np.int64)),
                pa.array((first - bounds[of]).astype(np.int32)),
                pa.array(size.astype(np.int32)),
                pa.array(least[first].view(np.int64)),
                pa.array(t.uid(first, end)),
                pa.array(goes[end] > goes[first]),
                pa.array(bare[end] == bare[first]),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(t.uid(at, at + WORDS))),
            ],
            schema=SEEDED,
        )


class Windows:
    """Repeated windows of a block of documents, in order: their first words ``at``, where reported words begin and end
    (``lead`` words from a window's start and ``tail`` before its end are of paragraphs that stay), number of places, keeper (and whether that is null), kept.

    From the documents' blocks (at, size, t, found). ``found`` has the windows ``k`` of a block, or -1 for all, with their number of
    places and their keeper's. Those inside repeated paragraphs are left to the paragraphs' rows,
    but for a keeper in a paragraph that goes.
    """

    def __init__(self, blocks: pa.Array, marks: Marks, bounds: np.ndarray) -> None:
        doc, rows = _flat(blocks)
        of, found = _flat(rows.field("found"))
        own = [_numbers(rows, c)[of] for c in ("at", "size", "t")] + [x[of] for x in _ids(rows, "doc_id")]
        k, n, keeper_t, keeper_at = (_numbers(found, c) for c in ("k", "n", "keeper_t", "keeper_at"))
        keeper, nobody = _ids(found, "keeper")
        # one row a window: -1 stands for as many as the block has
        every = k < 0
        row = np.repeat(np.arange(len(k)), np.where(every, own[1], 1))
        k = _spread(np.where(every, 0, k), np.where(every, own[1], 1))
        at = own[0][row] + k
        kept = (keeper_t == own[2]) & (keeper == own[3]) & (nobody == own[4])
        kept = kept[row] & (keeper_at[row] + np.where(every[row], k, 0) == at)
        at = at + bounds[doc[of[row]]]
        bare, gone = marks.bare_before(), np.concatenate([[0], np.cumsum(marks.dropped)])
        told = np.flatnonzero((bare[at + WORDS] > bare[at]) | (kept & (gone[at + WORDS] > gone[at])))
        told = told[np.argsort(at[told], kind="stable")]
        at, row, self.kept = at[told], row[told], kept[told]
        self.at, self.n, self.keeper, self.nobody = at, n[row], keeper[row], nobody[row]
        # words of paragraphs that stay at either end; a document's end is farther than WORDS
        place, last = np.arange(len(marks.stays)), at + WORDS - 1
        after = np.minimum.accumulate(np.where(marks.stays, len(place), place)[::-1])[::-1]
        ahead = np.maximum.accumulate(np.where(marks.stays, -WORDS, place))
        self.lead, self.tail = np.minimum(after[at] - at, WORDS), np.minimum(last - ahead[last], WORDS)

    def unfrayed(self) -> np.ndarray:
        """Windows without those at either end of a row of neighbours that only lead by under SHINGLE words
        to one that more places share: a word or two next to a passage that agree in some of its documents are not part of it."""
        if not len(self.at):
            return np.zeros(0, np.int64)
        a = np.flatnonzero(np.concatenate([[True], np.diff(self.at) > 1]))
        b = np.append(a[1:], len(self.at))
        step = np.arange(SHINGLE)
        edge = a[:, None] + step
        a = a + np.where(edge < b[:, None], self.n[np.minimum(edge, len(self.n) - 1)], -1).argmax(1)
        edge = b[:, None] - 1 - step
        b = b - np.where(edge >= a[:, None], self.n[np.maximum(edge, 0)], -1).argmax(1)
        return _spread(a, b - a)

    def runs(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word ranges [from, to) of neighbouring windows, their keeper's doc_id, whether that is null, and kept; ``doc`` has each word's document.

        Neighbouring windows are joined as long as their keepers stand in one document. Where
        ranges overlap the kept one has the words, and so have paragraphs that stay: what goes never takes a keeper's words.
        """
        w = self.unfrayed()
        at, keeper, nobody, kept = (x[w] for x in (self.at, self.keeper, self.nobody, self.kept))
        breaks = (np.diff(at) > 1) | (np.diff(keeper) != 0) | (nobody[1:] != nobody[:-1]) | (kept[1:] != kept[:-1])
        first = np.flatnonzero(np.concatenate([[True], breaks])) if len(at) else w
        last = np.append(first[1:], len(at))[: len(first)] - 1
        keeper, nobody, kept = keeper[first], nobody[first], kept[first]
        a = at[first] + np.where(kept, 0, self.lead[w][first])
        b = at[last] + WORDS - np.where(kept, 0, self.tail[w][last])
        of, number = doc[at[first]], np.arange(len(first))
        before = np.maximum.accumulate(np.where(kept, number, -1))
        a = np.where(~kept & (before >= 0) & (of[before] == of), np.maximum(a, b[before]), a) if len(a) else a
        behind = np.minimum.accumulate(np.where(kept, number, len(number))[::-1])[::-1]
        near = np.minimum(behind, len(number) - 1)
        b = np.where(~kept & (behind < len(number)) & (of[near] == of), np.minimum(b, a[near]), b) if len(b) else b
        left = np.flatnonzero(a < b)
        return a[left], b[left], keeper[left], nobody[left], kept[left]


def _passage_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of documents, from (doc_id, text, blocks, paragraphs)."""
    for ids, texts, batch in _blocks(batches):
        t = Tokens(texts)
        bounds = np.searchsorted(t.doc, np.arange(len(ids) + 1))
        marks = Marks(t, bounds, batch.column(3))
        a, b, keeper, nobody, kept = Windows(batch.column(2), marks, bounds).runs(t.doc)
        if not len(a):
            continue
        start, end = t.span(a, b)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[k] for k in t.doc[a].tolist()], pa.int64()),
                pa.array(t.line_in(a).astype(np.int32)),
                *[pa.array(c) for c in (start, end, b - a)],
                pa.array(keeper, pa.int64(), mask=nobody),
                pa.array(kept, pa.bool_()),
            ],
            names=["doc_id", "line", "start", "end", "n_words", "component_id", "kept"],
        )


def shingles(text: str) -> set[tuple[bytes, ...]]:
    words = text.encode("utf-8", "surrogatepass").split()
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of different shingles of each paragraph, and parities of their hashes as SKETCH / 64 longs.

    Shingles that only one of two paragraphs has are the only ones that can make bits differ:
    the bits in which two sketches differ are never more than those shingles.
    """
    t = Tokens(texts)
    bounds = np.searchsorted(t.doc, np.arange(len(texts) + 1))
    shingle = _weighted(t.word, _C)
    m = len(shingle)
    own = t.doc[:m] == t.doc[SHINGLE - 1 :] if m else np.zeros(0, bool)
    owner, shingle = t.doc[:m][own], shingle[own]
    # one of each: by a hash of paragraph and shingle
    first = np.unique(_mixed(shingle + owner.astype(np.uint64) * _M), return_index=True)[1]
    owner, shingle = owner[first], shingle[first]
    n = np.bincount(owner, minlength=len(texts))
    cell = owner * SKETCH + (shingle >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=len(texts) * SKETCH) & 1).astype(np.uint8).reshape(len(texts), SKETCH)
    few = np.diff(bounds) < SHINGLE  # paragraphs shorter than a shingle are one shingle of all their words
    n[few] = 1
    return n, np.packbits(odd, axis=1).view(">i8").astype(np.int64)


_SKETCH_COLUMNS = [f"s{i}" for i in range(8)]


@F.pandas_udf(StructType([StructField("n", IntegerType()), *[StructField(c, LongType()) for c in _SKETCH_COLUMNS]]))
def _sketched(text: pd.Series) -> pd.DataFrame:
    n, bits = sketches(text.tolist())
    return pd.DataFrame({"n": n.astype(np.int32)} | {c: bits[:, i] for i, c in enumerate(_SKETCH_COLUMNS)})


def may_be_like(a: str, b: str) -> Column:
    """Whether sketches ``a`` and ``b`` (structs) leave a Jaccard likeness of LIKE possible: (n + m - d) / (n + m + d) for d shingles apart."""
    d = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _SKETCH_COLUMNS[1:]), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    return d * (1 + LIKE) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (1 - LIKE) + 1e-6


@F.pandas_udf(DoubleType())
def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    def like(x: str, y: str) -> float:
        p, q = shingles(x), shingles(y)
        met = len(p & q)
        return met / (len(p) + len(q) - met)

    return pd.Series([like(x, y) for x, y in zip(a, b)])


def sized(keys: DataFrame) -> DataFrame:
    """A checkpointed table of ids, to be broadcast if it has FEW rows at most; beyond that the join shuffles."""
    return F.broadcast(keys) if keys.count() <= FEW else keys


class Steps:
    """Tables between the steps, each written to the shared folder, read back by column, and dropped when no later step needs it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/barloom-paragraphs-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        with freed_shuffles(self.spark):
            df.write.option("compression", "zstd").partitionBy(*by).parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def dropped(self, *names: str) -> None:
        for name in names:
            forget(self.spark, f"{self.folder}/{name}")


def unit_table(docs: DataFrame, steps: Steps) -> DataFrame:
    """Units of all documents, paragraphs and seeds in folders of their own."""
    ship_package(docs.sparkSession)
    schema = "doc_id long, line int, piece int, start long, end long, words int, uid long, bands array<long>, text string"
    return steps.written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_unit_batches, schema), "units", "piece")


def shared_buckets(distinct: DataFrame) -> DataFrame:
    """(key, uid, first): members of buckets that two or more different paragraphs share, and the bucket's least."""
    of_key = Window.partitionBy("key")
    keyed = distinct.select("uid", F.explode("bands").alias("key"))
    return keyed.select("key", "uid", F.min("uid").over(of_key).alias("first"), F.max("uid").over(of_key).alias("last")).where("first <> last").drop("last")


def links(table: DataFrame, distinct: DataFrame, steps: Steps) -> DataFrame:
    """Verified edges (a, b) between paragraph ids: exact Jaccard of LIKE or more.

    First each member of a bucket is compared with the bucket's least. Then members of buckets
    that still have several components are compared with those of the REACH before them that
    are in others (ids are hashes, so neighbours are random). These two rounds only make the third small: there every
    two members of a bucket that are still in different components are compared. So
    components are those of all pairs that meet in a bucket. Pairs whose sketches put them
    under LIKE for certain are never made; texts are fetched for the others only.
    """
    shared = steps.written(shared_buckets(distinct), "buckets")
    wanted = steps.written(shared.select("uid").distinct(), "wanted")
    texts = table.where("piece = -1").select("uid", "text").join(sized(wanted), "uid", "left_semi").groupBy("uid").agg(F.min("text").alias("text"))
    texts = steps.written(texts.withColumn("s", _sketched("text")), "texts")
    sketch = texts.select("uid", "s")

    def verified(pairs: DataFrame) -> DataFrame:
        """Edges among pairs (a, b, x, y) with the sketches of both."""
        met = pairs.where(may_be_like("x", "y")).select("a", "b").distinct()
        met = met.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("uid").alias("b"), F.col("text").alias("tb")), "b")
        return checkpointed(met.where(_jaccard("ta", "tb") >= LIKE).select("a", "b"))

    def sketched(pairs: DataFrame) -> DataFrame:
        return pairs.join(sketch.select(F.col("uid").alias("a"), F.col("s").alias("x")), "a").join(sketch.select(F.col("uid").alias("b"), F.col("s").alias("y")), "b")

    one = verified(sketched(shared.where("first <> uid").select(F.col("first").alias("a"), F.col("uid").alias("b")).distinct()))
    def still_apart(links: DataFrame, name: str) -> DataFrame:
        """Members (key, uid, c, s) of buckets that have more than one component ``c``."""
        classes = connected_components(links).withColumnRenamed("node", "uid")
        named = shared.select("key", "uid").join(classes, "uid", "left").withColumn("c", F.coalesce("component", "uid")).drop("component")
        mixed = named.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key")
        return steps.written(named.join(mixed, "key").join(sketch, "uid"), name)

    order = Window.partitionBy("key").orderBy("uid")
    other = F.struct(F.col("uid").alias("b"), F.col("c").alias("d"), F.col("s").alias("y"))
    near = still_apart(one, "apart").select(F.col("uid").alias("a"), "c", F.col("s").alias("x"), F.array(*[F.lag(other, k).over(order) for k in range(1, REACH + 1)]).alias("before"))
    near = near.select("a", "x", F.explode(F.filter("before", lambda o: o["d"] != F.col("c"))).alias("o"))
    two = verified(near.select("a", "o.b", "x", "o.y"))
    apart = still_apart(one.union(two), "rest")
    other = apart.select("key", F.col("uid").alias("b"), F.col("s").alias("y"), F.col("c").alias("d"))
    rest = apart.withColumnsRenamed({"uid": "a", "s": "x"}).join(other, "key").where((F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & may_be_like("x", "y"))
    three = verified(rest.select("a", "b", "x", "y"))
    steps.dropped("buckets", "wanted", "texts", "apart", "rest")
    return one.union(two).union(three)


def repeats(docs: DataFrame) -> DataFrame:
    """One row an occurrence of a passage that repeats.

    (doc_id, line, start, end, n_words, kind, component_id, kept): code points, end
    exclusive; kind is paragraph or passage (words that no repeated paragraph covers whole,
    over line ends too; line is that of the first word); component_id is the doc_id whose
    occurrence stays, for paragraphs the smallest that has one; kept marks the occurrence to
    stay, the first by doc_id and place. Each passage has one keeper document: where that
    changes a new row starts, and words that a kept row has are cut off rows that go, which may
    then be shorter than WORDS. Words of a kept passage stay even if a paragraph's row has them.

    Null and empty texts have no passages; null doc_ids sort first; rows that repeat a
    doc_id are one document. Empty table: no rows.
    """
    steps = Steps(docs.sparkSession)
    table = unit_table(docs, steps)
    at = F.struct("doc_id", "start")
    whole = table.where("piece = -1")
    distinct = steps.written(whole.groupBy("uid").agg(F.min(at).alias("least"), F.count("*").alias("n"), F.first("bands").alias("bands")), "distinct")
    found = connected_components(links(table, distinct.select("uid", "bands"), steps))
    named = distinct.drop("bands").join(found.withColumnRenamed("node", "uid"), "uid", "left").withColumn("c", F.coalesce("component", "uid"))
    classes = named.groupBy("c").agg(F.min("least").alias("keeper"), F.sum("n").alias("n")).where("n > 1").drop("n")
    repeated = named.select("uid", "c", "least").join(classes, "c").select("uid", "keeper", F.col("least").alias("first"))
    columns = ["doc_id", "line", "start", "end", "words"]
    marked = steps.written(whole.select(*columns, "uid").join(repeated, "uid"), "marked")
    steps.dropped("distinct", "units/piece=-1")
    paragraphs = marked.select(
        "doc_id", "line", "start", "end", F.col("words").cast("long").alias("n_words"), F.lit("paragraph").alias("kind"),
        F.col("keeper.doc_id").alias("component_id"), (F.col("keeper").eqNullSafe(F.struct("doc_id", "start"))).alias("kept"),
    )
    return paragraphs.union(passages(docs, table.where("piece = 0"), steps, marked.withColumn("least", F.col("first").eqNullSafe(at)).withColumn("kept", F.col("keeper").eqNullSafe(at))))


def passages(docs: DataFrame, table: DataFrame, steps: Steps, marked: DataFrame) -> DataFrame:
    """Rows of passages outside the repeated paragraphs ``marked`` (doc_id, start, words, uid, kept, least).

    Of a run of WORDS words the first occurrence is its keeper, one outside of paragraphs that go
    if there is any. Runs are counted by blocks: where all blocks with a seed are equal, one
    row stands for their runs; where they differ, the runs of each different block are counted
    once, with its number of places.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seeds = table.select("doc_id", "uid")
    copied = seeds.groupBy("uid").count().where("count > 1").select("uid")
    wanted = seeds.join(copied, "uid").groupBy("doc_id").agg(F.collect_set("uid").alias("seeds"))
    own = marked.groupBy("doc_id").agg(F.collect_list(F.struct("start", "words", "uid", "kept", "least")).alias("paragraphs")).withColumnRenamed("doc_id", "d")
    own = steps.written(own, "own")
    wanted = steps.written(wanted.join(own, F.col("doc_id").eqNullSafe(F.col("d")), "left").drop("d"), "asked")
    steps.dropped("units")
    asked = _with_text(texts, wanted).select("doc_id", "text", F.xxhash64("text").alias("t"), "seeds", "paragraphs")
    schema = "doc_id long, t long, at int, size int, seed long, block long, goes boolean, covered boolean, windows array<long>"
    blocks = steps.written(asked.mapInArrow(_block_batches, schema), "blocks")
    steps.dropped("asked")
    spoken = steps.written(repeated_blocks(blocks, steps), "spoken")
    steps.dropped("blocks", "seeds", "different")
    told = spoken.join(own, F.col("doc_id").eqNullSafe(F.col("d")), "left").drop("d")
    told = _with_text(texts, told).where(F.xxhash64("text") == F.col("t")).select("doc_id", "text", "blocks", "paragraphs")
    out = told.mapInArrow(_passage_batches, "doc_id long, line int, start long, end long, n_words long, component_id long, kept boolean")
    return out.distinct().select("doc_id", "line", "start", "end", "n_words", F.lit("passage").alias("kind"), "component_id", "kept")


def repeated_blocks(blocks: DataFrame, steps: Steps) -> DataFrame:
    """(doc_id, t, blocks) of documents that have runs which stand at two places or more, outside of repeated paragraphs.

    Each block (doc_id, t, at, size, found) lists its repeated runs ``k`` (-1: all) with the number of places and
    the keeper's. Runs whose places are all in repeated paragraphs are left out: no row would report them.
    """
    place = F.struct("goes", "covered", "doc_id", "t", "at")
    seeds = blocks.groupBy("seed").agg(F.min("block").alias("b0"), F.max("block").alias("b1"), F.min(place).alias("p0"), F.max(place).alias("p1"), F.count("*").alias("n"), F.min("covered").alias("inside"))
    seeds = steps.written(seeds.where("not inside and not (p0 <=> p1)"), "seeds")
    found = lambda k, p: F.struct(k.cast("int").alias("k"), F.col("n"), p["doc_id"].alias("keeper"), p["t"].alias("keeper_t"), p["at"].alias("keeper_at"))
    even = seeds.where("b0 = b1").select(F.col("b0").alias("block"), F.array(found(F.lit(-1), F.col("p0"))).alias("found"))
    uneven = seeds.where("b0 <> b1").select("seed")
    different = blocks.join(uneven, "seed").groupBy("block").agg(F.min(place).alias("p0"), F.max(place).alias("p1"), F.count("*").alias("n"), F.first("windows").alias("windows"))
    runs = steps.written(different, "different").select("block", "p0", "p1", "n", F.posexplode("windows").alias("k", "run"))
    shifted = lambda p: F.struct(*[F.col(f"{p}.{c}").alias(c) for c in ("goes", "covered", "doc_id", "t")], (F.col(f"{p}.at") + F.col("k")).alias("at"))
    counted = runs.groupBy("run").agg(F.min(shifted("p0")).alias("p0"), F.max(shifted("p1")).alias("p1"), F.sum("n").alias("n")).where("not (p0 <=> p1)").drop("p1")
    met = runs.select("block", "k", "run").join(counted, "run").groupBy("block").agg(F.collect_list(found(F.col("k"), F.col("p0"))).alias("found"))
    own = blocks.where("not covered").select("doc_id", "t", "at", "size", "block").join(even.union(met), "block")
    return own.groupBy("doc_id", "t").agg(F.collect_list(F.struct("doc_id", "t", "at", "size", "found")).alias("blocks"))


def _with_text(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of documents joined with the texts of those; a null doc_id is one like others."""
    ids = sized(rows.select(F.col("doc_id").alias("d")).distinct())
    few = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    return few.join(rows.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d"))).drop("d")
