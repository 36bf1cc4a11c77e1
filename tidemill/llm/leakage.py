"""Evaluation texts that appear in a corpus."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.plans.physical import materialize

#: Successive words of an item that make a leak.
WINDOW = 13
#: Hamming distance up to which fingerprints are candidates.
RADIUS = 2
#: Words of a shingle and the least weighted similarity of near windows.
SHINGLE = 5
SIMILARITY = 0.8
#: Words of items held by a worker at once; more items are taken in turn, in blocks of this size.
BLOCK_WORDS = 2_000_000
#: Windows whose fingerprints are computed at once, and candidate pairs compared at once.
CHUNK = 32_768
PAIRS = 65_536
#: What sums of weights may be off by.
SLACK = 1e-9
#: Shingles in order, and the weight of each.
Weights = tuple[np.ndarray, np.ndarray]


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words: maximal runs of letters or digits, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1)), lambda w: F.xxhash64(F.lower(w)))


def _starts(owner: np.ndarray, length: int) -> np.ndarray:
    """Positions at which `length` successive words of one text begin."""
    n = len(owner) - length + 1
    return np.flatnonzero(owner[:n] == owner[length - 1 :]) if n > 0 else np.empty(0, np.int64)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, member) for all members of the ranges low..high - 1."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n - low, n)


def _chunked(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The ranges in runs of about PAIRS members, or of one range: (the run, number of the range in it, member)."""
    met = np.cumsum(high - low)
    at = 0
    while at < len(low):
        end = max(int(np.searchsorted(met, (met[at - 1] if at else 0) + PAIRS, "right")), at + 1)
        yield slice(at, end), *_ranges(low[at:end], high[at:end])
        at = end


def _distinct(rows: np.ndarray) -> np.ndarray:
    """False where a value stands further left in its row already."""
    return ~np.tril(rows[:, :, None] == rows[:, None, :], -1).any(axis=2)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """64-bit hash of the SHINGLE words from every position on, in their order."""
    n = max(len(words) - SHINGLE + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n].view(np.uint64)
    return out.view(np.int64)


def weigh(shingles: np.ndarray, weights: Weights | None) -> np.ndarray:
    if weights is None or not len(weights[0]):
        return np.ones(len(shingles))
    k = np.minimum(np.searchsorted(weights[0], shingles), len(weights[0]) - 1)
    return np.where(weights[0][k] == shingles, weights[1][k], 1.0)


def simhash(words: np.ndarray, length: int) -> np.ndarray:
    """SimHash of every `length` successive words: each bit by the majority of the words' bits, ties up.

    Running sums of the bits give every window in one subtraction.
    """
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, CHUNK):
        part = words[a : a + CHUNK + length - 1].view(np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.zeros((len(part) + 1, 64), np.uint32)
        np.cumsum(bits, axis=0, dtype=np.uint32, out=sums[1:])
        high = (sums[length:] - sums[:-length]) * 2 >= length
        out[a : a + len(high)] = np.packbits(high, axis=1).view(np.uint64).ravel()
    return out


def blocks_of(prints: np.ndarray, radius: int) -> list[np.ndarray]:
    """The fingerprints cut into radius + 1 blocks of bits: two within the radius agree in one block at least."""
    cuts = np.linspace(0, 64, radius + 2).astype(int)
    return [((prints >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1)).astype(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class ItemIndex:
    """Windows of a block of items with a multi-index over their fingerprints.

    ids: item number of every text; words, owner: all words one after another and the text each belongs to.
    """

    def __init__(self, ids: np.ndarray, words: np.ndarray, owner: np.ndarray, weights: Weights | None, length: int, radius: int):
        self.ids, self.words, self.owner, self.length, self.radius = ids, words, owner, length, radius
        self.at = _starts(owner, length)
        self.prints = simhash(words, length)[self.at]
        self.tables = []
        for block in blocks_of(self.prints, radius):
            order = np.argsort(block, kind="stable")
            width = min(22, int(block.max()).bit_length() if len(block) else 1)
            seen = np.zeros(1 << width, bool)
            seen[block & ((1 << width) - 1)] = True
            self.tables.append((block[order], order, seen, (1 << width) - 1))
        self.weights = weights
        self.shingles = shingle_hashes(words)
        self.weight = weigh(self.shingles, weights)
        places = _starts(owner, SHINGLE)
        self.places = places[np.argsort(self.shingles[places], kind="stable")]
        self.keys = self.shingles[self.places]

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window of the argument, window of the index) for every pair within the radius, at least once, in bounded portions."""
        for (values, order, seen, mask), block in zip(self.tables, blocks_of(prints, self.radius), strict=True):
            some = np.flatnonzero(seen[block & mask])
            for run, which, k in _chunked(np.searchsorted(values, block[some], "left"), np.searchsorted(values, block[some], "right")):
                left, right = some[run][which], order[k]
                near = np.bitwise_count(prints[left] ^ self.prints[right]) <= self.radius
                yield left[near], right[near]

    def shared(self, shingles: np.ndarray, weight: np.ndarray, at: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window of the argument, window of the index) for at least every pair of that weighted similarity.

        The shared shingles of such a pair weigh `similarity` of the window's own at least, so it shares one of any of
        them that weigh more than the rest: of those, the ones found least often in the items are looked up.
        """
        low, high = np.searchsorted(self.keys, shingles, "left"), np.searchsorted(self.keys, shingles, "right")
        reach = self.length - SHINGLE + 1
        held = np.concatenate([[0], np.cumsum(high > low)])
        some = np.flatnonzero(held[at + reach] > held[at]) if len(at) else at
        for a in range(0, len(some), CHUNK):
            rows = at[some[a : a + CHUNK]][:, None] + np.arange(reach)
            own = weight[rows] * _distinct(shingles[rows])
            order = np.argsort((high - low)[rows], axis=1, kind="stable")
            rows, own = np.take_along_axis(rows, order, axis=1), np.take_along_axis(own, order, axis=1)
            before = np.cumsum(own, axis=1) - own
            r, c = np.nonzero((own > 0) & (before <= (1 - similarity) * own.sum(axis=1, keepdims=True) + SLACK) & (high > low)[rows])
            left, p = some[a : a + CHUNK][r], rows[r, c]
            for run, which, k in _chunked(low[p], high[p]):
                places = self.places[k]
                near, j = _ranges(np.searchsorted(self.at, places - reach + 1, "left"), np.searchsorted(self.at, places, "right"))
                both = np.unique((left[run][which[near]] << 32) | j)
                yield both >> 32, both & 0xFFFFFFFF

    def similarity(self, words: np.ndarray, shingles: np.ndarray, weight: np.ndarray, at: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weighted Jaccard similarity of the windows' shingles, whether the windows are the same word for word)."""
        reach = np.arange(self.length)
        same = (words[at[:, None] + reach] == self.words[self.at[mine][:, None] + reach]).all(axis=1)
        reach = np.arange(self.length - SHINGLE + 1)
        a, b = at[:, None] + reach, self.at[mine][:, None] + reach
        x, y = shingles[a], self.shingles[b]
        u, v = weight[a] * _distinct(x), self.weight[b] * _distinct(y)
        both = (u * (x[:, :, None] == y[:, None, :]).any(axis=2)).sum(axis=1)
        return np.where(same, 1.0, both / (u.sum(axis=1) + v.sum(axis=1) - both)), same


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts of a list column, and the row each belongs to; null lists have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), np.where(valid, sizes, 0))


def shingle_weights(items: DataFrame, item_id: str, text: str) -> Weights:
    """Shingle weights 1 / (1 + ln(number of items that hold it)): what many items share says less.

    Counted once over all items, whatever their blocks. Only shingles of more than one item are gathered, all others weigh 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, owner = _flat(batch.column(1))
            at = _starts(owner, SHINGLE)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[at])), pa.array(shingle_hashes(words)[at])], ["item_id", "shingle"])

    kind = dict(items.dtypes)[item_id]
    cut = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), word_hashes(F.col(text)).alias("words"))
    held = cut.mapInArrow(run, f"item_id {kind}, shingle bigint").groupBy("shingle").agg(F.count_distinct("item_id").alias("n")).where(F.col("n") > 1).toArrow()
    keys, n = (held.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(keys)
    return keys[order], 1.0 / (1.0 + np.log(n[order]))


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[pa.Table]:
    """The items as Arrow tables (item_id, words) of at most `block_words` words, or of one item.

    The number of blocks grows with the items, the size of what is sent to the workers at once does not: the split is
    doubled until the largest part is counted to be small enough.
    """
    cut = materialize(items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), word_hashes(F.col(text)).alias("words")))
    parts = 1
    while True:
        part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
        sizes = cut.groupBy(part.alias("part")).agg(F.sum(F.size("words")).alias("n"), F.count_distinct("item_id").alias("items"))
        most = sizes.where(F.col("items") > 1).agg(F.max("n")).first()[0] or 0
        if most <= block_words:
            break
        parts *= 2
    for k in range(parts):
        yield cut.where(part == k).select("item_id", "words").toArrow()


def summed(rows: np.ndarray, texts: np.ndarray, windows: np.ndarray, same: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
    """[row, text, exact, near, best] per row and text of found pairs: a window that met several windows of a text counts once."""
    order = np.lexsort((windows, texts, rows))
    r, t, w, s, v = rows[order], texts[order], windows[order], same[order].astype(np.int64), score[order]
    if not len(r):
        return [r, t, s, s, v]
    pair = np.concatenate([[True], (r[1:] != r[:-1]) | (t[1:] != t[:-1])])
    at = np.flatnonzero(pair | np.concatenate([[True], w[1:] != w[:-1]]))
    s, v = np.maximum.reduceat(s, at), np.maximum.reduceat(v, at)
    first = np.flatnonzero(pair[at])
    return [r[at][first], t[at][first], np.add.reduceat(s, first), np.diff(np.append(first, len(at))), np.maximum.reduceat(v, first)]


#: The index a Python worker holds, by the token of the items it was sent: built once a worker, not once a task.
_held: dict[str, ItemIndex] = {}


def held_index(token: str, sent: Broadcast, length: int, radius: int) -> ItemIndex:
    if token not in _held:
        _held.clear()
        _held[token] = ItemIndex(*sent.value, length, radius)
    return _held[token]


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", length: int = WINDOW, radius: int = RADIUS, similarity: float = SIMILARITY, near: bool = True) -> DataFrame:
    """(doc_id, item_id, exact_windows, near_windows, best_similarity): documents with windows of an item.

    SimHash fingerprints are taken of every `length` successive words of items and documents. A multi-index over
    radius + 1 blocks of bits finds every pair of windows within the Hamming radius: equal windows always, others as far
    as their fingerprints agree, which of windows with one changed word few do. With `near`, a join over shared five-word
    shingles therefore adds every pair of at least `similarity`; without, near_windows and best_similarity rest on the
    fingerprints alone. Each candidate is then compared itself: word for word, and by weighted shingles, the weights counted
    over all items; pairs of at least `similarity` stay. The items, in blocks of bounded size, meet the documents where they lie:
    whole texts are read once per block and only the pairs found are shuffled. exact_windows counts the document's windows
    that are word for word one of the item's, near_windows all that stay. A text of fewer than `length` words has no
    window; null ids and null texts have none; rows with one id count as one document or item.
    """
    kinds = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    posed = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), word_hashes(F.col(text)).alias("words"))
    spark = documents.sparkSession
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, exact bigint, near bigint, best double"
    out: DataFrame | None = None
    weights = shingle_weights(items, item_id, text)
    for block in item_blocks(items, item_id, text):
        words, owner = _flat(block.column(1))
        ids = block.column(0).combine_chunks()
        sent = spark.sparkContext.broadcast((ids, words, owner, weights))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, token=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = held_index(token, sent, length, radius)
            for batch in batches:
                own, of = _flat(batch.column(1))
                at = _starts(of, length)
                shingles = shingle_hashes(own)
                weight = weigh(shingles, index.weights)
                found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))]
                for x, y in chain(index.candidates(simhash(own, length)[at]), index.shared(shingles, weight, at, similarity) if near else ()):
                    for a in range(0, len(x), PAIRS):
                        i, j = x[a : a + PAIRS], y[a : a + PAIRS]
                        score, same = index.similarity(own, shingles, weight, at[i], j)
                        keep = score >= similarity - SLACK
                        found.append((i[keep], j[keep], score[keep], same[keep]))
                left, right, score, same = (np.concatenate(c) for c in zip(*found, strict=True))
                r, t, exact, close, best = summed(of[at[left]], index.owner[index.at[right]], left, same, score)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), index.ids.take(pa.array(t)), pa.array(exact), pa.array(close), pa.array(best)], ["doc_id", "item_id", "exact", "near", "best"])

        part = posed.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.sum("exact").alias("exact_windows"), F.sum("near").alias("near_windows"), F.max("best").alias("best_similarity"))


def leaked(found: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the rows of leaks() with a window that is the item's word for word."""
    return found.where(F.col("exact_windows") > 0).select("doc_id", "item_id")
