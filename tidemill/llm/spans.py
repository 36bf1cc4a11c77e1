"""Long spans that records share character by character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.physical import BROADCAST_BYTES, ROW_BYTES, materialize, skew_semi_join

#: Shortest shared span, in code points.
SPAN = 200
#: Code points worked on at a time; longer texts go through in overlapping pieces.
CHUNK = 1_000_000
#: Odd bases of the two rolling hashes, and what code points are mixed with.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
SLICES = 32


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """The splitmix64 finalizer: every bit of the result depends on every bit of x."""
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Rabin-Karp hashes of all windows of one length at once, modulo 2**64.

    With prefix sums of c[j] * base**j, a window's hash is the difference of two prefix sums times base**-start: no loop
    over positions. The tables of powers are as long as the longest array so far, a chunk at most.
    """

    def __init__(self, base: int, seed: int):
        self.base, self.seed = base, seed
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << (n - 1).bit_length()
            self.powers, self.inverses = self._powers(self.base, size), self._powers(_inverse(self.base), size)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def windows(self, codes: np.ndarray, length: int) -> np.ndarray:
        """The mixed hash of codes[i : i + length] for every i."""
        n = len(codes)
        if n < length:
            return np.empty(0, np.uint64)
        self._grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64), self.seed) * self.powers[:n], dtype=np.uint64, out=sums[1:])
        return _mix((sums[length:] - sums[:-length]) * self.inverses[: n - length + 1], self.seed)


def _extreme(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every `width` successive values, by block-wise running extremes from both sides."""
    take, fill = (np.minimum, np.uint64(2**64 - 1)) if least else (np.maximum, np.uint64(0))
    n = len(x)
    if n < width:
        return np.empty(0, x.dtype)
    padded = np.full(-(-n // width) * width, fill, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = take.accumulate(blocks, axis=1).ravel()
    back = take.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(back[: n - width + 1], ahead[width - 1 : n])


def winnow(hashes: np.ndarray, width: int, starts: np.ndarray) -> np.ndarray:
    """Positions that hold the least hash of some `width` successive windows; all of equal ones.

    starts: boolean, true where `width` successive windows that belong to one text begin. Two texts that share `width`
    successive windows both keep the least of them, so every long enough shared span is kept at one place at least.
    """
    low = _extreme(hashes, width, True)
    if not len(low):
        return np.empty(0, np.int64)
    low = np.where(starts[: len(low)], low, np.uint64(0))
    wide = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero((_extreme(wide, width, False) == hashes) & (hashes > 0))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _packs(texts: list, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts put together into arrays of about CHUNK code points: (codes, number of the text, place in the text).

    A longer text is cut into pieces that overlap by `reach` - 1, so that no window of up to `reach` code points is lost.
    """
    held: list[tuple[int, np.ndarray, int]] = []
    size = 0

    def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (
            np.concatenate([c for _, c, _ in held]),
            np.concatenate([np.full(len(c), i, np.int64) for i, c, _ in held]),
            np.concatenate([np.arange(at, at + len(c), dtype=np.int64) for _, c, at in held]),
        )

    for i, text in enumerate(texts):
        if text is None or len(text) < reach:
            continue
        codes = codes_of(text)
        for at in range(0, max(1, len(codes) - reach + 1), CHUNK):
            piece = codes[at : at + CHUNK + reach - 1]
            if held and size + len(piece) > CHUNK + reach:
                yield whole()
                held, size = [], 0
            held.append((i, piece, at))
            size += len(piece)
    if held:
        yield whole()


def fingerprints(documents: DataFrame, doc_id: str, text: str, span: int = SPAN) -> DataFrame:
    """(hash, doc_id, pos): winnowed hashes of windows of half a span, at least one in every span of every text.

    Every window of every text is hashed; kept is the least of each run of windows that together are one span long, about
    one window in span / 4. Computed where the texts lie, without a shuffle.
    """
    length = span // 2 + 1
    width = span - length + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash(BASES[0], 1)
        for batch in batches:
            for codes, owner, place in _packs(batch.column(1).to_pylist(), span):
                # 0 stands for no window in winnow.
                hashes = np.maximum(roll.windows(codes, length), np.uint64(1))
                # One span from here lies in one text (and piece) if its last code point follows in place.
                n = len(hashes) - width + 1
                starts = (owner[:n] == owner[span - 1 : span - 1 + n]) & (place[span - 1 : span - 1 + n] - place[:n] == span - 1)
                at = winnow(hashes, width, starts)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), batch.column(0).take(pa.array(owner[at])), pa.array(place[at])], ["hash", "doc_id", "pos"])

    kind = dict(documents.dtypes)[doc_id]
    return documents.where(F.col(doc_id).isNotNull()).select(doc_id, text).mapInArrow(run, f"hash bigint, doc_id {kind}, pos bigint")


def span_windows(documents: DataFrame, regions: DataFrame, doc_id: str, text: str, span: int = SPAN) -> DataFrame:
    """(h1, h2, doc_id, pos): two independent Rabin-Karp hashes of every window of one span that starts in a region.

    regions: written rows (doc_id, starts), one a document, starts being the ascending positions p that stand for the window starts p - span / 2 + 1 .. p.
    """
    reach = span - (span // 2 + 1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls = [RollingHash(b, k + 7) for k, b in enumerate(BASES)]
        for batch in batches:
            marks = batch.column(2).to_pylist()
            for codes, owner, place in _packs(batch.column(1).to_pylist(), span):
                n = len(codes) - span + 1
                inside = (owner[:n] == owner[span - 1 :]) & (place[span - 1 :] - place[:n] == span - 1)
                wanted = np.zeros(len(codes) + 1, np.int64)
                heads = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)]))
                ends = np.append(heads[1:], len(codes))
                for head, end in zip(heads, ends, strict=True):
                    p = np.asarray(marks[owner[head]], np.int64) - place[head]
                    p = p[(p >= 0) & (p - reach + 1 < end - head)]
                    np.add.at(wanted, head + np.maximum(p - reach + 1, 0), 1)
                    np.add.at(wanted, head + np.minimum(p + 1, end - head), -1)
                at = np.flatnonzero(inside & (np.cumsum(wanted[:-1])[:n] > 0))
                h = [r.windows(codes, span)[at].view(np.int64) for r in rolls]
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), batch.column(0).take(pa.array(owner[at])), pa.array(place[at])], ["h1", "h2", "doc_id", "pos"])

    kind = dict(documents.dtypes)[doc_id]
    # Texts stay where they lie if the counted positions are few enough to be sent to them. Else both sides are shuffled: the
    # planner would judge the positions by their compressed files, a fraction of what they take in the driver.
    size = regions.agg(F.sum(F.size("starts") * 8 + ROW_BYTES)).first()[0] or 0
    right = regions.withColumnRenamed("doc_id", "r_id")
    right = F.broadcast(right) if size <= BROADCAST_BYTES else right.hint("merge")
    posed = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(right, F.col("doc_id") == F.col("r_id"))
    return posed.select("doc_id", "text", "starts").mapInArrow(run, f"h1 bigint, h2 bigint, doc_id {kind}, pos bigint")


def shared_windows(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(h1, h2, doc_id, pos) of every window of `span` code points that lies in more than one document, written.

    First the winnowed hashes are counted: a span that is shared holds one that is shared. Then every window around the
    shared ones is hashed twice over and counted. Counting is partial before the shuffle, so a passage that a third of
    all documents hold costs one row a task; its places are found
    without shuffling its rows. Rows that bear the same doc_id are one
    document. Null ids, null texts and texts shorter than the span have no window.
    """
    prints = materialize(fingerprints(documents, doc_id, text, span))
    several = F.min("doc_id") < F.max("doc_id")
    n = F.count(F.lit(1)).alias("n")
    repeated = materialize(prints.groupBy("hash").agg(several.alias("several"), n).where("several").select("hash", "n"))
    # As many positions as one document has.
    regions = materialize(skew_semi_join(prints, repeated, ["hash"], "n").groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("starts")))
    windows = materialize(span_windows(documents, regions, doc_id, text, span))
    repeated = materialize(windows.groupBy("h1", "h2").agg(several.alias("several"), n).where("several").select("h1", "h2", "n"))
    return materialize(skew_semi_join(windows, repeated, ["h1", "h2"], "n"))


def sharing_groups(windows: DataFrame) -> DataFrame:
    """(h1, h2, doc_id) for every distinct set of documents that share a window, written; `windows`: rows of shared_windows.

    The windows of one passage are shared by the same documents: windows are told apart by an order-free signature of
    their documents (their number, least, greatest and two xors of hashes), and one window (h1, h2) per signature stands
    for the set. A document has one row for each set it is in, however many documents are in it: every link between
    documents is held by the rows of a set, without a row per pair.
    """
    own = windows.select("h1", "h2", "doc_id").distinct()
    marks = own.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y")
    )
    chosen = materialize(marks.groupBy("n", "a", "b", "x", "y").agg(F.min(F.struct("h1", "h2")).alias("w")).select("w.*", "n"))
    return materialize(skew_semi_join(own, chosen, ["h1", "h2"], "n"))


def sharing_pairs(windows: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b, for all documents that share a window; `windows`: rows of shared_windows.

    One window per set of documents is paired up, see sharing_groups, which holds the same links in a row per document and
    set. The pairing is salted, so that a window of very many documents is spread over many tasks. Both sides are shuffled:
    the planner may not broadcast the side that is repeated a slice, whose size its estimates do not know.
    """
    members = sharing_groups(windows)
    left = members.select("h1", "h2", F.col("doc_id").alias("doc_id_a"), F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).alias("slice"))
    right = members.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("doc_id").alias("doc_id_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SLICES - 1).cast("bigint"))).alias("s"))
    met = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("slice") == F.col("s")) & (F.col("doc_id_a") < F.col("doc_id_b"))
    return left.join(right.hint("merge"), met).select("doc_id_a", "doc_id_b").distinct()


def shared_spans(windows: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, start, end): maximal intervals of each document that are covered by shared windows, end exclusive."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    places = windows.select("doc_id", "pos").distinct()
    apart = F.coalesce(F.col("pos") > F.lag("pos").over(by) + span, F.lit(True))
    return (
        places.withColumn("apart", apart)
        .withColumn("part", F.count_if("apart").over(by))
        .groupBy("doc_id", "part")
        .agg(F.min("pos").alias("start"), (F.max("pos") + span).alias("end"))
        .select("doc_id", "start", "end")
    )


def shared_report(documents: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, n_chars, n_spans, longest, shared_chars, shared_share) of every document, those without a shared span included.

    Rows with one doc_id are put together: the longest of their texts counts. A null id is a document of its own
    without spans; null and empty texts have share 0.
    """
    spans = shared_spans(windows, span).groupBy(F.col("doc_id").alias("s_id")).agg(
        F.count(F.lit(1)).alias("n_spans"), F.max(F.col("end") - F.col("start")).alias("longest"), F.sum(F.col("end") - F.col("start")).alias("shared_chars")
    )
    sizes = documents.groupBy(F.col(doc_id).alias("doc_id")).agg(F.coalesce(F.max(F.char_length(text)), F.lit(0)).cast("bigint").alias("n_chars"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    out = sizes.join(spans, F.col("doc_id") == F.col("s_id"), "left").select("doc_id", "n_chars", none("n_spans"), none("longest"), none("shared_chars"))
    return out.withColumn("shared_share", F.round(F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)), 6))
