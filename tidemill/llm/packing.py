"""Texts of varying length into containers of fixed capacity."""

from __future__ import annotations

import base64
import bisect
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.physical import materialize

#: Items of one length that are numbered in one task; longer lists are cut into as many slices as they need.
SLICE_ITEMS = 200_000
#: The default vocabulary; any byte-pair rank file of the same form can be given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public splitting pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters given to the tokenizer at once; the pattern never joins a line break with a letter after it.
PIECE = 100_000


def _pieces(text: str) -> Iterator[str]:
    """The text cut where the pattern cuts it anyway: before a blank that follows a letter and precedes one."""
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_counts(documents: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens): tokens of the whole text; 0 for null and empty texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            ids, texts = pdf.iloc[:, 0], pdf.iloc[:, 1]
            yield pd.DataFrame({"doc_id": ids, "n_tokens": [sum(len(encoding.encode_ordinary(p)) for p in _pieces(t)) if isinstance(t, str) else 0 for t in texts]})

    return documents.select(doc_id, text).mapInPandas(run, f"doc_id {dict(documents.dtypes)[doc_id]}, n_tokens bigint")


class Bins:
    """A packing of item lengths: patterns (length -> items in one container) with the number of containers each."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.patterns: list[tuple[dict[int, int], int]] = []

    def add(self, pattern: dict[int, int], times: int) -> None:
        if times:
            self.patterns.append((pattern, times))


def reduce_dominated(counts: dict[int, int], capacity: int, bins: Bins) -> dict[int, int]:
    """Martello-Toth reduction on a histogram of lengths; returns what it could not fix.

    A set of items that holds item j dominates all others with j if every other feasible set can be divided among its
    items; then it is part of some optimal packing and is fixed for good. Tried for every length from the longest down,
    again until nothing changes:
    - no other item fits beside j: j alone;
    - j and the longest k beside it fill the container: {j, k};
    - no two further items fit beside j: {j, k} with the longest k;
    - no two or more further items together exceed k: {j, k} (what fits beside j is at most k long in sum);
    - no three further items fit beside j, k is the longest that does, k2 the longest beside both, and no pair that fits
      beside j has a shorter item above k2: {j, k, k2}.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    changed = True
    while changed:
        changed = False
        lengths = sorted(left)
        for j in sorted(left, reverse=True):
            while left.get(j, 0):
                room = capacity - j
                pattern = _dominating(left, lengths, j, room)
                if pattern is None:
                    break
                times = min(left[n] // k for n, k in pattern.items())
                if not times:
                    break
                # In bulk: to fix a set takes items away, which adds no feasible set, so the next of the same lengths dominates as well.
                bins.add(pattern, times)
                for n, k in pattern.items():
                    left[n] -= k * times
                    if not left[n]:
                        del left[n]
                        lengths.remove(n)
                changed = True
    return left


def _dominating(left: dict[int, int], lengths: list[int], j: int, room: int) -> dict[int, int] | None:
    def pattern(*items: int) -> dict[int, int]:
        out: dict[int, int] = defaultdict(int)
        for n in items:
            out[n] += 1
        return dict(out)

    def free(n: int) -> int:
        return left.get(n, 0) - (n == j)

    def longest(limit: int, used: int | None = None) -> int | None:
        at = bisect.bisect_right(lengths, limit) - 1
        while at >= 0 and free(lengths[at]) - (lengths[at] == used) < 1:
            at -= 1
        return lengths[at] if at >= 0 else None

    k = longest(room)
    if k is None:
        return pattern(j)
    if k == room:
        return pattern(j, k) if k != j or left[j] >= 2 else None
    small: list[int] = []
    for n in lengths:
        small += [n] * min(3 - len(small), free(n))
        if len(small) == 3:
            break
    if len(small) < 2 or small[0] + small[1] > room:
        return pattern(j, k)
    # The largest sum of two or more items that fits beside j; k covers them all if it is not exceeded.
    if len(small) == 3 and sum(small) <= room:
        return None
    best_pair = 0
    for n in lengths:
        if n + small[0] > room or free(n) < 1:
            continue
        other = longest(room - n, n)
        if other is not None:
            best_pair = max(best_pair, n + other)
    if best_pair <= k:
        return pattern(j, k)
    second = longest(room - k, k)
    if second is None:
        return None
    # The longest item that can be the shorter of two beside j: if it is no longer than the second, {k, second} covers every pair.
    for n in reversed(lengths[: bisect.bisect_right(lengths, room // 2)]):
        if n <= second:
            return pattern(j, k, second)
        above = bisect.bisect_right(lengths, n)
        other = next((x for x in lengths[above : bisect.bisect_right(lengths, room - n)] if free(x) >= 1), None)
        if free(n) >= 2 or (free(n) == 1 and other is not None):
            return None
    return pattern(j, k, second)


def best_fit(counts: dict[int, int], capacity: int, bins: Bins) -> None:
    """Best-fit decreasing on a histogram: each length, from the longest, into the fullest open containers it fits.

    Containers of one content are handled together, so the work depends on the number of lengths, not of items. It gives
    what item-by-item best fit gives: after an item the same container is the fullest that fits, until it no longer does.
    """
    open_: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(pattern: dict[int, int], times: int) -> None:
        if times:
            room = capacity - sum(n * k for n, k in pattern.items())
            if room not in open_ or not open_[room]:
                bisect.insort(rooms, room)
            open_[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                put({length: each}, n // each)
                put({length: n % each} if n % each else {}, int(bool(n % each)))
                break
            room = rooms[at]
            pattern, times = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            each = min(room // length, n)
            full = min(times, n // each)
            put(pattern | {length: pattern.get(length, 0) + each}, full)
            put(pattern, times - full)
            n -= full * each
    for groups in open_.values():
        for pattern, times in groups:
            bins.add(pattern, times)


def pack_lengths(counts: dict[int, int], capacity: int) -> Bins:
    """Patterns that hold exactly the items of a histogram {length: items}, 0 < length <= capacity."""
    bins = Bins(capacity)
    best_fit(reduce_dominated(counts, capacity, bins), capacity, bins)
    return bins


def _places(bins: Bins) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, by the running number of its items: (first number, items in one container, first container, offset)."""
    used: dict[int, int] = defaultdict(int)
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    first = 0
    for pattern, times in bins.patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            each = pattern[length]
            rows[length].append((used[length], each, first, offset))
            used[length] += each * times
            offset += each * length
        first += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in rows.items()}


def pack(documents: DataFrame, containers: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(window_name, capacity_tokens, container_no, offset, doc_id, copy, piece_no, piece_start, n_tokens) for every document.

    A text that exceeds a capacity is cut into pieces of that capacity and a rest; no other is cut. An instance is wholly
    given by its histogram of lengths, of at most `capacity` entries however many documents there are: only that goes to
    the driver, where sets are fixed by dominance and the rest is packed by best fit, in patterns with multiplicities.
    Items are then numbered within their length, in slices of about SLICE_ITEMS (one length may hold a large part of all), and look up their
    container by that number. Texts without tokens (null, empty) take no room: container_no is null. Rows that repeat a
    doc_id are items of their own, told apart by copy (0, 1, ... in no set order). Containers with a null name or no
    positive capacity are left out; of equal names each row is a packing of its own capacity.
    """
    spark = documents.sparkSession
    sizes = [tuple(r) for r in containers.where((F.col("capacity_tokens") > 0) & F.col("window_name").isNotNull()).select("window_name", "capacity_tokens").distinct().orderBy("window_name", "capacity_tokens").collect()]
    by_doc = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("n_tokens"))).orderBy("n_tokens")
    counted = materialize(token_counts(documents, doc_id, text, vocabulary).withColumn("copy", (F.row_number().over(by_doc) - 1).cast("bigint")))
    shape = "window_name string, capacity_tokens bigint"
    # The container sizes are a few constants of the plan.
    windows = F.array(*[F.struct(F.lit(n).alias("window_name"), F.lit(c).cast("bigint").alias("capacity_tokens")) for n, c in sizes]).cast("array<struct<window_name: string, capacity_tokens: bigint>>")
    starts = F.when(F.col("n_tokens") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.col("capacity_tokens"))).otherwise(F.array(F.lit(0).cast("bigint")))
    sized = counted.select("doc_id", "copy", "n_tokens", F.inline(windows))
    pieces = sized.select("window_name", "capacity_tokens", "doc_id", "copy", "n_tokens", F.posexplode(starts).alias("piece_no", "piece_start"))
    size = F.least(F.col("n_tokens") - F.col("piece_start"), F.col("capacity_tokens"))
    items = pieces.withColumns({"n_tokens": size, "piece_no": F.col("piece_no").cast("bigint")})
    group = ["window_name", "capacity_tokens", "n_tokens"]
    real = items.where(F.col("n_tokens") > 0)
    # At most capacity lengths for each container size.
    histogram: dict[tuple[str, int], dict[int, int]] = {w: {} for w in sizes}
    for name, capacity, length, n in real.groupBy(*group).agg(F.count(F.lit(1))).collect():
        histogram[name, capacity][length] = n
    slices = -(-max((n for counts in histogram.values() for n in counts.values()), default=1) // SLICE_ITEMS)
    real = real.withColumn("slice", F.pmod(F.xxhash64("doc_id", "copy", "piece_no"), F.lit(slices)).cast("int"))
    tally = real.groupBy(*group, "slice").agg(F.count(F.lit(1)).alias("n"))
    ahead = tally.withColumn("ahead", F.sum("n").over(Window.partitionBy(*group).orderBy("slice")) - F.col("n")).drop("n")
    ahead = ahead.withColumnsRenamed({c: f"a_{c}" for c in [*group, "slice"]})
    same = F.lit(True)
    for c in [*group, "slice"]:
        same = same & (F.col(c) == F.col(f"a_{c}"))
    numbered = real.withColumn("number", F.row_number().over(Window.partitionBy(*group, "slice").orderBy("doc_id", "copy", "piece_no")) - 1)
    numbered = numbered.join(ahead, same, "left").withColumn("number", F.col("number") + F.col("ahead"))

    sent = spark.sparkContext.broadcast({w: _places(pack_lengths(counts, w[1])) for w, counts in histogram.items()})

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            container, offset = np.full(len(pdf), -1, np.int64), np.zeros(len(pdf), np.int64)
            for (name, capacity, length), part in pdf[pdf.n_tokens > 0].groupby(group, sort=False):
                first, each, box, at = sent.value[name, capacity][length]
                number = part.number.to_numpy(np.int64)
                k = np.searchsorted(first, number, "right") - 1
                container[part.index] = box[k] + (number - first[k]) // each[k]
                offset[part.index] = at[k] + (number - first[k]) % each[k] * length
            found = pd.Series(container, dtype="Int64").where(container >= 0)
            yield pdf.assign(container_no=found, offset=pd.Series(offset, dtype="Int64").where(container >= 0)).drop(columns="number")

    kind = dict(documents.dtypes)[doc_id]
    columns = ["window_name", "capacity_tokens", "doc_id", "copy", "n_tokens", "piece_no", "piece_start"]
    # Texts without tokens need no number.
    every = numbered.select(*columns, "number").unionByName(items.where(F.col("n_tokens") == 0).select(*columns, F.lit(0).cast("bigint").alias("number")))
    out = every.mapInPandas(placed, f"{shape}, doc_id {kind}, copy bigint, n_tokens bigint, piece_no bigint, piece_start bigint, container_no bigint, offset bigint")
    return out.select("window_name", "capacity_tokens", "container_no", "offset", "doc_id", "copy", "piece_no", "piece_start", "n_tokens")


def fill_report(packed: DataFrame) -> DataFrame:
    """(window_name, capacity_tokens, containers, pieces, tokens, least_possible, fill): least_possible is tokens / capacity, rounded up."""
    held = packed.where(F.col("container_no").isNotNull())
    out = held.groupBy("window_name", "capacity_tokens").agg((F.max("container_no") + 1).alias("containers"), F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    return out.withColumns({"least_possible": F.ceil(F.col("tokens") / F.col("capacity_tokens")), "fill": F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)})
