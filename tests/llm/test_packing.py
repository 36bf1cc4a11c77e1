"""Packing: nothing lost, nothing over capacity, best-fit as item by item, dominance keeps the optimum, odd rows."""

import itertools
import random
from collections import Counter

import pytest

from tidemill.llm import packing


def unpacked(bins):
    out = Counter()
    for pattern, times in bins.patterns:
        assert sum(n * k for n, k in pattern.items()) <= bins.capacity and times > 0 and all(k > 0 for k in pattern.values())
        out.update({n: k * times for n, k in pattern.items()})
    return out


def number(bins):
    return sum(t for _, t in bins.patterns)


def by_item(counts, capacity):
    rooms = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def optimum(items, capacity):
    for k in itertools.count(-(-sum(items) // capacity)):
        def place(i, rooms):
            if i == len(items):
                return True
            for r in sorted(set(rooms)):
                if r >= items[i]:
                    rest = list(rooms)
                    rest.remove(r)
                    if place(i + 1, [*rest, r - items[i]]):
                        return True
            return False

        if place(0, [capacity] * k):
            return k


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_is_that_of_items(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100])
    counts = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.choice([1, 10, 200])))
    bins = packing.Bins(capacity)
    packing.best_fit(counts, capacity, bins)
    assert unpacked(bins) == counts and number(bins) == by_item(counts, capacity)


@pytest.mark.parametrize("seed", range(150))
def test_dominance_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([9, 12, 20, 37])
    items = sorted((rng.randrange(max(1, capacity // 7), capacity + 1) for _ in range(rng.randrange(1, 12))), reverse=True)
    bins = packing.Bins(capacity)
    left = packing.reduce_dominated(Counter(items), capacity, bins)
    fixed = number(bins)
    rest = sorted(Counter(left).elements(), reverse=True)
    assert unpacked(bins) + Counter(left) == Counter(items)
    assert fixed + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity)


def test_large_counts_take_no_longer():
    counts = {n: 10**9 + n for n in range(1, 257)}
    bins = packing.pack_lengths(counts, 256)
    assert unpacked(bins) == counts and len(bins.patterns) < 5000
    assert number(bins) <= 1.01 * sum(n * c for n, c in counts.items()) / 256


def frame(spark, texts):
    return spark.createDataFrame([(*t, "x", "y") for t in texts], "doc_id bigint, text string, n_tokens string, copy string").repartition(3)


def sizes(spark, *rows):
    return spark.createDataFrame(list(rows), "window_name string, capacity_tokens bigint")


def test_odd_rows(spark):
    rng = random.Random(1)
    word = lambda k: " ".join(rng.choice(["load", "trace", "window", "grid"]) for _ in range(k))
    texts = [(i, word(rng.randrange(1, 60))) for i in range(200)] + [(1000, None), (1001, ""), (1002, word(1000)), (5, "repeated id"), (None, "null id"), (None, "null id"), (7, word(3)), (7, word(3))]
    df = frame(spark, texts)
    out = packing.pack(df, sizes(spark, ("a", 64), ("b", 200), (None, 5), ("c", 0), ("d", None))).toPandas()
    assert set(out.window_name) == {"a", "b"}
    want = sorted((str(a), b) for a, b in packing.token_counts(df, "doc_id", "text").toPandas().assign(doc_id=lambda x: x.doc_id.astype(str)).itertuples(index=False))
    for _, part in out.groupby("window_name"):
        capacity = part.capacity_tokens.iloc[0]
        docs = part.assign(doc_id=part.doc_id.astype(str)).groupby(["doc_id", "copy"]).n_tokens.sum().reset_index()
        assert sorted((d, n) for d, n in zip(docs.doc_id, docs.n_tokens, strict=True)) == want
        held = part[part.container_no.notna()].sort_values(["container_no", "offset"])
        assert (held.n_tokens > 0).all() and set(part[part.container_no.isna()].doc_id) == {1000, 1001}
        for _, box in held.groupby("container_no"):
            assert box.n_tokens.sum() <= capacity and (box.offset.to_numpy() == [0, *box.n_tokens.cumsum()[:-1]]).all()
        assert sorted(held.container_no.unique()) == list(range(held.container_no.nunique()))
        cut = part[part.piece_no > 0]
        assert set(cut.doc_id) <= {1002}
        assert (part[part.doc_id == 1002].sort_values("piece_no").n_tokens.to_numpy()[:-1] == capacity).all()


def test_tokens_of_long_texts(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(packing.VOCABULARY, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "it's ", " ", "\n", "é", "12", ", ", "load window "]) for _ in range(120_000)), "x" * 1000, "naïve  test\n\n"]
    got = packing.token_counts(frame(spark, list(enumerate(texts))), "doc_id", "text").toPandas().set_index("doc_id").n_tokens
    assert [got[i] for i in range(3)] == [len(whole.encode_ordinary(t)) for t in texts]


def test_empty(spark):
    assert packing.pack(frame(spark, []), sizes(spark, ("a", 64))).count() == 0
    assert packing.pack(frame(spark, [(1, "a")]), sizes(spark)).count() == 0


def test_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ITEMS", 3)
    docs = spark.createDataFrame([(k, "word " * (1 + k % 3)) for k in range(40)] + [(90, "a b c " * 30), (91, None)], "doc_id bigint, text string").repartition(5)
    out = packing.pack(docs, spark.createDataFrame([("w", 10)], "window_name string, capacity_tokens bigint")).toPandas()
    held = out[out.container_no.notna()]
    assert (held.groupby("container_no").n_tokens.sum() <= 10).all() and set(out.doc_id) == {*range(40), 90, 91}
    assert not held.duplicated(["container_no", "offset"]).any() and sorted(held.container_no.unique()) == list(range(int(held.container_no.max()) + 1))
