"""Shared spans against brute force; pieces of long texts; odd rows."""

import random

import numpy as np
import pytest

from tidemill.llm import spans
from tidemill.plans.physical import materialize


def brute(docs, n):
    windows = {}
    for d, t in docs:
        if d is not None:
            for a in range(len(t or "") - n + 1):
                windows.setdefault(t[a : a + n], set()).add(d)
    return {(a, b) for s in windows.values() for a in s for b in s if a < b}


def covered(docs, n):
    out = {}
    for d, t in docs:
        others = [u for e, u in docs if e != d and e is not None and u]
        hit = np.zeros(len(t or ""), bool)
        for a in range(len(t or "") - n + 1):
            if any(t[a : a + n] in u for u in others):
                hit[a : a + n] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(int), [0]])))
        out[d] = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    return {(d, a, b) for d, x in out.items() for a, b in x}


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", "y", "z") for d in docs], "doc_id bigint, text string, hash string, pos string, starts string").repartition(3)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(12)
    letters = "abcdefgh 😀é́\n"
    line = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [line(n) for n in (19, 20, 21, 35, 60, 200)] + ["a" * 40, "-" * 70]
    docs = []
    for d in range(60):
        t = line(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(passages) + t[at:]
        docs.append((d, t))
    docs += [(60, None), (61, ""), (62, passages[4] * 2), (63, docs[3][1]), (64, docs[3][1])]
    return docs


def test_pairs_and_spans(spark, case):
    windows = spans.shared_windows(frame(spark, [*case, (None, case[3][1])]), span=20)
    assert {tuple(r) for r in spans.sharing_pairs(windows).collect()} == brute(case, 20)
    assert {tuple(r) for r in spans.shared_spans(windows, 20).collect()} == covered(case, 20)


def test_nothing_uncounted_is_broadcast(spark, case, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    docs = frame(spark, case)
    pairs = spans.sharing_pairs(spans.shared_windows(docs, span=20))
    assert "SortMergeJoin" in plan(pairs) and "Broadcast" not in plan(pairs)
    regions = materialize(spark.createDataFrame([(3, [0, 5])], "doc_id bigint, starts array<bigint>"))
    assert "BroadcastHashJoin" in plan(spans.span_windows(docs, regions, "doc_id", "text", 20))
    monkeypatch.setattr(spans, "BROADCAST_BYTES", 100)
    posed = spans.span_windows(docs, regions, "doc_id", "text", 20)
    assert "SortMergeJoin" in plan(posed) and "Broadcast" not in plan(posed)


def test_long_texts_in_pieces(spark, case, monkeypatch):
    joined = [(1, "".join(t or "" for _, t in case[:30])), (2, "".join(t or "" for _, t in case[20:])), (3, "q" * 30)]
    codes = [spans.codes_of(t) for _, t in joined]
    monkeypatch.setattr(spans, "CHUNK", 150)
    starts = {i: [] for i in range(3)}
    for piece, owner, place in spans._packs([t for _, t in joined], 20):
        for a in range(len(piece) - 19):
            if owner[a] == owner[a + 19] and place[a + 19] - place[a] == 19:
                assert (codes[owner[a]][place[a] : place[a] + 20] == piece[a : a + 20]).all()
                starts[int(owner[a])].append(int(place[a]))
    assert {i: sorted(s) for i, s in starts.items()} == {i: list(range(len(c) - 19)) for i, c in enumerate(codes)}


def test_rolling_hash_and_winnowing():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 3, 500).astype(np.uint32)
    got = spans.RollingHash(spans.BASES[0], 1).windows(codes, 7)
    same = {}
    for a in range(494):
        same.setdefault(tuple(codes[a : a + 7]), set()).add(int(got[a]))
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)
    starts = np.ones(len(got) - 9, bool)
    kept = set(spans.winnow(got, 10, starts).tolist())
    assert kept == {int(s + k) for s in range(len(got) - 9) for k in np.flatnonzero(got[s : s + 10] == got[s : s + 10].min())}


def test_repeats_within_one_and_one_id(spark, rows):
    docs = [(1, "abcdefghijklmnopqrstuvwxyz" * 3), (1, "abcdefghijklmnopqrstuvwxyz"), (2, "no match here at all, is there?")]
    windows = spans.shared_windows(frame(spark, docs), span=20)
    assert rows(spans.sharing_pairs(windows)) == [] == rows(spans.shared_spans(windows, 20))


def test_report(spark):
    docs = [(1, "x" * 10 + "0123456789abcdefghij" + "y"), (2, "0123456789abcdefghij"), (3, None), (None, "0123456789abcdefghij"), (4, "")]
    df = frame(spark, docs)
    out = {r["doc_id"]: (r["n_chars"], r["n_spans"], r["longest"], r["shared_chars"], r["shared_share"]) for r in spans.shared_report(df, spans.shared_windows(df, span=20), span=20).collect()}
    assert out == {1: (31, 1, 20, 20, pytest.approx(20 / 31, abs=1e-6)), 2: (20, 1, 20, 20, 1.0), 3: (0, 0, 0, 0, 0.0), None: (20, 0, 0, 0, 0.0), 4: (0, 0, 0, 0, 0.0)}


def test_empty(spark, rows):
    assert rows(spans.sharing_pairs(spans.shared_windows(frame(spark, []), span=20))) == []
