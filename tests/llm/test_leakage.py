"""Leaks against brute force; fingerprints; blocks of items; odd rows."""

import random
import re

import numpy as np
import pytest

from tidemill.llm import leakage


def words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def brute(docs, items, k=13):
    runs = {}
    for i, t in items:
        w = words(t)
        runs.setdefault(i, set()).update(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
    out = set()
    for d, t in docs:
        w = words(t)
        mine = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
        out |= {(d, i) for i, r in runs.items() if mine & r and d is not None and i is not None}
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    lexicon = [f"w{i}" for i in range(60)] + ["Größe", "naïve", "X9"]
    line = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    items = [(i, line(rng.choice([5, 12, 13, 14, 40]))) for i in range(40)]
    items += [(40, items[0][1]), (None, line(30)), (41, None), (42, ""), (40, line(20))]
    docs = []
    for d in range(150):
        w = line(rng.randrange(0, 60)).split()
        for _ in range(rng.randrange(3)):
            src = rng.choice(items)[1] or ""
            s = src.split()
            a, n = rng.randrange(len(s) + 1), rng.choice([12, 13, 14, 50])
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + rng.choice(["", ",", "-", "\n"]) for x in s[a : a + n]]
        docs.append((d, rng.choice([" ", ", ", " -- "]).join(w)))
    docs += [(150, None), (151, ""), (None, items[4][1]), (3, docs[5][1]), (152, "x " * 5000 + (items[3][1] + " ") * 3)]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id bigint, text string, words string, item_id string").repartition(4), spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, part string")


def test_against_brute_force(spark, case):
    docs, items = case
    d, i = frames(spark, docs, items)
    got = {tuple(r) for r in leakage.leaked(leakage.leaks(d, i)).collect()}
    assert got == brute(docs, items) and got


def test_blocks_of_items_give_the_same(spark, case, monkeypatch):
    docs, items = case
    d, i = frames(spark, docs, items)
    blocks = list(leakage.item_blocks(i, "item_id", "text", 300))
    assert len(blocks) > 2 and sum(b.num_rows for b in blocks) == sum(1 for a, t in items if a is not None and t is not None)
    monkeypatch.setattr(leakage, "item_blocks", lambda items, a, b: iter(blocks))
    assert {tuple(r) for r in leakage.leaked(leakage.leaks(d, i)).collect()} == brute(docs, items)


def test_near_windows(spark):
    base = " ".join(f"token{i}" for i in range(60))
    d, i = frames(spark, [(1, base), (2, "nothing " * 20)], [(1, base)])
    (row,) = leakage.leaks(d, i).collect()
    assert (row["doc_id"], row["exact_windows"], row["best_similarity"]) == (1, 48, 1.0) and row["near_windows"] >= 48


def test_radius_is_guaranteed(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)
    near = base.copy()
    for k in range(len(near)):
        for b in rng.choice(64, k % 4, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    index = leakage.ItemIndex(np.arange(1), np.zeros(13, np.int64), np.zeros(13, np.int64), None, 13, 2)
    index.prints = base
    index.tables = []
    for block in leakage.blocks_of(base, 2):
        order = np.argsort(block, kind="stable")
        seen = np.zeros(1 << 22, bool)
        seen[block & ((1 << 22) - 1)] = True
        index.tables.append((block[order], order, seen, (1 << 22) - 1))
    monkeypatch.setattr(leakage, "PAIRS", 50)
    found = list(index.candidates(near))
    want = {(a, b) for a in range(300) for b in range(300) if bin(int(near[a] ^ base[b])).count("1") <= 2}
    assert {(a, b) for x, y in found for a, b in zip(x.tolist(), y.tolist(), strict=True)} == want and len(found) > 5


def test_simhash_is_the_majority():
    rng = np.random.default_rng(1)
    w = rng.integers(-(2**63), 2**63 - 1, 40, dtype=np.int64)
    got = leakage.simhash(w, 13)
    for k in range(28):
        bits = np.unpackbits(w[k : k + 13].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) * 2 >= 13
        assert got[k] == np.packbits(bits).view(np.uint64)[0]


def test_empty(spark, case):
    docs, items = case
    d, i = frames(spark, docs, items)
    assert leakage.leaks(d.where("false"), i).count() == leakage.leaks(d, i.where("false")).count() == 0


def test_near_windows_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    lexicon = [f"w{i}" for i in range(400)]
    line = lambda n: [rng.choice(lexicon) for _ in range(n)]
    common = line(9)
    items = [(k, line(rng.randrange(3)) + (common if k % 3 == 0 else []) + line(14)) for k in range(30)] + [(30, ["a", "b", "c", "d", "e", "f"] * 4)]
    docs = [(k, line(5) + changed + line(5)) for k in range(120) for changed in [list(rng.choice(items)[1])] if changed.__setitem__(rng.randrange(len(changed)), "other") is None]
    grams = lambda w, n: {tuple(w[a : a + n]) for a in range(len(w) - n + 1)}
    holders = {}
    for k, w in items:
        for g in grams(w, 5):
            holders.setdefault(g, set()).add(k)
    weight = lambda s: sum(1 / (1 + np.log(max(len(holders.get(g, ())), 1))) for g in s)
    alike = lambda x, y: weight(x & y) / weight(x | y)
    want = {}
    for d, v in docs:
        for i, w in items:
            mine = [grams(w[b : b + 13], 5) for b in range(len(w) - 12)]
            best = [max((alike(grams(v[a : a + 13], 5), m) for m in mine), default=0.0) for a in range(len(v) - 12)]
            if max(best) >= 0.8 - 1e-9:
                want[d, i] = sum(b >= 0.8 - 1e-9 for b in best), round(max(best), 6)
    d, i = frames(spark, [(k, " ".join(w)) for k, w in docs], [(k, " ".join(w)) for k, w in items])
    got = lambda: {(r["doc_id"], r["item_id"]): (r["near_windows"], round(r["best_similarity"], 6)) for r in leakage.leaks(d, i).collect()}
    assert got() == want and len(want) > 50
    blocks = list(leakage.item_blocks(i, "item_id", "text", 150))
    assert len(blocks) > 2
    monkeypatch.setattr(leakage, "item_blocks", lambda items, a, b: iter(blocks))
    assert got() == want
