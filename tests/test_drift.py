"""Changes between files, flooding, lineage and the unified table."""

import json
import random

from tidemill.operators import drift


def frame(spark, files, feed=1):
    data = [(feed, no, i + 1, p if isinstance(p, str) or p is None else json.dumps(p), "x") for no, recs in files.items() for i, p in enumerate(recs)]
    return spark.createDataFrame(data, "feed_id bigint, file_no bigint, record_no bigint, payload string, field string").repartition(3)


def recs(start, n, make):
    return [{"rid": start + i} | make(start + i) for i in range(n)]


def test_every_kind(spark, rows):
    files = {
        1: recs(0, 6, lambda i: {"Model": f"m{i}", "log type": "API", "n": i, "old": 1}),
        2: recs(2, 6, lambda i: {"engine": f"m{i}", "LOG_TYPE": ["API"], "n": i, "fresh": None if i < 5 else 2}),
    }
    got = rows(drift.changes(frame(spark, files)))
    assert got == [(1, 2, "added", "", "fresh"), (1, 2, "removed", "old", ""), (1, 2, "renamed", "model", "engine"), (1, 2, "retyped", "log_type", "log_type")]


def test_rename_needs_three_equal_values(spark, rows):
    two = {1: recs(0, 4, lambda i: {"a": i}), 2: recs(2, 4, lambda i: {"b": i})}
    differs = {1: recs(0, 4, lambda i: {"a": i}), 2: recs(0, 4, lambda i: {"b": i if i else 9})}
    typed = {1: recs(0, 4, lambda i: {"a": i}), 2: recs(0, 4, lambda i: {"b": str(i)})}
    for files in (two, differs, typed):
        assert rows(drift.changes(frame(spark, files))) == [(1, 2, "added", "", "b"), (1, 2, "removed", "a", "")]
    nulls = {1: recs(0, 5, lambda i: {"a": {"y": 1.0, "x": i}}), 2: recs(0, 5, lambda i: {"b": None if i == 0 else {"x": i, "y": 1.0}})}
    assert rows(drift.changes(frame(spark, nulls))) == [(1, 2, "renamed", "a", "b")]


def test_gaps_bad_payloads_and_empty(spark, rows):
    files = {1: [None, "no json", "[1]", '{"rid": 1, "a": 1}'], 3: [{"rid": 1, "b": 1}]}
    df = frame(spark, files)
    assert rows(drift.changes(df)) == []
    assert drift.unify(df).count() == 5
    assert rows(drift.changes(df.where("false"))) == []
    assert drift.unify(df.where("false")).count() == 0


def test_unified_follows_renames(spark):
    files = {
        1: recs(0, 6, lambda i: {"Model": f"m{i}", "request tokens": i, "note": "k"}),
        2: recs(3, 6, lambda i: {"zz": f"m{i}", "request-tokens": str(i), "note": "k"}),
        3: recs(6, 6, lambda i: {"qq": f"m{i}", "REQUEST_TOKENS": "x" if i == 11 else i}),
    }
    out = {(r["file_no"], r["rid"]): r for r in drift.unify(frame(spark, files)).collect()}
    assert out[3, "8"]["model"] == "m8" and out[2, "5"]["request_tokens"] == 5.0 and out[1, "0"]["model"] == "m0"
    assert json.loads(out[3, "11"]["failed_casts"]) == {"request_tokens": "x"} and json.loads(out[2, "3"]["extras"]) == {"note": "k"}
    assert out[2, "4"]["resent"] and not out[2, "7"]["resent"] and not out[1, "4"]["resent"]


def test_flooding_prefers_value_evidence():
    field = lambda n, t="string", s="STRING": {"field": n, "type": t, "shape": s}
    scores = drift.flood([field("model"), field("lane")], [field("modes"), field("xyz")], {("model", "xyz"): 1.0, ("lane", "modes"): 1.0, ("model", "modes"): 0.0, ("lane", "xyz"): 0.0})
    assert drift.consistent(scores) == {"model": "xyz", "lane": "modes"}
    assert drift._children("OBJECT<name: STRING, tier: OBJECT<a: BIGINT, b: STRING>, z: ARRAY<STRING>>") == ["name", "tier", "z"]


def test_unified_keeps_all_of_objects_and_arrays(spark):
    files = {
        1: recs(0, 4, lambda i: {"model": {"tier": "base", "name": f"m{i}"}, "request_tokens": {"unit": "t", "value": i}, "log_type": ["API", "b", "c"]}),
        2: recs(4, 4, lambda i: {"model": {"name": f"m{i}", "tier": {"a": 1}}, "request_tokens": i, "log_type": ["API"]}),
        3: recs(8, 1, lambda i: {"model": {"name": None, "tier": "base"}}) + recs(9, 3, lambda i: {"model": {"name": f"m{i}"}, "log_type": "{x"}),
    }
    out = {int(r["rid"]): r for r in drift.unify(frame(spark, files)).collect()}
    assert [out[i]["model"] for i in range(12)] == [f"m{i}" if i != 8 else None for i in range(12)]
    assert out[2]["request_tokens"] == 2.0 and out[6]["request_tokens"] == 6.0 and {r["failed_casts"] for r in out.values()} == {"{}"}
    assert (out[2]["log_type"], out[5]["log_type"], out[9]["log_type"]) == ("API", "API", "{x")
    rest = {i: {k: json.loads(v) for k, v in json.loads(out[i]["extras"]).items()} for i in out}
    assert rest[1] == {"model": {"tier": "base"}, "request_tokens": {"unit": "t"}, "log_type": ["b", "c"]}
    assert json.loads(rest[5]["model"]["tier"]) == {"a": 1} and set(rest[5]) == {"model"}
    assert rest[8] == {"model": {"tier": "base"}} and rest[9] == {}
    assert drift._members("OBJECT<`a: b,``c>`: DECIMAL(3,1), z: ARRAY<OBJECT<`q,`: STRING, r: VOID>>>") == (("a: b,`c>", "DECIMAL(3,1)"), ("z", "ARRAY<OBJECT<`q,`: STRING, r: VOID>>"))
    assert drift._members("OBJECT<>") == ()


def test_flooding_decides_renames():
    field = lambda n, t="string": {"field": n, "type": t, "shape": t.upper(), "old_type": t, "old_shape": t.upper()}
    rng = random.Random(8)
    names = ["model", "models", "lane", "queue_name", "queue", "tier", "batch", "batch_no", "total_tokens", "tokens_total", "x", "a_b_c_d_e_f"]
    missed = 0
    for _ in range(40):
        went, arrived = [field(n) for n in rng.sample(names, 5)], [field(n + "_2") for n in rng.sample(names, 5)]
        exact = {(rng.choice(went)["field"], rng.choice(arrived)["field"]) for _ in range(3)}
        met = {(a["field"], b["field"]): (9, 9) if (a["field"], b["field"]) in exact else (9, rng.choice([0, 3, 8])) for a in went for b in arrived}
        chosen = {r[:2] for r in drift.select(went, arrived, [field("rest"), field("more")], met) if r[3]}
        assert exact <= chosen and len(chosen) < 25
        # Without what the flooding says, renames are lost.
        flood, drift.flood = drift.flood, lambda old, new, *_: {(a["field"], b["field"]): 1.0 for a in old for b in new}
        missed += len(exact - {r[:2] for r in drift.select(went, arrived, [field("rest"), field("more")], met) if r[3]})
        drift.flood = flood
    assert missed > 20


def test_unified_keeps_second_spellings_and_whole_numbers(spark):
    big = 9007199254740993
    files = {1: ['{"rid": 1, "Model": "m1", "model": "m2", "MODEL": null, "note": 1, "Note": 2, "RID": 7}', json.dumps({"rid": 2, "request_tokens": big, "total_tokens": "12.0", "timestamp": "1 days 02:03:04.5", "response_tokens": 2.5})]}
    out = {r["rid"]: r for r in drift.unify(frame(spark, files)).collect()}
    assert (out["1"]["model"], out["1"]["conflicts"], json.loads(out["1"]["extras"])) == ("m1", ["model", "note", "rid"], {"model#2": "m2", "note": "1", "note#2": "2", "rid#2": "7"})
    assert (out["2"]["request_tokens"], out["2"]["total_tokens"], out["2"]["timestamp"]) == (big, 12, 93784.5)
    assert out["2"]["response_tokens"] is None and json.loads(out["2"]["failed_casts"]) == {"response_tokens": "2.5"}


def test_unified_decodes_codes(spark):
    text = lambda i: "API log" if i % 2 else "Conversation log"
    files = {
        1: recs(0, 8, lambda i: {"log_type": text(i), "session_id": f"s{i}"}),
        2: recs(4, 8, lambda i: {"log_type": i % 2, "session_id": i}),
        3: recs(8, 8, lambda i: {"log_type": 1 - i % 2 == 0, "session_id": i}),
        4: recs(12, 8, lambda i: {"log_type": [text(i)], "session_id": f"s{i}"}),
    }
    late = {1: recs(0, 6, lambda i: {"log_type": 5 + i % 2}), 2: recs(2, 6, lambda i: {"log_type": text(i)})}
    out = {(r["file_no"], int(r["rid"])): r for r in drift.unify(frame(spark, files)).collect()}
    assert all(r["log_type"] == text(i) for (_, i), r in out.items())
    assert out[2, 5]["session_id"] == "s5" and out[3, 13]["session_id"] == "s13"
    assert out[2, 9]["session_id"] == "9" and out[2, 9]["undecoded"] == ["session_id"] and out[2, 5]["undecoded"] == []
    assert all(r["log_type"] == text(int(r["rid"])) for r in drift.unify(frame(spark, late)).collect())


def test_resent_records_agree(spark):
    from tests.oracle import DATA

    u = drift.unify(spark.read.parquet(f"{DATA}/feed_records.parquet")).toPandas()
    for c in drift.TARGET:
        n = u[u.rid.notna()].groupby(["feed_id", "rid"])[c].nunique()
        assert (n <= 1).all(), c
