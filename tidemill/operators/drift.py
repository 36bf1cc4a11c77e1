"""Records whose fields drift between files: schema matching by similarity flooding, change report, cast and union."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.physical import materialize, sized_join

#: The request table all feeds are brought to; whole numbers are BIGINT, other numbers DOUBLE.
TARGET = {
    "timestamp": "number",
    "model": "string",
    "request_tokens": "whole",
    "response_tokens": "whole",
    "total_tokens": "whole",
    "log_type": "string",
    "source_batch": "string",
    "session_id": "string",
    "elapsed_time": "number",
}
#: Durations spelled out, which a feed may use for seconds.
DURATION = r"^\s*(\d+) days? (\d+):(\d{2}):(\d{2}(?:\.\d+)?)\s*$"
#: Weight of what speaks for a pair besides its name and type in its first score; a name can weigh 1 at most.
EVIDENCE = 3.0
#: The same for equal values of re-sent records. With it a pair whose values all agree outranks every other; see flood.
TRUST = 30.0
EPSILON = 1e-4
ROUNDS = 200
#: Least share of the best score of its schema pair that a correspondence with the target table needs.
ACCEPT = 0.35
#: Re-sent records in which both fields of a rename must be held.
LEAST_SHARED = 3


def field_name(raw: Column) -> Column:
    """Lower-cased, runs of characters other than a-z and 0-9 turned to one underscore, outer underscores stripped."""
    return F.btrim(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "_"), F.lit("_"))


def json_type(shape: Column) -> Column:
    """string, number, boolean, object or array from the text of schema_of_variant; null for JSON null."""
    return (
        F.when(shape == "VOID", F.lit(None))
        .when(shape == "STRING", F.lit("string"))
        .when(shape == "BOOLEAN", F.lit("boolean"))
        .when(shape.startswith("OBJECT"), F.lit("object"))
        .when(shape.startswith("ARRAY"), F.lit("array"))
        .otherwise(F.lit("number"))
    )


def canonical(item: Column, kind: Column, shape: Column) -> Column:
    """A text of a variant value of that type and shape (object keys sorted, numbers without trailing zeros): equal texts of one type are equal values."""
    number = F.try_variant_get(item, "$", "double")
    exact = F.when(shape == "BIGINT", F.to_json(item)).when((number == F.floor(number)) & (F.abs(number) < 2.0**53), number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    return F.when(kind == "number", exact).otherwise(F.to_json(item))


@lru_cache(maxsize=1 << 14)
def _members(shape: str) -> tuple[tuple[str, str], ...]:
    """(name, shape) of the members of the schema text of a variant object; names in backticks may hold any character."""
    inner = shape.partition("<")[2][:-1]
    out, at = [], 0
    while at < len(inner):
        if inner[at] == "`":
            end = at + 1
            while inner[end] != "`" or inner[end : end + 2] == "``":
                end += 2 if inner[end] == "`" else 1
            name, at = inner[at + 1 : end].replace("``", "`"), end + 3
        else:
            end = inner.index(": ", at)
            name, at = inner[at:end], end + 2
        start, depth, quoted = at, 0, False
        while at < len(inner) and not (inner[at] == "," and depth == 0 and not quoted):
            ch = inner[at]
            quoted ^= ch == "`"
            depth += 0 if quoted else (ch in "<(") - (ch in ">)")
            at += 1
        out.append((name, inner[start:at]))
        at += 2
    return tuple(out)


def _plain(shape: str) -> str:
    """json_type of a shape; 'null' for JSON null."""
    return {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}.get(shape, "object" if shape.startswith("OBJECT") else "array" if shape.startswith("ARRAY") else "number")


def file_schemas(records: DataFrame) -> DataFrame:
    """(feed_id, file_no, field, type, shape, n, objects, raws): a field's type is that of most of its values, of equally many the later in the alphabet.

    Records are counted by the shape of the whole payload, and only the different shapes of a file are taken apart: no
    record is exploded, and a file that holds a third of all records sends a few shapes a task. objects: the shapes of
    all values that are objects; raws: the names as spelled. rid and nulls are no fields; payloads that are null or no
    JSON object give none.
    """
    shape = F.schema_of_variant(F.try_parse_json("payload"))
    shapes = records.select("feed_id", "file_no", shape.alias("shape")).where(F.col("shape").startswith("OBJECT")).groupBy("feed_id", "file_no", "shape").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_members(x) for x in batch.column(2).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(held)), [len(h) for h in held]))
            names, kinds = ([m[i] for h in held for m in h] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(names, pa.string()), pa.array(kinds, pa.string()), batch.column(3).take(of)], ["feed_id", "file_no", "raw", "shape", "n"])

    kind = dict(records.dtypes)
    named = shapes.mapInArrow(run, f"feed_id {kind['feed_id']}, file_no {kind['file_no']}, raw string, shape string, n bigint")
    typed = named.withColumns({"field": field_name(F.col("raw")), "type": json_type(F.col("shape"))}).where(F.col("type").isNotNull() & (F.col("field") != "rid"))
    kinds = typed.groupBy("feed_id", "file_no", "field", "type").agg(
        F.sum("n").alias("n"), F.max("shape").alias("shape"), F.collect_set(F.when(F.col("type") == "object", F.col("shape"))).alias("objects"), F.collect_set("raw").alias("raws")
    )
    best = F.max(F.struct("n", "type", "shape")).alias("x")
    held = kinds.groupBy("feed_id", "file_no", "field").agg(best, F.flatten(F.collect_list("objects")).alias("objects"), F.array_distinct(F.flatten(F.collect_list("raws"))).alias("raws"))
    return held.select("feed_id", "file_no", "field", "x.type", "x.shape", "x.n", "objects", "raws")


def sought_cells(records: DataFrame, sought: DataFrame) -> DataFrame:
    """(feed_id, pair_no, side, rid, field, type, value): the values of the sought fields of the records with a rid.

    sought: written rows (feed_id, file_no, cells), one a file, cells being structs (raw, field, pair_no, side). Files
    without one are left before a payload is parsed; what is not sought is left before it is named, typed or written out.
    """
    met = sized_join(records.select("feed_id", "file_no", "payload"), sought, ["feed_id", "file_no"], ["payload"], row_bytes=4000)
    parsed = met.select("feed_id", "cells", F.try_parse_json("payload").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    held = parsed.select("feed_id", "cells", "v", F.expr("to_json(variant_get(v, '$.rid'))").alias("rid")).where(F.col("rid").isNotNull() & (F.col("rid") != "null"))
    each = held.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("v").outer())).select("feed_id", "rid", "value", F.filter("cells", lambda c: c["raw"] == F.col("key")).alias("hits"))
    typed = each.where(F.size("hits") > 0).withColumn("shape", F.schema_of_variant("value"))
    typed = typed.withColumn("type", json_type(F.col("shape"))).where(F.col("type").isNotNull())
    out = typed.select("feed_id", "rid", "type", canonical(F.col("value"), F.col("type"), F.col("shape")).alias("text"), F.explode("hits").alias("x"))
    return out.select("feed_id", "x.pair_no", "x.side", "rid", "x.field", "type", F.col("text").alias("value"))


def _words(name: str) -> list[str]:
    return [w for w in name.split("_") if w] or [name]


@lru_cache(maxsize=1 << 16)
def _alike(a: str, b: str) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio()


def _children(shape: str) -> list[str]:
    """Names inside the outermost object of a shape, which an array may hold."""
    inner = shape
    while inner.startswith("ARRAY<"):
        inner = inner[6:-1]
    return [n for n, _ in _members(inner)] if inner.startswith("OBJECT<") else []


def member_of(shapes: list[str], column: str, goal: list[dict]) -> str | None:
    """The member of a field's objects that stands for `column`: of its type before others, then the best flooded, ties by name."""
    fields = {n: {"field": n, "type": _plain(k), "shape": k} for s in sorted(shapes) for n, k in _members(s) if k != "VOID"}
    if not fields:
        return None
    kind = next(g["type"] for g in goal if g["field"] == column)
    alike = {(f, g["field"]): _alike(f.lower().replace("_", ""), g["field"].replace("_", "")) for f in fields for g in goal}
    scores = flood(list(fields.values()), goal, alike)
    return min(fields, key=lambda f: (fields[f]["type"] != kind, fields[f]["type"] in ("object", "array"), -scores[f, column] * alike[f, column], f))


def flood(old: list[dict], new: list[dict], evidence: dict[tuple[str, str], float], weight: float = EVIDENCE, epsilon: float = EPSILON, rounds: int = ROUNDS) -> dict[tuple[str, str], float]:
    """Similarity flooding between two schemas; scores of all field pairs, the best being 1.

    A schema is a graph: its root has fields, a field has a type, the words of its name, and nested fields. Two nodes
    are a pair in the connectivity graph if edges of one label lead to or from them; a pair's score flows along these
    edges in both directions, divided among the neighbours of the same label, and is added to its first score
    (similarity of names, types and evidence) until the largest change is below epsilon.

    What a field pair takes from its type, from the words of its name and from its nested fields is a mean over them, each
    at most 2, so 6 in all; what it takes from the root is the same for every pair. A pair of evidence 1 thus stays above all of
    evidence 1/2 or less, whatever flows, if weight / 2 > 6.3: in every round it gains weight against 0.3 + weight / 2 + 6.
    """
    index: dict[tuple, int] = {}
    first: list[float] = []

    def node(key: tuple, score: float) -> int:
        if key not in index:
            index[key] = len(first)
            first.append(score)
        return index[key]

    edges: list[tuple[int, int, str]] = []
    root = node(("root",), 1.0)
    for a in old:
        for b in new:
            seen = evidence.get((a["field"], b["field"]))
            name = _alike(a["field"], b["field"])
            pair = node(("field", a["field"], b["field"]), max(0.05, 0.5 * name + 0.2 * (a["type"] == b["type"]) if seen is None else 0.3 * name + weight * seen))
            edges.append((root, pair, "field"))
            edges.append((pair, node(("type", a["type"], b["type"]), 1.0 if a["type"] == b["type"] else 0.1), "type"))
            for label, xs, ys in (("word", _words(a["field"]), _words(b["field"])), ("child", _children(a["shape"]), _children(b["shape"]))):
                for x in xs:
                    for y in ys:
                        edges.append((pair, node((label, x, y), _alike(x, y)), label))
    start = np.array(first)
    if not edges:
        return {}
    source = np.array([e[0] for e in edges])
    target = np.array([e[1] for e in edges])
    label = np.unique([e[2] for e in edges], return_inverse=True)[1]
    width = label.max() + 1
    out = np.bincount(source * width + label, minlength=len(first) * width)
    into = np.bincount(target * width + label, minlength=len(first) * width)
    forward = 1.0 / out[source * width + label]
    back = 1.0 / np.maximum(into[target * width + label], out[source * width + label])
    score = start.copy()
    for _ in range(rounds):
        base = start + score
        flow = np.bincount(target, base[source] * forward, len(first)) + np.bincount(source, base[target] * back, len(first))
        following = base + flow
        following /= following.max()
        change = np.abs(following - score).max()
        score = following
        if change < epsilon:
            break
    pairs = {k[1:]: float(score[i]) for k, i in index.items() if k[0] == "field"}
    top = max(pairs.values())
    return {k: v / top for k, v in pairs.items()}


def consistent(scores: dict[tuple[str, str], float], least: float = 0.0) -> dict[str, str]:
    """One-to-one correspondences, best first, ties by name; fields of equal name go together before all others."""
    chosen: dict[str, str] = {}
    taken: set[str] = set()
    for (a, b), s in sorted(scores.items(), key=lambda x: (x[0][0] != x[0][1], -x[1], x[0])):
        if s >= least and a not in chosen and b not in taken:
            chosen[a] = b
            taken.add(b)
    return chosen


def select(went: list[dict], arrived: list[dict], kept: list[dict], resent: dict[tuple[str, str], tuple[int, int]]) -> list[tuple[str, str, float, bool, int, int]]:
    """(old_field, new_field, score, selected, shared, equal) for every pair of a field that went and one that came.

    went, arrived, kept: the fields of two successive files; resent: (shared, equal) of the pairs held by a re-sent
    record. The schemas are flooded against each other, fields that stayed included, equal values being the evidence: 1
    where all of at least LEAST_SHARED agree, else half their share. Selected are the consistent correspondences, best first,
    and with each of them the pairs that tie with it: those of one of its fields with the same evidence.
    """
    stay = [{"field": k["field"], "type": k["old_type"], "shape": k["old_shape"]} for k in kept]
    held = {pair: 1.0 if n == e >= LEAST_SHARED else 0.5 * e / n for pair, (n, e) in resent.items()}
    scores = flood([*went, *stay], [*arrived, *kept], held | {(k["field"], k["field"]): 1.0 for k in kept}, TRUST)
    chosen = consistent(scores)
    taken = {b: a for a, b in chosen.items()}
    out = []
    for x in went:
        for y in arrived:
            a, b = x["field"], y["field"]
            own = held.get((a, b))
            ties = bool(own) and own in (held.get((a, chosen.get(a))), held.get((taken.get(b), b)))
            out.append((a, b, scores[a, b], chosen.get(a) == b or ties, *resent.get((a, b), (0, 0))))
    return out


def successive(records: DataFrame) -> dict[str, DataFrame]:
    """The comparison of every file with the one before it, by similarity flooding.

    schemas: file_schemas; correspondences: (feed_id, file_no, old_field, new_field, score, selected, shared, equal) for
    every pair of a field that went and one that came, shared counting the re-sent records that hold both and equal those
    of them with equal values of one type; changes: (feed_id, file_no, change_kind, old_field, new_field). A rename is a
    selected correspondence that an exact check confirms. Files without the file before them (gaps in the numbers) are
    not compared.
    """
    schemas = materialize(file_schemas(records))
    files = records.select("feed_id", "file_no").distinct()
    before = files.select(F.col("feed_id").alias("f"), (F.col("file_no") + 1).alias("k"))
    compared = materialize(files.join(before, F.col("feed_id").eqNullSafe(F.col("f")) & (F.col("file_no") == F.col("k"))).select("feed_id", "file_no"))
    old = schemas.select(F.col("feed_id").alias("f"), (F.col("file_no") + 1).alias("k"), F.col("field").alias("old_field"), F.col("type").alias("old_type"), F.col("shape").alias("old_shape"))
    both = schemas.join(old, F.col("feed_id").eqNullSafe(F.col("f")) & (F.col("file_no") == F.col("k")) & (F.col("field") == F.col("old_field")), "full")
    both = both.select(F.coalesce("feed_id", "f").alias("feed_id"), F.coalesce("file_no", "k").alias("file_no"), "field", "type", "shape", "old_field", "old_type", "old_shape")
    both = materialize(both.join(compared.withColumnsRenamed({"feed_id": "cf", "file_no": "cn"}), F.col("feed_id").eqNullSafe(F.col("cf")) & (F.col("file_no") == F.col("cn")), "left_semi"))

    gone, came = F.col("field").isNull(), F.col("old_field").isNull()
    # Both schemas of one pair of files in one row: as large as a file has fields.
    graphs = both.groupBy("feed_id", "file_no").agg(
        F.collect_list(F.when(gone, F.struct(F.col("old_field").alias("field"), F.col("old_type").alias("type"), F.col("old_shape").alias("shape")))).alias("gone"),
        F.collect_list(F.when(came, F.struct("field", "type", "shape"))).alias("came"),
        F.collect_list(F.when(~gone & ~came, F.struct(F.col("field"), F.col("type"), F.col("shape"), F.col("old_type"), F.col("old_shape")))).alias("kept"),
    )
    open_ = materialize(graphs.where((F.size("gone") > 0) & (F.size("came") > 0)))
    # Values of the fields that went or came, in the two files that hold the re-sent records; nothing else is shuffled.
    names = schemas.select(F.col("feed_id").alias("nf"), F.col("file_no").alias("nn"), F.col("field").alias("name"), "raws")
    wanted = open_.select("feed_id", F.col("file_no").alias("pair_no"), (F.col("file_no") - 1).alias("file_no"), F.explode("gone.field").alias("field"), F.lit("old").alias("side")).unionByName(
        open_.select("feed_id", F.col("file_no").alias("pair_no"), "file_no", F.explode("came.field").alias("field"), F.lit("new").alias("side"))
    )
    spelled = wanted.join(names, F.col("feed_id").eqNullSafe(F.col("nf")) & (F.col("file_no") == F.col("nn")) & (F.col("field") == F.col("name")))
    spelled = spelled.select("feed_id", "file_no", "field", "pair_no", "side", F.explode("raws").alias("raw"))
    sought = materialize(spelled.groupBy("feed_id", "file_no").agg(F.collect_list(F.struct("raw", "field", "pair_no", "side")).alias("cells")))
    held = sought_cells(records, sought)
    # The sought cells of one record in both files, those of its copies once. One reading of the table serves both sides.
    side = lambda s: F.filter("cells", lambda c: c["side"] == s)
    met = held.groupBy("feed_id", "pair_no", "rid").agg(F.collect_set(F.struct("side", "field", "type", "value")).alias("cells"))
    resent = met.select("feed_id", "pair_no", side("new").alias("new"), F.explode(side("old")).alias("o")).select("feed_id", "pair_no", "o", F.explode("new").alias("n"))
    resent = resent.select("feed_id", "pair_no", *[F.col(f"{x}.{c}").alias(f"{name}_{c}") for x, name in (("o", "old"), ("n", "new")) for c in ("field", "type", "value")])
    same = (F.col("old_type") == F.col("new_type")) & (F.col("old_value") == F.col("new_value"))
    evidence = (
        resent.groupBy("feed_id", "pair_no", "old_field", "new_field")
        .agg(F.count(F.lit(1)).alias("shared"), F.count_if(same).alias("equal"))
        .groupBy(F.col("feed_id").alias("e_feed"), F.col("pair_no").alias("e_no"))
        .agg(F.collect_list(F.struct("old_field", "new_field", "shared", "equal")).alias("evidence"))
    )
    posed = open_.join(evidence, F.col("feed_id").eqNullSafe(F.col("e_feed")) & (F.col("file_no") == F.col("e_no")), "left").select("feed_id", "file_no", "gone", "came", "kept", "evidence")

    def flooded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for feed, no, went, arrived, kept, ev in pdf.itertuples(index=False):
                met = {(e["old_field"], e["new_field"]): (e["shared"], e["equal"]) for e in (ev if ev is not None else [])}
                out.extend((feed, no, *row) for row in select(list(went), list(arrived), list(kept), met))
            yield pd.DataFrame(out, columns=["feed_id", "file_no", "old_field", "new_field", "score", "selected", "shared", "equal"])

    kind = dict(records.dtypes)
    # Small rows with much work each: spread by number, which the adaptive planner leaves alone.
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    correspondences = materialize(
        posed.repartition(tasks).mapInPandas(flooded, f"feed_id {kind['feed_id']}, file_no {kind['file_no']}, old_field string, new_field string, score double, selected boolean, shared bigint, equal bigint")
    )
    # The exact check of what the flooding selected: every re-sent record that holds both fields agrees.
    renamed = correspondences.where(F.col("selected") & (F.col("shared") >= LEAST_SHARED) & (F.col("shared") == F.col("equal")))
    ends = materialize(renamed.select("feed_id", "file_no", "old_field", "new_field", "score"))

    def rest(rows: DataFrame, name: str, used: str) -> DataFrame:
        taken = ends.select(F.col("feed_id").alias("tf"), F.col("file_no").alias("tn"), F.col(used).alias("tu"))
        return rows.join(taken, F.col("feed_id").eqNullSafe(F.col("tf")) & (F.col("file_no") == F.col("tn")) & (F.col(name) == F.col("tu")), "left_anti")

    nothing = F.lit("")
    changes = (
        ends.select("feed_id", "file_no", F.lit("renamed").alias("change_kind"), "old_field", "new_field")
        .unionByName(rest(both.where(gone), "old_field", "old_field").select("feed_id", "file_no", F.lit("removed").alias("change_kind"), "old_field", nothing.alias("new_field")))
        .unionByName(rest(both.where(came), "field", "new_field").select("feed_id", "file_no", F.lit("added").alias("change_kind"), nothing.alias("old_field"), F.col("field").alias("new_field")))
        .unionByName(both.where(F.col("type") != F.col("old_type")).select("feed_id", "file_no", F.lit("retyped").alias("change_kind"), "old_field", F.col("field").alias("new_field")))
    )
    return {"schemas": schemas, "correspondences": correspondences, "renames": ends, "changes": changes}


def changes(records: DataFrame) -> DataFrame:
    """(feed_id, file_no, change_kind, old_field, new_field) of every file against the one before it; see successive."""
    return successive(records)["changes"]


def followed(links: DataFrame, keys: list[str]) -> DataFrame:
    """links (keys..., node, up) with up moved to the end of its chain: the last one that no link leads on from.

    Pointer doubling: the rounds grow with the logarithm of the longest chain. Each node has one link; chains have no cycle.
    """
    links = materialize(links.select(*keys, "node", "up"))
    while True:
        step = links.select(*[F.col(k).alias(f"u_{k}") for k in keys], F.col("node").alias("at"), F.col("up").alias("upper"))
        same = F.col("up") == F.col("at")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"u_{k}"))
        moved = materialize(links.join(step, same, "left").select(*keys, "node", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")))
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return links


def lineage(schemas: DataFrame, renames: DataFrame) -> DataFrame:
    """(feed_id, file_no, field, type, shape, objects, origin): origin identifies one field of a feed through all its renames.

    A field's unbroken stay under one name is a segment; a rename links a segment to the one before it; see followed.
    """
    by = Window.partitionBy("feed_id", "field").orderBy("file_no")
    fresh = F.coalesce(F.lag("file_no").over(by) != F.col("file_no") - 1, F.lit(True))
    segments = materialize(schemas.withColumn("start", F.when(fresh, F.col("file_no"))).withColumn("start", F.last("start", True).over(by)))
    best = Window.partitionBy("feed_id", "file_no", "new_field").orderBy(F.desc("score"), "old_field")
    one = renames.withColumn("k", F.row_number().over(best)).where(F.col("k") == 1)
    parent = segments.select(F.col("feed_id").alias("pf"), (F.col("file_no") + 1).alias("pn"), F.col("field").alias("po"), F.col("start").alias("p_start"))
    linked = one.join(parent, F.col("feed_id").eqNullSafe(F.col("pf")) & (F.col("file_no") == F.col("pn")) & (F.col("old_field") == F.col("po")))
    place = lambda name, start: F.struct(F.col(name).alias("field"), F.col(start).alias("start"))
    ends = followed(linked.select("feed_id", place("new_field", "file_no").alias("node"), place("old_field", "p_start").alias("up")), ["feed_id"]).withColumnRenamed("feed_id", "lf")
    own = segments.withColumn("own", place("field", "start"))
    rooted = own.join(ends, F.col("feed_id").eqNullSafe(F.col("lf")) & (F.col("own") == F.col("node")), "left")
    return rooted.select("feed_id", "file_no", "field", "type", "shape", "objects", F.coalesce("up", "own").alias("origin"))


def _held_kind(field: dict, member: str | None) -> str:
    """text, number or boolean: what a column gets from a field, of an object from its member, of an array from its first value."""
    kind, shape = field["type"], field["shape"]
    if kind == "object" and member is not None:
        kind = next((_plain(k) for s in sorted(field["objects"]) for n, k in _members(s) if n == member and k != "VOID"), "string")
    elif kind == "array":
        kind = _plain(shape[6:-1])
    return kind if kind in ("number", "boolean") else "text"


def to_target(lines: DataFrame, target: dict[str, str] | None = None, accept: float = ACCEPT) -> DataFrame:
    """(feed_id, file_no, field, column, member, kind): the target column of every field of every file, null where it has none.

    member is the one that stands for the column where the field's values are objects, see member_of; kind is text, number or
    boolean, as most of what the column gets.

    The names an origin ever bore stand for it; each file's schema is flooded against the target table, origin names included.
    """
    target = target or TARGET
    goal = [{"field": k, "type": "string" if v == "string" else "number", "shape": ""} for k, v in target.items()]
    names = lines.groupBy("feed_id", "origin").agg(F.collect_set("field").alias("names"))
    names = names.withColumnsRenamed({"feed_id": "nf", "origin": "no"})
    files = (
        lines.join(names, F.col("feed_id").eqNullSafe(F.col("nf")) & (F.col("origin") == F.col("no")))
        .groupBy("feed_id", "file_no")
        .agg(F.collect_list(F.struct("field", "type", "shape", "objects", "names")).alias("fields"))
    )

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        members: dict[tuple, str | None] = {}
        for pdf in batches:
            out = []
            for feed, no, fields in pdf.itertuples(index=False):
                seen = {(f["field"], t): max(_alike(n.replace("_", ""), t.replace("_", "")) for n in f["names"]) for f in fields for t in target}
                scores = flood(list(fields), goal, seen)
                # A name that is a column's own settles the matter; else the flooded score weighs the likeness.
                ranked = {k: (2.0 if seen[k] == 1.0 else v * seen[k]) for k, v in scores.items()}
                chosen = consistent(ranked, accept)
                for f in fields:
                    column = chosen.get(f["field"])
                    shapes = tuple(sorted(f["objects"])) if column else ()
                    if shapes and (shapes, column) not in members:
                        members[shapes, column] = member_of(list(shapes), column, goal)
                    member = members.get((shapes, column))
                    out.append((feed, no, f["field"], column, member, _held_kind(f, member)))
            yield pd.DataFrame(out, columns=["feed_id", "file_no", "field", "column", "member", "kind"])

    kind = dict(lines.dtypes)
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks).mapInPandas(matched, f"feed_id {kind['feed_id']}, file_no {kind['file_no']}, field string, column string, member string, kind string")


def stretches(mapping: DataFrame, target: dict[str, str]) -> DataFrame:
    """mapping with (stretch, code, edge, back) for columns of text: where a feed delivers it as numbers or booleans, these are codes.

    A stretch is a run of files in which a column comes in one kind. edge: the file is the first or last of a stretch of
    codes, or the file beside it; back: text was delivered in an earlier stretch.
    """
    texts = [c for c, kind in target.items() if kind == "string"]
    by = Window.partitionBy("feed_id", "column").orderBy("file_no")
    own = mapping.where(F.col("column").isNotNull())
    new = F.coalesce((F.lag("kind").over(by) != F.col("kind")).cast("int"), F.lit(0))
    code = F.col("column").isin(texts) & (F.col("kind") != "text")
    placed = own.withColumn("new", new).withColumns({"stretch": F.sum("new").over(by).cast("int"), "code": code, "back": F.coalesce(F.max(F.col("kind") == "text").over(by), F.lit(False))})
    beside = lambda at: (at("stretch", 1).over(by) != F.col("stretch")) & (F.col("code") | at("code", 1).over(by))
    return placed.withColumn("edge", F.coalesce(beside(F.lag), F.lit(False)) | F.coalesce(beside(F.lead), F.lit(False))).drop("new", "kind")


def decoded(edges: DataFrame) -> DataFrame:
    """(feed_id, column, stretch, value, text): what the codes of a feed stand for, learned from re-sent records.

    edges: (feed_id, rid, file_no, column, stretch, code, back, value) of records at the edge of a stretch of codes. The
    same record in the files on either side of the edge holds the code and the text, or the code before it. A code
    stands for the text that over half of its records beside text say, on either side; a code that no such record holds
    is followed over other codes, back where there is an earlier stretch of text, else ahead. Codes that lead to no text,
    as no re-sent record holds them, have no row.
    """
    keys = ["feed_id", "rid", "column"]
    one = edges.where(F.col("rid").isNotNull() & F.col("value").isNotNull()).distinct()
    after = one.select(*[F.col(c).alias(f"n_{c}") for c in one.columns])
    same = F.col("file_no") + 1 == F.col("n_file_no")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"n_{k}"))
    met = materialize(one.join(after, same & (F.col("stretch") != F.col("n_stretch"))))
    node = lambda m: F.struct(F.col(f"{m}stretch").alias("stretch"), F.col(f"{m}value").alias("value"))
    end = lambda m: F.struct(F.when(F.col(f"{m}code"), F.col(f"{m}stretch")).alias("stretch"), F.col(f"{m}value").alias("value"))
    ahead = F.col("code") & (~F.col("n_code") | ~F.col("back"))
    links = met.where(F.col("n_code") & (~F.col("code") | F.col("n_back"))).select("feed_id", "column", node("n_").alias("node"), end("").alias("up"))
    links = links.unionByName(met.where(ahead).select("feed_id", "column", node("").alias("node"), end("n_").alias("up")))
    votes = links.groupBy("feed_id", "column", "node", "up").agg(F.count(F.lit(1)).alias("n")).withColumn("plain", F.col("up.stretch").isNull())
    most = lambda of: F.max_by("up", F.when(of, F.struct("n", "up")))
    share = lambda of: F.max(F.when(of, F.col("n"))) * 2 > F.sum(F.when(of, F.col("n")))
    best = votes.groupBy("feed_id", "column", "node").agg(*[f(of).alias(f"{name}_{kind}") for kind, of in (("text", F.col("plain")), ("code", ~F.col("plain"))) for name, f in (("up", most), ("sure", share))])
    chosen = F.when(F.col("sure_text").isNotNull(), F.when(F.col("sure_text"), F.col("up_text"))).otherwise(F.when(F.col("sure_code"), F.col("up_code")))
    ends = followed(best.withColumn("up", chosen).where(F.col("up").isNotNull()), ["feed_id", "column"])
    return ends.where(F.col("up.stretch").isNull()).select("feed_id", "column", F.col("node.stretch").alias("stretch"), F.col("node.value").alias("value"), F.col("up.value").alias("text"))


def number_of(text: Column) -> Column:
    """A number, or a duration such as '2 days 03:04:05.6' in seconds; null for other texts and for infinity and NaN."""
    part = lambda k: F.regexp_extract(text, DURATION, k)
    seconds = part(1).cast("double") * 86_400 + part(2).cast("double") * 3600 + part(3).cast("double") * 60 + part(4).cast("double")
    plain = text.try_cast("double")
    return F.when(text.rlike(DURATION), seconds).when(F.abs(plain) < F.lit(float("inf")), plain)


def whole_of(text: Column) -> Column:
    """A whole number as BIGINT, exact whatever its size; null for others."""
    number = text.try_cast("double")
    return F.coalesce(text.try_cast("bigint"), F.when((number == F.floor(number)) & (F.abs(number) < 9e18), number.try_cast("bigint")))


def unify(records: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """All records in one table: feed_id, file_no, record_no, rid, the target's columns, extras, failed_casts, conflicts, undecoded, resent.

    Each payload is read once as a map; its file's field mapping comes by a join that is broadcast or salted (one file may
    hold a large part of all records) and the columns are picked from the map: no record is exploded. Nothing delivered
    is lost but nulls. An object gives the member that name and type choose in its file, an array its first value; all that
    is left of it stays in extras under the field's name, as JSON. Where a record spells one name twice, the first value
    that is not null holds; the field is named in conflicts, later values stay in extras as field#2, field#3. Texts and numbers
    are cast to the column's type (durations to seconds); a value that cannot be cast is null and kept in failed_casts, a JSON
    object by column. Codes that a feed uses for a text (numbers, booleans) are decoded, see decoded; where no re-sent record
    tells, the code stays and its column is named in undecoded. Fields without a target column stay in extras, under their own
    name. resent marks records whose rid an earlier file of the feed held. A payload that is no JSON object gives a row
    with nulls.
    """
    target = target or TARGET
    texts = [c for c, kind in target.items() if kind == "string"]
    found = successive(records)
    mapping = stretches(materialize(to_target(lineage(found["schemas"], found["renames"]), target)), target)
    entry = F.struct("column", "member", "stretch", "code", "edge", "back")
    mapping = materialize(mapping.groupBy("feed_id", "file_no").agg(F.map_from_entries(F.collect_list(F.struct("field", entry))).alias("mapping")))
    named = F.transform(F.map_entries(F.from_json("payload", "map<string,string>")), lambda e: F.struct(field_name(e["key"]).alias("field"), e["value"].alias("value")))
    rows = records.select("feed_id", "file_no", "record_no", named.alias("named"))
    joined = sized_join(rows, mapping, ["feed_id", "file_no"], ["record_no"], "left", row_bytes=4000)

    before = lambda i, e: F.filter(F.slice("named", 1, i), lambda o: o["field"] == e["field"])
    nth = lambda e, i: F.size(before(i, e))
    second = lambda e, i: e["value"].isNotNull() & F.exists(before(i, e), lambda o: o["value"].isNotNull())
    to = F.transform("named", lambda e, i: F.struct(e["field"].alias("field"), e["value"].alias("value"), nth(e, i).alias("nth"), second(e, i).alias("second"), F.get(F.array(F.col("mapping")[e["field"]]), F.lit(0)).alias("to")))
    nested = lambda e, start, kind: F.when(e["to"].isNotNull() & ~e["second"] & e["value"].startswith(start), F.from_json(e["value"], kind))
    opened = lambda e: F.struct(
        F.when(~e["second"], e["to"]["column"]).alias("column"), F.coalesce(e["to"]["member"], F.lit("")).alias("member"), e["field"].alias("field"), e["value"].alias("value"), e["nth"].alias("nth"), e["second"].alias("second"), e["to"].alias("to"),
        nested(e, "{", "map<string,string>").alias("object"), nested(e, "[", "array<string>").alias("array"),
    )
    left = lambda e: F.map_filter(e["object"], lambda k, _: k != e["member"])
    kept = lambda e: F.when(e["object"].isNotNull(), e["object"][e["member"]]).when(e["array"].isNotNull(), F.get(e["array"], F.lit(0))).otherwise(e["value"])
    rest = lambda e: F.when(F.size(left(e)) > 0, F.to_json(left(e))).when(F.size(e["array"]) > 1, F.to_json(F.slice(e["array"], 2, F.size(e["array"]))))
    name = lambda e: F.when(e["nth"] == 0, e["field"]).otherwise(F.concat(e["field"], F.lit("#"), (e["nth"] + 1).cast("string")))
    placed = joined.withColumn("placed", F.transform(F.transform(to, opened), lambda e: F.struct(e["column"].alias("column"), e["field"].alias("field"), name(e).alias("name"), e["second"].alias("second"), e["value"].alias("value"), e["to"].alias("to"), kept(e).alias("kept"), rest(e).alias("rest"))))
    one = lambda keep: F.get(F.filter("placed", keep), F.lit(0))
    held = lambda c: one(lambda e: (e["column"] == c) & e["value"].isNotNull())
    others = F.filter("placed", lambda e: (e["column"].isNull() & (e["name"] != "rid")) | e["rest"].isNotNull())
    raw = placed.withColumns(
        {f"__{c}": held(c) for c in target}
        | {
            "rid": one(lambda e: e["field"] == "rid")["value"],
            "extras": F.to_json(F.map_from_entries(F.transform(others, lambda e: F.struct(e["name"], F.coalesce(e["rest"], e["value"]))))),
            "conflicts": F.array_distinct(F.transform(F.filter("placed", lambda e: e["second"]), lambda e: e["field"])),
        }
    )
    value = {c: F.col(f"__{c}.kept") for c in target}
    cast = {c: {"string": lambda v: v, "number": number_of, "whole": whole_of}[kind](value[c]) for c, kind in target.items()}
    failed = F.filter(F.array(*[F.struct(F.lit(c).alias("column"), F.when(v.isNull(), value[c]).alias("value")) for c, v in cast.items() if c not in texts]), lambda e: e["value"].isNotNull())
    marks = {f"__{c}": F.col(f"__{c}.to") for c in texts}
    table = materialize(
        raw.select("feed_id", "file_no", "record_no", "rid", *[v.alias(c) for c, v in cast.items()], "extras", F.to_json(F.map_from_entries(failed)).alias("failed_casts"), "conflicts", *[F.struct(v["stretch"].alias("stretch"), v["code"].alias("code"), v["edge"].alias("edge"), v["back"].alias("back")).alias(k) for k, v in marks.items()])
    )
    # The rids of more than one file, found on three columns.
    met = table.where(F.col("rid").isNotNull()).groupBy("feed_id", "rid").agg(F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file"))
    met = materialize(met.where(F.col("first_file") < F.col("last_file")).select("feed_id", "rid", "first_file"))
    cells = F.filter(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{c}.stretch"), F.col(f"__{c}.code"), F.col(f"__{c}.edge"), F.col(f"__{c}.back"), F.col(c).alias("value")) for c in texts]), lambda e: e["edge"])
    at_edge = table.select("feed_id", "rid", "file_no", "record_no", cells.alias("cells")).where((F.size("cells") > 0) & F.col("rid").isNotNull())
    edges = sized_join(at_edge, met.drop("first_file"), ["feed_id", "rid"], ["record_no"], "left_semi").select("feed_id", "rid", "file_no", F.explode("cells").alias("e")).select("feed_id", "rid", "file_no", "e.column", "e.stretch", "e.code", "e.back", "e.value")
    codes = materialize(decoded(edges))
    # As many rows as the target has columns of text.
    known = {r["column"] for r in codes.select("column").distinct().collect()}
    out = sized_join(table, met, ["feed_id", "rid"], ["record_no"], "left")
    for c in texts:
        out = out.withColumn(f"__{c}", F.when(F.col(f"__{c}.code"), F.col(f"__{c}.stretch")))
        if c in known:
            one = codes.where(F.col("column") == c).select("feed_id", F.col("stretch").alias(f"__{c}"), F.col("value").alias(c), F.col("text").alias(f"__text_{c}"))
            out = sized_join(out, one, ["feed_id", f"__{c}", c], ["record_no"], "left")
        else:
            out = out.withColumn(f"__text_{c}", F.lit(None).cast("string"))
    undecoded = F.array_compact(F.array(*[F.when(F.col(f"__{c}").isNotNull() & F.col(c).isNotNull() & F.col(f"__text_{c}").isNull(), F.lit(c)) for c in texts]))
    resent = F.coalesce(F.col("first_file") < F.col("file_no"), F.lit(False))
    return out.select("feed_id", "file_no", "record_no", "rid", *[F.coalesce(f"__text_{c}", c).alias(c) if c in texts else F.col(c) for c in target], "extras", "failed_casts", "conflicts", undecoded.alias("undecoded"), resent.alias("resent"))
