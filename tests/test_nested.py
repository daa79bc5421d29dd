"""Facts of unknown shape, opened level by level, against a walk in Python."""

import json
import random

from pyspark.sql import functions as F

from factloom.operators import nested


def made(rng, depth):
    kind = rng.randrange(3) if depth else 3
    if kind == 0:
        return {rng.choice(["origin", "a", 'q"\\', "ü"]): made(rng, depth - 1) for _ in range(rng.randrange(4))}
    if kind == 1:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, 7, -1.5, "", 'x"y\\\n', "é "])


def found(value, name):
    if isinstance(value, dict):
        for k, v in value.items():
            if k == name:
                yield v if isinstance(v, str) else json.dumps(v, sort_keys=True)
            yield from found(v, name)
    elif isinstance(value, list):
        for v in value:
            yield from found(v, name)


def canonical(text, is_text):
    return text if is_text else json.dumps(json.loads(text), sort_keys=True)


def test_fields_at_any_depth(spark):
    rng = random.Random(3)
    docs = [made(rng, 5) for _ in range(60)] + [{"origin": {"origin": ["origin"]}}]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, None), (901, "{"), (902, '{"origin":1,"origin":2}'), (903, "")], "id long, text string")
    got = {}
    for r in nested.fields(rows, "origin").collect():
        got.setdefault(r.id, []).append(r.value)
    norm = lambda v: v if not v or v[0] not in "{[" else json.dumps(json.loads(v), sort_keys=True)
    assert {i: sorted(map(norm, v)) for i, v in got.items()} == {i: sorted(map(norm, found(d, "origin"))) for i, d in enumerate(docs) if list(found(d, "origin"))}
    assert nested.fields(rows.where("false"), "origin").collect() == []


def tagged(rng, depth):
    """An encoded value and what it is without tags."""
    kind = rng.choice(["array", "object"]) if depth and rng.random() < 0.7 else rng.choice(["number", "string", "null", "undefined", "raw"])
    if kind == "array":
        parts = [tagged(rng, depth - 1) for _ in range(rng.randrange(12))]
        return {"kind": kind, "items": [p[0] for p in parts]}, [p[1] for p in parts]
    if kind == "object":
        parts = {rng.choice(["b", "a", 'q"\\', "kind", "ü"]): tagged(rng, depth - 1) for _ in range(rng.randrange(4))}
        return {"kind": kind, "entries": {k: p[0] for k, p in parts.items()}}, {k: p[1] for k, p in parts.items()}
    if kind in ("number", "string"):
        value = 5 if kind == "number" else 'w"\\\n'
        return {"kind": kind, "value": value}, value
    if kind == "raw":
        value = rng.choice([[{"kind": "number", "value": 1}], {"x": 1}, "s", 2, {"kind": ["array"]}])  # no tag on top: stays
        return value, value
    return {"kind": kind}, None if kind == "null" else {"kind": kind}


def test_untagged_at_any_depth(spark):
    rng = random.Random(8)
    cases = [tagged(rng, 4) for _ in range(60)] + [({"kind": "array", "items": {"a": 1}}, []), ({"kind": "object", "entries": [1]}, {}), ({"kind": "array", "items": None}, []), ({"kind": "we\"ird"}, {"kind": "we\"ird"})]
    texts = [json.dumps(c) for c, _ in cases]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts + texts[:5])] + [(900, None, "n")], "n int, v string, at string")
    got = {r.n: (r.got, r["at"]) for r in nested.untagged(rows, "v", "got").collect()}
    assert len(got) == len(cases) + 6 and got.pop(900) == (None, "n")
    assert all(kept == "kept" for _, kept in got.values())
    assert [json.loads(got[i][0]) for i in range(len(cases))] == [w for _, w in cases]
    assert [got[len(cases) + i][0] for i in range(5)] == [got[i][0] for i in range(5)]


def test_rows_of_one_text_are_looked_up_in_many_places(spark, monkeypatch):
    monkeypatch.setattr(nested, "buckets", lambda *_: 8)
    ids = ["often"] * 4000 + ["other", "none", None] * 20
    rows = spark.createDataFrame(list(enumerate(ids)), "k long, _id string")
    said = spark.createDataFrame([("often", "x"), ("other", "y")], "_id string, value string")
    got = nested._told(rows, said, rows.where("_id IS NOT NULL").groupBy("_id").count().withColumnRenamed("count", "n"), most=100)
    assert {r.k: r.value for r in got.collect()} == {k: {"often": "x", "other": "y"}.get(i) for k, i in enumerate(ids)}
    places = got.where("value = 'x'").groupBy(F.spark_partition_id()).count().collect()
    assert len(places) > 4 and max(r["count"] for r in places) < 2000
