"""One pass over sorted groups: nesting of spans against all pairs, shelves that hold their plates."""

import random

from factloom.operators import sweeps

SPANS = "path string, id long, start long, end long"


def test_nesting_is_that_of_all_pairs(spark):
    rng = random.Random(4)
    rows = [(p, i, a, a + rng.randrange(9)) for p in "xyz" for i in range(40) for a in [rng.randrange(25)]] + [("one", 1, 3, 3), (None, 1, 0, 1), ("bad", 1, 4, 2), ("bad", None, 0, 1)]
    got = {(r.path, r.id): r for r in sweeps.nesting(spark.createDataFrame(rows, SPANS)).collect()}
    assert len(got) == 121
    for p in "xyz":
        spans = sorted((r[1:] for r in rows if r[0] == p), key=lambda s: (s[1], -s[2], s[0]))
        for k, (i, start, end) in enumerate(spans):
            hold = [s[0] for s in spans[:k] if s[1] <= start and end <= s[2]]
            r = got[p, i]
            assert r.parent == (hold[-1] if hold else None)
            assert r.depth == (got[p, r.parent].depth + 1 if hold else 0)
        crossing = any(a[1] < b[1] < a[2] < b[2] for a in spans for b in spans)
        assert crossing == any(got[p, s[0]].crosses for s in spans)


def test_nested_spans_of_a_deep_tree(spark):
    rows = [("f", i, i, 4000 - i) for i in range(2000)] + [("g", i, 10 * i, 10 * i + 9) for i in range(2000)]
    got = sweeps.nesting(spark.createDataFrame(rows, SPANS)).collect()
    assert all((r.parent, r.depth) == ((r.id - 1 if r.id else None, r.id) if r.path == "f" else (None, 0)) and not r.crosses for r in got)
    assert sweeps.nesting(spark.createDataFrame([], SPANS)).collect() == []


def test_shelves_hold_their_plates(spark):
    rng = random.Random(9)
    rows = [(c, i, rng.randrange(40), rng.random() * 6, None if i % 5 == 0 else rng.random() * 6) for c, n in ((1, 60), (2, 1), (3, 7)) for i in range(n)]
    plates = sweeps.footprints(spark.createDataFrame(rows, "city int, plate int, blocks int, block_w double, block_d double"))
    sizes = {(r.city, r.plate): (r.w, r.d) for r in plates.collect()}
    placed = sweeps.shelves(plates).collect()
    assert len(placed) == len(rows)
    for city, n, root in ((1, 60, 8), (2, 1, 1), (3, 7, 3)):
        boxes = sorted((r.plate, r.shelf, r.x, r.z, *sizes[city, r.plate]) for r in placed if r.city == city)
        room = root * max(b[4] for b in boxes)
        x = z = deep = shelf = 0
        for k, (plate, s, bx, bz, w, d) in enumerate(boxes):
            if k and x + w > room:
                x, z, deep, shelf = 0, z + deep + 7, 0, shelf + 1
            assert (plate, s, round(bx, 6), round(bz, 6)) == (k, shelf, round(x, 6), round(z, 6)) and bx + w <= room + 1e-9
            x, deep = x + w + 7, max(deep, d)
    assert sweeps.shelves(plates.where("false")).collect() == []
