"""Queries against brute force on cases that the driver's tables hardly hold."""

import hashlib
import math
import random
import re

import pyarrow as pa

from factloom import plans
from factloom.operators import documents, geometry, patch

def test_ignore_rules_of_every_path(spark, tmp_path):
    def ignored(path):
        last = path.endswith(".png") or path.startswith("src1/de/")
        if path.startswith("src3/") and path.endswith(".js"):
            last = not re.search(r"/doc_1[^/]*\.js$", path)
        return last

    rows = [(i, "a", lang, source, 1) for i, (lang, source) in enumerate([("en", "src1"), ("de", "src1"), ("en", "src3"), ("de", "src3"), ("de", "src2")] * 24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path: r.ignored for r in plans.QUERIES["s4_ignore_rules_whole"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got == {p: ignored(p) for p in got}
    held = {(p.split("/")[0], p.split("/")[1], p.rsplit(".")[-1]) for p in got}
    assert {("src3", "en", "png"), ("src3", "de", "png"), ("src3", "de", "js"), ("src1", "de", "txt")} <= held


def test_windows_of_long_spans(spark, tmp_path):
    lines = ["é" * 1999 + "ab", "é" * 1999 + "abc", "a" + "é" * 3000, "ab" + "🫧" * 1500, "水" * 2000, "b" * 4000, "c" * 4001, "short é"]
    rows = [(0, "\n".join(lines), "en", "src1", 1), (1, "d" * 9000, "en", "src2", 1), (2, "é\n\n" + lines[2], "de", "src1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for doc, text, *_ in rows:
        at = 0
        for i, line in enumerate(text.split("\n")):
            raw = line.encode()
            if raw:
                window = raw[:4000].decode(errors="ignore")
                want[doc, at] = (i + 1, len(raw) > 4000, hashlib.sha256(window.encode()).hexdigest())
            at += len(raw) + 1
    got = {(int(re.search(r"doc_(\d+)", r.id)[1]), r.w_start): (r.start_line, r.truncated, r.digest) for r in plans.QUERIES["q13_source_window_whole"](spark, str(tmp_path)).collect()}
    assert got == want
    assert sum(t for _, t, _ in got.values()) == 7


def test_windows_that_cross_lines_and_frames(spark):
    text = "ab\né\n\nlast 水"
    files = spark.createDataFrame([("p", text)], "path string, text string")
    raw = text.encode()
    spans = [(f"{lo}-{hi}", "p", lo, hi) for lo in (0, 3, 6) for hi in range(lo, len(raw) + 1) if hi != 4 and hi < 13 or hi == len(raw)]
    for size in (1, 4, 100):
        got = {r.id: r for r in documents.source_windows(spark.createDataFrame(spans, "id string, path string, lo long, hi long"), files, size).collect()}
        for i, _, lo, hi in spans:
            want = raw[lo : min(lo + size, hi)].decode(errors="ignore")
            assert (got[i].window, got[i].start_line, got[i].truncated) == (want, raw[:lo].count(b"\n") + 1, lo + len(want.encode()) < hi), i
    frames = ["    at f (file:///r/x/p:2:9)", "at /r/x/p:4:1", "at g (/r/x/p:40:1)", "at g (/elsewhere/p:1:1)", "at native", "at /r/x/none:1:1", "/r/x/p:0:1"]
    rows = spark.createDataFrame(list(enumerate(frames)), "id long, frame string")
    got = {r.id: (r.path, r.line, r.column, r.byte_offset, r.line_text) for r in documents.frame_offsets(rows, files, "/r/x").collect()}
    assert got == {0: ("p", 2, 9, 3, "é"), 1: ("p", 4, 1, 7, "last 水"), 2: ("p", 40, 1, len(raw), "")}


def test_rays_against_all_boxes(spark):
    rng = random.Random(3)
    boxes = [(i, rng.randrange(300), rng.randrange(300), rng.randrange(1, 90), rng.randrange(1, 90), rng.randrange(1, 60)) for i in range(40)]
    rays = [(k, *(rng.uniform(-100, 400) for _ in range(3)), *(rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(3))) for k in range(150)]
    want = {}
    for k, *v in rays:
        for i, x, y, w, h, tall in boxes:
            near, far = -math.inf, math.inf
            for o, d, lo, hi in zip(v[:3], v[3:], (x, 0, y), (x + w, tall, y + h), strict=True):
                if abs(d) < 1e-8:
                    near, far = (near, far) if lo <= o <= hi else (math.inf, -math.inf)
                else:
                    near, far = max(near, min((lo - o) / d, (hi - o) / d)), min(far, max((lo - o) / d, (hi - o) / d))
            if near <= far and far >= 0:
                want[k] = min(want.get(k, (math.inf, 0)), (max(near, 0.0), i))
    got = geometry.ray_pick(spark.createDataFrame(boxes, "id long, x long, y long, w long, h long, tall long"), spark.createDataFrame(rays, "ray long, ox double, oy double, oz double, dx double, dy double, dz double")).collect()
    assert {r.ray: r.id for r in got} == {k: i for k, (_, i) in want.items()}
    assert all(abs(r.t - want[r.ray][0]) < 1e-9 for r in got)


def test_diff_that_says_no_newline(spark):
    diff = "--- a/p\n+++ b/p\n@@ -1,1 +1,1 @@\n-a\n\\ No newline at end of file\n+b\n\\ No newline at end of file\n"
    assert [(x[5], x[6], x[7]) for x in patch.hunk_lines(diff)] == [("-", "a", None), ("+", "b", None)]


def test_lines_of_diffs_are_handed_on_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(patch, "AT_ONCE", 50)
    monkeypatch.setattr(patch, "CHARS", 300)
    body = "".join(f"+line {i}\n" for i in range(400)) + f"+{'w' * 1000}\n"
    batch = pa.RecordBatch.from_pydict({"patch": ["a", "none", "b"], "text": [f"--- /dev/null\n+++ b/p\n@@ -0,0 +1,401 @@\n{body}", None, "rename from x\n"]})
    parts = list(patch._parsed(iter([batch])))
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert rows == [("a", *r) for r in patch.hunk_lines(batch["text"][0].as_py())] + [("b", *r) for r in patch.hunk_lines("rename from x\n")]
    assert len(parts) > 8 and all(p.num_rows <= 50 for p in parts)
    assert list(patch._parsed(iter([]))) == []
