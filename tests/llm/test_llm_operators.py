"""The ten operators against brute force, round trips and held-out accuracy, on the smallest tables and on edge cases."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import context_tree, decontaminate, entries, licenses, main_text, ngram_join, packing, preference, secrets, toxicity, vptree
from factloom.llm.kernels import Bitmap

SF = "/root/testdata/sf0.001"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", "   \n ", "a", "É", "x " * 20_000, "\x00\x01 b", "山 🌊 zwei"]


def words(text):
    return WORDS.findall((text or "").translate(ASCII_LOWER))


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1 -----------------------------------------------------------------------------------------------------------------


def base_spans(text):
    out = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for k, pattern in enumerate((r"(?ai)" + assign, r"AKIA[A-Z0-9]+", r"[0-9a-f]+")):
        for m in re.finditer(pattern, text or ""):
            if len(m[2] if k == 0 else m[0]) >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end(), ("assign", "access", "hex")[k]))
    return sorted(out)


def test_secret_base(spark, documents):
    extra = [
        "secret=token = abcdefgh",
        "tokensecret: x9\nPASSWORD = 'Abcdef1'",
        "AKIAAKIA" + "A" * 12 + " é🫧 AKIA" + "B" * 16 + "x",
        "ab" * 400 + " api_key:abcdef apikey='123456",
        None,
        "",
    ]
    texts = [r.text for r in documents.select("text").collect()] + extra
    got = {r.doc_id: r for r in secrets.scan(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        mine = [(s.start, s["rank"], s.end, s.kind) for s in got[i].spans if s.kind in secrets.STRONG]
        assert mine == base_spans(t), t


def test_secret_links(spark):
    opaque = "zQ3kT8vW5xY1aB7cD9eF2g"
    texts = [
        f"the value {opaque} alone",
        f"user = deploy with {opaque} here",
        f"user = deploy\n\n{opaque} in another scope",
        f"user = deploy {'far ' * 100} {opaque}",
        f"at db.example.com login: root key {opaque}",
        f"connect db.example.com and {opaque}",
        "login: root at db.example.com",
    ]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scan(docs_of(spark, texts)).collect()}
    assert got == {0: [], 1: ["account", "opaque"], 2: [], 3: [], 4: ["endpoint", "account", "opaque"], 5: ["opaque"], 6: []}


def test_secret_runs_of_any_length(spark):
    """Opaque runs and host names of any length; a text of two million characters."""
    run = "aB" * 40 + "7" + "cD" * 5
    texts = [f"login=bob key {run} end", f"{'x' * 2_000_000} login=bob {run}", "at a.b.c.d.e.f.g.h.i.j.k.example.com login=bob " + run, f"{run} alone"]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(docs_of(spark, texts)).collect()}
    at = texts[0].index(run)
    assert got[0] == [("account", 0, 9), ("opaque", at, at + len(run))]
    assert got[1][1][0] == "opaque" and got[1][1][2] == len(texts[1])
    assert [k for k, _, _ in got[2]] == ["endpoint", "account", "opaque"] and got[2][0][1:] == (3, 36)
    assert got[3] == []


def brute_linked(text, spans):
    """Reported parts by comparing all pairs: ``spans`` (kind, start, end) of every part found."""
    borders = [m.span() for m in re.finditer(r"\n[ \t]*\n", text)]
    scope = lambda s: sum(b[0] < s[1] or (b[0] == s[1] and b[1] <= s[2]) for b in borders)
    cls = {k: v[0] for k, v in secrets.KINDS.items()}

    def near(s, c):
        return any(
            cls[o[0]] == c and o is not s and scope(o) == scope(s) and (0 <= s[1] - o[2] <= secrets.REACH or 0 <= o[1] - s[2] <= secrets.REACH or (o[1] < s[2] and s[1] < o[2])) for o in spans
        )

    need = {"secret": lambda s: near(s, "identity") or near(s, "endpoint"), "identity": lambda s: near(s, "secret"), "endpoint": lambda s: near(s, "secret") and near(s, "identity")}
    return sorted(s for s in spans if s[0] in secrets.STRONG or need[cls[s[0]]](s))


def test_secret_links_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    parts = ["login=bob1", "user: ann", "aB3" * 8, "https://h.example.com/x", "db.example.com", "password=hunter22", "AKIA" + "A1B2C3D4E5F6G7H8", "0123456789abcdef0123456789", "\n\n", "\n \n", "x " * 60, "word", "10.0.0.1"]
    texts = [" ".join(rng.choice(parts, 14)) for _ in range(60)]
    found = secrets.parts(docs_of(spark, texts).withColumn("row", F.col("doc_id"))).where("kind IS NOT NULL AND kind <> 'border'").collect()
    got = {r.doc_id: sorted((s.kind, s.start, s.end) for s in r.spans) for r in secrets.scan(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        assert got[i] == brute_linked(text, [(r.kind, r.start, r.end) for r in found if r["row"] == i]), text


def test_secret_redaction(spark):
    texts = ["a password=abcdef1 b", "token = \"" + "ab12" * 8 + "\" é", "clean", None, ""]
    got = {r.doc_id: r for r in secrets.redact(docs_of(spark, texts)).collect()}
    assert got[0].text == "a [REDACTED] b" and got[0].n_chars == len(got[0].text)
    assert got[1].text == "[REDACTED]\" é"
    assert got[2].text == "clean" and got[3].text is None and got[4].text == "" and got[2].lang == "en"


def test_secret_plan_is_native(spark, documents):
    plan = secrets.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 2 -----------------------------------------------------------------------------------------------------------------


def test_preference(spark):
    side = lambda rows: spark.createDataFrame(rows, "pair_id long, turn long, role string, text string")
    chosen = side([(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "x"), (3, 0, None, None), (None, 0, "user", "n")])
    rejected = side([(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", "why"), (2, 0, "user", "x"), (4, 0, "assistant", "é")])
    got = {r.pair_id: r for r in preference.preferences(chosen, rejected).collect()}
    assert set(got) == {1, 2, 3, 4}
    r = got[1]
    assert r.n_common == 1 and r.prompt == "<|user|>\nq<|end|>\n"
    a, b = map(int, r.chosen_mask.split(":"))
    assert r.chosen == "<|assistant|>\ngood<|end|>\n" and r.chosen[a:b] == "good<|end|>"
    assert r.rejected == "<|assistant|>\nbad<|end|>\n<|user|>\nwhy<|end|>\n" and r.rejected_mask.count(":") == 1
    assert got[2].n_common == 0 and got[2].chosen == got[2].rejected
    assert got[3].prompt == "" and got[3].rejected == "" and got[3].chosen == "<|unknown|>\n<|end|>\n"
    assert got[4].chosen == "" and got[4].rejected_mask == "14:22"


def test_preference_whole_table(spark):
    got = entries.op2_chat_formatting(spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append(f"<|{r.role}|>\n{r.text}<|end|>\n")
    rows = got.collect()
    assert {r.pair_id for r in rows} == set(turns)
    assert all(r.prompt + r.chosen == "".join(turns[r.pair_id]) for r in rows)


# 3 -----------------------------------------------------------------------------------------------------------------


def brute_nearest(vectors, ids, k):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            s = [(-(vectors[j] * vectors[i]).sum(), ids[j]) for j in range(len(ids)) if j != i]
            out[ids[i]] = [(v, -d) for d, v in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("shard", [64, 8192])
def test_nearest_exact_with_factor_one(spark, monkeypatch, shard):
    monkeypatch.setattr(vptree, "SHARD", shard)
    monkeypatch.setattr(vptree, "QUERIES", 8)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) * rng.uniform(0.1, 3, size=(400, 1))
    x[50:200] = x[50]  # many copies, also of queries
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1020, [0.0] * 6, 0), (1040, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (1060, [float("nan")] * 6, 0), (1080, [float("inf")] + [0.0] * 5, 0), (None, [1.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = defaultdict(list)
    for r in vptree.nearest(df, lambda i: i % 20 == 0, k=20, factor=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_nearest(x, list(range(400)), 20)
    assert {q: [v for v, _ in g] for q, g in got.items()} == {q: [v for v, _ in g] for q, g in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize(("sf", "shard"), [("sf0.01", 8192), ("sf0.1", 8192), ("sf0.1", 300)])
def test_nearest_recall(spark, monkeypatch, sf, shard):
    monkeypatch.setattr(vptree, "SHARD", shard)
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), [r.vec_id for r in rows]
    got = defaultdict(set)
    for r in entries.op3_nearest_neighbours(spark, f"/root/testdata/{sf}").collect():
        got[r.query_id].add(r.vec_id)
    recall = []
    for i in np.flatnonzero(np.array(ids) % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        recall.append(len(got[ids[i]] & {ids[j] for j in best}) / len(best))
    assert np.mean(recall) >= 0.9


# 4 -----------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in entries.op4_toxicity(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    right = [got[d].predicted == t for d, t in marks.items() if got[d].held_out]
    assert np.mean(right) > 0.95


def test_toxicity_grammar_scores_clauses():
    s = toxicity.Grammar().scorer()
    score = lambda t: s.score(s.features(t))
    assert score("you are an idiot") > score("he said: what an idiot. fine") > score("a quiet day")
    assert score("you are not an idiot") < score("you are an idiot")
    assert score("i will kill you") > score("kill the process")
    assert score("") == score("   ") == score("nothing here")


def test_toxicity_composition():
    """The product writes what the four transducers write one after the other, on one path, for all strings of up to three symbols and many longer ones."""
    chain = (toxicity.negation(), toxicity.reported(), toxicity.threat(), toxicity.target())
    machine = toxicity.grammar_machine()
    rng = np.random.default_rng(4)
    strings = [list(x) for n in range(4) for x in itertools.product(toxicity.ALPHABET, repeat=n)]
    strings += [rng.choice(toxicity.ALPHABET, int(rng.integers(4, 12))).tolist() for _ in range(1500)]
    for symbols in strings:
        symbols = [*symbols, toxicity.BREAK]
        outs = [symbols]
        for t in chain:
            outs = [o for x in outs for o in t.paths(x)]
        live = machine.paths(symbols)
        assert sorted(map(tuple, live)) == sorted(map(tuple, outs))
        assert len(live) == 2 and live[0] == live[1]  # one path, and the two guesses for a clause to come


def brute_classes(symbols):
    """The grammar's rules, said directly: sums by class over clauses."""
    out = dict.fromkeys(toxicity.CLASSES, 0)
    quoted, clause = False, []
    for s in [*symbols, toxicity.BREAK]:
        if s in (toxicity.END, toxicity.BREAK):
            target = any(x in "go" for x, _ in clause)
            said, negated, verbs, objects = False, -9, [], -9
            for k, (x, q) in enumerate(clause):
                mark = "negated" if k - negated <= toxicity.REACH else "reported" if said or q else ""
                if x == "n":
                    negated = k
                elif x == "s":
                    said = True
                elif x == "i":
                    out[mark or ("targeted" if target else "plain")] += 1
                elif x == "t":
                    if objects >= 0 and k - objects <= toxicity.REACH:
                        out[mark or "threat"] += 1
                        verbs, objects = [], -9
                    else:
                        verbs, objects = [(k, mark)], -9
                elif x in "go":
                    if verbs and k - verbs[-1][0] <= toxicity.REACH:
                        out[verbs[-1][1] or "threat"] += 1
                        verbs, objects = [], -9
                    elif x == "o":
                        objects, verbs = k, []
            clause = []
            quoted = quoted and s == toxicity.END
        else:
            quoted ^= s == toxicity.QUOTE
            clause.append((s, quoted))
    return [out[c] for c in toxicity.CLASSES]


def test_toxicity_rules():
    scorer = toxicity.Grammar().scorer()
    rng = np.random.default_rng(5)
    for _ in range(3000):
        symbols = rng.choice([*toxicity.ALPHABET[:9], "w"], int(rng.integers(1, 14)), p=[0.2, 0.15, 0.1, 0.1, 0.1, 0.05, 0.1, 0.08, 0, 0.12]).tolist()
        got, _ = scorer.clauses([(s, 1.0) for s in [*symbols, toxicity.BREAK]])
        assert got == brute_classes(symbols), symbols


def test_toxicity_speech_and_objects():
    s = toxicity.Grammar().scorer()
    by = lambda t: dict(zip(toxicity.CLASSES, s.features(t), strict=False))
    assert by("You will kill it in the exam!")["threat"] == 0 < by("I will kill you.")["threat"]
    assert by("Ich werde dich töten")["threat"] > 0
    assert by("I won't kill you")["negated"] > 0 == by("I won't kill you")["threat"]
    assert by('A "you idiot. What a moron" it was.')["plain"] == 0 < by('A "b. c" it was, idiot.')["plain"]


def test_toxicity_learns_every_term(spark):
    """More terms than any bound on their number: all of them are weighed."""
    stems = [a + b + c + d for a, b, c, d in itertools.product("bcdfghjk", "aeiou", "lmnprst", "aeiou")][:300]
    rows = [(k, " ".join(f"{before} {x}" for x in stems[(k % 3) * 100 : (k % 3) * 100 + 100]) if k % 2 else f"{before} plain words", k % 2) for k, before in enumerate("ab cd ef gh ij kl mn op qr st uv wx yz".split() * 10)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    grammar = toxicity.learn(docs, spark.createDataFrame([(i, 0, t) for i, _, t in rows], "doc_id long, quality int, toxic int"))
    assert all(x in grammar.terms for x in stems)


def test_toxicity_edges(spark):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    g = toxicity.learn(docs, labels)
    got = toxicity.score(docs, g).collect()
    assert len(got) == len(ODD) and all(0 <= r.toxicity <= 1 for r in got)


# 5 -----------------------------------------------------------------------------------------------------------------


def brute_ctw(train, texts, depth):
    """Log10 probabilities by the definition: a recursion over (context, bit prefix)."""
    low = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
    n = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def steps(t):
        s = bytes([255]) * depth + low(t) + bytes([255])
        for i in range(depth, len(s)):
            p = 1
            for j in range(7, -1, -1):
                bit = s[i] >> j & 1
                yield [s[i - d : i] for d in range(depth + 1)], p, bit
                p = p << 1 | bit

    for t in train:
        for ctx, p, bit in steps(t):
            for d, c in enumerate(ctx):
                n[c, p][bit] += 1
                if d:
                    kids[ctx[d - 1], p].add(c)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    memo = {}

    def weighted(c, p):
        if (c, p) not in memo:
            own = kt(*n[c, p])
            if len(c) == depth:
                memo[c, p] = own, 1.0
            else:
                below = sum(weighted(k, p)[0] for k in kids[c, p])
                w = np.logaddexp(own, below) - math.log(2)
                memo[c, p] = w, math.exp(own - math.log(2) - w)
        return memo[c, p]

    out = []
    for t in texts:
        total = 0.0
        for ctx, p, bit in steps(t):
            prob = None
            for c in reversed(ctx):
                a, b = n.get((c, p), (0, 0))
                own = weighted(c, p)[1] if (c, p) in n else 0.5
                here = (b + 0.5) / (a + b + 1)
                prob = here if prob is None else own * here + (1 - own) * prob
            total += math.log10(prob if bit else 1 - prob)
        out.append(total)
    return out


def test_context_tree(spark, documents):
    texts = [r.text[:200] for r in documents.orderBy("doc_id").limit(24).collect()] + [t for t in ODD if len(t or "") < 100]
    docs = docs_of(spark, texts)
    is_train = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(len(texts))]
    for limits in ({}, {"top_words": 5, "top_grams": 5}, {"least": 1}):
        got = sorted(context_tree.score(docs, depth=3, **limits).collect(), key=lambda r: r.doc_id)
        want = brute_ctw([t for t, y in zip(texts, is_train, strict=True) if y], texts, 3)
        assert np.allclose([r.score for r in got], want, rtol=1e-9)
        split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER)) + [None]
        c = Counter(w for t, y in zip(texts, is_train, strict=True) if y for w in split(t))
        total, v = sum(c.values()), len(c)
        for r, t, y in zip(got, texts, is_train, strict=True):
            w = split(t)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not y, len(w), sum(c[x] > 0 for x in w), total)
            assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (v + 1))) for x in w))


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_context_tree_of_other_depths(spark, depth):
    texts = ["abcabcabd abc", "ABCABCABE", "水 abc\0abc", "", None, "zzzzzzzzzzzz", "abcabcabd abc abd"]
    want = brute_ctw([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10], texts, depth)
    got = sorted(context_tree.score(docs_of(spark, texts), depth=depth, least=3).collect(), key=lambda r: r.doc_id)
    assert np.allclose([r.score for r in got], want, rtol=1e-9)


def test_context_tree_beats_base(spark):
    got = entries.op5_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# 6 -----------------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    texts = [
        licenses.MIT.upper().replace("\n", "  "),
        "MIT Licence\n\nCopyright (c) 2020 Somebody\n\n" + licenses.MIT,
        "prose\nLicenced under the apache LICENSE - version 2.0\nmore",
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0",
        "near: Licensed under CC BY-NC 4.0 only",
        None,
        "",
        "...",
    ]
    got = {r.doc_id: (r.whole_license, r.n_notices, r.licenses) for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert got[0] == ("MIT", 1, "MIT") and got[1][0] == "MIT"
    assert got[2] == (None, 1, "Apache-2.0") and got[3] == (None, 2, "CC-BY-NC-4.0")
    assert got[4] == got[5] == got[6] == got[7] == (None, 0, "")


INSTALLED = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1"}
INSTALLED |= {"LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "Artistic": "Artistic-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3"}


def test_whole_licenses(spark):
    folder = Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence texts installed")
    texts, want = [], []
    for file, name in INSTALLED.items():
        text = (folder / file).read_text()
        texts += [text, text.replace("\n", "\r\n").upper(), text + "\nand more"]
        want += [name, name, None]
    apache = (folder / "Apache-2.0").read_text()
    texts.append(apache[: apache.index("APPENDIX")])
    want.append("Apache-2.0")
    bsd = (folder / "BSD").read_text().replace("the University nor", "the copyright holder nor").replace("THE REGENTS AND", "THE COPYRIGHT HOLDERS AND").replace("THE REGENTS OR", "THE COPYRIGHT HOLDER OR")
    a, b = bsd.index("3. Neither"), bsd.index("THIS SOFTWARE")
    texts += [bsd, "BSD 3-Clause License\n\n" + bsd, bsd[:a] + bsd[b:], "BSD 2-Clause License\n\n" + (bsd[:a] + bsd[b:]).replace("1. ", "* ").replace("2. ", "* ")]
    want += ["BSD-3-Clause", "BSD-3-Clause", "BSD-2-Clause", "BSD-2-Clause"]
    got = {r.doc_id: r.whole_license for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


# 7 -----------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(entries.tokenizer_path())
    texts = [r.text for r in documents.select("text").collect()] + ODD
    texts += ["it's we'll I'D ½ x² ǅ İstanbul ΑΣ ﬁ <|endoftext|> a\x85b\xa0c\x1cd", "ſ K Å é é", "'" * 50 + "ŉ ĳ Ĳ"]
    rows = packing.pack(docs_of(spark, texts), entries.tokenizer_path(), per_task=40).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in mine] == [(k, a, min(2048, len(ids) - a)) for k, a in enumerate(range(0, len(ids), 2048))]
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    least = math.ceil(sum(r.length for r in rows) / 2048)
    assert len(by_seq) <= least * 1.1 + 1


def test_packing_of_pieces_that_do_not_fit_together(spark, monkeypatch):
    tasks, made = [], packing._round

    def spy(bins, number, capacity, slack, last):
        tasks.append((bins.count(), bins.rdd.getNumPartitions()))
        return made(bins, number, capacity, slack, last)

    monkeypatch.setattr(packing, "_round", spy)
    texts = ["a " * (1100 + 10 * k) for k in range(60)]
    rows = packing.pack(docs_of(spark, texts), entries.tokenizer_path(), per_task=5).collect()
    assert all(1024 < r.length < 2040 for r in rows)
    assert sorted(r.doc_id for r in rows) == list(range(60)) and len({r.sequence_id for r in rows}) == 60
    assert all(n <= 5 * parts for n, parts in tasks)
    rows = packing.pack(docs_of(spark, [*texts, *["b " * 300] * 60]), entries.tokenizer_path(), per_task=5).collect()
    assert sorted(r.doc_id for r in rows) == list(range(120)) and len({r.sequence_id for r in rows}) < 110
    assert all(n <= 5 * parts for n, parts in tasks)


def test_best_fit():
    bins = packing.best_fit(np.array([5, 5, 6, 4, 10, 1]), 10)
    assert sorted(map(sorted, bins)) == [[0, 1], [2, 3], [4], [5]]


def test_packing_empty(spark):
    assert packing.pack(docs_of(spark, []), entries.tokenizer_path()).count() == 0


# 8 -----------------------------------------------------------------------------------------------------------------


def brute_hits(texts, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    for t in texts:
        w = words(t)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        yield len(w), len(hit), sorted(map(str, found))


def test_decontamination(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "Tiny item"), (901, None), (902, "  "), (10, "one two three four five six seven eight nine ten"), (7, "a b a b a b a b a b a b")]
    texts = [r.text for r in documents.select("text").collect()] + ODD
    texts += ["TINY, item! tiny item", "x one two three four five six seven eight nine ten y", "a b " * 9, "é one two three"]
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute_hits(texts, items)):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == want
    none = decontaminate.decontaminate(docs_of(spark, texts[:3]), spark.createDataFrame([], "item_id long, text string")).collect()
    assert [r.n_hit for r in none] == [0, 0, 0]


@pytest.mark.parametrize("slots", [[], [0], [0, 7, 8, 32767, 32768, 32769, 2**24 - 1, 7]])
def test_bitmap(spark, slots):
    rows = spark.createDataFrame([(s,) for s in [*slots, None]], "s int")
    assert np.flatnonzero(Bitmap.of(rows, F.col("s")).flags()).tolist() == sorted(set(slots))


# 9 -----------------------------------------------------------------------------------------------------------------


def test_main_text_of_labelled_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import html as entities

    for r in entries.op9_main_text(spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"</?b>", "", b))).strip() for b in re.split(r"</?(?:h1|p)>", article.replace("<br>", " "))]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_main_text_without_landmarks():
    weights = main_text.fit([])
    body = "<p>" + "word " * 60 + "</p><div class='ad'>buy now</div><p>" + "more text here " * 20 + "</p>"
    page = f"<html><head><title>t</title></head><body><ul><li><a href=x>Home</a></li><li><a>News</a></li></ul><header>Site</header>{body}<div id=comments><p>{'nice ' * 50}</p></div><footer>c</footer></body></html>"
    assert main_text.text_of(page, weights) == ("word " * 60).strip() + "\n" + ("more text here " * 20).strip()
    assert main_text.text_of("", weights) == main_text.text_of("<p></p>", weights) == ""
    assert main_text.text_of("plain &amp; simple", weights) == "plain & simple"
    assert main_text.text_of("<p>cut <script>var x='<p>'", weights) == "cut"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="content no-sidebar"><p>Some text.</p></div>', "Some text."),
        ('<div class="post has-comments share"><p>Some text.</p></div>', "Some text."),
        ("<form action=x><h1>T</h1><p>one two three</p><input></form>", "T\none two three"),
        ("<div><aside>note</div><p>one two three four</p>", "one two three four"),
        ("<main><h1>Title</h1><article><p>a b c</p></article></main>", "Title\na b c"),
        ("<article><p>a b</p></article><div class=ad>buy</div><article><p>c d e</p></article>", "a b\nc d e"),
        ("<p>one two three</p><table><tr><td>1<td>2<tr><td>3<td>4</table><p>last words</p>", "one two three\n1\n2\n3\n4\nlast words"),
        ("<p data-x=it's>text of it's</p><p>more</p>", "text of it's\nmore"),
        ('<p>a <span class="ad">no</span>b <a title="x > y">c</a></p>', "a b c"),
        ("<article><p>a b</p><section id=comments><article class=comment>me too</article></section></article><p>x</p>", "a b"),
        ("<nav><a>Home</a></nav>", ""),
        ("<body><nav>" + "menu " * 9 + "</nav><form><article>" + "word " * 70 + "</article></form>", ("word " * 70).strip()),
    ],
)
def test_main_text_keeps_content(page, text):
    assert main_text.text_of(page, main_text.fit([])) == text


def test_main_text_by_weights_alone(spark):
    """With the naming tags taken out of the pages the run that the weights find is the text that the tags name."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    weights = main_text.fit(pages)
    same = [main_text.text_of(re.sub("</?article>", "", h), weights) == main_text.text_of(h, weights) for h in pages]
    assert np.mean(same) > 0.98


def test_best_run():
    rng = np.random.default_rng(9)
    for n in (*range(9), 30):
        for _ in range(40):
            scores = rng.integers(-3, 4, n).tolist()
            a, b = main_text.best_run(scores)
            assert sum(scores[a:b]) == max([0, *(sum(scores[i:j]) for i in range(n) for j in range(i + 1, n + 1))])


@pytest.mark.parametrize("unit", ['<a href="x', "<a b='", '<a href="x>', "<ul><b>", "<p class=ad>", "<b><li>", "<!--", "<", "&amp;"])
def test_main_text_of_broken_pages_is_linear(unit):
    weights = main_text.fit([])
    took = []
    for k in (10_000, 80_000):
        began = time.process_time()
        main_text.text_of(unit * k + '>"', weights)
        took.append(time.process_time() - began)
    assert took[1] < 25 * took[0] + 0.2


# 10 ----------------------------------------------------------------------------------------------------------------


def brute_links(texts):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4) if w else 0)) for w in map(words, texts)]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    shared = Counter((a, b) for v in at.values() for k, b in enumerate(v) for a in v[:k])
    links, up = [0] * len(sets), list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in shared.items():
        if n * 10 >= 8 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return [(find(i), n) for i, n in enumerate(links)]


@pytest.mark.parametrize("block", [2048, 8])
def test_ngram_join(spark, documents, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = [r.text for r in documents.orderBy("doc_id").collect()] + ODD
    base = words(texts[0])[:150]
    for k in range(30):  # a group of near copies, each its own text
        texts.append(" ".join([*base[: 4 * k], f"new{k}", *base[4 * k + 1 :]]))
    texts += [texts[-1], texts[-1].upper()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(brute_links(texts)))


def test_ngram_buckets_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    sizes, linked = [], ngram_join._linked
    monkeypatch.setattr(ngram_join, "_linked", lambda rows, *a: sizes.extend(r["count"] for r in rows.groupBy("band").count().collect()) or linked(rows, *a))
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join([*base[: 3 * k], f"new{k}", *base[3 * k + 1 :]]) for k in range(40)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(brute_links(texts)))
    assert max(sizes, default=0) <= 8


def test_ngram_large_buckets_without_a_leader(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = np.random.default_rng(1)
    least = ngram_join.least_matches(0.8, 1e-6)
    sigs = [rng.integers(0, 256, ngram_join.HASHES).astype(np.uint8) for _ in range(12)]
    for k in range(5):  # chains of neighbours, whose ends do not survive with each other
        at = sigs[k]
        for _ in range(9):
            at = np.where(rng.random(ngram_join.HASHES) < 0.2, rng.integers(0, 256, ngram_join.HASHES), at).astype(np.uint8)
            sigs.append(at)
    order = rng.permutation(len(sigs))
    fps = [bytes([int(k)]) * 16 for k in order]
    rows = [(band, fps[k], sigs[k].tobytes(), len(sigs)) for band in (7, -7) for k in range(len(sigs))]
    buckets = spark.createDataFrame([(b, bytearray(f), bytearray(s), n) for b, f, s, n in rows], "band long, fp binary, sig binary, n long")
    pairs = {(fps[i], fps[k]) for i in range(len(sigs)) for k in range(i) if ngram_join.survivors(sigs[i][None], sigs[k][None], least)[0]}
    got = {(bytes(r.a), bytes(r.b)) for r in ngram_join._linked_large(buckets, 0.8, 1e-6).collect()}
    assert got <= pairs | {(b, a) for a, b in pairs}

    def classes(links):
        f = ngram_join.Forest(len(fps))
        for a, b in links:
            f.join(fps.index(a), fps.index(b))
        return f.roots().tolist()

    assert classes(got) == classes(pairs) and 2 < len(set(classes(pairs))) < len(fps) - 20


def test_bayesian_pruning():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert list(least) == [32, 64, 96, 128, 160] and all(0 < least[n] < 0.8 * n for n in least)
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 256, (200, ngram_join.HASHES)).astype(np.uint8)
    near = np.where(rng.random(sig.shape) < 0.8, sig, sig ^ 1)
    assert ngram_join.survivors(sig, near, least).all()
    assert not ngram_join.survivors(sig, sig[::-1], least).any()


def test_ngram_join_empty(spark):
    assert ngram_join.similar(docs_of(spark, [])).count() == 0
    assert sorted(tuple(r) for r in ngram_join.similar(docs_of(spark, [None, "", "a"])).select("doc_id", "class_id", "n_links").collect()) == [(0, 0, 0), (1, 1, 0), (2, 2, 0)]


def test_digest_of_nothing(spark):
    got = entries.op8_decontamination(spark, SF).where("n_items = 0").first()
    assert got.items_sha256 == hashlib.sha256(b"").hexdigest()
