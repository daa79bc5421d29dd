"""Token counts, fill-in-the-middle and tokenizer alignment against the libraries and brute force, on the smallest tables and on odd texts."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import alignment, entries, fill_middle, token_transducer

SF = "/root/testdata/sf0.001"
A, B = entries.public_path("byte_bpe_50k.json"), entries.public_path("piece_bpe_32k.model")
BITS = ["'", "s", "re", "ll", "'ve", "DON'T", " ", "  ", "\n", "\r\n", "\t", "　", "\xa0", "\x85", "\x1c", "\x00", "a", "Z", "1", "٣", "½", "é", "é", "山", "🌊", "ﬁ", "▁", "<", "|", "<|endo", "<|endoftext|>", "</s>", "<unk>", "...", "=====", "aaaaaaaa", "hello world "]
RNG = random.Random(7)
ODD = [None, "", " ", "\n", "a" * 3000, " " * 500, "ab" * 5000, "山" * 2000, "word " * 30_000, *("".join(RNG.choices(BITS, k=RNG.randrange(1, 40))) for _ in range(300))]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("n_tokens", F.lit("x"))


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ODD


@pytest.fixture(scope="module")
def machine():
    return token_transducer.Transducer(A)


def library_counts(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_token_counts(spark, texts):
    """Short texts whole, and every text above 50 bytes in chunks of 50, as the library counts them."""
    want = library_counts(texts)
    for chunk in (token_transducer.CHUNK, 50):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_transducer.counts(docs_of(spark, texts[-40:] if chunk == 50 else texts), A, chunk).collect()}
        shift = len(texts) - 40 if chunk == 50 else 0
        assert {i + shift: v for i, v in got.items()} == {i: (len((t or "").encode()), want[i]) for i, t in enumerate(texts) if i >= shift}


def test_chunk_maps_compose(machine):
    """Maps of chunks of any size, cut inside characters too, give the count by a scan, and compose associatively."""
    for text, n in zip(ODD[9:], library_counts(ODD[9:]), strict=True):
        raw, size = text.encode(), RNG.randrange(1, 9)
        maps = [machine.map(raw[i : i + size]) for i in range(0, len(raw), size)]
        for x, y, z in zip(maps, maps[1:], maps[2:], strict=False):
            assert machine.compose(machine.compose(x, y), z) == machine.compose(x, machine.compose(y, z))
        last = token_transducer.scan(machine, [machine.compose(machine.identity(), maps[0]), *maps[1:]])[-1]
        assert last[1] + machine.end(last[2]) == n, text


def test_tokens_before_chunks(spark):
    text = "Some words, and 12 numbers; don't they're.\n" * 40
    rows = docs_of(spark, [text]).select(F.lit(5).cast("long").alias("row"), "doc_id", "text")
    got = sorted((r.at, r.n_bytes, r.tokens_before, r.n_tokens) for r in token_transducer.chunk_counts(rows, A, 100).collect())
    assert [g[0] for g in got] == list(range(0, len(text), 100)) and sum(g[1] for g in got) == len(text)
    assert [g[2] for g in got[1:]] == list(np.cumsum([g[3] for g in got])[:-1]) and sum(g[3] for g in got) == library_counts([text])[0]


def test_machine_is_compiled_anew(machine, monkeypatch):
    monkeypatch.setattr(token_transducer, "LIMIT", 50)
    assert [machine.count((t or "").encode()) for t in ODD[9:80]] == library_counts(ODD[9:80])


def test_unknown_tokenizers_are_refused():
    with pytest.raises(token_transducer.Unsupported):
        token_transducer.Transducer(entries.public_path("word_bpe_49k.json"))


# 12 ----------------------------------------------------------------------------------------------------------------


def test_elias_fano():
    for _ in range(200):
        values = np.sort(np.array(RNG.choices(range(RNG.choice([1, 10, 10_000, 10**9])), k=RNG.randrange(1, 60))))
        packed = fill_middle.EliasFano.of(values)
        assert [packed.select(i) for i in range(len(values))] == values.tolist()


def cut_by_hand(doc_id, text):
    units = [u for u in text.splitlines(keepends=True)] if "\n" in text and not set(text) & set("\r\x0b\x0c\x1c\x1d\x1e\x85  ") else None
    if units is None:
        units = [p + "\n" for p in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] else [])
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(spark, texts):
    more = ["a <P> inside", "x\n<M>", "one line", "é\n山\n\n🌊 last", *["the same\ntext\nof\nmany\n"] * 400]
    all_texts = texts + more
    made = fill_middle.transform(docs_of(spark, all_texts), hot=16)  # the repeated text is hot
    rows = made.withColumn("restored", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(all_texts)
    for r in rows:
        text = all_texts[r.doc_id] or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut_by_hand(r.doc_id, text)
        assert r.restored == text
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_texts_that_share_a_digest_stop_the_job(spark):
    with pytest.raises(Exception, match="share the digest"):
        fill_middle.transform(docs_of(spark, ["aa", "bb"]), digest=lambda t: F.length(t).cast("string").cast("binary")).collect()


# 13 ----------------------------------------------------------------------------------------------------------------


def aligned_by_hand(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text by the libraries and nested loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    spelled = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in spelled} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in spelled)}
    assert len(json.loads(t.to_str())["model"]["vocab"]) == 50256
    docs, held = [], Counter()
    for text in texts:
        a, b, groups, links = [], [], [], Counter()
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
            raw_a = [bytes(byte_of[c] for c in t.id_to_token(i)) for i in a]
            raw_b = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                end_a, end_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
                i = j = 0
                for e in sorted(set(end_a.tolist()) & set(end_b.tolist())):
                    k, m = int(np.searchsorted(end_a, e)) + 1, int(np.searchsorted(end_b, e)) + 1
                    groups.append((a[i:k], b[j:m]))
                    links.update((x, y) for x in a[i:k] for y in b[j:m])
                    i, j = k, m
            else:
                a = b = []
        held.update(links.keys())
        docs.append((a, b, groups, links))
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in links.items() if held[p] == highest[p[0]])
        out.append((len(a), len(b), len(groups), sum(links.values()), best, sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def test_alignment(spark, texts):
    """In one slice with all pairs looked up, and in slices of 900 tokens with 50 pairs looked up and the others joined."""
    want = aligned_by_hand(texts)
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    for top, size in ((alignment.TOP, alignment.SLICE), (50, 900), (0, alignment.SLICE)):
        aligned = alignment.durable(alignment.align(docs_of(spark, texts), A, B, size))
        rows = alignment.scores(aligned, alignment.pair_counts(aligned), top).collect()
        assert len(rows) == len(texts)
        assert {r.doc_id: tuple(r[c] for c in columns) for r in rows} == dict(enumerate(want))


def test_odd_rows(spark):
    """Null ids and texts, rows that repeat, and no rows, through all three."""
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None), (2, "")], "doc_id long, text string")
    none = df.where("false")
    assert [r.n_tokens for r in sorted(token_transducer.counts(df, A).collect(), key=lambda r: (r.doc_id or 9, -r.n_tokens))] == [2, 2, 0, 2, 0]
    assert sorted((r.doc_id or 0, r.form) for r in fill_middle.transform(df).collect())[0] == (0, "plain") and fill_middle.transform(df).count() == 5
    assert sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in alignment.alignment(df, A, B).collect()) == [(0, 0, 0), (0, 2, 6), (1, 2, 6), (1, 2, 6), (2, 0, 0)]
    assert token_transducer.counts(none, A).count() == fill_middle.transform(none).count() == alignment.alignment(none, A, B).count() == 0
