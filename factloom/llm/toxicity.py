"""Toxicity by a weighted finite-state pattern grammar.

A text is a string over a small alphabet: what a lexicon takes each word for, quotation marks and ends. Four transducers are
composed over it, each reading what the one before wrote: negation marks the insults and threats in its reach, reported speech those
after a reporting verb or between quotation marks, threat joins a threatening verb to its object, and target, which guesses a
clause's kind and is held to it at the clause's end, tells insults beside a target from plain ones. The arcs of the composition bear
classes, the insults' weights are summed by class, and the score is a logistic function of the classes' sums and of the
heaviest clause: matched clauses count, not isolated words.

The lexicon's insults are learned from labelled training rows: words, and stems of four to six letters with any ending, that
toxic texts hold far more often than clean ones and in several contexts (copies of one text are one context). The weights of
the classes are fitted to a bounded sample of labelled rows.

Null and empty texts have no clause and get the score of that; a text of any length is scored whole; a row is scored by its own text
alone, so equal texts score equally; without labels the fixed lists and weights hold; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.durable import durable
from factloom.llm.kernels import Bitmap

#: Labelled rows that are learned from, picked by hash of the id.
SAMPLE = 50_000
#: Share of the toxic texts that must hold a term. The learned terms are at most 1 / SHARE times the distinct terms of a toxic text of mean length.
SHARE, RATIO = 0.01, 3.0
STEMS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
PART = re.compile(r"[^\W\d_]+(?:'t\b)?|[.!?;]+|[\"“”„«»]")
#: Small word lists of the grammar, in four languages.
INSULTS = "idiot idiots moron morons imbecile scum loser losers trash worthless pathetic stupid disgusting clown bastard dumbass abschaum trottel dummkopf salaud connard imbécile estúpido imbécil basura".split()
THREATS = "kill hurt destroy beat stab shoot burn strangle töten umbringen verprügeln tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your u they them he she him her his their du ihr sie tu toi vous il elle ils elles usted ustedes él ella ellos".split()
OBJECTS = "dich dir euch ihn ihm te".split()
NEGATIONS = "not no never nobody none neither isn't aren't don't won't didn't doesn't wasn't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say called calls wrote claimed reported quoted told sagte sagt nannte schrieb dit disait écrit appelé dijo dice llamó escribió".split()
CLASSES = ("plain", "targeted", "negated", "reported", "threat")
REACH = 3

#: The alphabet: an insult, a threatening verb, a target, an object that may stand before its verb, a negation, a reporting verb,
#: a quotation mark, a clause's end, a paragraph's end, any other word.
INSULT, THREAT, TARGET, OBJECT, NOT, SAID, QUOTE, END, BREAK, OTHER = "i t g o n s q . / w".split()
ALPHABET = (INSULT, THREAT, TARGET, OBJECT, NOT, SAID, QUOTE, END, BREAK, OTHER)


@dataclass
class Transducer:
    """``arcs``: state -> symbol read -> (symbol written, next state) of each arc. Every state may end a string."""

    start: tuple
    arcs: dict[object, dict[str, list[tuple[str, object]]]]

    def paths(self, symbols: list[str]) -> list[list[str]]:
        """What every path over ``symbols`` writes."""
        live = [([], q) for q in self.start]
        for s in symbols:
            live = [([*out, o], q2) for out, q in live for o, q2 in self.arcs[q].get(s, ())]
        return [out for out, _ in live]


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that writes what ``b`` does of what ``a`` writes: the product's states that can be reached."""
    start = tuple((p, q) for p in a.start for q in b.start)
    arcs: dict = {}
    todo = list(start)
    while todo:
        p, q = at = todo.pop()
        if at in arcs:
            continue
        arcs[at] = {s: [(o2, (p2, q2)) for o, p2 in outs for o2, q2 in b.arcs[q].get(o, ())] for s, outs in a.arcs[p].items()}
        todo += [to for outs in arcs[at].values() for _, to in outs]
    return Transducer(start, arcs)


def negation() -> Transducer:
    """Insults and threats within REACH words after a negation are written with "-"."""
    arcs = {}
    for left in range(REACH + 1):
        arcs[left] = {s: [(s + "-" if left and s in (INSULT, THREAT) else s, 0 if s in (END, BREAK) else REACH if s == NOT else max(0, left - 1))] for s in ALPHABET}
    return Transducer((0,), arcs)


def reported() -> Transducer:
    """Insults and threats after a reporting verb of the clause, or between quotation marks of the paragraph, are written with "~"."""
    arcs = {}
    for said in (0, 1):
        for quoted in (0, 1):
            row = arcs[said, quoted] = {}
            for s in (*ALPHABET, INSULT + "-", THREAT + "-"):
                to = {END: (0, quoted), BREAK: (0, 0), SAID: (1, quoted), QUOTE: (said, 1 - quoted)}.get(s, (said, quoted))
                row[s] = [(s + "~" if (said or quoted) and s in (INSULT, THREAT) else s, to)]
    return Transducer(((0, 0),), arcs)


MARKS = ("", "-", "~")


def threat() -> Transducer:
    """A threatening verb and its object, at most REACH words behind it, or before it where the object has a form of its own, are written as
    "T" (with the verb's mark) at the later of the two; other verbs as words."""
    arcs = {}
    states = [None, *((m, k) for m in (*MARKS, OBJECT) for k in range(1, REACH + 1))]
    verbs = {THREAT + m: m for m in MARKS}
    for state in states:
        mark, left = state or (None, 0)
        aged = (mark, left - 1) if left > 1 else None
        row = arcs[state] = {s: [(s, None if s in (END, BREAK) else aged)] for s in (*ALPHABET, INSULT + "-", INSULT + "~")}
        for s, m in verbs.items():
            row[s] = [("T" + m, None)] if mark == OBJECT else [(OTHER, (m, REACH))]
        for s in (TARGET, OBJECT):
            if mark in MARKS:
                row[s] = [("T" + mark, None)]
            elif s == OBJECT:
                row[s] = [(s, (OBJECT, REACH))]
    return Transducer((None,), arcs)


def target() -> Transducer:
    """Classes, and "." at a clause's end. A clause is guessed to have no target ("no"), or one that is to come ("due") or has come ("met"); a
    wrong guess has no arc for the symbol that shows it to be wrong, so that one path of each string is left."""
    of = {INSULT + "-": "negated", INSULT + "~": "reported", "T": "threat", "T-": "negated", "T~": "reported"}
    arcs: dict = {q: {} for q in ("no", "due", "met")}
    for s in (*ALPHABET, *of):
        for q, row in arcs.items():
            if s in (END, BREAK):
                row[s] = [] if q == "due" else [(".", "no"), (".", "due")]
            elif s in (TARGET, OBJECT) or s[0] == "T":
                row[s] = [] if q == "no" else [(of.get(s, ""), "met")]
            elif s == INSULT:
                row[s] = [("plain" if q == "no" else "targeted", q)]
            else:
                row[s] = [(of.get(s, ""), q)]
    return Transducer(("no", "due"), arcs)


@cache
def grammar_machine() -> Transducer:
    return reduce(compose, (negation(), reported(), threat(), target()))


@cache
def _table() -> tuple[tuple[int, ...], list[dict[str, list[tuple[int, int]]]]]:
    """The composed machine with numbered states and classes: -1 writes nothing, -2 ends a clause."""
    m = grammar_machine()
    number = {q: k for k, q in enumerate(m.arcs)}
    code = {"": -1, ".": -2} | {c: k for k, c in enumerate(CLASSES)}
    return tuple(number[q] for q in m.start), [{s: [(code[o], number[q]) for o, q in outs] for s, outs in row.items()} for row in m.arcs.values()]


@dataclass
class Grammar:
    terms: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 6.0))
    weights: list[float] = field(default_factory=lambda: [-3.0, 2.0, 2.5, 0.5, 0.5, 2.5, 1.0])

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """The lexicon in front of the composed transducers."""

    def __init__(self, grammar: Grammar) -> None:
        terms = grammar.terms
        self.weights = np.array(grammar.weights)

        class Insults(dict):
            """word -> weight of the heaviest path: the whole word, or a stem and any ending."""

            def __missing__(cache, word: str) -> float:  # noqa: N805
                if len(cache) > 500_000:
                    cache.clear()
                w = max(terms.get(word, 0.0), *(terms.get(word[:k] + "*", 0.0) for k in STEMS if len(word) >= k)) if len(word) >= STEMS[0] else terms.get(word, 0.0)
                cache[word] = w
                return w

        self.insults = Insults()
        self.threats = frozenset(THREATS)
        self.symbols = {w: s for s, words in ((THREAT, THREATS), (OBJECT, OBJECTS), (TARGET, TARGETS), (SAID, REPORTS), (NOT, NEGATIONS)) for w in words}
        self.symbols |= dict.fromkeys('"“”„«»', QUOTE)
        self.start, self.arcs = _table()

    def features(self, text: str) -> list[float]:
        """log(1 + sum) of each class's weights over the text's clauses, and the heaviest clause's."""
        sums, heaviest = [0.0] * len(CLASSES), 0.0
        low = text.lower()
        words = WORD.findall(low)
        if any(map(self.insults.__getitem__, words)) or not self.threats.isdisjoint(words):
            for part in low.split("\n"):  # no state outlasts a paragraph
                words = WORD.findall(part)
                if any(map(self.insults.__getitem__, words)) or not self.threats.isdisjoint(words):
                    got, most = self.clauses(self.read(part))
                    sums = [a + b for a, b in zip(sums, got, strict=True)]
                    heaviest = max(heaviest, most)
        return [math.log1p(x) for x in sums] + [math.log1p(heaviest)]

    def read(self, part: str) -> list[tuple[str, float]]:
        """The symbols of a paragraph and their weights."""
        out = []
        for t in PART.findall(part.replace("’", "'")):
            w = self.insults[t]
            out.append((INSULT, w) if w else (END, 0.0) if t[0] in ".!?;" else (self.symbols.get(t, OTHER), 1.0))
        return [*out, (BREAK, 0.0)]

    def clauses(self, symbols: list[tuple[str, float]]) -> tuple[list[float], float]:
        """Weights by class of the one path that is left, and its heaviest clause."""
        live = [(q, (0.0,) * len(CLASSES), 0.0, 0.0) for q in self.start]
        for s, w in symbols:
            new = []
            for q, sums, clause, most in live:
                for c, to in self.arcs[q][s]:
                    if c >= 0:
                        new.append((to, (*sums[:c], sums[c] + w, *sums[c + 1 :]), clause + w, most))
                    elif c == -2:
                        new.append((to, sums, 0.0, max(most, clause)))
                    else:
                        new.append((to, sums, clause, most))
            live = new
        return list(live[0][1]), live[0][3]

    def score(self, features: list[float]) -> float:
        z = float(self.weights[0] + self.weights[1:] @ np.array(features))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; a null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def _terms(words: list[str]) -> Iterator[tuple[str, str]]:
    before = ""
    for w in words:
        yield w, before
        for k in STEMS:
            if len(w) >= k:
                yield w[:k] + "*", before
        before = w


def _toxic_terms(texts: DataFrame) -> DataFrame:
    """(term, n, contexts): texts that hold the term, and a bitmap of hashes of the words before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            ctx = np.array([x[1] for x in seen.values()], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array(ctx)], ["term", "n", "contexts"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                own: dict[str, int] = {}
                for term, before in _terms(WORD.findall((text or "").lower())):
                    own[term] = own.get(term, 0) | 1 << zlib.crc32(before.encode()) % 64
                for term, bits in own.items():
                    x = seen.setdefault(term, [0, 0])
                    x[0] += 1
                    x[1] |= bits
                if len(seen) > 500_000:
                    yield out()
                    seen.clear()
        yield out()

    parts = texts.mapInArrow(run, "term string, n long, contexts long")
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("contexts")).alias("contexts"))


def _slot(term: str) -> int:
    return zlib.crc32(term.encode()) >> (32 - Bitmap.BITS)


def _clean_counts(texts: DataFrame, wanted: Bitmap) -> DataFrame:
    """(term, clean): texts that hold the term, of the terms whose slot is in the bitmap."""
    held = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = held.value.flags()
        words_of: dict[str, tuple[str, ...]] = {}
        seen: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                own: set[str] = set()
                for w in set(WORD.findall((text or "").lower())):
                    got = words_of.get(w)
                    if got is None:
                        if len(words_of) > 500_000:
                            words_of.clear()
                        got = words_of[w] = tuple(t for t, _ in _terms([w]) if flags[_slot(t)])
                    if got:
                        own.update(got)
                for t in own:
                    seen[t] = seen.get(t, 0) + 1
                if len(seen) > 500_000:
                    yield out()
                    seen.clear()
        yield out()

    return texts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("clean"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Bias and weights by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w * (np.arange(len(w)) > 0)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> Grammar:
    """The grammar from at most ``sample`` labelled rows outside the held-out fold."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"), folds))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = marks.count()
    if n > sample:  # by a threshold on the id's hash; a margin of 2 % keeps it below the bound, which holds in any case
        marks = marks.where(F.xxhash64("doc_id") < int(2**64 * 0.98 * sample / n) - 2**63).limit(sample)
    marks = durable(marks)  # at most ``sample`` pairs of an id and a mark: texts stay where they are
    train = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    grammar = Grammar()
    count = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = count.get(1, 0), count.get(0, 0)
    if not toxic or not clean:
        return grammar
    least = max(5, math.ceil(toxic * SHARE))
    found = durable(_toxic_terms(train.where("toxic = 1").select("text")).where((F.col("n") >= least) & (F.col("contexts") >= 4)))
    slot = F.shiftright(F.crc32(F.encode("term", "UTF-8")), 32 - Bitmap.BITS)
    other = _clean_counts(train.where("toxic = 0").select("text"), Bitmap.of(found, slot))
    ratio = F.log((F.col("n") + 0.5) / (toxic + 1)) - F.log((F.coalesce("clean", F.lit(0)) + 0.5) / (clean + 1))
    for r in found.join(other, "term", "left").select("term", ratio.alias("w")).where(F.col("w") >= RATIO).collect():
        grammar.terms[r["term"]] = r["w"]
    scorer = docs.sparkSession.sparkContext.broadcast(grammar)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer.value.scorer()
        for batch in batches:
            x = [s.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64())), batch.column("toxic").cast(pa.int32())], ["doc_id", "x", "y"])

    # of rows of one id one, so that the sample's bound is that of the rows sent
    rows = train.select(F.col("doc_id").cast("long"), "text", "toxic").mapInArrow(features, "doc_id long, x array<double>, y int")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("r.*").toArrow()
    grammar.weights = logistic(np.array(rows.column("x").to_pylist()), np.array(rows.column("y").to_pylist())).tolist()
    return grammar


def score(docs: DataFrame, grammar: Grammar, column: str = "toxicity") -> DataFrame:
    """``docs`` (any columns) with ``column``, a double of 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(grammar)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value.scorer()
        for batch in batches:
            got = [s.score(s.features(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*names, column])

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(run, schema)
