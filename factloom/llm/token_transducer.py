"""Token counts by a finite-state transducer compiled from a byte-level BPE tokenizer.

One deterministic transducer reads bytes and adds up the weights of its transitions: the tokens that a byte emits, less those
that it joins. It is the product of three machines:

* the added tokens' matcher holds back bytes that may begin one (``held``) and counts a whole one as a token;
* the word splitter holds back bytes whose meaning the next character decides: a character that is not whole yet, the last
  white space of a run, an apostrophe that may begin a contraction;
* the BPE machine reads the bytes of a word. A sequence of tokens is the word's encoding exactly if each two neighbours are
  encoded as themselves, so the encoding of every prefix ends in one token. Its state keeps, for each end of the prefix that
  some token may still grow from, the place in the trie of tokens, the token before it, and how many tokens were made up to there.

States and their transitions are compiled when they are met first and kept, about ``LIMIT`` transitions at a time; what characters and neighbouring tokens are is asked of the tokenizer's own library, so both follow its Unicode tables and merges.

Long texts are cut into chunks of ``chunk`` bytes that tasks share out. A chunk's map from the state before it to the state and
count after it is known without that state: between two ASCII characters of different kinds a word surely ends and one begins, and the
machine goes on as from its start. So a map is (``head``: the bytes up to the first such place, ``count``: the tokens known behind it, ``state``: the last
state); one without such a place is all head. The maps of short parts between two such places are kept and added up. Maps compose associatively, and a prefix scan over the chunks of a text gives the
state and the tokens before each of them and after the last.

Null and empty texts have no tokens; each row is a document of its own, whatever its doc_id; texts of any length are counted whole;
an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import gc
import pickle
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, pairwise
from operator import attrgetter, getitem

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.kernels import by_key

#: Texts above this many bytes are cut into chunks of that size.
CHUNK = 1 << 18
#: Transitions kept in a worker (some 200 bytes each); beyond, all are compiled anew.
LIMIT = 1_200_000
#: Parts up to so many bytes are kept with their count, at most LIMIT of them.
WORD = 64
#: The symbol behind a text's last byte.
END = 256
OTHER, LETTER, NUMBER, BLANK = range(4)
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")  # fixed values: the public splitting pattern of byte-level BPE
_NO_WORD = ()
_weight = attrgetter("weight")

State = tuple  # (held, run, pending, word): see Transducer.START


class Unsupported(ValueError):
    """The tokenizer is not one that this compiler knows."""


class Bpe:
    """The BPE machine over bytes. A word's state is a tuple of (trie node, token before it, tokens so far less those up to here)."""

    def __init__(self, model, vocabulary: dict[str, int]) -> None:
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.spelled = [chr(b) if b in printable else chr(next(spare)) for b in range(256)]
        byte_of = {c: b for b, c in enumerate(self.spelled)}
        self.model = model
        self.bytes = {i: bytes(byte_of[c] for c in t) for t, i in vocabulary.items() if all(c in byte_of for c in t)}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for i, raw in self.bytes.items():
            at = 0
            for b in raw:
                if b not in self.child[at]:
                    self.child[at][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                at = self.child[at][b]
            self.token[at] = i
        if len(self.child[0]) < 256:
            raise Unsupported("every byte must be a token")
        self.known: dict[tuple[int, int], bool] = {}

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the tokens ``a`` and ``b``, written together, are encoded as themselves."""
        if a < 0:
            return True
        if (a, b) not in self.known:
            if len(self.known) >= LIMIT:
                self.known.clear()
            word = "".join([self.spelled[x] for x in self.bytes[a] + self.bytes[b]])
            self.known[a, b] = [t.id for t in self.model.tokenize(word)] == [a, b]
        return self.known[a, b]

    def step(self, word: tuple, byte: int) -> tuple[tuple, int]:
        """The state after one more byte, and by how many tokens the encoding grew."""
        grown, last, delta = [], None, 0
        for node, before, count in word or ((0, -1, 0),):
            node = self.child[node].get(byte)
            if node is None:
                continue
            grown.append((node, before, count))
            token = self.token[node]
            if token >= 0 and last is None and self.neighbours(before, token):
                last, delta = token, count + 1
        kept = [(n, t, c - delta) for n, t, c in grown if self.child[n]]
        return (*kept, (0, last, 0)), delta


class Transducer:
    """State: (bytes that may begin an added token, kind of the run, bytes held back by the splitter, state of the BPE machine)."""

    START: State = (b"", OTHER, b"", _NO_WORD)

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        spec = json.loads(whole.to_str())
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in plain) or spec["normalizer"]:
            raise Unsupported("only plain BPE over bytes, without a normalizer")
        if split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise Unsupported("only the byte-level splitter, without a space in front")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise Unsupported("added tokens that take in what stands beside them")
        self.splitter = whole.pre_tokenizer
        self.added = tuple(t["content"].encode() for t in spec["added_tokens"])
        self.begins = {a[:i] for a in self.added for i in range(1, len(a))}
        self.bpe = Bpe(whole.model, model["vocab"])
        self.kinds: dict[bytes, int] = {}
        self.clear()
        self.sure = self._places()

    # The machines ---------------------------------------------------------------------------------------------------

    def kind(self, char: bytes) -> int:
        """What the library's splitter takes a character for: what it joins with an ``a``, a ``1`` or a ``!``."""
        if char not in self.kinds:
            joined = [len(self.splitter.pre_tokenize_str(c + char.decode(errors="replace"))) == 1 for c in "a1!"]
            self.kinds[char] = LETTER if joined[0] else NUMBER if joined[1] else OTHER if joined[2] else BLANK
        return self.kinds[char]

    def _put(self, word: tuple, raw: bytes) -> tuple[tuple, int]:
        total = 0
        for b in raw:
            word, delta = self.bpe.step(word, b)
            total += delta
        return word, total

    def _char(self, run: int, pending: bytes, word: tuple, char: bytes) -> tuple[int, bytes, tuple, int]:
        """The splitter after a whole character. ``pending``: a blank that ends a run of blanks, or the begin of a contraction."""
        kind, count = self.kind(char), 0
        if pending[:1] == b"'" and run == OTHER:
            grown = (pending + char).decode(errors="replace")
            if grown in _CONTRACTIONS:  # a word of its own
                return OTHER, b"", _NO_WORD, self._put(_NO_WORD, pending + char)[1]
            if any(c.startswith(grown) for c in _CONTRACTIONS):
                return OTHER, pending + char, _NO_WORD, 0
            word, count = self._put(_NO_WORD, b"'")  # a run of other characters after all
            if len(pending) > 1:  # and the letter after it a run of its own
                word, more = self._put(_NO_WORD, pending[1:])
                run, count = LETTER, count + more
        elif pending:  # a blank
            if kind == BLANK:
                word, count = self._put(word, pending)
                return BLANK, char, word, count
            word, count = self._put(_NO_WORD, pending)
            if pending == b" ":  # it leads the next word
                word, more = self._put(word, char)
                return kind, b"", word, count + more
            word, run = _NO_WORD, BLANK
        if word and run == kind:  # never blanks: the last of them is pending
            word, more = self._put(word, char)
            return run, b"", word, count + more
        if kind == BLANK:
            return BLANK, char, _NO_WORD, count
        if char == b"'":
            return OTHER, char, _NO_WORD, count
        word, more = self._put(_NO_WORD, char)
        return kind, b"", word, count + more

    def _plain(self, run: int, pending: bytes, word: tuple, byte: int) -> tuple[int, bytes, tuple, int]:
        """The splitter after a byte: characters of several bytes are held back until they are whole, behind what is pending."""
        whole, part = _cut(pending)
        part += bytes([byte])
        if len(part) < _width(part[0]):
            return run, whole + part, word, 0
        return self._char(run, whole, word, part)

    def _flush(self, run: int, pending: bytes, word: tuple) -> int:
        """Tokens of what is still pending where the splitter's input ends."""
        if pending[:1] == b"'" and run == OTHER:
            return sum(self._put(_NO_WORD, p)[1] for p in (b"'", pending[1:]))
        return self._put(word, pending)[1]

    def _feed(self, state: State, byte: int) -> tuple[State, int]:
        held, *inner = state
        held, count = held + bytes([byte]), 0
        while held and held not in self.begins:
            found = max((a for a in self.added if held.startswith(a)), key=len, default=None)
            if found:
                count += self._flush(*inner) + 1
                inner, held = self.START[1:], held[len(found) :]
            else:
                *inner, more = self._plain(*inner, held[0])
                count, held = count + more, held[1:]
        return (held, *inner), count

    def _finish(self, state: State) -> int:
        """Tokens that the end of the text adds."""
        held, *inner = state
        count = 0
        while held:
            found = max((a for a in self.added if held.startswith(a)), key=len, default=None)
            if found:
                count += self._flush(*inner) + 1
                inner, held = self.START[1:], held[len(found) :]
            else:
                *inner, more = self._plain(*inner, held[0])
                count, held = count + more, held[1:]
        return count + self._flush(*inner)

    # The compiled machine ---------------------------------------------------------------------------------------------

    def clear(self) -> None:
        """No node is compiled. A node is a state reached with a weight: a dictionary from bytes (and ``END``) to nodes, which compiles what it misses."""
        machine = self

        class Node(dict):
            __slots__ = ("state", "weight")

            def __missing__(node, byte: int) -> Node:  # noqa: N805
                machine.size += 1
                if byte == END:
                    to = machine._node(None, machine._finish(node.state))
                else:
                    to = machine._node(*machine._feed(node.state, byte))
                node[byte] = to
                return to

        class Parts(dict):
            def __missing__(parts, raw: bytes) -> int:  # noqa: N805
                n = sum(map(_weight, machine._path(machine.START, chain(raw, (END,)))))
                if len(raw) <= WORD:
                    if len(parts) >= LIMIT:
                        parts.clear()
                    parts[raw] = n
                return n

        self.kind_of_node, self.size, self.parts = Node, 0, Parts()
        self.nodes: dict[tuple[State | None, int], dict] = {}

    def _node(self, state: State | None, weight: int) -> dict:
        key = (state, weight)
        if key not in self.nodes:
            node = self.kind_of_node()
            node.state, node.weight = key
            self.nodes[key] = node
        return self.nodes[key]

    def _path(self, state: State, symbols: Iterable[int]) -> Iterator[dict]:
        if self.size > LIMIT:
            self.clear()
            gc.collect()  # nodes refer to each other
        return accumulate(symbols, getitem, initial=self._node(state, 0))

    def run(self, state: State, raw: bytes) -> tuple[State, int]:
        """The state and the tokens after ``raw``, read from ``state``."""
        met = list(self._path(state, raw))
        return met[-1].state, sum(map(_weight, met))

    def end(self, state: State) -> int:
        return sum(map(_weight, self._path(state, (END,))))

    def count(self, raw: bytes) -> int:
        """Tokens of a text: the sum over its parts between synchronising places, each read once."""
        return sum(map(self.parts.__getitem__, self.split(raw)))

    # Maps of chunks -------------------------------------------------------------------------------------------------

    def _places(self) -> np.ndarray:
        """Whether a word surely ends between two bytes and one begins, whatever came before: ASCII characters of different kinds, the first
        neither blank nor apostrophe, the second neither apostrophe nor the first of an added token, that no added token holds both."""
        kinds = {bytes([b]): self.kind(bytes([b])) for b in range(128) if b != 0x27}
        sure = np.zeros((256, 256), bool)
        for x, first in kinds.items():
            for y, second in kinds.items():
                barred = any(a.startswith(y) or x + y in a for a in self.added)
                sure[x[0], y[0]] = first not in (BLANK, second) and not barred
        return sure.ravel()

    def split(self, raw: bytes) -> list[bytes]:
        """The parts of ``raw`` between such places."""
        at = np.frombuffer(raw, np.uint8).astype(np.uint16)
        ends = [0, *(np.flatnonzero(self.sure[(at[:-1] << 8) | at[1:]]) + 1).tolist(), len(raw)]
        return [raw[a:b] for a, b in pairwise(ends)]

    def map(self, raw: bytes) -> tuple[bytes, int, State | None]:
        """(head, count, state) of a chunk, whatever the state before it."""
        head, *parts = self.split(raw)
        if not parts:
            return head, 0, None
        state, n = self.run(self.START, parts[-1])
        return head, n + sum(map(self.parts.__getitem__, parts[:-1])), state

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of chunk ``a`` and then ``b``; associative."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, n = self.run(a[2], b[0])
        return (a[0], a[1] + n, state) if b[2] is None else (a[0], a[1] + n + self.end(state) + b[1], b[2])

    def identity(self) -> tuple:
        return b"", 0, self.START


def _width(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def _cut(pending: bytes) -> tuple[bytes, bytes]:
    """``pending`` as whole characters and the begin of one that is not whole."""
    for i in range(1, min(4, len(pending)) + 1):
        if pending[-i] >= 0xC0:
            return (pending[:-i], pending[-i:]) if i < _width(pending[-i]) else (pending, b"")
        if pending[-i] < 0x80:
            break
    return pending, b""


def scan(transducer: Transducer, maps: list[tuple]) -> list[tuple]:
    """Inclusive prefix scan: each map composed with all before it. Neighbours are composed first, the half as many pairs are scanned
    so in turn, and the maps between take the scan of the pair before them: a tree of logarithmic depth."""
    if len(maps) < 2:
        return list(maps)
    pairs = scan(transducer, [transducer.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)])
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(pairs[i // 2] if i % 2 else transducer.compose(pairs[i // 2 - 1], maps[i]))
    return out


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One per Python worker, kept between its tasks."""
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


_COUNTED = "row long, doc_id long, n_bytes long, n_tokens long"
_MAPPED = "row long, doc_id long, at long, n_bytes long, head binary, count long, state binary"
_SCANNED = "row long, doc_id long, at long, n_bytes long, tokens_before long, n_tokens long"


def _marked(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _short(rows: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            n = pa.array([machine.count(t.as_buffer().to_pybytes()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "n_bytes")), n], ["row", "doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, _COUNTED)


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """row, doc_id, at (first byte) and part of each chunk, dealt out evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer()
                for first in range(0, raw.size, 64 * chunk):
                    starts = range(first, min(raw.size, first + 64 * chunk), chunk)
                    parts = [raw.slice(at, min(chunk, raw.size - at)).to_pybytes() for at in starts]
                    columns = [pa.array([row] * len(parts), pa.int64()), pa.array([doc] * len(parts), pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "at", "part"])

    return rows.mapInArrow(run, "row long, doc_id long, at long, part binary").repartition(F.xxhash64("row", "at"))


def _maps(parts: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            raw = [p.as_py() for p in batch.column("part")]
            made = [machine.map(r) for r in raw]
            columns = [
                *(batch.column(c) for c in ("row", "doc_id", "at")),
                pa.array(map(len, raw), pa.int64()),
                pa.array([m[0] for m in made], pa.binary()),
                pa.array([m[1] for m in made], pa.int64()),
                pa.array([None if m[2] is None else pickle.dumps(m[2]) for m in made], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "at", "n_bytes", "head", "count", "state"])

    return parts.mapInArrow(run, _MAPPED)


def chunk_counts(rows: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, at (first byte), n_bytes, tokens_before and n_tokens of each chunk of the texts of ``rows`` (row, doc_id, text, not null or empty).

    Tasks share the chunks evenly; the scan of a text takes its maps alone, a head and a state each. What a chunk's last bytes
    leave open counts with the chunk that decides it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for table in by_key(batches, ["row"]):
            texts: dict[int, list[dict]] = {}
            for r in table.to_pylist():
                texts.setdefault(r["row"], []).append(r)
            out: list[tuple] = []
            for parts in texts.values():
                maps = [(p["head"], p["count"], None if p["state"] is None else pickle.loads(p["state"])) for p in parts]
                maps[0] = machine.compose(machine.identity(), maps[0])
                done = scan(machine, maps)
                totals = [m[1] for m in done]
                totals[-1] += machine.end(done[-1][2])
                out += [(p["row"], p["doc_id"], p["at"], p["n_bytes"], b, t - b) for p, b, t in zip(parts, [0, *totals], totals, strict=False)]
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "at", "n_bytes", "tokens_before", "n_tokens"])

    maps = _maps(_chunks(rows, chunk), path)
    return maps.repartition("row").sortWithinPartitions("row", "at").mapInArrow(run, _SCANNED)


def counts(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, n_bytes and n_tokens of every text of ``docs``, as the tokenizer at ``path`` counts them without special tokens added."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = _short(rows.where(F.col("n_bytes") <= chunk), path)
    long = chunk_counts(rows.where(F.col("n_bytes") > chunk), path, chunk)
    summed = long.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return short.unionByName(summed)
