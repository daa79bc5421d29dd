"""Fill-in-the-middle transformation over an index of distinct texts.

Identical texts are grouped by content: by SHA-256, and every text under a digest is compared, so two different texts are never one
(a digest that two share stops the job). Documents, which ship no text themselves, are joined back to the distinct texts by digest; once for
each distinct text the ends of its units (lines with their newline; a last piece without one is a unit too) are made an Elias-Fano list, from which
all its documents take their cuts: two seeded unit numbers choose where the prefix and the middle end, two more the form.

Texts that more than a ``HOT``-th of all rows hold, of which there are fewer than ``HOT``, are dealt out: their documents by a salt,
the text once to each salt, so that a text of a third of all rows is worked on by many tasks.

Null is the empty text; without units, or with one of the marks inside, a text is left as it is (``plain``); texts of any length are
cut whole; rows that repeat, or repeat a doc_id, are documents of their own; a null doc_id seeds as an empty one; an empty table
gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred documents so many are transformed, and of a hundred of those so many with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
SEED = "7"
#: Texts of more than a HOT-th of all rows are dealt out, to about a task for each HOT-th.
HOT = 1024
_NEWLINE = 10
_BATCH_BYTES = 8_000_000


class EliasFano:
    """A rising list of numbers: the low bits of each side by side, the high bits as gaps in unary, about 2 + log(last / n) bits a number."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray) -> None:
        self.n, self.low, self.lows, self.highs = n, low, lows, highs

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        values = values.astype(np.int64)
        low = max(0, (int(values[-1]) // n).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low)) & 1
        high = np.zeros((int(values[-1]) >> low) + n, np.uint8)
        high[(values >> low) + np.arange(n)] = 1
        return cls(n, low, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"))

    def select(self, i: int) -> int:
        """The i-th number, from 0."""
        ones = np.bitwise_count(self.highs).cumsum()
        byte = int(np.searchsorted(ones, i + 1))
        before = int(ones[byte - 1]) if byte else 0
        place = 8 * byte + int(np.flatnonzero(np.unpackbits(self.highs[byte : byte + 1], bitorder="little"))[i - before])
        first = i * self.low
        window = np.unpackbits(self.lows[first // 8 : (first + self.low + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.low]
        return ((place - i) << self.low) | int(window.astype(np.int64) @ (1 << np.arange(self.low)))


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """The byte behind each unit of a text."""
    ends = np.flatnonzero(raw == _NEWLINE) + 1
    return np.append(ends, len(raw)) if len(raw) and raw[-1] != _NEWLINE else ends


def _characters(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def assemble(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def distinct_texts(docs: DataFrame, digest=_digest) -> DataFrame:
    """digest, text, n_docs of every distinct text of ``docs``, dealt by digest. ``digest``: a column's, for tests."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(text.alias("text")).groupBy(digest(F.col("text")).alias("digest")).agg(F.collect_set("text").alias("texts"), F.count("*").alias("n_docs"))
    clash = F.raise_error(F.concat(F.lit("different texts share the digest "), F.hex("digest")))
    return found.select("digest", F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(clash).alias("text"), "n_docs")


def _seeds(doc: Column, seed: str) -> list[Column]:
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED, hot: int = HOT, digest=_digest) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("doc_id"), digest(text).alias("digest"), *_seeds(doc, seed))
    total = docs.count()
    texts = distinct_texts(docs, digest)
    # fewer than ``hot`` texts can each be held by more than a hot-th of all rows, so their list is bounded
    often = rows.groupBy("digest").agg(F.count("*").alias("held")).where(F.col("held") * hot > total)
    salts = F.broadcast(often.select("digest", F.least(F.ceil(F.col("held") * hot / max(total, 1)), F.col("held")).cast("int").alias("salts")))
    dealt = rows.join(salts, "digest", "left")
    plain = dealt.where("salts IS NULL").drop("salts").hint("merge").join(texts.where(F.col("n_docs") * hot <= total).drop("n_docs"), "digest")
    salted = dealt.where("salts IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("salts")).cast("int")).drop("salts")
    spread = texts.where(F.col("n_docs") * hot > total).join(salts, "digest").select("digest", "text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hot_ones = salted.hint("merge").join(spread, ["digest", "salt"]).drop("salt")

    def cut(raw: bytes, units: EliasFano, h1: int, h2: int, h3: int, h4: int) -> tuple[str, int | None, int | None, bytes]:
        n = units.n
        if not raw or PREFIX in raw or SUFFIX in raw or MIDDLE in raw or h3 % 100 >= rate:
            return "plain", None, None, raw
        a, b = (units.select(k - 1) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        form = "spm" if h4 % 100 < suffix_first else "psm"
        return form, _characters(raw[:a]), _characters(raw[a:b]), assemble(form, raw[:a], raw[a:b], raw[b:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, raw, units = None, b"", EliasFano.of(np.zeros(0, np.int64))
        for batch in batches:
            given = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "h1", "h2", "h3", "h4")), batch.column("text"), strict=True)
            out: list[tuple] = []
            size = 0
            for doc_id, key, h1, h2, h3, h4, text in given:
                if key != last:  # rows come in order of their digests: the list is made once for all documents of a text
                    last, raw = key, text.as_buffer().to_pybytes()
                    units = EliasFano.of(unit_ends(np.frombuffer(raw, np.uint8)))
                made = cut(raw, units, h1, h2, h3, h4)
                out.append((doc_id, units.n, *made))
                size += len(made[-1])
                if size > _BATCH_BYTES:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    columns = ["doc_id", "digest", "h1", "h2", "h3", "h4", "text"]
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return plain.select(*columns).mapInArrow(run, schema).unionByName(hot_ones.select(*columns).mapInArrow(run, schema))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
    return pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], list(kinds))


def restored(output: Column, form: Column) -> Column:
    """The text, from the output and its form alone."""
    part = F.split(output, "<[PSM]>", -1)
    order = F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))
    return F.when(form == "plain", output).otherwise(order)


#: DuckDB SQL of the digests of the default transformation, each unit an element of a list.
ORACLE = r"""
WITH seeded AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM seeded
), cut AS (
  SELECT doc_id, text, n,
         array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
