"""Byte-exact text functions. Offsets are UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SOURCE = r"\.(js|jsx|mjs|cjs|ts|tsx|mts|cts)$"
CODE, MARKDOWN = SOURCE, r"\.(md|markdown)$"
CONFIG = r"\.(json|toml|ya?ml|ini)$"
BINARY = r"\.(png|jpe?g|gif|ico|pdf|zip|wasm)$"


def ascii_lower(text: Column) -> Column:
    """Only A-Z are folded: other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def is_source(path: Column) -> Column:
    return path.rlike(SOURCE)


def file_kind(path: Column) -> Column:
    return F.when(path.rlike(CODE), "code").when(path.rlike(MARKDOWN), "markdown").when(path.rlike(CONFIG), "config").when(path.rlike(BINARY), "binary").otherwise("text")


def safe_path(path: Column) -> Column:
    """A relative path whose parts are all plain names."""
    bad = F.exists(F.split(path, "/", -1), lambda p: (p == "") | (p == ".") | (p == ".."))
    return ~(path.contains("\\") | path.contains("\u0000") | bad)


def parent(path: Column) -> Column:
    """The directory of a path; of a top-level one, the empty root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def bytes_at(text: Column, start: Column, length: Column) -> Column:
    """``length`` bytes from byte ``start`` on."""
    return F.substring(F.encode(text, "UTF-8"), (start + 1).cast("int"), length.cast("int"))


def on_boundary(text: Column, at: Column) -> Column:
    """Whether byte ``at`` begins a character, or is the end."""
    first = F.conv(F.hex(bytes_at(text, at, F.lit(1))), 16, 10).cast("int")
    return F.coalesce((at == F.octet_length(text)) | (first.bitwiseAND(F.lit(0xC0)) != 0x80), F.lit(False)) & (at >= 0) & (at <= F.octet_length(text))


def boundary_before(text: Column, at: Column) -> Column:
    """The last character border at or before byte ``at``: at most three bytes back."""
    back = F.coalesce(*[F.when(on_boundary(text, at - k), at - k) for k in range(4)])
    return F.coalesce(back, F.lit(0).cast("long"))


def line_of(text: Column, at: Column) -> Column:
    """1-based line of byte ``at``."""
    before = F.decode(bytes_at(text, F.lit(0), boundary_before(text, at)), "UTF-8")
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")
