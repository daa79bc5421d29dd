"""Dataflow over flattened programs, as fixpoints of joins: all functions of a version advance together, round by round.

A program is rows: blocks (fn, block, succ), definitions (fn, block, idx, var, def, value, origin) and uses (fn, block, idx, var, use). A
round joins what is new alone (semi-naive), so that its cost follows the frontier, and a fixpoint is reached when a round adds
nothing. Facts that a front-end could not derive come in as rows with an unknown reason and are carried to the end.

A program's rows meet only rows of the same function. ``by_function`` deals tables by it once, and rounds over small functions then shuffle nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import rollup, traverse
from factloom.session import buckets, checkpointed, dealt, shuffled

UNKNOWN = "unknown"
#: Rows of a function that may meet in one task; the rounds of larger ones are shuffled by all keys.
SMALL = 32


@dataclass(frozen=True)
class Rounds:
    """How rounds keep what they derive, and how the new rows, few by few, are joined to the old."""

    keep: Callable[[DataFrame], DataFrame] = checkpointed
    hint: str = ""

    def few(self, new: DataFrame) -> DataFrame:
        return new.hint(self.hint) if self.hint else new

    def without(self, new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
        """``new`` rows whose ``keys`` are not among ``old``, which is streamed past them."""
        if not self.hint:
            return new.join(shuffled(old), keys, "left_anti")
        return self.few(new).join(old.select(*keys, F.lit(True).alias("_old")), keys, "left").where("_old IS NULL").drop("_old")


SPREAD = Rounds()


def by_function(rows: DataFrame, n_rows: int, solve: Callable[[DataFrame, Rounds], DataFrame], small: int = SMALL) -> DataFrame:
    """``solve`` over ``rows`` (fn, n, ...), about ``n_rows`` of them, where n is how many the function has: small functions where they lie once
    they are dealt, larger ones apart and spread by block, in the same rounds."""
    n = buckets(rows.sparkSession, n_rows)
    keep = lambda df: dealt(df, n, "fn")
    laid = keep(rows)
    out = solve(laid.where(F.col("n") <= small), Rounds(keep, "shuffle_hash"))
    large = laid.where(F.col("n") > small)
    return out if large.isEmpty() else out.unionByName(solve(large, SPREAD))


def _grow(start: DataFrame, step, keys: list[str], rounds: Rounds = SPREAD) -> DataFrame:
    """The least set that holds ``start`` and what ``step`` derives from its rows."""
    parts = [rounds.keep(start.select(*keys).distinct())]
    while not parts[-1].isEmpty():
        new = step(parts[-1]).select(*keys).distinct()
        for old in reversed(parts):  # one by one: Spark shuffles a union again
            new = rounds.without(new, old, keys)
        parts.append(rounds.keep(new))
        if len(parts) > 16:
            parts = [rounds.keep(reduce(DataFrame.unionByName, parts[:-1])), parts[-1]]
    return reduce(DataFrame.unionByName, parts)


def reaching(blocks: DataFrame, defs: DataFrame, rounds: Rounds = SPREAD) -> DataFrame:
    """(fn, block, var, def): definitions that reach the start of a block; a later definition of the variable in a block kills."""
    last = defs.groupBy("fn", "block", "var").agg(F.max_by("def", "idx").alias("def"))
    kills = rounds.keep(last.select("fn", "block", "var"))
    edges = rounds.keep(blocks.where("succ IS NOT NULL").select("fn", "block", "succ").distinct())

    def across(at_end: DataFrame) -> DataFrame:
        return rounds.few(at_end).join(edges, ["fn", "block"]).select("fn", F.col("succ").alias("block"), "var", "def")

    def step(at_start: DataFrame) -> DataFrame:
        return across(rounds.without(at_start, kills, ["fn", "block", "var"]))

    return _grow(across(last), step, ["fn", "block", "var", "def"], rounds)


def def_use(blocks: DataFrame, defs: DataFrame, uses: DataFrame, rounds: Rounds = SPREAD) -> DataFrame:
    """(fn, var, def, use): the definitions that a use may read: the last one before it in its block, else those that reach the block."""
    before = uses.alias("u").join(
        shuffled(defs).alias("d"), (F.col("u.fn") == F.col("d.fn")) & (F.col("u.block") == F.col("d.block")) & (F.col("u.var") == F.col("d.var")) & (F.col("d.idx") < F.col("u.idx"))
    )
    local = before.groupBy(F.col("u.fn").alias("fn"), F.col("u.var").alias("var"), F.col("u.use").alias("use")).agg(F.max_by("d.def", "d.idx").alias("def"))
    far = uses.join(shuffled(local.select("fn", "use")), ["fn", "use"], "left_anti").join(shuffled(reaching(blocks, defs, rounds)), ["fn", "block", "var"])
    return rounds.keep(local.select("fn", "var", "def", "use").unionByName(far.select("fn", "var", "def", "use")))


def values(blocks: DataFrame, defs: DataFrame, uses: DataFrame, rounds: Rounds = SPREAD) -> DataFrame:
    """(fn, use, constants, overflow, unknown): what a use may read, as a capped set of constants. A copy (origin: another use) reads what that use
    reads; an uncapped or unknown source makes the reader unknown; a use without a definition reads an unknown."""
    chain = def_use(blocks, defs, uses, rounds)
    d = shuffled(defs.select("fn", "def", "value", "origin"))
    base = rounds.keep(chain.join(d, ["fn", "def"]).select("fn", "use", F.when(F.col("origin").isNull(), F.coalesce("value", F.lit(UNKNOWN))).alias("value"), "origin"))
    copies = rounds.keep(base.where("origin IS NOT NULL").select("fn", F.col("use").alias("to"), F.col("origin").alias("use")))
    none = uses.select("fn", "use").join(shuffled(chain.select("fn", "use")), ["fn", "use"], "left_anti").withColumn("value", F.lit(UNKNOWN))
    seed = base.where("value IS NOT NULL").select("fn", "use", "value").unionByName(none)
    held = _grow(seed, lambda new: rounds.few(new).join(copies, ["fn", "use"]).select("fn", F.col("to").alias("use"), "value"), ["fn", "use", "value"], rounds)
    first = Window.partitionBy("fn", "use").orderBy(F.asc_nulls_last("known"))
    placed = held.withColumn("known", F.when(F.col("value") != UNKNOWN, F.col("value"))).withColumn("place", F.row_number().over(first))
    constants, over = rollup.capped_union(F.when(F.col("place") <= rollup.CONSTANTS + 1, F.col("known")), rollup.CONSTANTS)
    return placed.groupBy("fn", "use").agg(constants.alias("constants"), over.alias("overflow"), (F.bool_or(F.col("value") == UNKNOWN) | over).alias("unknown"))


def live_blocks(blocks: DataFrame, entries: DataFrame, dead: DataFrame, rounds: Rounds = SPREAD) -> DataFrame:
    """(fn, block): blocks reached from the entries without the ``dead`` edges (fn, block, succ), such as branches on a constant."""
    edges = rounds.keep(blocks.where("succ IS NOT NULL").select("fn", "block", "succ").distinct().join(shuffled(dead), ["fn", "block", "succ"], "left_anti"))
    return _grow(entries, lambda new: rounds.few(new).join(edges, ["fn", "block"]).select("fn", F.col("succ").alias("block")), ["fn", "block"], rounds)


def loop_blocks(blocks: DataFrame, rounds: Rounds = SPREAD) -> DataFrame:
    """(fn, block): blocks on a cycle. Blocks without an edge in or out are trimmed first, as long as that leaves half of the edges or fewer."""
    live = rounds.keep(blocks.where("succ IS NOT NULL").select("fn", "block", "succ").distinct())
    left, was = live.count(), None
    while left and (was is None or 2 * left <= was):
        for _ in range(traverse.TRIMS):
            out, into = live.select("fn", F.col("block").alias("succ")).distinct(), live.select("fn", F.col("succ").alias("block")).distinct()
            live = live.join(shuffled(out), ["fn", "succ"], "left_semi").join(shuffled(into), ["fn", "block"], "left_semi")
        live = rounds.keep(live.select("fn", "block", "succ"))
        left, was = live.count(), left
    key = lambda c: F.concat_ws("\u0000", F.col("fn").cast("string"), F.col(c).cast("string"))
    comps = traverse.strong_components(live.select(key("block").alias("a"), key("succ").alias("b")), singletons=False)
    parts = F.split("id", "\u0000")
    return comps.select(parts[0].cast(blocks.schema["fn"].dataType).alias("fn"), parts[1].cast("long").alias("block"))


def effects(own: DataFrame, calls: DataFrame) -> DataFrame:
    """(fn, effect): own effects and those of all callees; an unresolved call (callee null) has the effect 'unknown_call'. ``own``: fn, effect;
    ``calls``: fn, callee. One fixpoint over the call graph, recursion included."""
    known = checkpointed(calls.where("callee IS NOT NULL").select("fn", "callee").distinct())
    seed = own.select("fn", "effect").unionByName(calls.where("callee IS NULL").select("fn", F.lit("unknown_call").alias("effect")))
    return _grow(seed, lambda new: new.join(known.select(F.col("callee").alias("fn"), F.col("fn").alias("caller")), "fn").select(F.col("caller").alias("fn"), "effect"), ["fn", "effect"])


def never_returns(functions: DataFrame, exits: DataFrame, must_call: DataFrame) -> DataFrame:
    """(fn): functions without an exit, and those that must call one. ``exits``: fn, of functions that can end; ``must_call``: fn, callee on every
    path. An unknown callee proves nothing."""
    seed = functions.select("fn").join(exits.select("fn"), "fn", "left_anti")
    edges = checkpointed(must_call.where("callee IS NOT NULL").select(F.col("callee").alias("fn"), F.col("fn").alias("caller")).distinct())
    return _grow(seed, lambda new: new.join(edges, "fn").select(F.col("caller").alias("fn")), ["fn"])


def contexts(calls: DataFrame, per_callee: int = 8) -> DataFrame:
    """Calls whose arguments are scalars, the first ``per_callee`` by (caller, op) of each callee: those that get a context of their own."""
    w = Window.partitionBy("callee").orderBy("fn", "op")
    return calls.where("callee IS NOT NULL AND scalar").withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_callee)


def summary_status(functions: DataFrame, effect_rows: DataFrame, recursive: DataFrame, over_budget: DataFrame) -> DataFrame:
    """(fn, status): complete, partial_recursion (in a cycle with an unknown), or partial_budget; what was cut short never counts as complete."""
    unknown = effect_rows.where("effect = 'unknown_call'").select("fn").distinct().withColumn("u", F.lit(True))
    rows = functions.select("fn").join(unknown, "fn", "left").join(recursive.select("fn").distinct().withColumn("r", F.lit(True)), "fn", "left")
    rows = rows.join(over_budget.select("fn").distinct().withColumn("b", F.lit(True)), "fn", "left")
    return rows.select("fn", F.when(F.col("b"), "partial_budget").when(F.col("r") & F.col("u"), "partial_recursion").otherwise("complete").alias("status"))


def invalid_flow(bindings: DataFrame, scopes: DataFrame, references: DataFrame) -> DataFrame:
    """(fn, id, problem) of a flow document: repeated scopes or bindings, bindings of no scope, scopes of no parent, references of no binding."""
    twice = lambda df, what: df.groupBy("fn", "id").agg(F.count("*").alias("n")).where("n > 1").select("fn", "id", F.lit(f"duplicate_{what}").alias("problem"))
    s = scopes.select("fn", F.col("id").alias("scope"))
    b = bindings.select("fn", F.col("id").alias("binding"))
    loose = bindings.join(shuffled(s), ["fn", "scope"], "left_anti").select("fn", "id", F.lit("binding_without_scope").alias("problem"))
    parent = scopes.where("parent IS NOT NULL").join(shuffled(s.withColumnRenamed("scope", "parent")), ["fn", "parent"], "left_anti").select("fn", "id", F.lit("scope_without_parent").alias("problem"))
    refs = references.join(shuffled(b), ["fn", "binding"], "left_anti").select("fn", "id", F.lit("unknown_binding").alias("problem"))
    return twice(scopes, "scope").unionByName(twice(bindings, "binding")).unionByName(loose).unionByName(parent).unionByName(refs)


def invalid_cover(bindings: DataFrame, symbols: DataFrame, budget: int) -> DataFrame:
    """(fn, id, problem), id null: functions with more bindings than ``budget``, flows of no symbol (fn), and symbols without a flow."""
    per = bindings.groupBy("fn").agg(F.count("*").alias("n"))
    row = lambda df, what: df.select("fn", F.lit(None).cast("long").alias("id"), F.lit(what).alias("problem"))
    known = symbols.select("fn").distinct()
    loose = per.join(shuffled(known), "fn", "left_anti")
    bare = known.join(shuffled(per), "fn", "left_anti")
    return row(per.where(F.col("n") > budget), "binding_budget").unionByName(row(loose, "flow_of_no_symbol")).unionByName(row(bare, "symbol_without_flow"))
