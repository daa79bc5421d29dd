"""Graph traversals as driver-paced rounds of joins; only the budgeted search, whose budgets are small, is folded on the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.ranks import numbered
from factloom.session import ROWS, checkpointed, dealt, shuffled, stored

#: Rounds that are planned together as one job: fewer jobs against longer plans.
TRIMS, DOUBLINGS = 3, 3
#: What is left after a trim is finished in one task when it has at most so many edges; larger remainders go on in rounds.
REST = 200_000
#: Ends of edges in a lot of neighbouring nodes, and how often lots are joined at most.
LOT, JOINS = ROWS, 24


def reachable(edges: DataFrame, seeds: DataFrame, levels: int | None = None) -> DataFrame:
    """(id, level): breadth-first levels from ``seeds`` (id) along ``edges`` (a, b). Each round joins the frontier alone."""
    seen = checkpointed(seeds.select("id").distinct().withColumn("level", F.lit(0)))
    front, level = seen, 0
    step = edges.select(F.col("a").alias("id"), "b").where("b IS NOT NULL")
    while levels is None or level < levels:
        level += 1
        front = front.select("id").join(shuffled(step), "id").select(F.col("b").alias("id")).distinct().join(shuffled(seen.select("id")), "id", "left_anti")
        front = checkpointed(front.withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if level % 8 == 0:
            seen = checkpointed(seen)
    return seen


def signed_levels(edges: DataFrame, root: DataFrame, levels: int = 4) -> DataFrame:
    """(id, distance): edges walked both ways, +1 downstream and -1 upstream; the first visit wins, downstream first."""
    seen = checkpointed(root.select("id").distinct().withColumn("distance", F.lit(0)))
    front = seen
    both = edges.where("b IS NOT NULL").select(F.col("a").alias("id"), F.col("b").alias("to"), F.lit(1).alias("step"))
    both = both.unionByName(edges.where("b IS NOT NULL").select(F.col("b").alias("id"), F.col("a").alias("to"), F.lit(-1).alias("step"))).distinct()
    for _ in range(levels):
        found = front.join(both, "id").select(F.col("to").alias("id"), (F.col("distance") + F.col("step")).alias("distance"))
        front = checkpointed(found.groupBy("id").agg(F.max("distance").alias("distance")).join(seen.select("id"), "id", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def _small_components(edges: DataFrame) -> DataFrame:
    """Strong components of a graph that is known to be small, by two depth-first passes in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ahead: dict = {}
        back: dict = {}
        for pdf in batches:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                ahead.setdefault(a, []).append(b)
                back.setdefault(b, []).append(a)
        nodes = sorted(set(ahead) | set(back))
        order, seen = [], set()
        for root in nodes:
            stack = [] if root in seen else [(root, iter(ahead.get(root, ())))]
            seen.add(root)
            while stack:
                step = next((n for n in stack[-1][1] if n not in seen), None)
                if step is None:
                    order.append(stack.pop()[0])
                else:
                    seen.add(step)
                    stack.append((step, iter(ahead.get(step, ()))))
        comp: dict = {}
        for root in reversed(order):
            if root in comp:
                continue
            comp[root], todo, members = root, [root], [root]
            while todo:
                for n in back.get(todo.pop(), ()):
                    if n not in comp:
                        comp[n] = root
                        todo.append(n)
                        members.append(n)
            least = min(members)
            comp.update(dict.fromkeys(members, least))
        if nodes:
            yield pd.DataFrame({"id": nodes, "comp": [comp[n] for n in nodes]})

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInPandas(run, f"id {kind}, comp {kind}")


def lots(edges: DataFrame, n: int, lot: int = LOT) -> DataFrame:
    """(id, lot): the nodes of ``n`` ``edges`` (a, b) in lots that one task each can hold. Neighbours are joined in rounds, by a coin that each tosses, to
    blocks of at most ``lot`` ends of edges; lots are blocks dealt by number. Any lots are right, and near ones save rounds; a node of more edges is a block of its own."""
    tasks = -(-2 * n // lot)
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
    if tasks <= 1:
        return stored(ends.select("id").distinct().withColumn("lot", F.lit(0)))
    of = stored(ends.groupBy("id").agg(F.count("*").alias("n")).withColumn("x", F.xxhash64("id")))
    size = stored(of.groupBy("x").agg(F.sum("n").alias("n")))
    links = stored(ends.select(F.xxhash64("id").alias("x"), F.xxhash64("to").alias("y")).where("x <> y").groupBy("x", "y").agg(F.count("*").alias("w")))
    moves = []
    for k in range(JOINS):
        coin = lambda c: F.xxhash64(c, F.lit(k)).bitwiseAND(F.lit(1))
        to = links.where((coin("x") == 0) & (coin("y") == 1)).groupBy("x").agg(F.max_by("y", F.struct("w", "y")).alias("y"))
        to = to.join(shuffled(size), "x").join(shuffled(size.select(F.col("x").alias("y"), F.col("n").alias("has"))), "y")
        # a block takes in its least neighbours first, as long as there is room
        to = to.withColumn("all", F.col("has") + F.sum("n").over(Window.partitionBy("y").orderBy("n", "x"))).where(F.col("all") <= lot)
        moved = stored(to.select("x", "y"))
        if moved.isEmpty() and k > 2:  # not for want of luck
            break
        moves.append(moved)
        at = lambda rows, c: rows.join(shuffled(moved.select(F.col("x").alias(c), F.col("y").alias("_y"))), c, "left").withColumn(c, F.coalesce("_y", c)).drop("_y")  # noqa: E731, B023
        links = stored(at(at(links, "x"), "y").where("x <> y").groupBy("x", "y").agg(F.sum("w").alias("w")))
        size = stored(at(size, "x").groupBy("x").agg(F.sum("n").alias("n")))
        of = at(of, "x")
        if len(moves) % 4 == 0:
            of = stored(of)
    return stored(of.select("id", F.pmod(F.xxhash64("x"), F.lit(2 * tasks)).cast("int").alias("lot")))


def spread(edges: DataFrame, labels: DataFrame, of: DataFrame) -> DataFrame:
    """(id, lot, c): the least label that reaches each node along ``edges`` (a, b), its own too. ``labels``: id, lot, c, null where a node has none; ``of``: ``lots``.

    A task spreads the labels of a lot as far as they go in it, and hands on those that go to other lots; rounds end when none does.
    """
    kind = dict(labels.dtypes)["id"]
    there = edges.join(shuffled(of.withColumnRenamed("id", "a")), "a").join(shuffled(of.select(F.col("id").alias("b"), F.col("lot").alias("to"))), "b").select("lot", "a", "b", "to")
    count = of.agg(F.countDistinct("lot")).first()[0]
    there = dealt(there, max(count, 1), "lot")

    def run(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        told = s[s["kind"] != 0]
        s = s[s["kind"] == 0]
        lot = s["lot"].iloc[0]
        index = pd.Index(s["id"])
        named = np.sort(pd.unique(pd.concat([s["c"], told["c"]]).dropna()))  # labels as numbers in their order
        none = len(named)
        rank = lambda c: np.where(c.isna(), none, np.searchsorted(named, c.fillna(named[0]))) if none else np.zeros(len(c), dtype="int64")
        c = rank(s["c"]).astype("int64")
        first = bool(s["first"].iloc[0])
        was = np.full(len(c), none, dtype="int64") if first else c.copy()
        np.minimum.at(c, index.get_indexer(told["id"]), rank(told["c"]).astype("int64"))
        inside = (e["to"] == lot).to_numpy()
        a, b = index.get_indexer(e["a"]), index.get_indexer(e["b"])  # -1 for nodes of other lots
        x, y = a[inside], b[inside]
        order = np.argsort(x, kind="stable")
        begin, y = np.searchsorted(x[order], np.arange(len(c) + 1)).tolist(), y[order].tolist()
        start = np.flatnonzero(c < was)
        start = start[np.argsort(c[start], kind="stable")].tolist()
        now = c.tolist()
        for node in start:  # least labels first: each node is passed once
            label, todo = now[node], [node]
            while todo:
                at = todo.pop()
                for n in y[begin[at] : begin[at + 1]]:
                    if now[n] > label:
                        now[n] = label
                        todo.append(n)
        c = np.array(now, dtype="int64")
        known = lambda k: pd.Series([named[i] if i < none else None for i in k.tolist()], dtype=s["id"].dtype if not (k >= none).any() else object)
        state = pd.DataFrame({"lot": s["lot"].to_numpy(), "id": s["id"].to_numpy(), "c": known(c), "kind": 0})
        out = np.flatnonzero(~inside & (c < was)[a]) if len(a) else np.zeros(0, dtype="int64")
        sent = pd.DataFrame({"lot": e["to"].to_numpy()[out], "id": e["b"].to_numpy()[out], "c": c[a[out]] if len(out) else np.zeros(0, dtype="int64")})
        sent = sent.groupby(["lot", "id"], as_index=False, sort=False)["c"].min()
        sent["c"] = known(sent["c"].to_numpy())
        return pd.concat([state, sent.assign(kind=1)], ignore_index=True) if len(sent) else state

    rows, first = labels.select("lot", "id", "c", F.lit(0).alias("kind")), True
    while True:
        state = rows.where("kind = 0")
        told = rows.where("kind = 1").groupBy("lot", "id").agg(F.min("c").alias("c")).withColumn("kind", F.lit(1)) if not first else rows.where("false")
        all_rows = state.unionByName(told.select("lot", "id", "c", "kind")).withColumn("first", F.lit(first))
        rows = stored(there.groupBy("lot").cogroup(all_rows.groupBy("lot")).applyInPandas(run, f"lot int, id {kind}, c {kind}, kind int"))
        first = False
        if rows.where("kind = 1").isEmpty():
            return rows.select("id", "lot", "c")


def strong_components(edges: DataFrame, singletons: bool = True, rest: int = REST, lot: int = LOT) -> DataFrame:
    """(id, comp): strongly connected components of ``edges`` (a, b); comp is the least member.

    Trim, then forward-backward colouring: nodes without an edge in or out of what is left are components of their own; then the
    least label that reaches a node colours it, and what reaches the colour's root backwards inside the colour is one component.
    Labels spread in lots of neighbouring nodes, a task each, so rounds do not grow with the length of paths but with the lots that these pass. Rounds are
    stored tables, whose size is that of their files: a checkpoint keeps the estimate of its plan, with twice as many digits each time that labels meet themselves.
    """
    live = stored(edges.where("b IS NOT NULL").select("a", "b").distinct())
    every = live.select(F.col("a").alias("id")).unionByName(live.select(F.col("b").alias("id"))).distinct()
    loops = live.where("a = b").select(F.col("a").alias("id"))
    done, of = None, None
    live = live.where("a <> b")
    while True:
        for _ in range(TRIMS):  # any number is right: what is not trimmed is coloured alone
            live = live.join(shuffled(live.select(F.col("b").alias("a")).distinct()), "a", "left_semi").join(shuffled(live.select(F.col("a").alias("b")).distinct()), "b", "left_semi")
        live = stored(live.select("a", "b"))
        left = live.count()
        if left <= rest:
            if left:
                found = _small_components(live)
                done = found if done is None else done.unionByName(found)
            break
        of = lots(live, left, lot) if of is None else of
        ids = live.select(F.col("a").alias("id")).unionByName(live.select(F.col("b").alias("id"))).distinct()
        colour = spread(live, of.join(shuffled(ids), "id", "left_semi").select("id", "lot", F.col("id").alias("c")), of)
        inner = live.join(shuffled(colour.select(F.col("id").alias("a"), F.col("c").alias("ca"))), "a").join(shuffled(colour.select(F.col("id").alias("b"), F.col("c").alias("cb"))), "b")
        inner = stored(inner.where("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b")))
        back = spread(inner, colour.select("id", "lot", F.when(F.col("id") == F.col("c"), F.col("c")).alias("c")), of)
        found = stored(back.where("c IS NOT NULL").select("id", F.col("c").alias("comp")))
        done = found if done is None else done.unionByName(found)
        live = inner.select(F.col("b").alias("a"), F.col("a").alias("b"))  # no component has edges between colours
        live = live.join(shuffled(found.select(F.col("id").alias("a"))), "a", "left_anti").join(shuffled(found.select(F.col("id").alias("b"))), "b", "left_anti")
    if done is None:
        done = every.where("false").select("id", F.col("id").alias("comp"))
    if singletons:
        alone = every.join(shuffled(done.select("id")), "id", "left_anti").select("id", F.col("id").alias("comp"))
    else:
        size = done.groupBy("comp").agg(F.count("*").alias("n")).where("n > 1").select("comp")
        done = done.join(size, "comp", "left_semi").select("id", "comp")
        alone = loops.join(done.select("id"), "id", "left_anti").select("id", F.col("id").alias("comp"))
    return done.unionByName(alone)


def condensed(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """(id, to): the edges (a, b) between different components, each once."""
    c = shuffled(comps.select("id", "comp"))
    met = edges.where("b IS NOT NULL").join(c.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(c.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
    return met.where("ca <> cb").select(F.col("ca").alias("id"), F.col("cb").alias("to")).distinct()


def jumped(pointers: DataFrame) -> DataFrame:
    """``pointers`` (id, to, w, k), one for each id and without a cycle, followed to the end: where an id's target is an id too, to is that one's.

    A pointer says that the value of ``id`` is max(k, w + value of ``to``); two such in a row are one again. Every step doubles how far all of
    them reach, so a chain of n takes log2(n) steps, ``DOUBLINGS`` of them a job.
    """
    at, steps = pointers.select("id", "to", "w", "k"), 1
    while True:
        for _ in range(steps):
            on = at.select(F.col("id").alias("to"), F.col("to").alias("on_to"), F.col("w").alias("on_w"), F.col("k").alias("on_k"))
            at = at.join(shuffled(on), "to", "left").select(
                "id",
                F.coalesce("on_to", "to").alias("to"),
                (F.col("w") + F.coalesce("on_w", F.lit(0))).alias("w"),
                F.greatest(F.col("k"), F.col("w") + F.col("on_k")).alias("k"),
                F.col("on_to").isNotNull().alias("moved"),
            )
        at = stored(at)
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at, steps = at.drop("moved"), DOUBLINGS  # most chains are short


def topological_levels(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """(comp, level) of the condensation, leaves first: a component's level is one above the highest of those it points at.

    A component that waits for one other alone is a pointer to it, however many it waited for before; pointers are followed by doubling
    and set aside until their ends are known. So rounds do not grow with the length of chains, with or without short branches.
    """
    # (id, to, w): the level of id is w or more above that of to; without to, w or more
    floor = comps.select(F.col("comp").alias("id")).distinct().withColumn("to", F.lit(None).cast(comps.schema["comp"].dataType))
    links = stored(condensed(edges, comps).withColumn("w", F.lit(1).cast("long")).unionByName(floor.withColumn("w", F.lit(0).cast("long"))))
    known, aside = [], []
    while True:
        open_w, floor_w = F.max(F.when(F.col("to").isNotNull(), F.col("w"))), F.max(F.when(F.col("to").isNull(), F.col("w")))
        state = stored(links.groupBy("id").agg(F.count("to").alias("n"), F.max("to").alias("to"), open_w.alias("w"), floor_w.alias("k")))
        known.append(state.where("n = 0").select("id", F.col("k").alias("level")))
        met = known[-1].select(F.col("id").alias("to"), F.lit(None).cast(state.schema["to"].dataType).alias("on"), F.lit(0).cast("long").alias("on_w"), F.col("level").alias("on_k"))
        one, more = state.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") > 1)).first()
        if one:  # a pointer that ends at a known level is known; the others wait with what they end at
            ends = jumped(state.where("n = 1")).join(shuffled(known[-1].withColumnRenamed("id", "to")), "to", "left")
            ends = stored(ends.select("id", F.when(F.col("level").isNull(), F.col("to")).alias("to"), "w", F.greatest("k", F.col("w") + F.col("level")).alias("k")))
            known.append(ends.where("to IS NULL").select("id", F.col("k").alias("level")))
            aside.append(ends.where("to IS NOT NULL"))
            met = met.unionByName(ends.select(F.col("id").alias("to"), F.col("to").alias("on"), F.col("w").alias("on_w"), F.col("k").alias("on_k")))
        if not more:
            break
        moved = links.join(shuffled(state.where("n > 1").select("id")), "id", "left_semi").join(shuffled(met.withColumn("met", F.lit(True))), "to", "left")
        # an edge to a pointer is one to its end, and no less than what it says itself; one to a known level says no more than that
        ways = F.when(F.col("met"), F.array(F.struct("on", (F.col("w") + F.col("on_w")).alias("w")), F.struct(F.lit(None).cast(state.schema["to"].dataType).alias("on"), (F.col("w") + F.col("on_k")).alias("w"))))
        ways = F.coalesce(ways, F.array(F.struct(F.col("to").alias("on"), "w")))
        way = moved.select("id", F.col("met"), F.explode(ways).alias("way"))
        links = stored(way.groupBy("id", F.col("way.on").alias("to")).agg(F.max("way.w").alias("w")))
    out = _union(known)
    for ends in reversed(aside):
        found = ends.join(shuffled(out.select(F.col("id").alias("to"), "level")), "to").select("id", F.greatest(F.col("k"), F.col("w") + F.col("level")).alias("level"))
        out = stored(out.unionByName(found))
    return out.select(F.col("id").alias("comp"), F.col("level").cast("int").alias("level"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paths(links: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(id, path, place) of ids on the chains of ``links`` (id, to): each id of a chain but the last points at one id alone, which only it points at.
    ``path`` is the last id, ``place`` how far from it. ``among`` (id): the ids that chains may hold."""
    alone = links.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")
    sole = links.groupBy("to").agg(F.count("*").alias("n")).where("n = 1").select("to")
    steps = links.join(shuffled(alone), "id", "left_semi").join(shuffled(sole), "to", "left_semi")
    if among is not None:
        steps = steps.join(shuffled(among.select(F.col("id").alias("to"))), "to", "left_semi")
    ends = jumped(steps.select("id", "to", F.lit(1).alias("w"), F.lit(0).alias("k")))
    last = ends.select(F.col("to").alias("id")).distinct()
    return ends.select("id", F.col("to").alias("path"), F.col("w").alias("place")).unionByName(last.select("id", F.col("id").alias("path"), F.lit(0).cast("long").alias("place")))


def _rolled(rows: DataFrame) -> DataFrame:
    """(comp, place, path, closure) of ``rows`` (comp, path, place, own, kids), all of a path: a path's last component has the digest of its own and its kids', each
    other that of its own and the one's after it. A task streams its paths in order and keeps one digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, digest = None, ""
        for pdf in batches:
            out = []
            for p, own, kids in zip(pdf["path"], pdf["own"], pdf["kids"], strict=True):
                below = digest if p == path else kids
                text = own if below is None else f"{own}\0{below}"
                path, digest = p, hashlib.sha256(text.encode()).hexdigest()
                out.append(digest)
            yield pdf[["comp", "path", "place"]].assign(closure=out)

    kind = rows.schema["comp"].dataType.simpleString()
    dealt = rows.repartition("path").sortWithinPartitions("path", "place")
    return dealt.mapInPandas(run, f"comp {kind}, path {kind}, place long, closure string")


def closure_digests(files: DataFrame, edges: DataFrame, comps: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(comp, closure): Merkle digest of each component from its members' hashes and its children's digests; ``known`` (comp, closure) are
    taken as they are and not given again.

    Chains are digested in one go, so that a round is a level of the graph of chains. A round hands the digests that it found to the chains that wait
    for them and to no others; what is carried on is what a later round needs.
    """
    links = condensed(edges, comps)
    if known is not None:
        comps = stored(comps.join(known.select("comp"), "comp", "left_anti"))
        links = links.join(comps.select(F.col("comp").alias("id")).distinct(), "id", "left_semi")
    links = stored(links)
    members = comps.join(shuffled(files.select("id", "hash")), "id").groupBy("comp").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "id", "hash"))), "\n").alias("own"))
    chain = stored(paths(links, comps.select(F.col("comp").alias("id")).distinct()))
    of = lambda c, p: chain.select(F.col("id").alias(c), F.col("path").alias(p))
    between = links.join(shuffled(of("id", "from_path")), "id", "left").join(shuffled(of("to", "to_path")), "to", "left")
    between = between.select("to", F.coalesce("from_path", "id").alias("a"), F.coalesce("to_path", "to").alias("b"))
    between = stored(between.where("a <> b"))  # from a chain's last component to any place of another
    rows = members.join(shuffled(chain.withColumnRenamed("id", "comp")), "comp", "left").select("comp", F.coalesce("path", "comp").alias("path"), F.coalesce("place", F.lit(0)).cast("long").alias("place"), "own")
    every = stored(rows.select(F.col("path").alias("id")).distinct().withColumn("comp", F.col("id")))
    levels = topological_levels(between.select("a", "b"), every).select(F.col("comp").alias("path"), "level")
    rows = stored(rows.join(shuffled(levels), "path"))
    waits = stored(between.join(shuffled(levels.withColumnRenamed("path", "a")), "a").select("to", "a", "level"))
    top = rows.agg(F.max("level")).first()[0]
    done, told = [], []
    if known is not None:
        told.append(stored(known.select(F.col("comp").alias("to"), "closure").join(waits, "to").select("a", "level", "closure")))
    for level in range(0 if top is None else top + 1):
        here = rows.where(F.col("level") == level).drop("level")
        if told:
            kids = _union(told).where(F.col("level") == level).groupBy(F.col("a").alias("path")).agg(F.array_join(F.array_sort(F.collect_list("closure")), "\n").alias("kids"))
            here = here.join(shuffled(kids), "path", "left")
        else:
            here = here.withColumn("kids", F.lit(None).cast("string"))
        found = stored(_rolled(here))
        done.append(found.select("comp", "closure"))
        if level < top:
            told.append(stored(found.select(F.col("comp").alias("to"), "closure").join(waits.where(F.col("level") > level), "to").select("a", "level", "closure")))
            if len(told) == 8:
                told = [stored(_union(told).where(F.col("level") > level))]
    return _union(done) if done else rows.select("comp", F.col("own").alias("closure"))


def changed_closures(before: DataFrame, old: DataFrame, new: DataFrame, edges: DataFrame, comps: DataFrame) -> DataFrame:
    """(comp, closure, fresh): closure digests of ``new`` files (id, hash) from those ``before`` (comp, closure) of ``old``, over one graph. Components
    that reach no changed file keep theirs; the others (fresh), found backwards from the changes, are digested anew."""
    changed = new.join(old.select("id", F.col("hash").alias("was")), "id", "left").where(~F.col("hash").eqNullSafe(F.col("was")))
    seeds = stored(comps.join(changed.select("id"), "id", "left_semi").select(F.col("comp").alias("id")).distinct())
    back = condensed(edges, comps).select(F.col("to").alias("a"), F.col("id").alias("b"))
    touched = reachable(back, seeds).select(F.col("id").alias("comp"))
    kept = stored(before.join(touched, "comp", "left_anti").select("comp", "closure"))
    fresh = closure_digests(new, edges, comps, kept)
    return kept.withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))


@dataclass
class Reach:
    nodes: set[str] = field(default_factory=set)
    edges: set[str] = field(default_factory=set)
    unresolved: list[str] = field(default_factory=list)
    frontier: set[str] = field(default_factory=set)
    truncated: bool = False


def bounded_reach(edges: DataFrame, root: str, max_nodes: int, max_edges: int) -> Reach:
    """First-in-first-out search under a budget of nodes and of examined edges. ``edges``: id, source, target (null: unresolved).

    A level is one Spark job. Inside a level the order is (rank of the source, edge id), so that a row number is the count of
    examined edges; no more rows than the rest of the budget, and one, are brought to the driver.
    """
    if not 1 <= max_nodes <= 500 or not 1 <= max_edges <= 2000:
        raise ValueError("budgets: nodes 1..500, edges 1..2000")
    spark = edges.sparkSession
    out = Reach(nodes={root})
    level, examined = [root], 0
    while level:
        queue = spark.createDataFrame(list(enumerate(level)), "rank int, source string")
        room = max_edges - examined
        rows = edges.join(F.broadcast(queue), "source").orderBy("rank", "id").limit(room + 1).select("rank", "id", "target").collect()
        found: list[str] = []
        for r in rows[:room]:
            examined += 1
            if r.target is None:
                out.unresolved.append(r.id)
            elif r.target in out.nodes:
                out.edges.add(r.id)
            elif len(out.nodes) < max_nodes:
                out.nodes.add(r.target)
                out.edges.add(r.id)
                found.append(r.target)
            else:
                out.frontier.add(r.target)
                out.truncated = True
        if examined >= max_edges:
            last = rows[room - 1].rank
            if len(rows) > room and rows[room].rank == last:  # cut in the middle of a node's edges
                out.frontier.add(level[last])
                out.truncated = True
            rest = [*level[last + 1 :], *found]
            out.frontier.update(rest)
            out.truncated |= bool(rest)
            break
        level = found
    return out


def import_closure(imports: DataFrame, seed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files reached from ``seed`` (id) by value imports, and the unresolved imports met on the way."""
    value = imports.where("NOT type_only").select(F.col("path").alias("a"), F.col("target_path").alias("b"), F.col("id").alias("import_id"))
    files = reachable(value.select("a", "b"), seed)
    return files, value.where("b IS NULL").join(files.select(F.col("id").alias("a")), "a", "left_semi")


def folds(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, a, b, n, members) of what is not drawn. ``levels``: id, distance, drawn.

    A folded node walks towards the root (its least neighbour of smaller distance) and away from it until it meets drawn nodes. Between
    two different ones it is part of a chain from a to b, with one towards the root a tail of a, else it is not attributed.
    A step changes the distance, so there are no more rounds than distances.
    """
    ends = edges.where("b IS NOT NULL")
    both = ends.select("a", "b").unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    side = lambda c, s: levels.select(F.col("id").alias(c), F.abs("distance").alias(s))
    steps = checkpointed(both.join(side("a", "da"), "a").join(side("b", "db"), "b").where("da <> db").groupBy("a").agg(F.min(F.when(F.col("db") < F.col("da"), F.col("b"))).alias("inward"), F.min(F.when(F.col("db") > F.col("da"), F.col("b"))).alias("outward")))
    drawn = levels.where("drawn").select(F.col("id").alias("at"))
    folded = checkpointed(levels.where("NOT drawn").select("id"))

    def ends_of(way: str) -> DataFrame:
        walkers, found = folded.select("id", F.col("id").alias("at")), folded.where("false").select("id", F.col("id").alias(way))
        while not walkers.isEmpty():
            on = steps.select(F.col("a").alias("at"), F.col(way).alias("to")).where("to IS NOT NULL")
            moved = checkpointed(walkers.join(on, "at").select("id", F.col("to").alias("at")))
            found = found.unionByName(moved.join(drawn, "at").select("id", F.col("at").alias(way)))
            walkers = moved.join(drawn, "at", "left_anti")
        return found

    rows = folded.join(ends_of("inward"), "id", "left").join(ends_of("outward"), "id", "left")
    chain = F.col("inward").isNotNull() & F.col("outward").isNotNull() & (F.col("inward") != F.col("outward"))
    kind = F.when(chain, "chain").when(F.col("inward").isNotNull(), "tail").otherwise("unattributed")
    rows = rows.select(kind.alias("kind"), F.col("inward").alias("a"), F.when(chain, F.col("outward")).alias("b"), "id")
    rows = checkpointed(rows)
    keys = ["kind", "a", "b"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    shown = rows.withColumn("place", place).where("place <= 24").groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias("ids"))  # a fold shows its first 24
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}"))
    members = F.array_join(F.transform("s.ids", lambda x: x.cast("string")), ",")
    return counts.alias("c").join(shown.alias("s"), same).select(*[f"c.{k}" for k in keys], "c.n", members.alias("members"))


def closure_report(files: DataFrame, unresolved: DataFrame, named: int = 20) -> DataFrame:
    """(part, id): the files of a closure; of its unresolved imports (specifier) the first ``named`` relative ones, which a copy can break, and
    the number of bare ones, which are looked up elsewhere."""
    relative = F.col("specifier").rlike(r"^\.\.?(/|$)")
    broken = unresolved.where(relative).select(F.col("specifier").alias("id")).distinct().orderBy("id").limit(named)
    bare = unresolved.agg(F.count_if(~relative).cast("string").alias("id"))
    out = files.select(F.lit("file").alias("part"), "id").unionByName(broken.select(F.lit("relative").alias("part"), "id"))
    return out.unionByName(bare.select(F.lit("bare").alias("part"), "id"))


def rank_by_distance(levels: DataFrame, budget: int) -> DataFrame:
    """Nodes to draw: the nearest ``budget`` by (abs(distance), id); the others are folded."""
    return numbered(levels, [F.abs("distance"), F.col("id")], "rank").withColumn("drawn", F.col("rank") <= budget)
