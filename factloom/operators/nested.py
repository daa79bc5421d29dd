"""Facts of unknown shape as VARIANT: opened level by level, a round for each depth that occurs, with no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import buckets, shuffled, stored

#: Kinds of encoded values that carry their value with them.
CARRIED = ("number", "string", "boolean", "bigint")
#: Rows of one text that are looked up in one place.
MOST = 20_000


def opened(rows: DataFrame, inner: str) -> DataFrame:
    """(id, at, key, v) of the members of the arrays and objects in column ``inner`` of ``rows`` (id, at); ``at`` are the places on the way down."""
    spark = rows.sparkSession
    members = rows.select("id", "at", F.col(inner).alias("inner")).lateralJoin(spark.tvf.variant_explode(F.col("inner").outer()))
    return members.select("id", F.array_append("at", F.col("pos")).alias("at"), "key", F.col("value").alias("v"))


def walk(rows: DataFrame) -> DataFrame:
    """(id, at, key, v): every value inside the documents of ``rows`` (id, v), itself included; ``key`` is null in arrays and at the top."""
    level = stored(rows.where("v IS NOT NULL").select("id", F.array().cast("array<int>").alias("at"), F.lit(None).cast("string").alias("key"), "v"))
    out = level
    while True:
        level = stored(opened(level, "v"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def fields(texts: DataFrame, name: str) -> DataFrame:
    """(id, at, value): what fields of that name hold, at any depth of the JSON of ``texts`` (id, text); text that is not JSON, or names a key of one object
    twice, holds nothing. Strings are given as they are, other values as JSON."""
    found = walk(texts.select("id", F.try_parse_json("text").alias("v"))).where(F.col("key") == name)
    word = F.schema_of_variant("v") == "STRING"
    return found.select("id", "at", F.when(word, F.try_variant_get("v", "$", "string")).otherwise(F.to_json("v")).alias("value"))


def _quoted(text: Column) -> Column:
    """A JSON string."""
    one = F.to_json(F.array(text))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def untagged(rows: DataFrame, encoded: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the JSON in column ``encoded``, where a value of any kind is an object that tells its ``kind``, without the tags.

    A number, word, truth value or big integer is what its ``value`` says (null without one), an array its ``items``, an object its ``entries``, each of
    them without tags in turn; null is null. What JSON has no word for (undefined, nan, infinities, any other kind) keeps its kind alone. An object that names no kind by
    a string, and every value that is no object, stays as it is. Keys come in order. Null where the text is null, is no JSON or repeats a key.

    Every different text is opened once: containers alone go on to the next round, which holds their members, and are put together from the deepest up.
    """
    counts = stored(rows.select(F.col(encoded).alias("text")).where("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("n")).withColumn("id", F.sha2("text", 256)))
    top = counts.select("id", F.array().cast("array<int>").alias("at"), F.lit(None).cast("string").alias("key"), F.try_parse_json("text").alias("v"))
    levels = [stored(_read(top.where("v IS NOT NULL")))]
    while not levels[-1].where("inner IS NOT NULL").isEmpty():
        levels.append(stored(_read(opened(levels[-1].where("inner IS NOT NULL"), "inner"))))
    done = levels.pop().select("id", "at", "key", "said")
    for level in reversed(levels):
        up = done.select("id", F.expr("slice(at, 1, size(at) - 1)").alias("at"), F.struct(F.element_at("at", -1).alias("pos"), F.concat(F.when(F.col("key").isNull(), "").otherwise(F.concat(_quoted(F.col("key")), F.lit(":"))), "said").alias("text")).alias("member"))
        members = F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda m: m.text), ",")
        inner = up.groupBy("id", "at").agg(members.alias("members"))
        whole = F.concat(F.substring("said", 1, 1), F.coalesce("members", F.lit("")), F.substring("said", 2, 1))
        containers = level.where("inner IS NOT NULL").join(inner, ["id", "at"], "left").select("id", "at", "key", whole.alias("said"))
        done = stored(level.where("inner IS NULL").select("id", "at", "key", "said").unionByName(containers))
    return _told(rows.withColumn("_id", F.sha2(F.col(encoded), 256)), done.select(F.col("id").alias("_id"), F.col("said").alias(name)), counts.select(F.col("id").alias("_id"), "n"))


def _told(rows: DataFrame, said: DataFrame, counts: DataFrame, most: int = MOST) -> DataFrame:
    """``rows`` (_id, ...) with what ``said`` (_id, ...) says of theirs, about ``most`` rows of one id in a place. ``counts``: _id, n, the rows of each. Ids of more rows alone
    are broadcast, of which there are no more than rows by ``most``; rows without an id go anywhere."""
    often = counts.where(F.col("n") > most).select("_id", F.ceil(F.col("n") / most).cast("int").alias("_places"))
    n = buckets(rows.sparkSession, rows.count())
    places = F.when(F.col("_id").isNull(), n).otherwise(F.coalesce("_places", F.lit(1)))
    far = rows.join(F.broadcast(often), "_id", "left").withColumn("_place", F.floor(F.rand(7) * places).cast("int")).drop("_places")
    each = said.join(F.broadcast(often), "_id", "left").withColumn("_place", F.explode(F.sequence(F.lit(0), F.coalesce("_places", F.lit(1)) - 1))).drop("_places")
    return far.repartition(n, "_id", "_place").join(shuffled(each), ["_id", "_place"], "left").drop("_id", "_place")


def _read(rows: DataFrame) -> DataFrame:
    """``rows`` (id, at, key, v) with what each says, and of containers the array or object in them that is still to be opened."""
    part = lambda field, kind="variant": F.try_variant_get("v", f"$.{field}", kind)
    shape = lambda field: F.coalesce(F.schema_of_variant(part(field)), F.lit(""))
    kind = F.when(shape("kind") == "STRING", part("kind", "string"))
    said = (
        F.when(kind.isNull(), F.to_json("v"))
        .when(kind.isin(*CARRIED), F.coalesce(F.to_json(part("value")), F.lit("null")))
        .when(kind == "array", "[]")
        .when(kind == "object", "{}")
        .when(kind == "null", "null")
        .otherwise(F.concat(F.lit('{"kind":'), _quoted(kind), F.lit("}")))
    )
    items = F.when((kind == "array") & shape("items").startswith("ARRAY"), part("items"))
    entries = F.when((kind == "object") & shape("entries").startswith("OBJECT"), part("entries"))
    return rows.select("id", "at", "key", said.alias("said"), F.coalesce(items, entries).alias("inner"))
