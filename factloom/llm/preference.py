"""Preference formatting, in DataFrame functions alone.

Chosen and rejected conversations of a pair are aligned turn by turn; their longest common prefix of turns is rendered
once as the prompt, the rest of either as its completion. A mask lists the character spans of a completion that are
trained on: the text of assistant turns with the end mark.

Turns are ordered by turn, nulls first, ties by role and text, and repeated rows are turns of their own; a conversation is one row of the
result, whole, whatever its length; null texts are empty, null roles "unknown". A pair with one side alone
has that side as its prompt-less completion and an empty other one. Equal conversations share all but their last turn, so that
there is something to complete. Null pair ids take no part; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _turns(side: DataFrame) -> DataFrame:
    by = Window.partitionBy("pair_id").orderBy("turn", "role", "text")
    rows = side.where("pair_id IS NOT NULL").select(
        "pair_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.select("pair_id", (F.row_number().over(by) - 1).alias("pos"), "role", "text")


def _completion(turns: Column, prefix: Column) -> tuple[Column, Column]:
    """The rendered turns from ``prefix`` on, and the spans of what the assistant says there."""
    rest = F.filter(turns, lambda t: t.pos >= prefix)
    text = F.array_join(F.transform(rest, lambda t: F.concat(F.lit(OPEN), t.role, F.lit(MIDDLE), t.text, F.lit(CLOSE))), "")
    size = lambda t: F.length(t.role) + F.length(t.text) + len(OPEN) + len(MIDDLE) + len(CLOSE)
    spans = F.aggregate(
        rest,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + size(t)).alias("at"),
            F.when(t.role != "assistant", a["spans"])
            .otherwise(
                F.concat(
                    a["spans"],
                    F.when(a["spans"] == "", "").otherwise(","),
                    (a["at"] + F.length(t.role) + len(OPEN) + len(MIDDLE)).cast("string"),
                    F.lit(":"),
                    (a["at"] + size(t) - 1).cast("string"),
                )
            )
            .alias("spans"),
        ),
    )
    return text, spans["spans"]


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per pair_id: n_common, prompt, chosen, chosen_mask, rejected, rejected_mask. Inputs: pair_id, turn, role, text."""
    both = _turns(chosen).withColumn("side", F.lit(0)).unionByName(_turns(rejected).withColumn("side", F.lit(1)))
    turn = F.struct("pos", "role", "text")
    pairs = both.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == 0, turn))).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("side") == 1, turn))).alias("r"),
    )
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.zip_with("c", "r", lambda c, r: c.eqNullSafe(r))
    first = F.array_position(same, False)
    common = F.when(first > 0, first - 1).otherwise(F.size("c")).cast("int")
    whole = (common == F.size("c")) & (common == F.size("r"))
    pairs = pairs.withColumn("n_common", F.greatest(F.lit(0), F.when(whole, common - 1).otherwise(F.least(common, shorter))))
    prompt = F.array_join(
        F.transform(F.slice("c", F.lit(1), F.col("n_common")), lambda t: F.concat(F.lit(OPEN), t.role, F.lit(MIDDLE), t.text, F.lit(CLOSE))), ""
    )
    (ct, cm), (rt, rm) = _completion(F.col("c"), F.col("n_common")), _completion(F.col("r"), F.col("n_common"))
    return pairs.select("pair_id", "n_common", prompt.alias("prompt"), ct.alias("chosen"), cm.alias("chosen_mask"), rt.alias("rejected"), rm.alias("rejected_mask"))


def neighbour_pairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen: every conversation; rejected: the same with one turn changed, by conv_id mod 3 its last turn's or its middle turn's text taken
    from the last turn of the conversation beside it (conv_id xor 1), or its middle turn left out.

    The synthetic conversations hold no rejected answers; a neighbour's stands in for one. Where there is no neighbour, the
    turn is left out. Turns are counted in the order of ``preferences``, so that repeated and null turn numbers have a place.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("pos"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    beside = rows.where("pos = n").select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.coalesce("text", F.lit("")).alias("other"))
    kind = F.pmod("conv_id", F.lit(3))
    changed = F.col("pos") == F.when(kind == 0, F.col("n")).otherwise(F.expr("(n + 1) DIV 2"))
    joined = rows.join(beside, "conv_id", "left").where(~(changed & ((kind == 2) | F.col("other").isNull())))
    rejected = joined.withColumn("text", F.when(changed, F.col("other")).otherwise(F.col("text")))
    as_pair = lambda df: df.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    return as_pair(turns), as_pair(rejected)


_ORDER = "row_number() OVER (PARTITION BY {} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)"
_SIDE = f"""SELECT conv_id AS pair_id, {_ORDER.format("conv_id")} - 1 AS pos, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM"""
_TURN = f"""'{OPEN}' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)"""


def _completion_sql(side: str) -> str:
    """(pair_id, text, mask) of the turns of a side from the common prefix on."""
    return f"""SELECT pair_id, string_agg(turn, '' ORDER BY pos) AS text, coalesce(string_agg((upto - length(turn) + length(role) + {len(OPEN) + len(MIDDLE)})::VARCHAR || ':' || (upto - 1)::VARCHAR, ',' ORDER BY pos) FILTER (role = 'assistant'), '') AS mask
 FROM (SELECT *, sum(length(turn)) OVER (PARTITION BY pair_id ORDER BY pos) AS upto FROM (SELECT s.*, {_TURN} AS turn FROM {side} s JOIN c USING (pair_id) WHERE pos >= n_common)) GROUP BY pair_id"""


#: DuckDB's SQL for ``preferences(*neighbour_pairs(conversations))``.
ORACLE = f"""WITH t AS (SELECT *, {_ORDER.format("conv_id")} AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id IS NOT NULL),
j AS (SELECT t.*, l.other, pos = CASE WHEN conv_id % 3 = 0 THEN n ELSE (n + 1) // 2 END AS changed FROM t LEFT JOIN (SELECT xor(conv_id, 1) AS conv_id, coalesce(text, '') AS other FROM t WHERE pos = n) l USING (conv_id)),
x AS (SELECT conv_id, turn, role, CASE WHEN changed THEN other ELSE text END AS text FROM j WHERE NOT (changed AND (conv_id % 3 = 2 OR other IS NULL))),
a AS ({_SIDE} conversations WHERE conv_id IS NOT NULL), b AS ({_SIDE} x),
c AS (SELECT pair_id, CAST(coalesce(min(pos) FILTER (a.role IS NULL OR b.role IS NULL OR a.role <> b.role OR a.text <> b.text), max(pos)) AS INT) AS n_common FROM a FULL JOIN b USING (pair_id, pos) GROUP BY pair_id),
p AS (SELECT pair_id, string_agg({_TURN}, '' ORDER BY pos) AS prompt FROM a JOIN c USING (pair_id) WHERE pos < n_common GROUP BY pair_id)
SELECT pair_id, n_common, coalesce(prompt, '') AS prompt, coalesce(y.text, '') AS chosen, coalesce(y.mask, '') AS chosen_mask, coalesce(z.text, '') AS rejected, coalesce(z.mask, '') AS rejected_mask
FROM c LEFT JOIN p USING (pair_id) LEFT JOIN ({_completion_sql("a")}) y USING (pair_id) LEFT JOIN ({_completion_sql("b")}) z USING (pair_id)"""
