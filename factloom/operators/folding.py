"""Scalar semantics of the analysed programs as column expressions over tagged values.

A value is a struct(tag, num, str, bool): undefined, null, a number (with NaN and infinities), a string or a boolean. SQL's NULL is never
a value, and SQL's equality of NaN is not the programs'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<tag:string,num:double,str:string,bool:boolean>"


def value(tag: str, num: Column | None = None, text: Column | None = None, flag: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(tag).alias("tag"),
        (none if num is None else num).cast("double").alias("num"),
        (none if text is None else text).cast("string").alias("str"),
        (none if flag is None else flag).cast("boolean").alias("bool"),
    )


def truthy(v: Column) -> Column:
    return (
        F.when(v.tag.isin("undefined", "null"), False)
        .when(v.tag == "num", ~(F.isnan(v.num) | (v.num == 0)))
        .when(v.tag == "str", v.str != "")
        .otherwise(v.bool)
    )


def to_number(v: Column) -> Column:
    text = F.trim(v.str)
    return (
        F.when(v.tag == "num", v.num)
        .when(v.tag == "null", F.lit(0.0))
        .when(v.tag == "bool", v.bool.cast("double"))
        .when((v.tag == "str") & (text == ""), F.lit(0.0))
        .when((v.tag == "str") & text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), text.try_cast("double"))
        .otherwise(F.lit(float("nan")))
    )


def to_text(v: Column) -> Column:
    """Integral numbers below 2**53 print without a point; others as the shortest decimal that Java has."""
    whole = (v.num == F.floor(v.num)) & (F.abs(v.num) < 9007199254740992.0)
    return (
        F.when(v.tag == "str", v.str)
        .when(v.tag == "bool", v.bool.cast("string"))
        .when(v.tag.isin("null", "undefined"), v.tag)
        .when(F.isnan(v.num), "NaN")
        .when(F.abs(v.num) == float("inf"), F.when(v.num > 0, "Infinity").otherwise("-Infinity"))
        .when(whole, v.num.cast("long").cast("string"))
        .otherwise(v.num.cast("string"))
    )


def strictly_equal(a: Column, b: Column) -> Column:
    return (
        F.when(a.tag != b.tag, False)
        .when(a.tag == "num", (a.num == b.num) & ~F.isnan(a.num) & ~F.isnan(b.num))
        .when(a.tag == "str", a.str == b.str)
        .when(a.tag == "bool", a.bool == b.bool)
        .otherwise(True)
    )


def nullish(v: Column) -> Column:
    return v.tag.isin("undefined", "null")


def divide(a: Column, b: Column) -> Column:
    """Division with infinities and NaN in place of errors."""
    return F.when(b != 0, F.try_divide(a, b)).when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))


def binary(op: Column, a: Column, b: Column) -> Column:
    """The constant that an operator folds to, or null where it is not folded."""
    x, y = to_number(a), to_number(b)
    texts = (a.tag == "str") | (b.tag == "str")
    rel = ((a.tag == "num") & (b.tag == "num")) | ((a.tag == "str") & (b.tag == "str"))
    nan = F.isnan(a.num) | F.isnan(b.num)
    less = F.when(a.tag == "str", a.str < b.str).otherwise((a.num < b.num) & ~nan)
    more = F.when(a.tag == "str", a.str > b.str).otherwise((a.num > b.num) & ~nan)
    flag = lambda c: value("bool", flag=c)
    return (
        F.when((op == "+") & texts, value("str", text=F.concat(to_text(a), to_text(b))))
        .when(op == "+", value("num", num=x + y))
        .when(op == "-", value("num", num=x - y))
        .when(op == "*", value("num", num=x * y))
        .when(op == "/", value("num", num=divide(x, y)))
        .when(op == "===", flag(strictly_equal(a, b)))
        .when(op == "!==", flag(~strictly_equal(a, b)))
        .when((op == "<") & rel, flag(less))
        .when((op == ">") & rel, flag(more))
        .when(op == "&&", F.when(truthy(a), b).otherwise(a))
        .when(op == "||", F.when(truthy(a), a).otherwise(b))
        .when(op == "??", F.when(nullish(a), b).otherwise(a))
        .when(op == ",", b)
    )


def unary(op: Column, v: Column) -> Column:
    kind = F.when(v.tag == "num", "number").when(v.tag == "str", "string").when(v.tag == "bool", "boolean").when(v.tag == "undefined", "undefined").otherwise("object")
    return (
        F.when(op == "!", value("bool", flag=~truthy(v)))
        .when(op == "-", value("num", num=-to_number(v)))
        .when(op == "+", value("num", num=to_number(v)))
        .when(op == "typeof", value("str", text=kind))
        .when(op == "void", value("undefined"))
    )


def may_throw(kind: Column, detail: Column) -> Column:
    """Which operations may raise."""
    return (
        F.when(kind.isin("call", "new", "unknown", "property_write", "element_write", "compound_assign"), True)
        .when(kind == "property_read", detail != "optional")
        .when(kind == "unary", detail.isin("-", "+", "~"))
        .when(kind == "binary", ~detail.isin("===", "!==", ","))
        .otherwise(False)
    )


def shown(v: Column) -> Column:
    """tag:text of a value, for reports."""
    return F.when(v.isNotNull(), F.concat_ws(":", v.tag, to_text(v)))
