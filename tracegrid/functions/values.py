"""Value functions: non-finite numbers, categories, unsigned ranges, hashed uniforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrid.schema import UNSIGNED


def finite_or_null(v: Column) -> Column:
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def finite_or_null_array(a: Column) -> Column:
    return F.transform(a, finite_or_null)


def category_dictionary(rows: DataFrame, label_col: str, order_col: str) -> DataFrame:
    """(label, code): codes 1..K in the order in which labels are first seen; null has code 0 and no row. One row a label."""
    first = rows.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("label")).agg(F.min(order_col).alias("__first"))
    return first.select("label", F.row_number().over(Window.orderBy("__first", "label")).cast("int").alias("code"))


def extend_dictionary(dictionary: DataFrame, rows: DataFrame, label_col: str, order_col: str) -> DataFrame:
    """(label, code): codes given before stay; labels that ``rows`` brings follow in the order in which they are first seen."""
    fresh = rows.join(dictionary.select(F.col("label").alias("__label")), rows[label_col] == F.col("__label"), "left_anti")
    last = dictionary.agg(F.coalesce(F.max("code"), F.lit(0)).alias("__last"))
    added = category_dictionary(fresh, label_col, order_col).crossJoin(F.broadcast(last))  # one row
    return dictionary.select("label", "code").unionByName(added.select("label", (F.col("code") + F.col("__last")).cast("int").alias("code")))


def encode_category(rows: DataFrame, label_col: str, dictionary: DataFrame, code_col: str = "code") -> DataFrame:
    """Rows with the label's code: 0 for null. Labels that the dictionary lacks get null."""
    d = dictionary.select(F.col("label").alias("__label"), F.col("code").alias("__code"))
    out = rows.join(d, rows[label_col] == d["__label"], "left")
    return out.withColumn(code_col, F.when(F.col(label_col).isNull(), 0).otherwise(F.col("__code"))).drop("__label", "__code")


def decode_category(rows: DataFrame, code_col: str, dictionary: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows with the code's label; null for code 0 and unknown codes."""
    d = dictionary.select(F.col("label").alias("__label"), F.col("code").alias("__code"))
    return rows.join(d, rows[code_col] == d["__code"], "left").withColumn(label_col, F.col("__label")).drop("__label", "__code")


def packed_bits(flags: Column) -> Column:
    """Up to 63 booleans as the bits of a LONG, the first lowest; null counts as false."""
    place = F.transform(flags, lambda x, i: F.when(x, F.expr("1L") * F.pow(F.lit(2), i).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(place, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def bits_shared(a: Column, b: Column) -> Column:
    """How many bits two packed masks have in common."""
    return F.bit_count(a.bitwiseAND(b)).cast("int")


def quoted_name(name: Column, suffix: str = "") -> Column:
    """A name as it may stand in a file name: what is not a letter or digit is percent-encoded, blanks included."""
    return F.concat(F.regexp_replace(F.url_encode(name), r"\+", "%20"), F.lit(suffix))


def in_unsigned_range(v: Column, storage: str) -> Column:
    return v.between(0, UNSIGNED[storage])


def hashed_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys only: the top 53 bits of a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def hashed_normal(seed: int, *keys: Column) -> Column:
    u, v = hashed_uniform(seed, *keys, F.lit("u")), hashed_uniform(seed, *keys, F.lit("v"))
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * F.pi() * v)
