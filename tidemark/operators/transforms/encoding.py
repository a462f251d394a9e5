"""Encode categories as numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...functions.columns import as_double, col, is_numeric, pick_columns, text_columns, value
from ...sources.scratch import settle
from .. import ordering, values
from ..lookup import category_table, lookup
from .result import TransformResult, choose_method, names

METHODS = ["one_hot", "one_hot_sparse", "label", "ordinal", "target", "frequency", "binary"]


#: Values up to which `one_hot` makes a column each.
MAX_COLUMNS = 10_000


def _at_most(df: DataFrame, name: str, most: int) -> bool:
    """Whether a column has at most so many values; no value leaves the cluster."""
    return df.where(value(df, name).isNotNull()).select(col(name)).distinct().limit(most + 1).count() <= most


def one_hot(df: DataFrame, name: str, prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """A 0/1 column per value, sorted; null is 0 everywhere. Over `limit` values, where one is given, is an error. The values come
    to the driver, since they are column names; `one_hot_sparse` is for columns of very many values."""
    found = values.value_list(df, name, limit)
    flags = [F.coalesce((value(df, name) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix or name}_{v}")
             for v in found]
    return df.select("*", *flags)


def _codes(df: DataFrame, name: str, out: str, missing: int) -> DataFrame:
    """Rank of the value among the sorted distinct values."""
    table = category_table(df, name)
    ranked = ordering.row_numbers(table, [name], out="__code")
    coded = lookup(df, name, ranked, ["__code"])
    return coded.withColumn(out, F.coalesce(F.col("__code") - 1, F.lit(missing)).cast("int")).drop("__code")


def one_hot_index(df: DataFrame, name: str) -> DataFrame:
    """position (from 0, in sorted order), value and n (rows) of every value: the table that tells what the places of
    `one_hot_sparse` stand for. Positions come from range partitions, nothing is collected."""
    ranked = ordering.row_numbers(category_table(df, name), [name], out="position")
    return ranked.select((F.col("position") - 1).alias("position"), col(name).alias("value"), "n")


def one_hot_sparse(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """One column struct<size, indices, values> in place of a column per value: `indices` holds the value's position in
    `one_hot_index`, and nothing for null. However many values there are, the schema stays, and the values stay on the cluster."""
    table = settle(one_hot_index(df, name))
    size = table.count()
    coded = lookup(df, name, table.select(col("value").alias(name), "n", "position"), ["position"], settled=True)
    known = F.col("position").isNotNull()
    vector = F.struct(F.lit(size).cast("long").alias("size"),
                      F.when(known, F.array("position")).otherwise(F.array().cast("array<bigint>")).alias("indices"),
                      F.when(known, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("values"))
    return coded.withColumn(out or f"{name}_one_hot", vector).drop("position")


def label(df: DataFrame, name: str) -> DataFrame:
    return _codes(df, name, f"{name}_encoded", 0)


def ordinal(df: DataFrame, name: str, order: list) -> DataFrame:
    """Place in the given order; values outside it, and null, are 0. Without an order: label codes."""
    out = f"{name}_ordinal"
    if not order:
        return _codes(df, name, out, 0)
    place = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)])
    return df.withColumn(out, F.coalesce(F.try_element_at(place, col(name)), F.lit(0)).cast("int"))


def target(df: DataFrame, name: str, goal: str) -> DataFrame:
    """Mean of a numeric goal per value (overall mean for null), or the commonest class of a text goal."""
    if not goal or goal not in df.columns:
        return frequency(df, name)
    out = f"{name}_target_enc"
    if is_numeric(df.schema[goal].dataType):
        number = as_double(df, goal)
        table = category_table(df, name, F.avg(number).alias(out))
        overall = df.agg(F.avg(number)).first()[0]
        return lookup(df, name, table, [out]).withColumn(out, F.coalesce(col(out), F.lit(overall)))
    pairs = df.where(value(df, name).isNotNull() & value(df, goal).isNotNull()) \
        .groupBy(col(name).alias(name), col(goal).alias("__goal")).agg(F.count("*").alias("__m"))
    best = pairs.groupBy(col(name)).agg(
        F.sum("__m").alias("n"), F.min(F.struct(-F.col("__m"), F.col("__goal")))["__goal"].alias(out))
    return lookup(df, name, best, [out])


def frequency(df: DataFrame, name: str) -> DataFrame:
    """Share of the value among non-null values; null is 0."""
    out = f"{name}_freq"
    table = category_table(df, name)
    total = table.agg(F.sum("n")).first()[0] or 1
    shares = table.withColumn(out, F.col("n") / F.lit(total))
    return lookup(df, name, shares, [out]).withColumn(out, F.coalesce(col(out), F.lit(0.0)))


def binary(df: DataFrame, name: str) -> DataFrame:
    """Codes in sorted order with null as -1: 0/1 for a two-valued column."""
    return _codes(df, name, f"{name}_binary", -1)


def encode(df: DataFrame, config: dict) -> TransformResult:
    """Config: column/columns (default all text), method (label), categories/order, target_column,
    drop_original (true), prefix, max_columns (one_hot: beyond so many values, one sparse vector column in place of a column each)."""
    method = choose_method(config, METHODS, "label")
    wanted = pick_columns(df, config, text_columns(df))
    if not wanted:
        return TransformResult(df, note="No categorical columns found to encode")
    out, created = df, {}
    for c in wanted:
        before = set(out.columns)
        if method == "one_hot" and _at_most(out, c, int(config.get("max_columns", MAX_COLUMNS))):
            out = one_hot(out, c, config.get("prefix"))
        elif method in ("one_hot", "one_hot_sparse"):
            out = one_hot_sparse(out, c, f"{config.get('prefix') or c}_one_hot")
        elif method == "ordinal":
            out = ordinal(out, c, names(config.get("categories", config.get("order"))))
        elif method == "target":
            out = target(out, c, config.get("target_column", ""))
        else:
            out = {"label": label, "frequency": frequency, "binary": binary}[method](out, c)
        created[c] = [x for x in out.columns if x not in before]
        if config.get("drop_original", True):
            out = out.drop(c)
    new = sum(len(v) for v in created.values())
    return TransformResult(out, columns_affected=wanted, measure=lambda: {
        "rows_affected": df.count(),
        "details": {c: {"method": method, "new_columns": v} for c, v in created.items()},
        "message": f"Encoded {len(wanted)} columns using {method}: {new} new columns created"})
