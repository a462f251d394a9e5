"""Value counts of many columns in one shuffle, and what follows from them.

Where only numbers of values are wanted, or the commonest ones, long texts are not shuffled to be counted: their 64-bit codes are.
A code that occurs once is a value that occurs once. Only the texts of codes that occur again are then counted themselves, so that
results are exact although two texts may share a code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.columns import value

#: Bytes up to which a text is no longer than what would stand for it.
SHORT = 32
#: Codes that occur more than once are broadcast up to this number (16 bytes each), joined by a shuffle beyond it.
BROADCAST_CODES = 2_000_000


def plain(df: DataFrame, name: str) -> Column:
    """The value with -0.0 read as 0.0, so that equal numbers have equal text."""
    c = value(df, name)
    return c + F.lit(0.0) if df.schema[name].dataType.typeName() in ("double", "float") else c


def _cell(df: DataFrame, name: str) -> Column:
    """The value in the slot of its kind, so that numbers are grouped as numbers and not as text."""
    dtype = df.schema[name].dataType
    c = plain(df, name)
    whole, real, text = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dtype, T.IntegralType):
        whole = c.cast("long")
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        real = c.cast("double")
    else:
        text = c.cast("string")
    return F.struct(whole.alias("whole"), real.alias("real"), text.alias("text"))


def value_counts(df: DataFrame, columns: list[str], keep_null: bool = False) -> DataFrame:
    """Rows (column, value as text, number, n): how often each value occurs in each column.

    All columns share one aggregation; rows are combined before the shuffle, so a value that fills a
    third of the table costs one row per task. `number` orders numeric values by size.
    """
    cells = df.select(*[_cell(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    tall = cells.unpivot([], cells.columns, "slot", "cell").select(
        "slot", F.col("cell.whole").alias("whole"), F.col("cell.real").alias("real"), F.col("cell.text").alias("text"))
    if not keep_null:
        tall = tall.where("whole is not null or real is not null or text is not null")
    counted = tall.groupBy("slot", "whole", "real", "text").agg(F.count("*").alias("n"))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.substring("slot", 2, 9).cast("int") + 1)
    decimals = [f"c{i}" for i, c in enumerate(columns) if isinstance(df.schema[c].dataType, T.DecimalType)]
    number = F.coalesce("real", F.col("whole").cast("double"),
                        F.when(F.col("slot").isin(decimals), F.col("text").try_cast("double")))
    value = F.coalesce("text", F.col("whole").cast("string"), F.col("real").cast("string"))
    return counted.select(name.alias("column"), value.alias("value"), number.alias("number"), "n")


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The k commonest values per column; ties by value. Spark prunes to k per task before the shuffle."""
    order = W.partitionBy("column").orderBy(F.desc("n"), F.asc("number"), F.asc("value"))
    ranked = counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    return ranked.select("column", "position", "value", "n")


def distinct_counts(counts: DataFrame) -> DataFrame:
    """Per column: distinct non-null values and values that occur exactly once."""
    present = counts.where(F.col("value").isNotNull())
    return present.groupBy("column").agg(
        F.count("*").alias("distinct_count"), F.count_if(F.col("n") == 1).alias("singleton_count"))


def _tall(df: DataFrame, columns: list[str], wanted: list[int], fields: list[str]) -> DataFrame:
    """Rows (slot, fields...) of the cells of the wanted columns that are not null; the slot is the place in `columns`."""
    cells = df.select(*[_cell(df, columns[i]).alias(f"c{i}") for i in wanted])
    tall = cells.unpivot([], cells.columns, "slot", "cell")
    return tall.where(" or ".join(f"cell.{f} is not null" for f in fields)).select(F.substring("slot", 2, 9).cast("int").alias("slot"), *[f"cell.{f}" for f in fields])


def _texts(df: DataFrame, columns: list[str], wanted: list[int] | None = None) -> DataFrame | None:
    """Rows (slot, word, code, text) of the values that are grouped as text: a short one is its own word, a longer one has the code
    that is its hash."""
    wanted = [i for i, c in enumerate(columns) if not _is_number(df, c)] if wanted is None else wanted
    if not wanted:
        return None
    short = F.octet_length("text") <= SHORT
    return _tall(df, columns, wanted, ["text"]).select("slot", F.when(short, F.col("text")).alias("word"), F.when(~short, F.xxhash64("text")).alias("code"), "text")


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.IntegralType, T.DoubleType, T.FloatType))


def _code_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """How often each number, word and code occurs: numbers are grouped by keys of fixed width, apart from texts."""
    parts = []
    for fields, kinds in ((["whole"], T.IntegralType), (["real"], (T.DoubleType, T.FloatType))):
        wanted = [i for i, c in enumerate(columns) if isinstance(df.schema[c].dataType, kinds)]
        if wanted:
            parts.append(_tall(df, columns, wanted, fields).groupBy("slot", *fields).agg(F.count("*").alias("n")))
    texts = _texts(df, columns)
    if texts is not None:
        parts.append(texts.groupBy("slot", "word", "code").agg(F.count("*").alias("n")))
    kinds = {"slot": "int", "whole": "long", "real": "double", "word": "string", "code": "long", "n": "long"}
    full = [p.select(*[F.col(c) if c in p.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]) for p in parts]
    out = full[0]
    for p in full[1:]:
        out = out.unionByName(p)
    return out


MANY = "code is not null and n > 1"


def _again(rows: DataFrame, codes: DataFrame, by: list[str], n_codes: int, how: str = "left_semi") -> DataFrame:
    """The rows whose code is among the `n_codes` of `codes`, or is not (left_anti)."""
    return rows.join(F.broadcast(codes) if n_codes <= BROADCAST_CODES else codes, by, how)


def distinct_map(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    """(distinct, singletons) per column, on the driver: one row per column."""
    if not columns:
        return {}
    told = _code_counts(df, columns).groupBy("slot").agg(
        F.count_if(~F.expr(MANY)).alias("d"), F.count_if(F.col("n") == 1).alias("s"), F.count_if(F.expr(MANY)).alias("many")).collect()
    found = {r["slot"]: (r["d"], r["s"]) for r in told}
    many = {r["slot"]: r["many"] for r in told if r["many"]}
    if many:  # long texts whose code occurs again
        long = _texts(df, columns, sorted(many)).where("code is not null")
        codes = long.groupBy("slot", "code").agg(F.count("*").alias("n")).where("n > 1").select("slot", "code")
        exact = _again(long, codes, ["slot", "code"], sum(many.values())).groupBy("slot", "text").agg(F.count("*").alias("n"))
        for r in exact.groupBy("slot").agg(F.count("*").alias("d"), F.count_if(F.col("n") == 1).alias("s")).collect():
            found[r["slot"]] = found[r["slot"]][0] + r["d"], found[r["slot"]][1] + r["s"]
    return {c: found.get(i, (0, 0)) for i, c in enumerate(columns)}


def commonest(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """`top_values` of the columns: numbers and short texts are counted as they are, long ones if their code occurs again, and the
    least of the others fill up."""
    counts = _code_counts(df, columns)
    n_long, n_many = counts.agg(F.count("code"), F.count_if(F.expr(MANY))).first()
    told = counts.where("code is null").select("slot", F.coalesce("word", F.col("whole").cast("string"), F.col("real").cast("string")).alias("value"),
                                               F.coalesce("real", F.col("whole").cast("double")).alias("number"), "n")
    if n_long:
        long, codes = _texts(df, columns).where("code is not null"), counts.where(MANY).select("slot", "code")
        again = _again(long, codes, ["slot", "code"], n_many).groupBy("slot", "text").agg(F.count("*").alias("n"))
        once = _again(long, codes, ["slot", "code"], n_many, "left_anti")
        least = once.withColumn("p", F.row_number().over(W.partitionBy("slot").orderBy("text"))).where(F.col("p") <= k)  # k of a task leave it
        worded = again.unionByName(least.select("slot", "text", F.lit(1).cast("long").alias("n")))
        told = told.unionByName(worded.select("slot", F.col("text").alias("value"), F.lit(None).cast("double").alias("number"), "n"))
    decimals = [i for i, c in enumerate(columns) if isinstance(df.schema[c].dataType, T.DecimalType)]
    number = F.coalesce("number", F.when(F.col("slot").isin(decimals), F.col("value").try_cast("double"))) if decimals else F.col("number")
    return top_values(told.select(F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("slot") + 1).alias("column"), "value", number.alias("number"), "n"), k)


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Commonest value per column in the column's own type; ties give the smallest value."""
    if not columns:
        return {}
    counts = value_counts(df, columns)
    best = counts.groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("number"), F.col("value"))).alias("best"))
    texts = {r["column"]: r["best"]["value"] for r in best.collect()}
    if not texts:
        return {}
    typed = df.sparkSession.range(1).select(
        *[F.lit(texts[c]).cast(df.schema[c].dataType).alias(c) for c in texts]).first()
    return typed.asDict()


def duplicate_rows(df: DataFrame, subset: list[str] | None = None) -> int:
    """Extra copies: rows beyond the first of each group. Null keys equal each other. With texts among the keys, codes of the rows
    are counted first, and only rows whose code occurs again are compared in full."""
    names = subset or df.columns
    keys = [plain(df, c).alias(f"k{i}") for i, c in enumerate(names)]
    rows, by = df.select(*keys), [f"k{i}" for i in range(len(keys))]
    extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long")
    if all(isinstance(df.schema[c].dataType, (T.NumericType, T.DatetimeType, T.BooleanType)) for c in names):
        return rows.groupBy(*by).agg(F.count("*").alias("n")).agg(extra).first()[0]
    coded = rows.withColumn("code", F.xxhash64(*by, F.concat(*[F.col(k).isNull().cast("string") for k in by])))
    again = coded.select("code").groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code")
    n_codes = again.count()
    if not n_codes:
        return 0
    return _again(coded, again, ["code"], n_codes).groupBy(*by).agg(F.count("*").alias("n")).agg(extra).first()[0]


def few_values(df: DataFrame, limit: int = 15) -> DataFrame:
    """Columns with 1 to `limit` distinct non-null values, and those values.

    A sketch first rules out columns that are clearly wider; the rest are counted exactly.
    """
    row = df.agg(*[F.approx_count_distinct(plain(df, c).cast("string")).alias(f"d{i}")
                   for i, c in enumerate(df.columns)]).first()
    narrow = [c for i, c in enumerate(df.columns) if row[i] <= 4 * limit]
    schema = "column string, distinct_count bigint, values array<string>"
    if not narrow:
        return df.sparkSession.createDataFrame([], schema)
    firsts = top_values(value_counts(df, narrow), limit + 1)
    grouped = firsts.groupBy("column").agg(
        F.count("*").alias("distinct_count"), F.sort_array(F.collect_list("value")).alias("values"))
    return grouped.where(F.col("distinct_count") <= limit)


def value_list(df: DataFrame, name: str, limit: int | None) -> list:
    """Sorted distinct non-null values; more than `limit`, where one is given, raise an error."""
    found = df.select(plain(df, name).alias("v")).where(F.col("v").isNotNull()).distinct()
    rows = (found if limit is None else found.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"column {name!r} has more than {limit} distinct values")
    return sorted(r["v"] for r in rows)
