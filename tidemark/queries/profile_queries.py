"""Types, profiles, value counts and exploratory analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import as_double, select_class
from ..operators import eda, onehot, profile, quantiles, readiness, values
from .registry import GAPPY, gappy, load, query, rounded

MIXED = """m AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' END AS flag,
    CAST(o_totalprice AS VARCHAR) AS price_text, strftime(o_orderdate, '%Y-%m-%d') AS day_text,
    o_orderpriority AS label, o_orderdate AS day FROM orders)"""


def mixed(spark, sf):
    o = load(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"),
                    F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").alias("flag"),
                    F.col("o_totalprice").cast("string").alias("price_text"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"),
                    F.col("o_orderpriority").alias("label"), F.col("o_orderdate").alias("day"))


@query("type_detection", f"""WITH {MIXED}, t AS (
      SELECT * FROM (SELECT 'id' AS c, id::VARCHAR AS v FROM m UNION ALL SELECT 'flag', flag FROM m UNION ALL SELECT 'price_text', price_text FROM m
      UNION ALL SELECT 'day_text', day_text FROM m UNION ALL SELECT 'label', label FROM m UNION ALL SELECT 'day', day::VARCHAR FROM m) WHERE v IS NOT NULL),
    a AS (SELECT c, count(*) n, count(*) FILTER (WHERE lower(trim(v)) IN ('true','false','yes','no','0','1','t','f','y','n')) b,
      count(try_cast(v AS DOUBLE)) x, count(*) FILTER (WHERE try_cast(v AS DOUBLE) = floor(try_cast(v AS DOUBLE))) w,
      count(try_cast(v AS TIMESTAMP)) d FROM t GROUP BY c)
    SELECT c AS "column", CASE WHEN b = n THEN 'boolean' WHEN x = n THEN CASE WHEN w = n THEN 'integer' ELSE 'float' END
      WHEN d > 0.8 * n THEN 'datetime' ELSE 'string' END AS type FROM a""")
def type_detection(spark, sf):
    return spark.createDataFrame(list(profile.detect_types(mixed(spark, sf)).items()), "column string, type string")


@query("columns_by_class", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def columns_by_class(spark, sf):
    return select_class(load(spark, sf, "orders"), "numeric")


@query("value_hints", """
    SELECT 'event_type' AS "column", count(DISTINCT event_type) AS distinct_count,
      string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS "values" FROM events""")
def value_hints(spark, sf):
    found = values.few_values(load(spark, sf, "events").select("event_id", "event_type", "value"))
    return found.withColumn("values", F.concat_ws(",", "values"))


def profile_sql(column: str, kind: str, table: str) -> str:
    number = f"""min({column})::DOUBLE AS "min", max({column})::DOUBLE AS "max", pround(avg({column}), 2) AS mean,
        pround(median({column}), 2)::DOUBLE AS median, pround(stddev_samp({column}), 2) AS stddev, NULL::INT AS min_length, NULL::INT AS max_length"""
    text = f"""NULL::DOUBLE AS "min", NULL::DOUBLE AS "max", NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS stddev,
        min(length({column}))::INT AS min_length, max(length({column}))::INT AS max_length"""
    other = text.replace(f"min(length({column}))::INT", "NULL::INT").replace(f"max(length({column}))::INT", "NULL::INT")
    body = {"integer": number, "float": number, "string": text}.get(kind, other)
    return f"""SELECT '{column}' AS "column", '{kind}' AS type, count(*) - count({column}) AS null_count,
      pround((count(*) - count({column}))::DOUBLE / count(*) * 100, 2) AS null_percent, count(DISTINCT {column}) AS unique_count,
      (SELECT count(*) FROM (SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) = 1)) AS distinct_count,
      {body} FROM {table}"""


@query("ingest_profile", f"WITH {GAPPY} " + " UNION ALL ".join([
    profile_sql("o_orderkey", "integer", "g"), profile_sql("o_custkey", "integer", "g"), profile_sql("o_orderstatus", "string", "g"),
    profile_sql("o_totalprice", "float", "g"), profile_sql("o_orderdate", "datetime", "g"), profile_sql("o_orderpriority", "string", "g")]))
def ingest_profile(spark, sf):
    return profile.ingest_profile(gappy(spark, sf))


def stats_sql(column: str, dtype: str, table: str, numeric: bool) -> str:
    number = f"""min({column})::DOUBLE AS "min", max({column})::DOUBLE AS "max", pround(avg({column}), 4) AS mean, pround(median({column})::DOUBLE, 4) AS median,
        pround(stddev_samp({column}), 4) AS std"""
    none = 'NULL::DOUBLE AS "min", NULL::DOUBLE AS "max", NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS std'
    return f"""SELECT '{column}' AS "column", '{dtype}' AS dtype, count(*) - count({column}) AS null_count,
      pround((count(*) - count({column}))::DOUBLE / count(*) * 100, 2) AS null_percent, count(DISTINCT {column}) AS unique_count,
      count({column}) AS non_null, {number if numeric else none} FROM {table}"""


@query("data_profile", " UNION ALL ".join([
    stats_sql("l_orderkey", "bigint", "lineitem", True), stats_sql("l_quantity", "double", "lineitem", True),
    stats_sql("l_extendedprice", "double", "lineitem", True), stats_sql("l_discount", "double", "lineitem", True),
    stats_sql("l_returnflag", "string", "lineitem", False), stats_sql("l_linestatus", "string", "lineitem", False)]))
def data_profile(spark, sf):
    df = load(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    return rounded(profile.data_profile(df).drop("top_values"), 4)


@query("text_profile", " UNION ALL ".join(f"""
    SELECT '{t}' AS "table", '{c}' AS "column", count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, count({c}) AS non_null,
      (SELECT list(v || ':' || n ORDER BY n DESC, v) FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5)) AS top_values,
      (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) FROM {t}) AS duplicate_rows
    FROM {t}""" for t, cs in (("documents", ("text", "lang", "source")), ("pages", ("url", "html"))) for c in cs))
def text_profile(spark, sf):
    """Long texts: distinct values, commonest values and duplicate rows of whole tables."""
    parts = []
    for t in ("documents", "pages"):
        df = load(spark, sf, t)
        told = profile.data_profile(df).where(F.col("dtype") == "string")
        parts.append(told.select(F.lit(t).alias("table"), "column", "null_count", "unique_count", "non_null",
                                 F.transform("top_values", lambda x: F.concat(x["value"], F.lit(":"), x["n"].cast("string"))).alias("top_values"),
                                 F.lit(values.duplicate_rows(df)).alias("duplicate_rows")))
    return parts[0].unionByName(parts[1])


@query("snapshot_stats", f"""WITH {GAPPY}
    SELECT 'o_totalprice' AS "column", count(*) AS total_count, count(*) - count(o_totalprice) AS null_count,
      pround((count(*) - count(o_totalprice))::DOUBLE / count(*) * 100, 2) AS null_pct, count(DISTINCT o_totalprice) AS unique_count,
      pround(min(o_totalprice), 4) AS "min", pround(max(o_totalprice), 4) AS "max", pround(avg(o_totalprice), 4) AS mean,
      pround(median(o_totalprice), 4) AS median, pround(stddev_samp(o_totalprice), 4) AS std,
      pround(quantile_cont(o_totalprice, 0.25), 4) AS q25, pround(quantile_cont(o_totalprice, 0.75), 4) AS q75 FROM g""")
def snapshot_stats(spark, sf):
    return rounded(profile.snapshot_stats(gappy(spark, sf), ["o_totalprice"]).drop("top_values"), 4)


@query("top_values_per_column", """
    SELECT "column", position, value, n FROM (
      SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INTEGER AS position, value, n FROM (
        SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2
        UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
        UNION ALL SELECT 'l_shipdate', strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), count(*) FROM lineitem GROUP BY 2)) WHERE position <= 5""")
def top_values_per_column(spark, sf):
    df = load(spark, sf, "lineitem")
    return values.top_values(values.value_counts(df, ["l_returnflag", "l_linestatus", "l_shipdate"]), 5)


@query("exact_quantiles", " UNION ALL ".join(
    f"""SELECT {p}::DOUBLE AS p, pround(quantile_cont(l_extendedprice, {p}), 4) AS price,
        pround(quantile_cont(l_quantity, {p}), 4) AS quantity FROM lineitem""" for p in (0.01, 0.25, 0.5, 0.75, 0.99)))
def exact_quantiles(spark, sf):
    df = load(spark, sf, "lineitem")
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    q = quantiles.quantiles(df, {c: as_double(df, c) for c in ("l_extendedprice", "l_quantity")}, probs)
    rows = list(zip(probs, q["l_extendedprice"], q["l_quantity"]))
    return rounded(spark.createDataFrame(rows, "p double, price double, quantity double"), 4)


# ---- exploratory analysis -------------------------------------------------------------------------------

LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINES_SQL = "x AS (SELECT " + ", ".join(LINES) + " FROM lineitem)"
NUMBERS = LINES[:4]


def lines(spark, sf):
    return eda.Exploration(load(spark, sf, "lineitem").select(*LINES))


@query("eda_overview", f"""WITH {GAPPY}, y AS (SELECT o_custkey, o_totalprice, o_orderpriority, o_orderstatus, o_orderdate FROM g),
    dup AS (SELECT sum(c - 1)::BIGINT d FROM (SELECT count(*) c FROM y GROUP BY o_custkey, o_totalprice, o_orderpriority, o_orderstatus, o_orderdate)),
    a AS (SELECT count(*) n, count(*) - count(o_totalprice) + count(*) - count(o_orderpriority) gaps FROM y)
    SELECT n AS rows, 5::BIGINT AS columns, 2::BIGINT AS numeric_columns, 2::BIGINT AS categorical_columns, 1::BIGINT AS datetime_columns,
      d AS duplicate_rows, pround(d::DOUBLE / n * 100, 2) AS duplicate_pct, gaps AS total_missing,
      pround(gaps::DOUBLE / (n * 5) * 100, 2) AS total_missing_pct FROM a, dup""")
def eda_overview(spark, sf):
    df = gappy(spark, sf).select("o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate")
    return eda.overview(eda.Exploration(df))


def shape(c: str, table: str) -> str:
    return f"""SELECT '{c}' AS "column", pround(avg({c}), 4) AS mean, pround(median({c})::DOUBLE, 4) AS median,
      pround(stddev_samp({c}), 4) AS std, pround(skewness({c}), 4) AS skewness, pround(kurtosis({c}), 4) AS kurtosis,
      pround(quantile_cont({c}, 0.25), 4) AS q1, pround(quantile_cont({c}, 0.75), 4) AS q3,
      pround(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr, count(DISTINCT {c}) AS unique_count,
      pround(count(DISTINCT {c})::DOUBLE / count({c}) * 100, 2) AS unique_pct FROM {table}"""


HINT = """CASE WHEN abs(skewness) < 0.5 AND abs(kurtosis) < 1 THEN 'approximately_normal' WHEN skewness > 1 THEN 'right_skewed'
    WHEN skewness < -1 THEN 'left_skewed' ELSE 'moderately_skewed' END"""


@query("eda_column_profiles", f"WITH {LINES_SQL}, s AS (" + " UNION ALL ".join(shape(c, "x") for c in NUMBERS) +
       f") SELECT *, {HINT} AS distribution_hint FROM s")
def eda_column_profiles(spark, sf):
    whole = eda.column_profiles(lines(spark, sf)).where(F.col("column").isin(NUMBERS))
    return rounded(whole.select("column", "mean", "median", "std", "skewness", "kurtosis", "q1", "q3", "iqr", "unique_count",
                                "unique_pct", "distribution_hint"), 4)


@query("eda_categorical_profiles", f"WITH {LINES_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count, count(DISTINCT {c})::DOUBLE / count({c}) < 0.05 AS is_categorical,
        (SELECT string_agg(v || '=' || n, ',' ORDER BY n DESC, v) FROM (SELECT {c} v, count(*) n FROM x GROUP BY 1 ORDER BY n DESC, v LIMIT 10)) AS top FROM x"""
    for c in ("l_returnflag", "l_linestatus")))
def eda_categorical_profiles(spark, sf):
    whole = eda.column_profiles(lines(spark, sf)).where(F.col("column").isin("l_returnflag", "l_linestatus"))
    shown = F.transform("top_values", lambda t: F.concat(t["value"], F.lit("="), t["n"].cast("string")))
    return whole.select("column", "unique_count", "is_categorical", F.concat_ws(",", shown).alias("top"))


PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]]
PAIR_SQL = "c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col1, '{b}' AS col2, pround(corr({a}, {b}), 4) + 0.0 AS correlation FROM lineitem" for a, b in PAIRS) + ")"


@query("eda_correlations", f"WITH {PAIR_SQL} SELECT * FROM c")
def eda_correlations(spark, sf):
    return rounded(eda.correlation_pairs(lines(spark, sf)), 4)


@query("eda_correlation_matrix", f"WITH {PAIR_SQL}, f AS (SELECT * FROM c UNION ALL SELECT col2, col1, correlation FROM c UNION ALL " +
       " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0" for c in NUMBERS) + """) SELECT col1 AS "column", """ +
       ", ".join(f"max(correlation) FILTER (WHERE col2 = '{c}') AS {c}" for c in NUMBERS) + " FROM f GROUP BY col1")
def eda_correlation_matrix(spark, sf):
    return rounded(eda.correlation_matrix(lines(spark, sf)), 4)


@query("eda_strong_correlations", f"WITH {PAIR_SQL} SELECT *, CASE WHEN correlation > 0 THEN 'strong_positive' ELSE 'strong_negative' END AS strength "
       "FROM c WHERE abs(correlation) > 0.7")
def eda_strong_correlations(spark, sf):
    return eda.strong_correlations(lines(spark, sf))


@query("eda_moderate_correlations", f"WITH {PAIR_SQL} SELECT * FROM c WHERE abs(correlation) > 0.3 ORDER BY abs(correlation) DESC")
def eda_moderate_correlations(spark, sf):
    return eda.moderate_correlations(lines(spark, sf))


@query("eda_missing_analysis", f"WITH {GAPPY} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS count, pround((count(*) - count({c}))::DOUBLE / count(*) * 100, 2) AS percent
        FROM g HAVING count(*) > count({c})""" for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")))
def eda_missing_analysis(spark, sf):
    return eda.missing_analysis(eda.Exploration(gappy(spark, sf)))


@query("eda_histogram", "WITH " + ", ".join(f"""h_{c} AS (SELECT least(floor((v - lo) / (hi - lo) * 20), 19)::INT AS bin, count(*) n, any_value(lo) lo, any_value(hi) hi
      FROM (SELECT {c} v, min({c}) OVER () lo, max({c}) OVER () hi FROM lineitem) GROUP BY 1)""" for c in NUMBERS) + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", b::INT AS bin, pround(lo + b * ((hi - lo) / 20), 4) AS low,
        pround(CASE WHEN b = 19 THEN hi ELSE lo + (b + 1) * ((hi - lo) / 20) END, 4) AS high, coalesce(n, 0)::BIGINT AS count
        FROM range(20) r(b) CROSS JOIN (SELECT any_value(lo) lo, any_value(hi) hi FROM h_{c}) LEFT JOIN (SELECT bin, n FROM h_{c}) ON bin = b"""
    for c in NUMBERS))
def eda_histogram(spark, sf):
    return eda.histogram(lines(spark, sf))


@query("eda_distributions", "WITH s AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", skewness({c}) AS g1, kurtosis({c}) AS g2 FROM lineitem""" for c in NUMBERS) +
    """) SELECT "column", pround(g1, 4) + 0.0 AS skewness, pround(g2, 4) + 0.0 AS kurtosis, abs(g1) < 0.5 AND abs(g2) < 1 AS is_normal FROM s""")
def eda_distributions(spark, sf):
    return rounded(eda.distributions(lines(spark, sf)), 4)


def fences(c: str, table: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS iqr_outliers,
      pround((count(*) FILTER (WHERE {c} < lo OR {c} > hi))::DOUBLE / count({c}) * 100, 2) AS iqr_pct,
      count(*) FILTER (WHERE abs({c} - mu) / sd > 3) AS zscore_outliers,
      pround((count(*) FILTER (WHERE abs({c} - mu) / sd > 3))::DOUBLE / count({c}) * 100, 2) AS zscore_pct,
      pround(any_value(lo), 4) AS lower_fence, pround(any_value(hi), 4) AS upper_fence
      FROM {table}, (SELECT q1 - 1.5 * (q3 - q1) lo, q3 + 1.5 * (q3 - q1) hi, mu, sd FROM (
        SELECT quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.75) q3, avg({c}) mu, stddev_samp({c}) sd FROM {table}))"""


@query("eda_outlier_summary", " UNION ALL ".join(fences(c, "lineitem") for c in NUMBERS))
def eda_outlier_summary(spark, sf):
    return rounded(eda.outlier_summary(lines(spark, sf)), 4)


@query("eda_insights", """WITH n AS (SELECT count(*) n FROM customer), d AS (SELECT count(DISTINCT c_name) d FROM customer)
    SELECT 'info' AS type, 'cardinality' AS category, 'c_name' AS "column" FROM n, d WHERE d::DOUBLE / n > 0.9
    UNION ALL SELECT 'warning', 'zero_variance', 'country' FROM n
    UNION ALL SELECT 'warning', 'multicollinearity', 'c_acctbal,doubled' FROM n""")
def eda_insights(spark, sf):
    df = load(spark, sf, "customer").select("c_name", "c_nationkey", "c_acctbal", (F.col("c_acctbal") * 2).alias("doubled"),
                                            "c_mktsegment", F.lit("X").alias("country"))
    return eda.insights(eda.Exploration(df)).drop("message")


@query("eda_warnings", f"""WITH {GAPPY} SELECT 'critical' AS level, 'spare' AS "column", 'Column ''spare'' is entirely null' AS message
    FROM (SELECT count(*) n FROM g) WHERE n > 0""")
def eda_warnings(spark, sf):
    df = gappy(spark, sf).withColumn("spare", F.lit(None).cast("double"))
    return eda.warnings(eda.Exploration(df))


@query("eda_report", """SELECT 'overview' AS section, 1::BIGINT AS rows UNION ALL SELECT 'column_profiles', 4 UNION ALL SELECT 'correlations', 1
    UNION ALL SELECT 'high_correlations', (abs(pround(corr(c_custkey, c_acctbal), 4)) > 0.7)::BIGINT FROM customer
    UNION ALL SELECT 'missing_analysis', 0 UNION ALL SELECT 'histograms', 40 UNION ALL SELECT 'distributions', 2
    UNION ALL SELECT 'outlier_summary', 2 UNION ALL SELECT 'insights', (count(DISTINCT c_name)::DOUBLE / count(*) > 0.9)::BIGINT FROM customer
    UNION ALL SELECT 'warnings', 0""")
def eda_report(spark, sf):
    sections = eda.report(load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))
    whole = None
    for name, part in sections.items():
        counted = part.agg(F.count("*").alias("rows")).select(F.lit(name).alias("section"), "rows")
        whole = counted if whole is None else whole.unionByName(counted)
    return whole


# ---- readiness ------------------------------------------------------------------------------------------

def dimension(name: str, score: str, source: str) -> str:
    return f"SELECT '{name}' AS dimension, pround(({score})::DOUBLE, 4) AS score FROM {source}"


READY = f"""WITH {GAPPY}, y AS (SELECT o_custkey, o_totalprice, o_totalprice * 2 AS twice, o_orderpriority, o_orderstatus FROM g),
    a AS (SELECT count(*) n, (2 * (count(*) - count(o_totalprice)) + count(*) - count(o_orderpriority))::DOUBLE / (count(*) * 5) * 100 gap,
      skewness(o_totalprice) s1, skewness(o_custkey) s2, corr(o_custkey, o_totalprice) r FROM y),
    t AS (SELECT min(c)::DOUBLE rare FROM (SELECT count(*) c FROM y GROUP BY o_orderstatus))"""
READY_DIMS = [
    dimension("completeness", "pround(greatest(0, 100 - 2 * gap), 1)", "a"), dimension("feature_quality", "100", "a"),
    dimension("encoding_needed", "80", "a"),
    dimension("distribution", "100 - 15 * ((abs(s1) > 3)::INT * 2 + (abs(s2) > 3)::INT)", "a"),
    dimension("target_suitability", "CASE WHEN rare / n * 100 < 5 THEN 85 ELSE 100 END", "a, t"),
    dimension("data_size", "CASE WHEN n < 100 THEN 30 WHEN n < 1000 THEN 70 ELSE 100 END", "a"),
    dimension("multicollinearity", "100 - 15 * (1 + 2 * (abs(r) > 0.9)::INT)", "a")]


def ready(spark, sf):
    df = gappy(spark, sf)
    return df.select("o_custkey", "o_totalprice", (F.col("o_totalprice") * 2).alias("twice"), "o_orderpriority", "o_orderstatus")


@query("readiness_dimensions", READY + " " + " UNION ALL ".join(READY_DIMS))
def readiness_dimensions(spark, sf):
    return rounded(readiness.readiness(ready(spark, sf), "o_orderstatus").select("dimension", "score"), 4)


@query("readiness_score", READY + ", s AS (" + " UNION ALL ".join(READY_DIMS) + """), w AS (SELECT sum(score * CASE dimension
      WHEN 'completeness' THEN 25 WHEN 'feature_quality' THEN 20 WHEN 'encoding_needed' THEN 15 WHEN 'distribution' THEN 15
      WHEN 'target_suitability' THEN 10 WHEN 'data_size' THEN 10 ELSE 5 END) / 100 AS x FROM s)
    SELECT pround(x, 1) AS overall_score, CASE WHEN x >= 90 THEN 'A' WHEN x >= 80 THEN 'B' WHEN x >= 70 THEN 'C' WHEN x >= 60 THEN 'D' ELSE 'F' END AS grade,
      x >= 70 AS is_ml_ready FROM w""")
def readiness_score(spark, sf):
    return readiness.readiness(ready(spark, sf), "o_orderstatus").select("overall_score", "grade", "is_ml_ready").distinct()


@query("readiness_target_issues", f"""WITH {GAPPY}, a AS (SELECT count(*) n, count(o_totalprice) m FROM g)
    SELECT 'missing values' AS issue, 80.0::DOUBLE AS score FROM a WHERE m < n""")
def readiness_target_issues(spark, sf):
    score, issues = readiness.target_suitability(eda.Exploration(gappy(spark, sf)), "o_totalprice")
    rows = [("missing values", float(score)) for _, m in issues if "missing" in m]
    return spark.createDataFrame(rows, "issue string, score double")


# ---- one-hot layouts ------------------------------------------------------------------------------------

def unnamed(spark, sf):
    df = load(spark, sf, "lineitem")
    flags = [(F.col("l_returnflag") == v).cast("int").alias(f"Unnamed: 0_{v}") for v in ("A", "N", "R")]
    flags.append(F.lit(0).alias("Unnamed: 0_Return Flag"))
    numbers = [(F.col("l_linenumber") == v).cast("double").alias(f"Unnamed: 1_{v}") for v in range(1, 6)]
    return df.select("l_orderkey", "l_partkey", *flags, *numbers)


@query("one_hot_decode", """SELECT l_orderkey, l_partkey, l_returnflag AS "Return Flag",
    CASE WHEN l_linenumber <= 5 THEN l_linenumber::DOUBLE END AS "1" FROM lineitem""")
def one_hot_decode(spark, sf):
    return onehot.decode(unnamed(spark, sf))


@query("one_hot_detect", "SELECT true AS one_hot, false AS plain, count(*) AS rows FROM lineitem")
def one_hot_detect(spark, sf):
    df = unnamed(spark, sf)
    plain = load(spark, sf, "lineitem")
    return df.agg(F.lit(onehot.is_one_hot(df.columns)).alias("one_hot"), F.lit(onehot.is_one_hot(plain.columns)).alias("plain"),
                  F.count("*").alias("rows"))


@query("json_safe_rows", """SELECT '{"p_partkey":' || p_partkey || ',"half":' || CASE WHEN p_size > 25 THEN 'null' ELSE p_size || '.5' END || '}' AS json FROM part""")
def json_safe_rows(spark, sf):
    from ..functions.columns import json_safe
    half = F.when(F.col("p_size") > 25, F.lit(float("nan"))).otherwise(F.col("p_size") + F.lit(0.5))
    return json_safe(load(spark, sf, "part").select("p_partkey", half.alias("half")))
