"""Transforms: filling, outliers, duplicates, encoding, scaling, text, dates, splits and types."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.transforms import apply_transform, date_parse, dedup
from ..operators.transforms.types import choose_types
from .profile_queries import MIXED, mixed
from .registry import GAPPY, gappy, load, query, rounded


def done(df, kind, digits: int = 4, **config):
    return rounded(apply_transform(df, kind, config).df, digits)


# ---- missing values -------------------------------------------------------------------------------------

def filled(price: str = "o_totalprice", priority: str = "o_orderpriority") -> str:
    return (f"WITH {GAPPY} SELECT o_orderkey, o_custkey, o_orderstatus, round({price}, 4) AS o_totalprice, o_orderdate, "
            f"{priority} AS o_orderpriority FROM g")


MODE = "coalesce(o_orderpriority, (SELECT v FROM (SELECT o_orderpriority v, count(*) n FROM g WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)))"


@query("impute_mean", filled("coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM g))", MODE))
def impute_mean(spark, sf):
    return done(gappy(spark, sf), "imputation", method="mean")


@query("impute_median", filled("coalesce(o_totalprice, (SELECT median(o_totalprice) FROM g))"))
def impute_median(spark, sf):
    return done(gappy(spark, sf), "fill_missing", method="median", column="o_totalprice")


@query("impute_mode", filled("coalesce(o_totalprice, (SELECT v FROM (SELECT o_totalprice v, count(*) n FROM g WHERE o_totalprice IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)))", MODE))
def impute_mode(spark, sf):
    return done(gappy(spark, sf), "impute", method="most_frequent")


@query("impute_constant", filled("coalesce(o_totalprice, 0)", "coalesce(o_orderpriority, 'unknown')"))
def impute_constant(spark, sf):
    return done(gappy(spark, sf), "imputation", method="constant")


@query("impute_forward", filled("coalesce(o_totalprice, last_value(o_totalprice IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"))
def impute_forward(spark, sf):
    return done(gappy(spark, sf), "imputation", method="forward_fill", column="o_totalprice", order_by=["o_orderdate", "o_orderkey"])


@query("impute_backward_per_customer", filled("coalesce(o_totalprice, first_value(o_totalprice IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"))
def impute_backward_per_customer(spark, sf):
    return done(gappy(spark, sf), "imputation", method="backward_fill", column="o_totalprice", order_by="o_orderkey", partition_by="o_custkey")


@query("impute_nothing_missing", "SELECT * FROM nation")
def impute_nothing_missing(spark, sf):
    return apply_transform(load(spark, sf, "nation"), "imputation", {}).df


@query("impute_counts", f"""WITH {GAPPY} SELECT c AS "column", b AS before, 0::BIGINT AS after FROM (
    SELECT 'o_totalprice' c, count(*) - count(o_totalprice) b FROM g UNION ALL SELECT 'o_orderpriority', count(*) - count(o_orderpriority) FROM g)""")
def impute_counts(spark, sf):
    r = apply_transform(gappy(spark, sf), "imputation", {"method": "mode", "columns": ["o_totalprice", "o_orderpriority"]})
    return spark.createDataFrame([(c, d["before"], d["after"]) for c, d in r.details.items()], "column string, before bigint, after bigint")


@query("impute_knn", """WITH s AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey < 5 THEN NULL ELSE s_acctbal END AS bal FROM supplier),
    p AS (SELECT a.s_suppkey, b.bal, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY
        sqrt(((a.s_suppkey - b.s_suppkey)::DOUBLE ** 2 + (a.s_nationkey - b.s_nationkey)::DOUBLE ** 2) / 2), b.bal) rn
      FROM s a, s b WHERE a.bal IS NULL AND b.bal IS NOT NULL)
    SELECT s_suppkey, s_nationkey, round(coalesce(bal, (SELECT avg(bal) FROM p WHERE p.s_suppkey = s.s_suppkey AND rn <= 5)), 4) AS bal FROM s""")
def impute_knn(spark, sf):
    df = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_nationkey") >= 5, F.col("s_acctbal")).alias("bal"))
    return done(df, "imputation", method="knn", column="bal")


@query("impute_knn_gaps", """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS nation,
      CASE WHEN c_custkey % 7 <> 0 THEN length(c_name) + c_custkey % 50 END AS size, CASE WHEN c_custkey % 11 <> 3 THEN c_acctbal END AS bal FROM customer),
    p AS (SELECT a.c_custkey, b.bal, row_number() OVER (PARTITION BY a.c_custkey ORDER BY sqrt((
        (a.c_custkey - b.c_custkey)::DOUBLE ** 2 + coalesce((a.nation - b.nation)::DOUBLE ** 2, 0) + coalesce((a.size - b.size)::DOUBLE ** 2, 0))
        / (1 + (a.nation IS NOT NULL AND b.nation IS NOT NULL)::INT + (a.size IS NOT NULL AND b.size IS NOT NULL)::INT)), b.bal) rn
      FROM c a, c b WHERE a.bal IS NULL AND b.bal IS NOT NULL)
    SELECT c_custkey, round(coalesce(bal, (SELECT avg(bal) FROM p WHERE p.c_custkey = c.c_custkey AND rn <= 5)), 4) AS bal FROM c""")
def impute_knn_gaps(spark, sf):
    """Neighbours of customers where a fifth and a seventh of two features are missing."""
    key = F.col("c_custkey")
    df = load(spark, sf, "customer").select(
        "c_custkey", F.when(key % 5 != 0, F.col("c_nationkey")).alias("nation"),
        F.when(key % 7 != 0, F.length("c_name") + key % 50).alias("size"), F.when(key % 11 != 3, F.col("c_acctbal")).alias("bal"))
    return done(df, "imputation", method="knn", column="bal").drop("nation", "size")


# ---- outliers -------------------------------------------------------------------------------------------

PRICES = "x AS (SELECT o_orderkey, o_totalprice * o_totalprice / 1000000 AS v FROM g)"


def squares(spark, sf):
    return gappy(spark, sf).select("o_orderkey", (F.col("o_totalprice") * F.col("o_totalprice") / 1000000).alias("v"))


def trimmed(low: str, high: str, cap: bool, extra: str = "") -> str:
    head = f"WITH {GAPPY}, {PRICES}, b AS (SELECT {low} lo, {high} hi FROM x {extra})"
    if cap:
        return head + " SELECT o_orderkey, round(CASE WHEN v < lo THEN lo WHEN v > hi THEN hi ELSE v END, 4) AS v FROM x, b"
    return head + " SELECT o_orderkey, round(v, 4) AS v FROM x, b WHERE v IS NULL OR (v >= lo AND v <= hi)"


Q1, Q3 = "quantile_cont(v, 0.25)", "quantile_cont(v, 0.75)"


@query("outliers_iqr_remove", trimmed(f"{Q1} - 0.5 * ({Q3} - {Q1})", f"{Q3} + 0.5 * ({Q3} - {Q1})", False))
def outliers_iqr_remove(spark, sf):
    return done(squares(spark, sf), "outlier", method="iqr_remove", column="v", iqr_multiplier=0.5)


@query("outliers_iqr_cap", trimmed(f"{Q1} - 0.5 * ({Q3} - {Q1})", f"{Q3} + 0.5 * ({Q3} - {Q1})", True))
def outliers_iqr_cap(spark, sf):
    return done(squares(spark, sf), "cap_outliers", method="iqr", column="v", multiplier=0.5)


@query("outliers_zscore_remove", trimmed("avg(v) - 1.5 * stddev_samp(v)", "avg(v) + 1.5 * stddev_samp(v)", False))
def outliers_zscore_remove(spark, sf):
    return done(squares(spark, sf), "outlier", method="zscore_remove", column="v", z_threshold=1.5)


@query("outliers_zscore_cap", trimmed("avg(v) - 1.5 * stddev_samp(v)", "avg(v) + 1.5 * stddev_samp(v)", True))
def outliers_zscore_cap(spark, sf):
    return done(squares(spark, sf), "outlier", method="zscore", column="v", threshold=1.5)


@query("outliers_winsorize", f"""WITH {GAPPY}, {PRICES}, r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM x WHERE v IS NOT NULL),
    b AS (SELECT max(v) FILTER (WHERE i = floor(0.05 * n)::BIGINT) lo, max(v) FILTER (WHERE i = n - floor(0.1 * n)::BIGINT - 1) hi FROM r)
    SELECT o_orderkey, round(CASE WHEN v < lo THEN lo WHEN v > hi THEN hi ELSE v END, 4) AS v FROM x, b""")
def outliers_winsorize(spark, sf):
    return done(squares(spark, sf), "winsorize", method="winsorize", column="v", limits=(0.05, 0.1))


@query("outliers_percentile_clip", trimmed("quantile_cont(v, 0.02)", "quantile_cont(v, 0.97)", True))
def outliers_percentile_clip(spark, sf):
    return done(squares(spark, sf), "outlier", method="percentile_clip", column="v", lower_percentile=2, upper_percentile=97)


@query("outliers_in_sequence", """WITH a AS (SELECT quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.75) q3 FROM lineitem),
    s AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem, a WHERE l_extendedprice BETWEEN q1 - 0.1 * (q3 - q1) AND q3 + 0.1 * (q3 - q1)),
    b AS (SELECT quantile_cont(l_quantity, 0.25) q1, quantile_cont(l_quantity, 0.75) q3 FROM s)
    SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM s, b WHERE l_quantity BETWEEN q1 - 0.1 * (q3 - q1) AND q3 + 0.1 * (q3 - q1)""")
def outliers_in_sequence(spark, sf):
    df = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return done(df, "outlier", columns=["l_extendedprice", "l_quantity"], multiplier=0.1)


# ---- duplicates -----------------------------------------------------------------------------------------

EVENTS = "SELECT event_id, user_id, event_type, value FROM events"


def events(spark, sf):
    return load(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


@query("dedup_exact", "SELECT DISTINCT text, lang FROM documents")
def dedup_exact(spark, sf):
    return done(load(spark, sf, "documents").select("text", "lang"), "dedup")


@query("dedup_subset", f"SELECT * FROM ({EVENTS}) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedup_subset(spark, sf):
    return done(events(spark, sf), "remove_duplicates", method="subset", columns=["user_id", "event_type"], order_by="event_id")


@query("dedup_keep_first", f"SELECT * FROM ({EVENTS}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1")
def dedup_keep_first(spark, sf):
    return done(events(spark, sf), "dedup", method="keep_first", columns=["user_id"], order_by=["value", "event_id"])


@query("dedup_keep_last", f"SELECT * FROM ({EVENTS}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) = 1")
def dedup_keep_last(spark, sf):
    return done(events(spark, sf), "dedup", method="keep_last", columns=["user_id"], order_by=["value", "event_id"])


@query("dedup_keep_none", f"SELECT * FROM ({EVENTS}) QUALIFY count(*) OVER (PARTITION BY value) = 1")
def dedup_keep_none(spark, sf):
    return done(events(spark, sf), "dedup", method="keep_none", columns=["value"])


@query("dedup_null_keys", f"WITH {GAPPY} SELECT o_orderpriority, o_orderstatus, o_orderkey FROM g QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) = 1")
def dedup_null_keys(spark, sf):
    df = gappy(spark, sf).select("o_orderpriority", "o_orderstatus", "o_orderkey")
    return done(df, "dedup", columns=["o_orderpriority", "o_orderstatus"], order_by="o_orderkey")


@query("dedup_by_column", """SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text""")
def dedup_by_column(spark, sf):
    return dedup.column_deduplication(load(spark, sf, "documents").select("text", "doc_id"), {"subset": ["text"], "order_by": "doc_id"}).df


@query("dedup_by_column_counts", """SELECT count(*) AS original_rows, count(*) - count(DISTINCT text) AS duplicate_rows, count(DISTINCT text) AS remaining_rows FROM documents""")
def dedup_by_column_counts(spark, sf):
    d = dedup.column_deduplication(load(spark, sf, "documents").select("text", "doc_id"), {"subset": ["text"], "order_by": "doc_id"}).details
    return spark.createDataFrame([(d["original_rows"], d["duplicate_rows"], d["remaining_rows"])], "original_rows bigint, duplicate_rows bigint, remaining_rows bigint")


@query("dedup_full_rows", "SELECT text, lang FROM documents GROUP BY text, lang HAVING count(*) = 1")
def dedup_full_rows(spark, sf):
    return dedup.full_row_deduplication(load(spark, sf, "documents").select("text", "lang"), {"keep": "none"}).df


# ---- encoding -------------------------------------------------------------------------------------------

@query("encode_one_hot", f"""WITH {GAPPY} SELECT o_orderkey, (coalesce(o_orderpriority, '') = '1-URGENT')::INT AS "o_orderpriority_1-URGENT",
    (coalesce(o_orderpriority, '') = '2-HIGH')::INT AS "o_orderpriority_2-HIGH", (coalesce(o_orderpriority, '') = '3-MEDIUM')::INT AS "o_orderpriority_3-MEDIUM",
    (coalesce(o_orderpriority, '') = '5-LOW')::INT AS "o_orderpriority_5-LOW" FROM g""")
def encode_one_hot(spark, sf):
    return done(gappy(spark, sf).select("o_orderkey", "o_orderpriority"), "one_hot", method="onehot", column="o_orderpriority")


@query("encode_one_hot_sparse", """WITH c AS (SELECT text, row_number() OVER (ORDER BY text) - 1 AS position FROM documents WHERE text IS NOT NULL GROUP BY 1)
    SELECT doc_id, (SELECT count(*) FROM c) AS size, coalesce(position, -1) AS position, (position IS NOT NULL)::INT::DOUBLE AS total FROM documents d LEFT JOIN c ON d.text = c.text""")
def encode_one_hot_sparse(spark, sf):
    """Every distinct text of the documents is a place of one sparse vector column."""
    out = done(load(spark, sf, "documents").select("doc_id", "text"), "encoding", method="one_hot_sparse", column="text")
    vector = F.col("text_one_hot")
    return out.select("doc_id", vector["size"].alias("size"), F.coalesce(F.get(vector["indices"], F.lit(0)), F.lit(-1).cast("long")).alias("position"),
                      F.aggregate(vector["values"], F.lit(0.0), lambda a, x: a + x).alias("total"))


CODES = "c AS (SELECT o_orderpriority v, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM g WHERE o_orderpriority IS NOT NULL GROUP BY 1)"


@query("encode_label", f"WITH {GAPPY}, {CODES} SELECT o_orderkey, coalesce(code, 0)::INT AS o_orderpriority_encoded FROM g LEFT JOIN c ON v = o_orderpriority")
def encode_label(spark, sf):
    return done(gappy(spark, sf).select("o_orderkey", "o_orderpriority"), "label_encode", column="o_orderpriority")


@query("encode_label_many", """SELECT c_custkey, (dense_rank() OVER (ORDER BY c_name) - 1)::INT AS c_name_encoded FROM customer""")
def encode_label_many(spark, sf):
    return done(load(spark, sf, "customer").select("c_custkey", "c_name"), "encoding", method="label", column="c_name")


@query("encode_ordinal", f"""WITH {GAPPY} SELECT o_orderkey, CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '1-URGENT' THEN 3 ELSE 0 END::INT AS o_orderpriority_ordinal FROM g""")
def encode_ordinal(spark, sf):
    return done(gappy(spark, sf).select("o_orderkey", "o_orderpriority"), "ordinal_encode", method="ordinal", column="o_orderpriority",
                order=["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"])


@query("encode_target_mean", f"""WITH {GAPPY}, m AS (SELECT o_orderpriority v, avg(o_totalprice) a FROM g WHERE o_orderpriority IS NOT NULL GROUP BY 1)
    SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, round(coalesce(a, (SELECT avg(o_totalprice) FROM g)), 4) AS o_orderpriority_target_enc FROM g LEFT JOIN m ON v = o_orderpriority""")
def encode_target_mean(spark, sf):
    return done(gappy(spark, sf).select("o_orderkey", "o_orderpriority", "o_totalprice"), "target_encode", method="target", column="o_orderpriority", target_column="o_totalprice")


@query("encode_target_class", f"""WITH {GAPPY}, m AS (SELECT o_orderpriority v, o_orderstatus s FROM (SELECT o_orderpriority, o_orderstatus, count(*) n FROM g
      WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_orderstatus) = 1)
    SELECT o_orderkey, o_orderstatus, s AS o_orderpriority_target_enc FROM g LEFT JOIN m ON v = o_orderpriority""")
def encode_target_class(spark, sf):
    return done(gappy(spark, sf).select("o_orderkey", "o_orderpriority", "o_orderstatus"), "encoding", method="target", column="o_orderpriority", target_column="o_orderstatus")


@query("encode_frequency", f"""WITH {GAPPY}, m AS (SELECT o_orderpriority v, count(*)::DOUBLE / (SELECT count(o_orderpriority) FROM g) f FROM g GROUP BY 1)
    SELECT o_orderkey, round(coalesce(f, 0), 6) AS o_orderpriority_freq FROM g LEFT JOIN m ON v = o_orderpriority""")
def encode_frequency(spark, sf):
    return done(gappy(spark, sf).select("o_orderkey", "o_orderpriority"), "encoding", 6, method="frequency", column="o_orderpriority")


@query("encode_text_frequency", """WITH m AS (SELECT text v, count(*)::DOUBLE / (SELECT count(text) FROM documents) f FROM documents GROUP BY 1)
    SELECT doc_id, round(coalesce(f, 0), 6) AS text_freq FROM documents LEFT JOIN m ON v = text""")
def encode_text_frequency(spark, sf):
    """Keys as wide as whole texts: none of them is collected, however few there are."""
    return done(load(spark, sf, "documents").select("doc_id", "text"), "encoding", 6, method="frequency", column="text")


@query("encode_binary", """SELECT l_orderkey, l_linenumber, (l_linestatus = 'O')::INT AS l_linestatus_binary FROM lineitem""")
def encode_binary(spark, sf):
    return done(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus"), "encoding", method="binary", column="l_linestatus")


@query("encode_binary_many", f"WITH {GAPPY}, {CODES} SELECT o_orderkey, o_orderpriority, coalesce(code, -1)::INT AS o_orderpriority_binary FROM g LEFT JOIN c ON v = o_orderpriority")
def encode_binary_many(spark, sf):
    return done(gappy(spark, sf).select("o_orderkey", "o_orderpriority"), "encoding", method="binary", column="o_orderpriority", drop_original=False)


# ---- scaling --------------------------------------------------------------------------------------------

def scaled(expr: str, stats: str) -> str:
    return f"WITH {GAPPY}, a AS (SELECT {stats} FROM g) SELECT o_orderkey, round({expr}, 6) + 0.0 AS o_totalprice FROM g, a"


def prices(spark, sf):
    return gappy(spark, sf).select("o_orderkey", "o_totalprice")


@query("scale_minmax", scaled("(o_totalprice - lo) / (hi - lo) * 2 - 1", "min(o_totalprice) lo, max(o_totalprice) hi"))
def scale_minmax(spark, sf):
    return done(prices(spark, sf), "minmax", 6, column="o_totalprice", feature_range=[-1, 1])


@query("scale_zscore", scaled("(o_totalprice - m) / s", "avg(o_totalprice) m, stddev_samp(o_totalprice) s"))
def scale_zscore(spark, sf):
    return done(prices(spark, sf), "standardize", 6, column="o_totalprice", method="zscore")


@query("scale_robust", scaled("(o_totalprice - m) / (b - a)", "median(o_totalprice) m, quantile_cont(o_totalprice, 0.25) a, quantile_cont(o_totalprice, 0.75) b"))
def scale_robust(spark, sf):
    return done(prices(spark, sf), "normalization", 6, column="o_totalprice", method="robust")


@query("scale_log", """WITH a AS (SELECT min(c_acctbal) lo FROM customer) SELECT c_custkey,
    round(CASE WHEN lo <= 0 THEN ln(1 + c_acctbal - lo + 1) ELSE ln(1 + c_acctbal) END, 6) AS c_acctbal FROM customer, a""")
def scale_log(spark, sf):
    return done(load(spark, sf, "customer").select("c_custkey", "c_acctbal"), "normalize", 6, column="c_acctbal", method="log")


@query("scale_max_abs", scaled("o_totalprice / hi", "max(abs(o_totalprice)) hi"))
def scale_max_abs(spark, sf):
    return done(prices(spark, sf), "scaling", 6, column="o_totalprice", method="max_abs")


# ---- text -----------------------------------------------------------------------------------------------

def cleaned(expr: str, table: str = "documents", key: str = "doc_id", column: str = "text") -> str:
    return f"SELECT {key}, {expr} AS {column} FROM {table}"


def documents(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "text")


@query("text_trim", cleaned(r"regexp_replace(text, '^\s+|\s+$', '', 'g')"))
def text_trim(spark, sf):
    return done(documents(spark, sf), "trim", column="text")


@query("text_lowercase", cleaned("lower(text)"))
def text_lowercase(spark, sf):
    return done(documents(spark, sf), "string_clean", method="lowercase", column="text")


@query("text_uppercase", cleaned("upper(replace(text, 'ß', 'SS'))"))
def text_uppercase(spark, sf):
    return done(documents(spark, sf), "string_clean", method="uppercase", column="text")


@query("text_title_case", r"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || '''s ' || lower(p_type) || '-x_' || p_brand, '[a-zA-Z]+|[^a-zA-Z]+'),
    lambda w: upper(w[1]) || lower(w[2:])), '') AS name FROM part""")
def text_title_case(spark, sf):
    df = load(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit("'s "), F.lower("p_type"), F.lit("-x_"), "p_brand").alias("name"))
    return done(df, "string_clean", method="title_case", column="name")


@query("text_regex_replace", r"SELECT c_custkey, regexp_replace(c_name, '([A-Za-z]+)#0*([0-9]+)', '\2/\1', 'g') AS c_name FROM customer")
def text_regex_replace(spark, sf):
    df = load(spark, sf, "customer").select("c_custkey", "c_name")
    return done(df, "clean_string", method="regex_replace", column="c_name", pattern=r"([A-Za-z]+)#0*([0-9]+)", replacement=r"\2/\1")


@query("text_remove_special", cleaned(r"regexp_replace(text, '[^a-zA-Z0-9\s]', '', 'g')"))
def text_remove_special(spark, sf):
    return done(documents(spark, sf), "string_clean", method="remove_special", column="text")


@query("text_standardize_whitespace", cleaned(r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')"))
def text_standardize_whitespace(spark, sf):
    return done(documents(spark, sf), "text_clean", method="standardize_whitespace", column="text")


@query("text_snake_case", cleaned(r"lower(regexp_replace(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9]', ' ', 'g'), '^ +| +$', '', 'g'), ' +', '_', 'g'))"))
def text_snake_case(spark, sf):
    return done(documents(spark, sf), "string_clean", method="snake_case", column="text")


@query("text_camel_case", cleaned(r"CASE WHEN len(w) > 0 THEN lower(w[1]) || array_to_string(list_transform(w[2:], lambda x: upper(x[1]) || lower(x[2:])), '') ELSE text END",
       r"(SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '[^a-zA-Z0-9]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents)"))
def text_camel_case(spark, sf):
    return done(documents(spark, sf), "string_clean", method="camel_case", column="text")


@query("text_change_counts", """SELECT 'lang' AS "column", count(*) FILTER (WHERE upper(lang) <> lang) AS values_changed FROM documents
    UNION ALL SELECT 'source', count(*) FILTER (WHERE upper(source) <> source) FROM documents""")
def text_change_counts(spark, sf):
    r = apply_transform(load(spark, sf, "documents"), "string_clean", {"method": "uppercase", "columns": ["lang", "source"]})
    return spark.createDataFrame([(c, d["values_changed"]) for c, d in r.details.items()], "column string, values_changed bigint")


# ---- dates ----------------------------------------------------------------------------------------------

@query("date_parse_format", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS day FROM orders""")
def date_parse_format(spark, sf):
    text = F.when(F.col("o_orderstatus") == "P", "no date").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return done(load(spark, sf, "orders").select("o_orderkey", text.alias("day")), "parse_date", column="day", format="%d/%m/%Y")


@query("date_parse_mixed", """SELECT o_orderkey, o_orderdate AS day FROM orders""")
def date_parse_mixed(spark, sf):
    text = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy/MM/dd")) \
        .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "MMM dd, yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return done(load(spark, sf, "orders").select("o_orderkey", text.alias("day")), "date_parse", column="day")


@query("date_auto_detect", f"""WITH {MIXED} SELECT c AS "column" FROM (VALUES ('day_text'), ('day')) t(c), (SELECT count(*) n FROM m) WHERE n > 0""")
def date_auto_detect(spark, sf):
    return spark.createDataFrame([(c,) for c in date_parse.detect_date_columns(mixed(spark, sf))], "column string")


@query("date_features", """SELECT event_id, ts, year(ts)::INT AS ts_year, month(ts)::INT AS ts_month, day(ts)::INT AS ts_day, hour(ts)::INT AS ts_hour,
    minute(ts)::INT AS ts_minute, quarter(ts)::INT AS ts_quarter, dayofyear(ts)::INT AS ts_dayofyear FROM events""")
def date_features(spark, sf):
    return done(load(spark, sf, "events").select("event_id", "ts"), "extract_date", method="extract_features", column="ts",
                features=["year", "month", "day", "hour", "minute", "quarter", "dayofyear"])


GONE = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END"


@query("date_week_features", f"""SELECT o_orderkey, d, (isodow(d) - 1)::INT AS d_dayofweek, coalesce((isodow(d) >= 6)::INT, 0) AS d_is_weekend, week(d)::INT AS d_weekofyear
    FROM (SELECT o_orderkey, {GONE} AS d FROM orders)""")
def date_week_features(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("d"))
    return done(df, "date_parse", method="extract_features", column="d", features=["dayofweek", "is_weekend", "weekofyear", "no_such"])


@query("date_month_edges", f"""SELECT o_orderkey, d, coalesce((day(d) = 1)::INT, 0) AS d_is_month_start, coalesce((last_day(d) = d::DATE)::INT, 0) AS d_is_month_end
    FROM (SELECT o_orderkey, {GONE} AS d FROM orders)""")
def date_month_edges(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("d"))
    return done(df, "date_parse", method="extract_features", column="d", features=["is_month_start", "is_month_end"])


@query("date_to_format", "SELECT event_id, strftime(ts, '%d %b %Y %H:%M') AS ts FROM events")
def date_to_format(spark, sf):
    return done(load(spark, sf, "events").select("event_id", "ts"), "date_parse", method="to_format", column="ts", output_format="%d %b %Y %H:%M")


# ---- splits ---------------------------------------------------------------------------------------------

@query("split_random", """WITH a AS (SELECT count(*) n FROM orders), b AS (SELECT n, round_even(0.8 * n, 0)::BIGINT AS train FROM a),
    c AS (SELECT n, train, round_even(0.1 / (1 - 0.2) * train, 0)::BIGINT AS val FROM b)
    SELECT 'train' AS split, train - val AS rows FROM c UNION ALL SELECT 'val', val FROM c UNION ALL SELECT 'test', n - train FROM c""")
def split_random(spark, sf):
    r = apply_transform(load(spark, sf, "orders"), "train_test_split", {"key": "o_orderkey", "val_size": 0.1})
    return r.extra_outputs["labelled"].groupBy("split").agg(F.count("*").alias("rows"))


@query("split_stratified", """SELECT c_mktsegment, greatest(1, floor(count(*) * 0.25))::BIGINT AS test, (count(*) - greatest(1, floor(count(*) * 0.25)))::BIGINT AS train
    FROM customer GROUP BY 1""")
def split_stratified(spark, sf):
    r = apply_transform(load(spark, sf, "customer"), "data_split", {"method": "stratified", "stratify_column": "c_mktsegment", "test_size": 0.25, "key": "c_custkey"})
    return r.extra_outputs["labelled"].groupBy("c_mktsegment").agg(F.count_if(F.col("split") == "test").alias("test"),
                                                                   F.count_if(F.col("split") == "train").alias("train"))


@query("split_by_time", """WITH r AS (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate) AS i, count(*) OVER () AS n FROM orders)
    SELECT CASE WHEN i <= floor(n * 0.7)::BIGINT THEN 'train' ELSE 'test' END AS split, count(*) AS rows, min(o_orderdate) AS first, max(o_orderdate) AS last FROM r GROUP BY 1""")
def split_by_time(spark, sf):
    r = apply_transform(load(spark, sf, "orders"), "data_split", {"method": "time_based", "time_column": "o_orderdate", "test_size": 0.3, "key": "o_orderkey"})
    return r.extra_outputs["labelled"].groupBy("split").agg(F.count("*").alias("rows"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("split_by_text_time", """WITH r AS (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate) AS i, count(*) OVER () AS n FROM orders)
    SELECT CASE WHEN i <= floor(n * 0.7)::BIGINT THEN 'train' ELSE 'test' END AS split, count(*) AS rows, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last FROM r GROUP BY 1""")
def split_by_text_time(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"))
    r = apply_transform(df, "data_split", {"method": "time_based", "time_column": "d", "test_size": 0.3, "key": "o_orderkey"})
    return r.extra_outputs["labelled"].groupBy("split").agg(F.count("*").alias("rows"), F.min("day").alias("first"), F.max("day").alias("last"))


@query("split_parts_cover", "SELECT o_orderkey, o_custkey FROM orders")
def split_parts_cover(spark, sf):
    r = apply_transform(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), "data_split", {"key": "o_orderkey", "test_size": 0.3})
    return r.extra_outputs["train"].unionByName(r.extra_outputs["test"])


# ---- types ----------------------------------------------------------------------------------------------

@query("convert_to_numeric", f"WITH {MIXED} SELECT id, price_text::DOUBLE AS price_text, NULL::DOUBLE AS label FROM m")
def convert_to_numeric(spark, sf):
    return done(mixed(spark, sf).select("id", "price_text", "label"), "convert_type", method="to_numeric", columns=["price_text", "label"])


@query("convert_to_string", f"WITH {MIXED} SELECT id::VARCHAR AS id, flag FROM m")
def convert_to_string(spark, sf):
    return done(mixed(spark, sf).select("id", "flag"), "cast_type", method="to_string", columns=["id", "flag"])


@query("convert_to_datetime", f"WITH {MIXED} SELECT id, day_text::TIMESTAMP AS day_text, NULL::TIMESTAMP AS label FROM m")
def convert_to_datetime(spark, sf):
    return done(mixed(spark, sf).select("id", "day_text", "label"), "type_conversion", method="to_datetime", columns=["day_text", "label"])


@query("convert_to_category", f"WITH {MIXED} SELECT id, label FROM m")
def convert_to_category(spark, sf):
    return apply_transform(mixed(spark, sf).select("id", "label"), "type_conversion", {"method": "to_category", "column": "label"}).df


@query("convert_to_boolean", f"""WITH {MIXED} SELECT id, CASE WHEN flag = 'yes' THEN true WHEN flag = 'no' THEN false END AS flag,
    CASE WHEN label = '1-URGENT' THEN true WHEN label = '5-LOW' THEN false END AS label FROM m""")
def convert_to_boolean(spark, sf):
    df = mixed(spark, sf).select("id", "flag", "label")
    first = apply_transform(df, "type_conversion", {"method": "to_boolean", "column": "flag"}).df
    return apply_transform(first, "type_conversion", {"method": "to_boolean", "column": "label", "true_values": ["1-urgent"], "false_values": ["5-low"]}).df


@query("convert_auto", f"WITH {MIXED} SELECT id, flag = 'yes' AS flag, price_text::DOUBLE AS price_text, day_text::TIMESTAMP AS day_text, label, day FROM m")
def convert_auto(spark, sf):
    return done(mixed(spark, sf), "type_conversion")


@query("convert_auto_choices", f"""WITH {MIXED} SELECT c AS "column", k AS kind FROM (VALUES ('id', 'keep'), ('flag', 'boolean'), ('price_text', 'numeric'),
    ('day_text', 'datetime'), ('label', 'category'), ('day', 'keep')) t(c, k), (SELECT count(*) n FROM m) WHERE n > 0""")
def convert_auto_choices(spark, sf):
    df = mixed(spark, sf)
    return spark.createDataFrame(list(choose_types(df, df.columns).items()), "column string, kind string")
