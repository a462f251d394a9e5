"""Sources, history, sequences, SQL guard and streams."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

import duckdb
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from tidemark.plans import rule_runs, sql, steps
from tidemark.queries import ORACLES, QUERIES
from tidemark.queries.table_queries import TABLES
from tidemark.sources import readers, scratch, tables
from tidemark.sources.history import History
from tidemark.streaming import quality


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,x,flag,day,note\n1,1.5,True,2024-01-15,N/A\n2,NA,false,2024-01-16,ok\n3,-2,TRUE,,null\n")
    df = readers.read_path(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "boolean", "string", "string"]
    assert [r["note"] for r in df.orderBy("id").collect()] == [None, "ok", None] and df.where("x is null").count() == 1


def test_json_and_load(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    assert tables.load(spark, "t", str(tmp_path)).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.load(spark, "zz", str(tmp_path))


def test_jdbc_options():
    pg = readers.jdbc_options("postgresql", {"host": "db", "database": "d", "user": "u", "password": "p", "query": "SELECT 1;"})
    assert pg["url"] == "jdbc:postgresql://db:5432/d" and pg["query"] == "SELECT 1" and pg["user"] == "u"
    my = readers.jdbc_options("mysql", {"database": "d", "query": "SELECT * FROM t", "partition_column": "id", "lower_bound": 0, "upper_bound": 9})
    assert my["dbtable"] == "(SELECT * FROM t) AS q" and my["numPartitions"] == "32" and "query" not in my
    assert readers.jdbc_options("sqlite", {"path": "/x.db", "query": "SELECT 1"})["url"] == "jdbc:sqlite:/x.db"
    with pytest.raises(ValueError):
        readers.jdbc_options("other", {"query": ""})


def test_names_and_copies(spark):
    assert tables.safe_name("1 a-b", "t_") == "t_1_a_b" and tables.safe_name("", "t_") == "t_"
    base = f"n{uuid.uuid4().hex[:8]}"
    df = spark.range(3)
    assert [tables.save_copy(df, n) for n in (base, base, f"{base}_fixed_v2")] == [f"{base}_fixed", f"{base}_fixed_v2", f"{base}_fixed_v3"]
    tables.append(df, f"{base}_rows")
    tables.append(df, f"{base}_rows")
    assert tables.load(spark, f"{base}_rows").count() == 6
    spark.range(2).select((F.col("id") > 0).alias("is it")).createOrReplaceTempView(base)
    assert spark.table(tables.register(spark.table(base), base + "x")).columns == ["is_it"]


def test_preview_bounds(spark):
    head, total, truncated = tables.preview(spark.range(20_000), 99_999)
    assert (head.count(), total, truncated) == (10_000, 20_000, True)
    assert tables.preview(spark.range(5), 0)[0].count() == 1


def test_too_many_columns(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text(",".join(f"c{i}" for i in range(1001)) + "\n" + ",".join("1" * 1001) + "\n")
    with pytest.raises(ValueError):
        tables.ingest(spark, str(path), "wide")


def test_history(spark, tmp_path):
    past = History(spark, str(tmp_path), "t1")
    assert past.rollback_last() is None and past.history().count() == 0
    first = past.save_snapshot(spark.range(3), "dedup", {"keep": "first"})
    second = past.save_snapshot(spark.range(2), "outlier")
    assert past.rollback(first).count() == 3 and past.rollback("none") is None
    assert past.info(second)["rows"] == 2 and past.info(first)["config"] == '{"keep": "first"}'
    assert past.rollback_last().count() == 2
    assert [r["snapshot_id"] for r in past.history().collect()] == [first]
    past.clear()
    assert past.history().count() == 0
    past.save_snapshot(spark.range(1), "dedup")
    assert past.history(1).count() == 1


def test_sequences(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.0), ("A", 1.0), ("B", None)], "s string, x double")
    seq = steps.Sequence("s", "all")
    seq.add("string_clean", {"method": "lowercase"}, condition="check_passed")
    seq.add("imputation", {"method": "mean"}, condition="always")
    seq.add("dedup", {}, condition="check_passed")
    seq.add("dedup", {"columns": ["zz"]})
    seq.add("string_clean", {"method": "lowercase"}, condition="check_failed")
    seq.add("dedup", {}, condition="score > 10")
    past = History(spark, str(tmp_path), "seq")
    done = steps.run_sequence(df, seq, past)
    assert [s["status"] for s in done["steps"]] == ["skipped", "success", "success", "failed", "success", "skipped"]
    assert (done["completed_steps"], done["skipped_steps"], done["failed_steps"]) == (3, 2, 1)
    assert sorted(tuple(r) for r in done["df"].collect()) == [("a", 1.0), ("b", 1.0)] and past.history().count() == 4
    broken = steps.Sequence("b", "broken")
    broken.add("imputation", {"method": "forward_fill"})
    broken.add("dedup", {})
    assert [s["status"] for s in steps.run_sequence(df, broken)["steps"]] == ["error"]


def test_batches(spark):
    df = spark.createDataFrame([("A",), ("A",)], "s string")
    ok = steps.run_batch(df, [("dedup", {}), ("string_clean", {"method": "lowercase"})], copy_of=f"b{uuid.uuid4().hex[:8]}")
    assert ok["success"] and spark.table(ok["saved_as"]).count() == 1
    part = steps.run_batch(df, [("outlier", {}), ("dedup", {})], copy_of="unused")
    assert [s["status"] for s in part["steps"]] == ["failed", "success"] and part["saved_as"] is None and part["df"].count() == 1
    assert steps.run_batch(df, [("nothing", {}), ("dedup", {})])["steps"][-1]["status"] == "error"


@pytest.mark.parametrize("text", ["DROP TABLE t", "", "SELECT 1; DELETE FROM t", "WITH a AS (SELECT 1) INSERT INTO t SELECT 1",
                                  "SELECT * FROM QualityRule", "SELECT * FROM x JOIN `QualityRule` ON 1 = 1", "PRAGMA writable_schema"])
def test_guard_refuses(spark, text):
    with pytest.raises(sql.NotAllowed):
        sql.query(spark, text, internal={"QualityRule"})


def test_guard_lets_queries_pass(spark):
    spark.range(1500).createOrReplaceTempView("many")
    found = sql.query_rows(spark, "SELECT id AS updated FROM many;")
    assert found["row_count"] == 1000 and found["truncated"] and found["columns"] == ["updated"]
    assert sql.query(spark, "PRAGMA table_info('many')").first()["col_name"] == "id"
    assert sql.query(spark, "with a as (select 1 as x) select * from a").first()["x"] == 1


def test_single_rule_falls_back_to_profile(spark):
    rule = {"id": "r", "type": "completeness", "config": '{"column": "x", "threshold": 50}'}
    profile = spark.createDataFrame([("x", 40, 40.0, 10, 100)], "column string, null_count bigint, null_percent double, unique_count bigint, row_count bigint")
    assert rule_runs.run_one(spark, rule, "t", profile=profile).first()["status"] == "passed"
    with pytest.raises(ValueError):
        rule_runs.run_one(spark, rule, "t")


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=7 * i), float(i % 5) if i % 3 else None) for i in range(200)]
    schema = "ts timestamp, v double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in/first"))
    folder, out = str(tmp_path / "in/*"), str(tmp_path / "out")

    def metrics(df, late=None):
        return quality.window_metrics(df, "ts", "1h", {"v": F.col("v").isNotNull()}, {"low": F.col("v") < 3}, lateness=late)

    quality.run_available(metrics(quality.stream_table(spark, folder, "*.parquet", schema), "10m"), out)
    done = spark.read.parquet(out)
    newest = rows[-1][0] - timedelta(minutes=10)
    batch = metrics(spark.createDataFrame(rows, schema)).where(F.col("window_end") <= F.lit(newest))
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, batch.collect())) and done.count() > 10


def test_a_second_run_of_a_stream_goes_on(spark, tmp_path):
    schema, folder, out = "ts timestamp, v double", str(tmp_path / "in/*"), str(tmp_path / "out")
    start = datetime(2024, 1, 1)
    for part in range(2):
        rows = [(start + timedelta(minutes=7 * i), float(i)) for i in range(100 * part, 100 * part + 100)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
        quality.run_available(quality.window_metrics(quality.stream_table(spark, folder, "*.parquet", schema), "ts", "1h", lateness="10m"), out)
    done = [r["window_start"] for r in spark.read.parquet(out).collect()]
    assert sorted(done) == [start + timedelta(hours=k) for k in range(len(done))] and len(done) > 20


def test_scratch_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or scratch.shared_dir(spark) == named


@pytest.mark.parametrize("text", [
    "SELECT * FROM Secret", "SELECT * FROM range(1) a, secret", "WITH x AS (TABLE secret) SELECT * FROM x", "SELECT * FROM text.`/etc/hostname`",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT (SELECT max(id) FROM spark_catalog.default.secret)",
    "SELECT 1 WHERE EXISTS (SELECT 1 FROM secret)", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT * FROM parquet.`/tmp/x`", "SELECT 1; DROP TABLE t"])
def test_guard_reads_the_plan(spark, text):
    with pytest.raises(sql.NotAllowed):
        sql.guard(spark, text, {"secret"})


def test_exactly_the_limit_is_not_truncated(spark):
    spark.range(5).createOrReplaceTempView("five")
    assert not sql.query_rows(spark, "SELECT * FROM five", limit=5)["truncated"] and sql.query_rows(spark, "SELECT * FROM five", limit=4)["truncated"]


def test_quoted_line_breaks_by_default(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,t\n1,"two\nlines"\n2,x\n')
    assert readers.read_path(spark, str(path)).count() == 2 and readers.read_path(spark, str(path), multiLine=False).count() == 3


@pytest.mark.parametrize("text", [
    "SELECT * FROM IDENTIFIER('secret')", "SELECT * FROM IDENTIFIER('sec' || 'ret')", "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.dir')", "WITH a AS (SELECT * FROM Secret) SELECT 1", "SELECT (SELECT max(id) FROM db.secret)",
    "SELECT * FROM range(3) WHERE EXISTS (SELECT 1 FROM secret)", "SELECT * FROM a JOIN LATERAL (SELECT * FROM secret) b", "SELECT 1 UNION SELECT id FROM `secret`",
    "SELECT * FROM json.`/tmp/x`", "SELECT java_method('java.lang.Math', 'random')", "SELECT my_own_function(1)", "SELECT * FROM read_everything('x')",
    "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "FROM a INSERT INTO t SELECT *", "SELECT TRANSFORM(id) USING 'cat' FROM a", "TABLE secret"])
def test_guard_walks_the_nodes(spark, text):
    with pytest.raises(sql.NotAllowed):
        sql.guard(spark, text, {"secret"})


@pytest.mark.parametrize("text", [
    "SELECT 'a\nSet b\nInsert' AS x", "SELECT 'secret' AS secret, \"reflect(1)\"", "WITH a AS (SELECT id, id % 3 AS k FROM range(9)) SELECT k, sum(id) OVER (PARTITION BY k) FROM a",
    "SELECT * FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b) WHERE a IN (SELECT id FROM range(5)) ORDER BY a LIMIT 3", "SELECT k, count(*) FROM (SELECT id % 2 AS k FROM range(4)) GROUP BY ALL HAVING count(*) > 1",
    "SELECT * FROM range(3) EXCEPT SELECT 1 INTERSECT SELECT 2", "SELECT explode(array(1, 2)) AS x", "SELECT transform(array(1, 2), x -> x + 1) AS x",
    "SELECT * FROM (SELECT 1 AS a, 2 AS b) UNPIVOT (v FOR c IN (a, b))", "SELECT * FROM (SELECT 1 AS a, 'x' AS b) PIVOT (sum(a) FOR b IN ('x', 'y'))"])
def test_guard_lets_nodes_that_read_pass(spark, text):
    assert sql.query(spark, text, {"secret"}).collect() is not None


def test_a_query_gives_all_its_rows(spark):
    spark.range(2500).createOrReplaceTempView("long_table")
    assert sql.query(spark, "SELECT id FROM long_table").count() == 2500
    assert sql.query(spark, "SELECT id FROM long_table ORDER BY id DESC").take(1)[0]["id"] == 2499
    assert sql.query(spark, "SELECT id FROM long_table", limit=7).count() == 7


def test_statements_are_whole_beyond_a_thousand_rows(spark, tmp_path):
    """More rows than were let through before, some without a name or twice; the other tables are there to be registered."""
    made = {"supplier": "SELECT i % 15000 AS s_suppkey, CASE WHEN i % 50 <> 7 THEN format('Supplier#{:09d}', i % 15000) END AS s_name FROM range(15020) t(i)",
            "orders": "SELECT i AS o_orderkey, CASE WHEN i % 2 = 0 THEN 'P' ELSE 'O' END AS o_orderstatus, 100000.0::DOUBLE + i AS o_totalprice FROM range(3000) t(i)"}
    for t in TABLES:
        duckdb.execute(f"COPY ({made.get(t, 'SELECT 1 AS id')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    duck = connect(str(tmp_path))
    found = QUERIES["sql_filter_like"](spark, str(tmp_path))
    keys = [r["s_suppkey"] for r in found.collect()]
    assert len(keys) > 1000 and keys == sorted(keys)
    assert differences(found, duck, ORACLES["sql_filter_like"]) == ""
    assert differences(QUERIES["sql_two_conditions"](spark, str(tmp_path)), duck, ORACLES["sql_two_conditions"]) == ""
