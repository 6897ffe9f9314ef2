"""Upserts, deletes and state transitions, as joins and windows over old and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table

ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
ORDER_SQL = ", ".join(ORDER)


def one_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows replace the old ones of equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY " + ", ".join(f"{c} DESC" for c in ORDER) + ") AS n FROM lineitem) WHERE n = 1")
def upsert_last_wins(spark, sf_dir):
    return one_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], *map(F.desc, ORDER)).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ORDER_SQL}) AS n FROM lineitem) WHERE n = 1")
def insert_ignore_first_wins(spark, sf_dir):
    return one_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], *map(F.asc, ORDER)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY user_id")
def upsert_seen_window(spark, sf_dir):
    """First and last seen after replaying all batches of an upsert that keeps the first and moves the last."""
    e = table(spark, sf_dir, "events")
    early, late = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    a, b = (x.groupBy("user_id").agg(F.min("ts").alias(f"f{i}"), F.max("ts").alias(f"l{i}"), F.count("*").alias(f"n{i}")) for i, x in enumerate((early, late)))
    return a.join(b, "user_id", "full_outer").select("user_id", F.least("f0", "f1").alias("first_seen"), F.greatest("l0", "l1").alias("last_seen"), (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("n"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_semi(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(gone, "l_orderkey", "left_anti").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P'))")
def resume_pending(spark, sf_dir):
    """Units without a completed run."""
    done = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "P")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("WITH n AS (SELECT doc_id, 'new' AS v FROM labels WHERE quality = 1) SELECT doc_id, 'old' AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, v FROM n")
def upsert_rows(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit("old").alias("v"))
    return upsert(old, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("new").alias("v")), ["doc_id"])


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_profile(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(100e0 * sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) / count(*), 1) AS hit_rate FROM events")
def cache_stats(spark, sf_dir):
    hit = F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0))
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), hit.alias("hits"), F.round(hit * 100.0 / F.count("*"), 1).alias("hit_rate"))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose keys are not there yet are appended; the others do nothing."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def replace_scope(old: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """All old rows of the scopes that ``new`` holds go, its rows come."""
    return old.join(new.select(scope).distinct(), scope, "left_anti").unionByName(new)


def overwrite_seen(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """An upsert that takes the new columns, keeps ``first_seen`` and moves ``last_seen``."""
    a = old.select(key, *(F.col(c).alias(f"old_{c}") for c in [*columns, "first_seen", "last_seen"]))
    b = new.select(key, *columns, F.col("seen"), F.lit(True).alias("_new"))
    taken = [F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in columns]
    return a.join(b, key, "full_outer").select(key, *taken, F.coalesce("old_first_seen", "seen").alias("first_seen"), F.coalesce("seen", "old_last_seen").alias("last_seen"))


def with_columns_of(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """``rows`` with the columns that an older table lacks, as nulls."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in schema.items() if c not in rows.columns}) if set(schema) - set(rows.columns) else rows


@query("SELECT doc_id, 'old' AS v FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 2 = 1")
def insert_missing_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return insert_missing(d.where("doc_id % 2 = 0").withColumn("v", F.lit("old")), d.withColumn("v", F.lit("new")), ["doc_id"])


@query("SELECT source, doc_id, 'old' AS v FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT source, doc_id, 'new' FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 2 = 0 AND EXISTS (SELECT 1 FROM documents d WHERE d.source = documents.source AND d.doc_id % 2 = 0) UNION ALL SELECT source, doc_id, 'old' FROM documents WHERE source IN ('src1', 'src2') AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = documents.source AND d.doc_id % 2 = 0)")
def scoped_rebuild(spark, sf_dir):
    """Two sources loaded anew with fewer documents."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return replace_scope(d.withColumn("v", F.lit("old")), d.where("source in ('src1', 'src2') and doc_id % 2 = 0").withColumn("v", F.lit("new")), "source")


@query("""WITH a AS (SELECT user_id, max(event_id) AS e, min(ts) AS f, max(ts) AS l FROM events WHERE event_id % 3 = 0 GROUP BY user_id), b AS (SELECT user_id, max(event_id) AS e, max(ts) AS s FROM events WHERE event_id % 7 = 1 GROUP BY user_id)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NOT NULL THEN CASE WHEN b.e % 2 = 0 THEN b.e END ELSE a.e END AS e, coalesce(f, s) AS first_seen, coalesce(s, l) AS last_seen FROM a FULL JOIN b ON a.user_id = b.user_id""")
def upsert_overwrite(spark, sf_dir):
    """New values count even where they are null."""
    e = table(spark, sf_dir, "events")
    old = e.where("event_id % 3 = 0").groupBy("user_id").agg(F.max("event_id").alias("e"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    new = e.where("event_id % 7 = 1").groupBy("user_id").agg(F.max("event_id").alias("e"), F.max("ts").alias("seen")).withColumn("e", F.when(F.col("e") % 2 == 0, F.col("e")))
    return overwrite_seen(old, new, "user_id", ["e"])


@query("SELECT source AS spec_id, count(*) AS rows_inserted, '[\"' || min(lang) || '\",\"low count\"]' AS warnings, 'text' AS source_type FROM documents GROUP BY source UNION ALL SELECT 'x', 0, '[]', NULL")
def audit_rows(spark, sf_dir):
    """Runs appended with their warnings as JSON; the older row has no source type."""
    runs = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("spec_id")).agg(F.count("*").alias("rows_inserted"), F.to_json(F.array(F.min("lang"), F.lit("low count"))).alias("warnings")).withColumn("source_type", F.lit("text"))
    old = spark.createDataFrame([("x", 0, "[]")], "spec_id string, rows_inserted long, warnings string")
    return with_columns_of(old, {"source_type": "string"}).unionByName(runs)


@query("SELECT name, rows FROM (VALUES ('a', 2), ('b', 0)) AS t(name, rows)")
def clean_rebuild(spark, sf_dir):
    """A table rewritten with two rows, one truncated, both by overwriting."""
    from ..sources.store import work_dir

    out = []
    for name, n in (("a", 2), ("b", 0)):
        path = work_dir(spark, f"rebuild-{name}")
        for count in (5, n):
            spark.range(count).write.mode("overwrite").parquet(path)
        out.append(spark.read.schema("id long").parquet(path).agg(F.count("*").cast("int").alias("rows")).select(F.lit(name).alias("name"), "rows"))
    return out[0].unionByName(out[1])
