"""The delivery catalogue: filters, counts, latest versions, selection.

region = type, nation = range, customer = document, orders = version, lineitem = file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


def every(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def like_any(words: str, *columns: str) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(c).contains(words.lower()) for c in columns])


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def catalog_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(every(F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") == 7, None)).select("c_custkey", "c_name")


FILES = "f AS (SELECT l_orderkey, count(*) AS files FROM lineitem GROUP BY l_orderkey), v AS (SELECT o_custkey, count(*) AS versions, coalesce(sum(files), 0) AS files FROM orders LEFT JOIN f ON o_orderkey = l_orderkey GROUP BY o_custkey)"


def counts(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("files"))
    versions = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(files, "o_orderkey", "left")
    return versions.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("versions"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


@query(f"WITH {FILES} SELECT c_custkey, coalesce(versions, 0) AS versions, CAST(coalesce(files, 0) AS BIGINT) AS files FROM customer LEFT JOIN v ON c_custkey = o_custkey")
def catalog_file_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(counts(spark, sf_dir), "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("versions", F.lit(0)).cast("long").alias("versions"), F.coalesce("files", F.lit(0)).cast("long").alias("files"))


@query(f"WITH {FILES} SELECT c_custkey, c_name, n_name, r_name, CAST(files AS BIGINT) AS files FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN v ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY' AND contains(lower(c_name), '1')")
def catalog_search(spark, sf_dir):
    """Documents with range, type and files; the two small dimensions have fixed sizes."""
    rows = table(spark, sf_dir, "customer").where((F.col("c_mktsegment") == "MACHINERY") & like_any("1", "c_name"))
    dims = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.join(dims, F.col("c_nationkey") == F.col("n_nationkey")).join(counts(spark, sf_dir), "c_custkey", "left").select("c_custkey", "c_name", "n_name", "r_name", F.col("files").cast("long").alias("files"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def catalog_ingested_only(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def catalog_has_files(spark, sf_dir):
    """The tri-state filter at false: versions without files."""
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'A' OR l_linestatus = 'A'")
def catalog_status_any(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(F.array_contains(F.array("l_returnflag", "l_linestatus"), "A")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY o_orderkey")
def versions_with_files(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_partkey")).alias("p"))
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey").join(files, "o_orderkey")
    return rows.select("o_orderkey", F.array_join(F.col("p").cast("array<string>"), ",").alias("parts"), F.size("p").cast("long").alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def version_counts(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber || '.' || l_suppkey || '.0' AS v, l_linenumber AS a, l_suppkey AS b FROM lineitem) SELECT l_orderkey, arg_max(v, a * 1000000 + b) AS latest FROM x GROUP BY l_orderkey")
def latest_version(spark, sf_dir):
    """The largest dotted version by numeric parts."""
    v = F.concat(F.concat_ws(".", "l_linenumber", "l_suppkey"), F.lit(".0"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", v.alias("v"))
    return rows.groupBy("l_orderkey").agg(F.max_by("v", F.transform(F.split("v", r"\."), lambda x: x.cast("int"))).alias("latest"))


NAMES = ["region", "nation", "customer", "orders", "lineitem"]


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in NAMES))
def table_counts(spark, sf_dir):
    return reduce(lambda a, b: a.unionAll(b), [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in NAMES])


@query("SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def set_diff(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("extra")))


@query("SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def catalog_rollup(spark, sf_dir):
    dims = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def latest_orders(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).where("n <= 3").select("o_orderkey", "o_custkey")
