"""Extraction jobs and the state around them: pages, failures told per file, placeholders, time stamps, cache contents, capabilities."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import table


def extracted(files: DataFrame, extract: Callable[[str, bytes], Iterable[tuple[int, str]]], path: str = "path", content: str = "content") -> DataFrame:
    """(path, page, text, warning) of files (path, content), by a function that gives (page, text) of one: a reader of any format.

    A file on which it fails gives one row with a warning; the others are not touched by that.
    """

    def run(frames):
        for pdf in frames:
            rows = []
            for name, data in zip(pdf[path], pdf[content], strict=True):
                try:
                    rows += [(name, n, text, None) for n, text in extract(name, bytes(data))]
                except Exception as e:  # noqa: BLE001  any fault of a reader is the file's
                    rows.append((name, 0, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "warning"])

    return files.select(path, content).mapInPandas(run, "path string, page int, text string, warning string")


def read_binary(spark: SparkSession, folder: str, pattern: str, extract: Callable[[str, bytes], Iterable[tuple[int, str]]]) -> DataFrame:
    """Pages of the files of a folder; PDF among them, if ``extract`` can read it."""
    return extracted(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder), extract)


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CAST(n AS INTEGER) AS page, CASE WHEN doc_id % 7 = 0 THEN '' ELSE string_split(text, chr(10))[n] END AS text, CASE WHEN doc_id % 7 = 0 THEN 'ValueError: no file of this kind' END AS warning FROM (SELECT doc_id, text, unnest(CASE WHEN doc_id % 7 = 0 THEN [0] ELSE range(1, len(string_split(text, chr(10))) + 1) END) AS n FROM documents)")
def extract_all(spark, sf_dir):
    """Each line a page; one file in seven fails and says so."""

    def lines(name, data):
        if int(name) % 7 == 0:
            raise ValueError("no file of this kind")
        return list(enumerate(data.decode().split("\n"), 1))

    return extracted(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content")), lines)


@query("SELECT doc_id, string_agg('--- Page ' || n || ' ---' || chr(10) || line, chr(10) || chr(10) ORDER BY n) AS dump FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE n <= 3 GROUP BY doc_id")
def page_dump(spark, sf_dir):
    """Pages as one text with a mark before each."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where("n < 3")
    marked = F.concat(F.lit("--- Page "), (F.col("n") + 1).cast("string"), F.lit(" ---\n"), "line")
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", marked.alias("t")))), lambda x: x["t"]), "\n\n").alias("dump"))


def is_placeholder(text) -> F.Column:
    """Whether a file's text only points at content kept elsewhere."""
    return (F.octet_length(text) < 1000) & text.startswith("version https://git-lfs.github.com/spec/")


@query("SELECT doc_id, doc_id % 3 = 0 AS missing FROM documents")
def placeholders(spark, sf_dir):
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("version https://git-lfs.github.com/spec/v1\nsize "), F.length("text").cast("string"))).otherwise(F.concat(F.lit(" version https://git-lfs.github.com/spec/"), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", is_placeholder(made).alias("missing"))


def first_there(candidates: Iterable[str | None]) -> str | None:
    """The first of some places that exists: an explicit one, then the usual ones."""
    return next((c for c in candidates if c and os.path.exists(c)), None)


def capabilities(vectors: DataFrame | None) -> dict[str, bool]:
    """What a corpus can be asked for; without vectors a search goes by keywords."""
    return {"keyword": True, "semantic": vectors is not None and not vectors.isEmpty()}


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(ts, '%Y-%m-%d') AS day FROM events")
def iso_stamps(spark, sf_dir):
    """Times to the second as text, and their dates."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "events").select("event_id", stamp.alias("stamp"), F.regexp_replace(stamp, "T.*$", "").alias("day"))


@query("WITH l AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id), n AS (SELECT user_id, ts, row_number() OVER (ORDER BY ts DESC, user_id) AS k FROM l WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL '2 days') SELECT user_id, ts FROM n WHERE k <= 8")
def cache_contents(spark, sf_dir):
    """What a cache of eight entries and two days holds after all accesses: the last used keys that are not too old."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("ts"))
    now = e.agg(F.max("ts").alias("now"))
    fresh = last.crossJoin(F.broadcast(now)).where(F.col("ts") >= F.col("now") - F.expr("interval 2 days"))
    return fresh.orderBy(F.desc("ts"), "user_id").limit(8).select("user_id", "ts")


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 5")
def top_per_group(spark, sf_dir):
    """The first five of each group."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("k", F.row_number().over(w)).where("k <= 5").select("c_mktsegment", "c_custkey", "c_acctbal")
