"""Readers of the tables and adapters that give them the shape of a document corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(text) -> F.Column:
    """ASCII word tokens of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the tokens of title (first line) and content."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", "text", tokens(F.substring_index("text", "\n", 1)).alias("title"), tokens(F.col("text")).alias("body"))


CORPUS_SQL = """c AS (SELECT doc_id, lang, source, text, regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9]+') AS title,
  regexp_extract_all(lower(text), '[a-z0-9]+') AS body FROM documents)"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents are dealt and sorted, their sections then come in order
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("spec_id"), "text").repartitionByRange("spec_id").sortWithinPartitions("spec_id")
    lines = d.select("spec_id", F.posexplode(F.split("text", "\n")).alias("l", "line")).withColumn("l", F.col("l") + 1)
    sentences = F.split("line", r"\. ")
    row = lambda s, c, x: F.struct(s.alias("s"), c.alias("c"), x.alias("content"))
    top = F.array(row(F.lit(0), F.lit(0), F.when(F.size(sentences) > 2, "").otherwise(F.col("line"))))
    below = F.transform(sentences, lambda x, i: row(i + 1, F.lit(0), x))
    clauses = F.flatten(F.transform(sentences, lambda x, i: F.transform(F.split(x, ", "), lambda y, j: row(i + 1, j + 1, y))))
    rows = lines.select("spec_id", "l", F.explode(F.array_sort(F.concat(top, below, F.when(F.col("l") == 1, clauses).otherwise(F.slice(top, 1, 0))))).alias("x")).select("spec_id", "l", "x.*")
    number = F.concat_ws(".", "l", F.when(F.col("s") > 0, F.col("s")), F.when(F.col("c") > 0, F.col("c")))
    depth = (F.col("s") > 0).cast("int") + (F.col("c") > 0).cast("int")
    title = (
        F.when((F.col("c") == 0) & (F.col("s") == 2), "General").when((F.col("c") == 0) & (F.col("s") == 3), "Abnormal cases here")
        .when((F.col("c") == 0) & ((F.col("s") == 4) | (F.col("s") == 0) & (F.col("l") == 2)), "Link cause").otherwise(F.array_join(F.slice(F.split("content", " "), 1, 4), " "))
    )
    return rows.select(
        F.concat_ws(":", "spec_id", number).alias("id"), "spec_id", number.alias("section_number"), title.alias("title"), "content", F.length("content").alias("content_length"),
        F.when(depth == 1, F.concat_ws(":", "spec_id", "l")).when(depth == 2, F.concat(F.concat_ws(":", "spec_id", "l"), F.lit("."), "s")).alias("parent"),
        depth.alias("depth"), F.col("l").alias("page_start"), F.col("l").alias("page_end"), "l", "s", "c",
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section tree: lines are top sections, their sentences the sections below, and clauses those below the first line's.

    Lines of more than two sentences are headings without content. Stored by document, so that a
    filter on spec_id and section_number reaches the files' statistics.
    """
    return stored(spark, sf_dir, "sections", lambda: _sections(spark, sf_dir))


SECTIONS_SQL = """ln AS (SELECT CAST(doc_id AS VARCHAR) AS spec_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS l FROM documents),
se AS (SELECT spec_id, l, generate_subscripts(string_split(line, '. '), 1) AS s, unnest(string_split(line, '. ')) AS content FROM ln),
rw AS (SELECT spec_id, l, 0 AS s, 0 AS c, CASE WHEN len(string_split(line, '. ')) > 2 THEN '' ELSE line END AS content FROM ln UNION ALL SELECT spec_id, l, s, 0, content FROM se
  UNION ALL SELECT spec_id, l, s, generate_subscripts(string_split(content, ', '), 1), unnest(string_split(content, ', ')) FROM se WHERE l = 1),
nu AS (SELECT *, l || CASE WHEN s > 0 THEN '.' || s ELSE '' END || CASE WHEN c > 0 THEN '.' || c ELSE '' END AS section_number FROM rw),
sec AS (SELECT spec_id || ':' || section_number AS id, spec_id, section_number,
  CASE WHEN c = 0 AND s = 2 THEN 'General' WHEN c = 0 AND s = 3 THEN 'Abnormal cases here' WHEN c = 0 AND (s = 4 OR s = 0 AND l = 2) THEN 'Link cause' ELSE array_to_string(string_split(content, ' ')[1:4], ' ') END AS title,
  content, length(content) AS content_length, CASE WHEN c > 0 THEN spec_id || ':' || l || '.' || s WHEN s > 0 THEN spec_id || ':' || l END AS parent,
  CASE WHEN c > 0 THEN 2 WHEN s > 0 THEN 1 ELSE 0 END AS depth, l AS page_start, l AS page_end, l, s, c FROM nu)"""


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents rows of four documents in five: the sections with briefs, in document order."""
    from pyspark.sql import Window

    from ..functions.text import brief

    def build():
        rows = sections(spark, sf_dir).where("cast(spec_id as long) % 5 != 0")
        order = F.row_number().over(Window.partitionBy("spec_id").orderBy("l", "s", "c")) - 1
        return rows.select("spec_id", "section_number", F.col("title").alias("section_title"), F.col("l").alias("page"), "depth", F.when(F.col("content_length") > 0, brief(F.col("content"))).alias("brief"), order.alias("sort_order")).sortWithinPartitions("spec_id", "sort_order")

    return stored(spark, sf_dir, "toc", build)


SPACES = r"regexp_replace({}, '\s+', ' ', 'g')"


def brief_sql(x: str, limit: int = 180) -> str:
    """SQL of ``functions.text.brief`` for a collapsed text ``x``."""
    end = rf"length(regexp_extract({x}, '^(.*?[.!?])\s', 1))"
    cut = f"substr({x}, 1, {limit})"
    blank = f"(length({cut}) - length(string_split({cut}, ' ')[-1]) - 1)"
    return f"CASE WHEN length({x}) <= {limit} THEN {x} WHEN {end} BETWEEN 2 AND {limit} THEN substr({x}, 1, {end}) WHEN {blank} > {limit} * 0.6 THEN substr({x}, 1, {blank}) || '…' ELSE {cut} || '…' END"


TOC_SQL = SECTIONS_SQL + f""", toc AS (SELECT spec_id, section_number, title AS section_title, l AS page, depth, CASE WHEN content_length > 0 THEN {brief_sql("x")} END AS brief,
  CAST(row_number() OVER (PARTITION BY spec_id ORDER BY l, s, c) - 1 AS INTEGER) AS sort_order FROM (SELECT *, trim({SPACES.format("content")}) AS x FROM sec WHERE CAST(spec_id AS BIGINT) % 5 <> 0))"""


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: id, title, version, series, description, total_sections, total_pages."""

    def build():
        n = sections(spark, sf_dir).groupBy(F.col("spec_id").alias("id")).agg(F.count("*").alias("total_sections"), F.max("l").alias("total_pages"))
        d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("lang").alias("version"), F.col("source").alias("series"), F.substring("text", 1, 100).alias("description"))
        return d.join(n, "id", "left").sortWithinPartitions("series", "id")

    return stored(spark, sf_dir, "specs", build)


SPECS_SQL = SECTIONS_SQL + """, specs AS (SELECT CAST(doc_id AS VARCHAR) AS id, string_split(text, chr(10))[1] AS title, lang AS version, source AS series, substr(text, 1, 100) AS description,
  n AS total_sections, p AS total_pages FROM documents LEFT JOIN (SELECT spec_id, count(*) AS n, max(l) AS p FROM sec GROUP BY spec_id) ON spec_id = CAST(doc_id AS VARCHAR))"""
