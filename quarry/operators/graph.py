"""The citation graph and link listings: extraction, degrees, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..plans.registry import query
from ..sources.tables import table


def cited(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Sections (id, spec_id, content) whose texts cite others, themselves and unknown ones, and the specs (id, title)."""
    d = F.col("doc_id")
    ref = lambda a, b: F.concat((a % 20 + 10).cast("string"), F.lit("."), (b % 50 + 100).cast("string"))
    own, other, memo = ref(d, d), ref(d * 7, d * 3), (d % 7 + 1000).cast("string")
    content = F.concat(F.lit("See 3GPP TS "), other, F.lit(" and TS "), other, F.lit(" again, tr 33.444-1, RFC "), memo, F.lit(" or RFC-"), memo, F.lit(", this TS "), own, F.lit("; not RFC 12, TS 1.234. "), F.lit("In TS 11.222"))
    spec = F.concat(F.lit("ts_"), F.replace(own, F.lit("."), F.lit("_")))
    rows = table(spark, sf_dir, "documents").select(F.concat(spec, F.lit(":"), d.cast("string")).alias("id"), spec.alias("spec_id"), content.alias("content"))
    return rows, rows.select(F.col("spec_id").alias("id")).distinct().withColumn("title", F.concat(F.lit("Title of "), "id"))


CITED = """ci AS (SELECT doc_id AS d, 'ts_' || (doc_id % 20 + 10) || '_' || (doc_id % 50 + 100) AS source, (doc_id * 7 % 20 + 10) || '.' || (doc_id * 3 % 50 + 100) AS o, doc_id % 7 + 1000 AS m FROM documents),
ed AS (SELECT source, 'ts_' || replace(o, '.', '_') AS target, '3gpp' AS ref_type, '3GPP TS ' || o AS citation_text, source || ':' || d AS section_id FROM ci UNION ALL SELECT source, 'tr_33_444', '3gpp', 'tr 33.444', source || ':' || d FROM ci
 UNION ALL SELECT source, 'rfc_' || m, 'rfc', 'RFC ' || m, source || ':' || d FROM ci UNION ALL SELECT source, 'ts_11_222', '3gpp', 'TS' || chr(160) || '11.222', source || ':' || d FROM ci),
edges AS (SELECT *, target IN (SELECT source FROM ci) AS in_corpus FROM ed WHERE target <> source)"""


def edges(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """(source, target, ref_type, citation_text, section_id, in_corpus): each target once a section, by its first mention; none to itself."""
    found = rows.select(F.col("spec_id").alias("source"), F.col("id").alias("section_id"), F.posexplode(fn.citations(F.col("content"))).alias("nth", "c")).select("source", "section_id", "nth", "c.*")
    found = found.withColumnRenamed("target_id", "target").where("target != source")
    first = F.row_number().over(Window.partitionBy("section_id", "target").orderBy("nth"))
    found = found.withColumn("n", first).where("n = 1").drop("n", "nth")
    known = specs.select(F.col("id").alias("target"), F.lit(True).alias("known")).distinct()
    return found.join(known, "target", "left").select("source", "target", "ref_type", "citation_text", "section_id", F.coalesce("known", F.lit(False)).alias("in_corpus"))


def graph(spark, sf_dir) -> DataFrame:
    return edges(*cited(spark, sf_dir))


@query(f"WITH {CITED} SELECT source, target, ref_type, citation_text, section_id, in_corpus FROM edges")
def citation_edges(spark, sf_dir):
    """From text: both kinds, white space of any sort, parts of numbers lost, repeats and mentions of itself left out."""
    return graph(spark, sf_dir)


def degrees(rows: DataFrame, specs: DataFrame, by: str) -> DataFrame:
    """(spec_id, title, in_corpus, mention_count, ref_types) by target or source; ref_types is bounded by the kinds there are."""
    n = rows.groupBy(F.col(by).alias("spec_id")).agg(F.max("in_corpus").alias("in_corpus"), F.count("*").alias("mention_count"), F.array_join(F.sort_array(F.collect_set("ref_type")), ",").alias("ref_types"))
    return n.join(specs.select(F.col("id").alias("spec_id"), "title"), "spec_id", "left")


def outgoing(rows: DataFrame, specs: DataFrame, spec_id: str, *, in_corpus_only: bool = False, max_results: int = 20) -> DataFrame:
    """What a document cites, most mentions first."""
    own = rows.where(F.col("source") == spec_id)
    return degrees(own.where("in_corpus") if in_corpus_only else own, specs, "target").orderBy(F.desc("mention_count"), "spec_id").limit(max_results)


def incoming(rows: DataFrame, specs: DataFrame, spec_id: str, *, max_results: int = 20) -> DataFrame:
    """What cites a document: rows of the corpus, whatever ``in_corpus_only`` asks."""
    found = degrees(rows.where(F.col("target") == spec_id), specs, "source").withColumn("in_corpus", F.lit(True))
    return found.orderBy(F.desc("mention_count"), "spec_id").limit(max_results)


def mentions(rows: DataFrame, source: str, target: str, limit: int = 10) -> DataFrame:
    """Where exactly a document cites another."""
    return rows.where((F.col("source") == source) & (F.col("target") == target)).orderBy("section_id").select("section_id", "citation_text").limit(limit)


def references(spark, sf_dir: str, spec_id: str, *, direction: str = "both", in_corpus_only: bool = False, max_results: int = 20) -> dict:
    """The citations of a document as a record; an unknown one gives up to five identifiers that contain what was asked."""
    rows, specs = graph(spark, sf_dir), cited(spark, sf_dir)[1]
    row = specs.where(F.col("id") == spec_id).first()
    if row is None:
        near = specs.where(F.lower("id").contains(spec_id.lower())).orderBy("id").limit(5)
        return {"error": f"no document {spec_id}", "suggestions": [r["id"] for r in near.collect()]}
    out: dict = {"spec_id": spec_id, "title": row["title"]}
    if direction != "incoming":
        out["outgoing"] = [r.asDict() for r in outgoing(rows, specs, spec_id, in_corpus_only=in_corpus_only, max_results=max_results).collect()]
        if direction == "outgoing" and len(out["outgoing"]) == 1:
            out["outgoing"][0]["cited_in_sections"] = [r.asDict() for r in mentions(rows, spec_id, out["outgoing"][0]["spec_id"]).collect()]
    if direction != "outgoing":
        out["incoming"] = [r.asDict() for r in incoming(rows, specs, spec_id, max_results=max_results).collect()]
    return out


TYPES = "string_agg(DISTINCT ref_type, ',' ORDER BY ref_type)"


@query(f"WITH {CITED} SELECT target AS spec_id, CASE WHEN bool_or(in_corpus) THEN 'Title of ' || target END AS title, bool_or(in_corpus) AS in_corpus, count(*) AS mention_count, {TYPES} AS ref_types FROM edges WHERE source = 'ts_13_103' GROUP BY target ORDER BY mention_count DESC, target LIMIT 20")
def refs_outgoing(spark, sf_dir):
    return outgoing(graph(spark, sf_dir), cited(spark, sf_dir)[1], "ts_13_103").select("spec_id", "title", "in_corpus", "mention_count", "ref_types")


@query(f"WITH {CITED} SELECT target AS spec_id, count(*) AS mention_count FROM edges WHERE source = 'ts_15_105' AND in_corpus GROUP BY target ORDER BY mention_count DESC, target LIMIT 20")
def refs_in_corpus(spark, sf_dir):
    return outgoing(graph(spark, sf_dir), cited(spark, sf_dir)[1], "ts_15_105", in_corpus_only=True).select("spec_id", "mention_count")


@query(f"WITH {CITED} SELECT source AS spec_id, 'Title of ' || source AS title, true AS in_corpus, count(*) AS mention_count, {TYPES} AS ref_types FROM edges WHERE target = 'rfc_1003' GROUP BY source ORDER BY mention_count DESC, source LIMIT 20")
def refs_incoming(spark, sf_dir):
    return incoming(graph(spark, sf_dir), cited(spark, sf_dir)[1], "rfc_1003").select("spec_id", "title", "in_corpus", "mention_count", "ref_types")


@query(f"WITH {CITED} SELECT section_id, citation_text FROM edges WHERE source = 'ts_13_103' AND target = 'tr_33_444' ORDER BY section_id LIMIT 10")
def ref_mentions(spark, sf_dir):
    return mentions(graph(spark, sf_dir), "ts_13_103", "tr_33_444")


@query(f"WITH {CITED} SELECT source, target, count(*) AS n, {TYPES} AS ref_types FROM edges GROUP BY source, target")
def ref_degrees(spark, sf_dir):
    """All pairs at once: the batch form."""
    return graph(spark, sf_dir).groupBy("source", "target").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("ref_type")), ",").alias("ref_types"))


@query(f"WITH {CITED} SELECT count(*) AS edges, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets, CAST(sum(CASE WHEN in_corpus THEN 1 ELSE 0 END) AS BIGINT) AS in_corpus FROM edges")
def graph_stats(spark, sf_dir):
    return graph(spark, sf_dir).agg(F.count("*").alias("edges"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"), F.sum(F.col("in_corpus").cast("int")).alias("in_corpus"))


@query(f"WITH {CITED} SELECT target, count(*) AS n, bool_or(in_corpus) AS in_corpus FROM edges GROUP BY target ORDER BY n DESC, target LIMIT 10")
def top_cited(spark, sf_dir):
    return graph(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n"), F.max("in_corpus").alias("in_corpus")).orderBy(F.desc("n"), "target").limit(10)


#: fixed values: an entry of a directory listing: date, size or <dir>, target, name
ENTRY = r'(?i)(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}\s+[AP]M)?\s*(<dir>|\d+)?\s*<a\s+href="([^"]+)">([^<]+)</a>'


def listing(rows: DataFrame, body: str, base: str) -> DataFrame:
    """Entries of directory pages: name, href, url, is_dir, modified_at, size_bytes; links up and sort links are left out."""
    whole = F.regexp_extract_all(body, F.lit(ENTRY), 0)
    one = rows.withColumn("e", F.explode(whole))
    part = lambda i: F.regexp_extract("e", ENTRY, i)
    name, href, size = F.trim(fn.unescaped(part(4))), F.trim(fn.unescaped(part(3))), part(2)
    out = one.withColumns({"name": name, "href": href, "is_dir": href.endswith("/") | (F.lower(size) == "<dir>"), "modified_at": F.nullif(part(1), F.lit("")), "size_bytes": F.when(size.rlike(r"^\d+$"), size.cast("long"))})
    out = out.where((F.col("name") != "") & ~F.col("name").startswith("[") & ~F.col("href").startswith("?"))
    return out.withColumns({"name": F.regexp_replace("name", "^/+|/+$", ""), "url": fn.joined_url(F.col(base), F.col("href"))}).drop("e")


@query("""SELECT page_id, 'A & B' AS name, '/deliver/' || page_id || '/' AS href, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/deliver/' || page_id || '/' AS url, true AS is_dir, '3/14/2024 9:05 AM' AS modified_at, CAST(NULL AS BIGINT) AS size_bytes FROM pages
UNION ALL SELECT page_id, 'f' || page_id || '.pdf', 'f.pdf', regexp_replace(url, '[^/]*$', '') || 'f.pdf', false, '3/15/2024 11:00 PM', page_id + 10 FROM pages""")
def html_listing(spark, sf_dir):
    """Directory pages of two entries, a link up and a sort link each."""
    i = F.col("page_id").cast("string")
    body = F.concat(F.lit('<a href="/up/">[parent]</a> 3/14/2024 9:05 AM   &lt;dir&gt; '), F.lit("3/14/2024 9:05 AM <dir> "), F.lit('<a href="/deliver/'), i, F.lit('/">A &amp; B/</a><br>3/15/2024 11:00 PM '), (F.col("page_id") + 10).cast("string"), F.lit(' <A HREF="f.pdf">f'), i, F.lit('.pdf</A> <a href="?C=N">Name</a>'))
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("base"), body.alias("body"))
    return listing(rows, "body", "base").select("page_id", "name", "href", "url", "is_dir", "modified_at", "size_bytes")


@query("""SELECT page_id, a[1] AS href, a[2] AS name FROM (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2))) AS a FROM pages)""")
def page_links(spark, sf_dir):
    """Every plain anchor of the pages."""
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    both = F.arrays_zip(F.regexp_extract_all("html", pattern, 1).alias("href"), F.regexp_extract_all("html", pattern, 2).alias("name"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(both).alias("a")).select("page_id", "a.href", "a.name")


@query("SELECT page_id, k AS name FROM pages, (SELECT unnest(['124300_124399', 'EN-range']) AS k)")
def range_entries(spark, sf_dir):
    """Which entries of a listing are ranges: directories named by two numbers or a word, but not publication types."""
    names = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(d).alias("is_dir")) for n, d in [("124300_124399", True), ("EN-range", True), ("etsi_ts", True), ("deliver", True), ("124400_124499", False), ("1x", True)]))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(names).alias("e")).select("page_id", "e.*")
    ok = F.col("is_dir") & ~F.col("name").startswith("etsi_") & (F.col("name") != "deliver") & F.col("name").rlike(r"^\d+_\d+$|^[A-Za-z][A-Za-z0-9_-]*$")
    return rows.where(ok).select("page_id", "name")
