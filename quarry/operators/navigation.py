"""Section lookup, tables of contents, neighbours and related sections over the section tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..plans.registry import query
from ..sources.tables import SECTIONS_SQL, SPECS_SQL, TOC_SQL, sections, specs, table, toc
from .search import natural

S = "WITH " + SECTIONS_SQL
T = "WITH " + TOC_SQL
GENERIC_SQL = "(lower({0}) IN ('general', 'overview', 'introduction', 'scope') OR regexp_matches(lower({0}), '^abnormal cases([^a-z0-9_]|$)'))"


def split_id(section_id: str) -> tuple[str, str]:
    spec, _, number = section_id.partition(":")
    return spec, number


def by_id(tree: DataFrame, section_id: str) -> DataFrame:
    """One section: the filter is on document and number, which the files are sorted by."""
    spec, number = split_id(section_id)
    return tree.where((F.col("spec_id") == spec) & (F.col("section_number") == number))


@query(S + " SELECT id, section_number, title, content FROM sec WHERE id = '3:1.1'")
def section_by_id(spark, sf_dir):
    return by_id(sections(spark, sf_dir), "3:1.1").select("id", "section_number", "title", "content")


@query(S + " SELECT id, title, content_length FROM sec WHERE spec_id = '5' AND section_number = '1'")
def section_by_number(spark, sf_dir):
    return by_id(sections(spark, sf_dir), "5:1").select("id", "title", "content_length")


@query("WITH " + SPECS_SQL + " SELECT id, title, version FROM specs WHERE id = '7'")
def spec_by_id(spark, sf_dir):
    return specs(spark, sf_dir).where("id = '7'").select("id", "title", "version")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS BIGINT) AS nth FROM documents")
def spec_ids(spark, sf_dir):
    """All identifiers in order, numbered: counts by range partition give each partition's first number."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id")).orderBy("id").withColumn("part", F.spark_partition_id())
    within = rows.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("id")))
    sizes = within.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return within.join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("n")).cast("long").alias("nth"))


@query(S + " SELECT a.id, a.title, b.title AS parent_title FROM sec a LEFT JOIN sec b ON a.parent = b.id")
def section_with_parent(spark, sf_dir):
    s = sections(spark, sf_dir)
    up = s.where("depth < 2").select(F.col("id").alias("parent"), F.col("title").alias("parent_title"))
    return s.join(up, "parent", "left").select("id", "title", "parent_title")


def neighbors(rows: DataFrame, window: int) -> DataFrame:
    """Each row with ``near``: the sections up to ``window`` places before and after it, by frames instead of a band join."""
    w = Window.partitionBy("spec_id").orderBy("l", "s", "c")
    places = [i for i in range(-window, window + 1) if i]
    near = F.array(*(F.struct(F.lit(i).cast("long").alias("away"), F.lag("id", -i).over(w).alias("id"), F.lag("title", -i).over(w).alias("title")) for i in places))
    return rows.withColumn("near", F.filter(near, lambda x: x["id"].isNotNull()) if places else F.array())


@query(S + ", o AS (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY l, s, c) AS n FROM sec) SELECT a.id AS anchor, b.id, CAST(b.n - a.n AS BIGINT) AS away FROM o a JOIN o b ON a.spec_id = b.spec_id AND abs(a.n - b.n) <= 2 AND a.n <> b.n WHERE a.section_number = '2'")
def section_neighbors(spark, sf_dir):
    """Two sections either side of section 2 of every document."""
    rows = neighbors(sections(spark, sf_dir).select("spec_id", "id", "title", "l", "s", "c", "section_number"), 2).where("section_number = '2'")
    return rows.select(F.col("id").alias("anchor"), F.explode("near").alias("x")).select("anchor", "x.id", "x.away")


def cut(content: Column, limit: int | None) -> tuple[Column, Column]:
    """Content of at most ``limit`` characters, and whether that cuts it."""
    return (content, F.lit(False)) if limit is None else (F.substring(content, 1, limit), F.length(content) > limit)


@query(S + " SELECT id, substr(content, 1, 50) AS content, length(content) > 50 AS truncated, length(trim(content)) > 0 AS has_content FROM sec")
def section_truncate(spark, sf_dir):
    content, truncated = cut(F.col("content"), 50)
    return sections(spark, sf_dir).select("id", content.alias("content"), truncated.alias("truncated"), (F.length(F.trim("content")) > 0).alias("has_content"))


@query(T + ", ch AS (SELECT parent, count(*) AS children FROM sec WHERE parent IS NOT NULL GROUP BY parent) SELECT t.spec_id || ':' || t.section_number AS id, t.depth, section_title AS title, coalesce(content_length, 0) > 0 AS has_content, coalesce(children, 0) AS children FROM toc t LEFT JOIN sec s ON s.spec_id = t.spec_id AND s.section_number = t.section_number LEFT JOIN ch ON ch.parent = s.id")
def toc_tree(spark, sf_dir):
    """Contents rows with what their sections hold; children are counted beside the sections, in one more scan of two columns."""
    s = sections(spark, sf_dir)
    below = s.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    held = toc(spark, sf_dir).join(s.select("spec_id", "section_number", "content_length"), ["spec_id", "section_number"], "left").withColumn("id", F.concat_ws(":", "spec_id", "section_number"))
    return held.join(below, "id", "left").select("id", "depth", F.col("section_title").alias("title"), (F.coalesce("content_length", F.lit(0)) > 0).alias("has_content"), F.coalesce("children", F.lit(0)).cast("long").alias("children"))


def under(number: Column | str, prefix: str) -> Column:
    n = F.col(number) if isinstance(number, str) else number
    return (n == prefix) | n.startswith(prefix + ".")


@query(S + " SELECT id, title FROM sec WHERE section_number = '2' OR section_number LIKE '2.%'")
def toc_subtree(spark, sf_dir):
    return sections(spark, sf_dir).where(under("section_number", "2")).select("id", "title")


@query(T + " SELECT spec_id, section_number, depth FROM toc WHERE depth < 2 AND page <= 3")
def toc_depth(spark, sf_dir):
    """A listing bounded by depth."""
    return toc(spark, sf_dir).where("depth < 2 and page <= 3").select("spec_id", "section_number", "depth")


@query(T + ", o AS (SELECT id, spec_id, section_number, row_number() OVER (PARTITION BY spec_id ORDER BY section_number) AS n FROM sec) SELECT spec_id || ':' || section_number AS id, section_number, 'toc' AS origin FROM toc UNION ALL SELECT id, section_number, 'sections' FROM o WHERE n <= 100 AND spec_id NOT IN (SELECT spec_id FROM toc)")
def toc_fallback(spark, sf_dir):
    """Documents without contents rows list their first 100 sections instead, by number as text, whatever their depth."""
    rows = toc(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("spec_id").orderBy("section_number"))
    rest = sections(spark, sf_dir).select("id", "spec_id", "section_number").join(rows.select("spec_id").distinct(), "spec_id", "left_anti").withColumn("n", rank).where("n <= 100")
    return rows.select(F.concat_ws(":", "spec_id", "section_number").alias("id"), "section_number", F.lit("toc").alias("origin")).unionByName(rest.select("id", "section_number", F.lit("sections").alias("origin")))


def children(tree: DataFrame, contents: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` children of each section (``parent``), by number as text, with briefs."""
    rows = tree.where("parent is not null").join(contents.select("spec_id", "section_number", "brief"), ["spec_id", "section_number"], "left")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("parent").orderBy("section_number"))).where(F.col("n") <= limit)


@query(T + ", r AS (SELECT parent, id, brief, row_number() OVER (PARTITION BY parent ORDER BY sec.section_number) AS n FROM sec LEFT JOIN toc ON toc.spec_id = sec.spec_id AND toc.section_number = sec.section_number WHERE parent IS NOT NULL) SELECT parent, id, brief FROM r WHERE n <= 10")
def children_of(spark, sf_dir):
    return children(sections(spark, sf_dir), toc(spark, sf_dir), 10).select("parent", "id", "brief")


def ancestors(number: Column, spec: Column) -> Column:
    """The ids above a section, so that a descendant join is an equi-join."""
    parts = F.split(number, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat_ws(":", spec, F.array_join(F.slice(parts, F.lit(1), i), ".")))


def descendants(tree: DataFrame) -> DataFrame:
    """Every contentful section below another, with that one's id as ``above``."""
    deep = tree.where("content_length > 0 and depth > 0")
    return deep.withColumn("above", F.explode(ancestors(F.col("section_number"), F.col("spec_id"))))


DESCENDANTS = "de AS (SELECT a.id AS above, b.* FROM sec a JOIN sec b ON a.spec_id = b.spec_id AND starts_with(b.section_number, a.section_number || '.') WHERE b.content_length > 0)"


@query(S + f", {DESCENDANTS} SELECT above AS id, count(*) AS n FROM de GROUP BY above")
def descendant_counts(spark, sf_dir):
    """Contentful descendants at any depth."""
    return descendants(sections(spark, sf_dir)).groupBy(F.col("above").alias("id")).agg(F.count("*").alias("n"))


def suggestions(tree: DataFrame, limit: int = 8) -> DataFrame:
    """The nearest contentful descendants of each section (``above``), and their order (``nth``): generic titles last."""
    near = F.row_number().over(Window.partitionBy("above").orderBy("depth", "page_start", "section_number"))
    rows = descendants(tree).withColumn("n", near).where(F.col("n") <= limit)
    order = Window.partitionBy("above").orderBy(fn.is_generic(F.col("title")), "depth", "page_start", natural(F.col("section_number")))
    return rows.withColumn("nth", F.row_number().over(order))


@query(S + f", {DESCENDANTS}, n8 AS (SELECT *, row_number() OVER (PARTITION BY above ORDER BY depth, page_start, section_number) AS n FROM de), em AS (SELECT id FROM sec WHERE length(trim(content)) = 0) SELECT above, id, title, CAST(row_number() OVER (PARTITION BY above ORDER BY {GENERIC_SQL.format('title')}, depth, page_start, l, s, c) AS INTEGER) AS nth FROM n8 WHERE n <= 8 AND above IN (SELECT id FROM em)")
def navigation_suggestions(spark, sf_dir):
    """What a heading without content offers instead: eight sections below it, generic titles last."""
    tree = sections(spark, sf_dir)
    empty = tree.where("length(trim(content)) = 0").select(F.col("id").alias("above"))
    return suggestions(tree).join(empty, "above", "left_semi").select("above", "id", "title", "nth")


@query(T + f""", {DESCENDANTS}, em AS (SELECT id FROM sec WHERE length(trim(content)) = 0),
ch AS (SELECT parent, string_agg(id, ',' ORDER BY section_number) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY section_number) AS n FROM sec WHERE parent IS NOT NULL) WHERE n <= 10 GROUP BY parent),
dc AS (SELECT above, count(*) AS n FROM de GROUP BY above) SELECT em.id, ids AS children, coalesce(n, 0) AS descendant_content_count FROM em LEFT JOIN ch ON ch.parent = em.id LEFT JOIN dc ON dc.above = em.id""")
def navigation_block(spark, sf_dir):
    """The block of every heading without content: its children and how much lies below."""
    tree = sections(spark, sf_dir)
    kids = children(tree, toc(spark, sf_dir), 10).groupBy(F.col("parent").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]), ",").alias("children"))
    below = descendants(tree).groupBy(F.col("above").alias("id")).agg(F.count("*").alias("n"))
    return tree.where("length(trim(content)) = 0").select("id").join(kids, "id", "left").join(below, "id", "left").select("id", "children", F.coalesce("n", F.lit(0)).cast("long").alias("descendant_content_count"))


@query(S + " SELECT id FROM sec WHERE spec_id = '12' AND starts_with(section_number, '1') ORDER BY section_number LIMIT 5")
def suggest_prefix(spark, sf_dir):
    return suggested(sections(spark, sf_dir), "12:1").select("id")


def suggested(tree: DataFrame, section_id: str, limit: int = 5) -> DataFrame:
    """Sections whose numbers begin as the one asked for."""
    spec, number = split_id(section_id)
    return tree.where((F.col("spec_id") == spec) & F.col("section_number").startswith(number)).orderBy("section_number").limit(limit)


@query(S + f" SELECT id, title FROM sec WHERE {GENERIC_SQL.format('title')}")
def generic_titles(spark, sf_dir):
    return sections(spark, sf_dir).where(fn.is_generic(F.col("title"))).select("id", "title")


@query(S + ", r AS (SELECT spec_id, section_number, row_number() OVER (PARTITION BY spec_id ORDER BY l, s, c) AS n FROM sec) SELECT spec_id, section_number, CAST(n AS INTEGER) AS n FROM r")
def natural_sort(spark, sf_dir):
    """Numeric order of dotted numbers."""
    return sections(spark, sf_dir).select("spec_id", "section_number", F.row_number().over(Window.partitionBy("spec_id").orderBy(natural(F.col("section_number")))).alias("n"))


@query("WITH " + SPECS_SQL + " SELECT id AS spec_id, title, total_sections AS count FROM specs")
def list_specs(spark, sf_dir):
    return specs(spark, sf_dir).select(F.col("id").alias("spec_id"), "title", F.col("total_sections").alias("count"))


@query("SELECT DISTINCT source FROM documents")
def list_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct()


@query(S + " SELECT id, content_length FROM (SELECT * FROM sec WHERE regexp_matches(section_number, '^[0-9]') ORDER BY content_length DESC, id LIMIT 3)")
def longest_sections(spark, sf_dir):
    """Samples: the longest sections whose numbers begin with a digit."""
    return sections(spark, sf_dir).where(F.col("section_number").rlike("^[0-9]")).orderBy(F.desc("content_length"), "id").limit(3).select("id", "content_length")


@query(S + ", r AS (SELECT spec_id, id, CAST(row_number() OVER (PARTITION BY spec_id ORDER BY l, s, c) - 1 AS INTEGER) AS sort_order FROM sec) SELECT id, sort_order FROM r")
def sort_orders(spark, sf_dir):
    """Places in a document without gaps, from 0."""
    return sections(spark, sf_dir).select("id", (F.row_number().over(Window.partitionBy("spec_id").orderBy("l", "s", "c")) - 1).alias("sort_order"))


def ranked_family(tree: DataFrame, anchors: DataFrame, each: int = 5) -> DataFrame:
    """(anchor, prio, ord, id, relation, score): parent, then up to five children, then up to five siblings."""
    a = anchors.select(F.col("id").alias("anchor"), F.col("parent").alias("up"))
    s = tree.select("id", "parent", "section_number")

    def some(rows, name, score, prio, by):
        n = F.row_number().over(Window.partitionBy(by).orderBy("section_number"))
        return rows.withColumn("ord", n).select("anchor", F.lit(prio).alias("prio"), "ord", "id", F.lit(name).alias("relation"), F.lit(score).alias("score")).where(F.col("ord") <= each)

    parts = [
        some(a.join(s, F.col("id") == F.col("up")), "parent", 0.95, 0, "anchor"),
        some(a.join(s, F.col("parent") == F.col("anchor")), "child", 0.90, 1, "anchor"),
        some(a.join(s, F.col("parent") == F.col("up")).where("id != anchor"), "sibling", 0.85, 2, "anchor"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(S + """, a AS (SELECT * FROM sec WHERE section_number IN ('1.2', '2', '1.1.1')),
u AS (SELECT a.id AS anchor, 0 AS prio, 1 AS ord, b.id, 'parent' AS relation, 0.95e0 AS score FROM a JOIN sec b ON b.id = a.parent
 UNION ALL SELECT a.id, 1, row_number() OVER (PARTITION BY a.id ORDER BY b.section_number), b.id, 'child', 0.9e0 FROM a JOIN sec b ON b.parent = a.id
 UNION ALL SELECT a.id, 2, row_number() OVER (PARTITION BY a.id ORDER BY b.section_number), b.id, 'sibling', 0.85e0 FROM a JOIN sec b ON b.parent = a.parent AND b.id <> a.id),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY prio, ord) AS n FROM u WHERE ord <= 5) SELECT anchor, id, relation, score FROM r WHERE n <= 8""")
def related_sections(spark, sf_dir):
    """Parent, children and siblings of three sections of every document, best eight."""
    s = sections(spark, sf_dir)
    rows = ranked_family(s, s.where(F.col("section_number").isin("1.2", "2", "1.1.1")))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("anchor").orderBy("prio", "ord"))).where("n <= 8").select("anchor", "id", "relation", "score")


@query(S + ", e AS (SELECT spec_id, title, id FROM sec WHERE content_length = 0), f AS (SELECT spec_id, title, id AS rescued, row_number() OVER (PARTITION BY spec_id, title ORDER BY depth, page_start, section_number) AS n FROM sec WHERE content_length > 0) SELECT id, rescued FROM e JOIN f USING (spec_id, title) WHERE n <= 5")
def title_rescue(spark, sf_dir):
    """For sections without content, the first five with content of the same document and title; these are chosen before the join."""
    s = sections(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("spec_id", "title").orderBy("depth", "page_start", "section_number"))
    full = s.where("content_length > 0").select("spec_id", "title", F.col("id").alias("rescued"), rank.alias("n")).where("n <= 5")
    return s.where("content_length = 0").select("spec_id", "title", "id").join(full, ["spec_id", "title"]).select("id", "rescued")


def related(spark, sf_dir: str, section_id: str | None = None, text: str | None = None, *, same_spec: bool = True, max_results: int = 5) -> list[dict]:
    """Sections that belong with one: its family first, then, if that is too little, what a search for its title finds; or what a
    text finds, in any document. A score of 0 counts as 0.5."""
    from .search import search

    out: list[dict] = []
    tree = sections(spark, sf_dir)
    if section_id:
        anchor = by_id(tree, section_id)
        row = anchor.first()
        if row is None:
            return []
        near = tree.where(F.col("spec_id") == split_id(section_id)[0])
        out = [{"section_id": r["id"], "relation": r["relation"], "score": r["score"]} for r in ranked_family(near, anchor).orderBy("prio", "ord").collect()]
        if len(out) >= max_results:
            return out[:max_results]
        text, spec, relation = row["title"], split_id(section_id)[0] if same_spec else None, "keyword_related"
    else:
        spec, relation = None, "query_match"
    seen = {section_id, *(r["section_id"] for r in out)} if section_id else set()
    for r in search(spark, sf_dir, text or "", spec=spec, max_results=max_results * 2, mode="keyword", include_scores=True)["results"] if text else []:
        if r["section_id"] not in seen:
            out.append({"section_id": r["section_id"], "relation": relation, "score": r["score"] or 0.5})
            seen.add(r["section_id"])
    return out[:max_results]
