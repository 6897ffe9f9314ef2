"""The public operators with their arguments: each answers with a record, or with what is wrong with the arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..plans.registry import query
from ..sources.tables import SECTIONS_SQL, TOC_SQL, sections, specs, toc
from . import codes, deliveries, graph, navigation, parser, search


def contents(tree: DataFrame, rows: DataFrame, spec_id: str, *, max_depth: int = 4, prefix: str | None = None, briefs: bool = True) -> DataFrame:
    """The contents of a document in order: below a depth, within a subtree; without contents rows its first 100 sections, by
    number as text, which no depth bounds."""
    own = rows.where(F.col("spec_id") == spec_id)
    held = tree.where(F.col("spec_id") == spec_id).select("spec_id", "section_number", "title", "content_length", "page_start", "depth")
    some = own.where(F.col("depth") < max_depth)
    some = some.where(navigation.under("section_number", prefix)) if prefix else some
    listed = some.join(held.select("spec_id", "section_number", "content_length"), ["spec_id", "section_number"], "left").select(
        "section_number", "section_title", "page", "depth", (F.coalesce("content_length", F.lit(0)) > 0).alias("has_content"), (F.col("brief") if briefs else F.lit(None).cast("string")).alias("brief"), F.col("sort_order").cast("long").alias("nth"), F.lit("toc").alias("origin")
    )
    other = held.where(navigation.under("section_number", prefix)) if prefix else held
    none = own.select("spec_id").limit(1)
    rest = other.join(none, "spec_id", "left_anti").orderBy("section_number").limit(100)
    rest = rest.select("section_number", F.col("title").alias("section_title"), F.col("page_start").alias("page"), "depth", (F.col("content_length") > 0).alias("has_content"), F.lit(None).cast("string").alias("brief"), F.lit(0).cast("long").alias("nth"), F.lit("sections").alias("origin"))
    return listed.unionByName(rest).orderBy("nth", "section_number")


@query("WITH " + TOC_SQL + " SELECT t.section_number, section_title, t.page, t.depth, content_length > 0 AS has_content, t.brief, CAST(sort_order AS BIGINT) AS nth, 'toc' AS origin FROM toc t JOIN sec s ON s.spec_id = t.spec_id AND s.section_number = t.section_number WHERE t.spec_id = '7' AND t.depth < 2 AND (t.section_number = '1' OR t.section_number LIKE '1.%')")
def spec_toc(spark, sf_dir):
    """One document's subtree to a depth."""
    return contents(sections(spark, sf_dir), toc(spark, sf_dir), "7", max_depth=2, prefix="1")


@query("WITH " + SECTIONS_SQL + " SELECT section_number, title AS section_title, page_start AS page, depth, content_length > 0 AS has_content, CAST(NULL AS VARCHAR) AS brief, CAST(0 AS BIGINT) AS nth, 'sections' AS origin FROM (SELECT * FROM sec WHERE spec_id = '5' ORDER BY section_number LIMIT 100)")
def spec_toc_fallback(spark, sf_dir):
    return contents(sections(spark, sf_dir), toc(spark, sf_dir), "5", max_depth=1)


def section_rows(tree: DataFrame, section_id: str, *, max_chars: int | None = None, neighbors: int = 0) -> DataFrame:
    """One section, its content cut, and its neighbours in the document's order."""
    spec, number = navigation.split_id(section_id)
    own = tree.where(F.col("spec_id") == spec)
    content, truncated = navigation.cut(F.col("content"), max_chars)
    near = navigation.neighbors(own, neighbors).where(F.col("section_number") == number)
    return near.select("id", "section_number", "title", "page_start", "page_end", "parent", content.alias("content"), "content_length", (F.length(F.trim("content")) > 0).alias("has_content"), truncated.alias("truncated"), F.transform("near", lambda x: x["id"]).alias("neighbors") if neighbors else F.array().cast("array<string>").alias("neighbors"))


@query("WITH " + SECTIONS_SQL + ", o AS (SELECT *, row_number() OVER (ORDER BY l, s, c) AS n FROM sec WHERE spec_id = '7') SELECT id, section_number, title, parent, substr(content, 1, 20) AS content, content_length, length(trim(content)) > 0 AS has_content, length(content) > 20 AS truncated, (SELECT string_agg(b.id, ',' ORDER BY n) FROM o b WHERE b.n <> o.n AND abs(b.n - o.n) <= 3) AS neighbors FROM o WHERE section_number = '1.1'")
def section_record(spark, sf_dir):
    """A section with its content cut and three neighbours either side."""
    rows = section_rows(sections(spark, sf_dir), "7:1.1", max_chars=20, neighbors=3)
    return rows.select("id", "section_number", "title", "parent", "content", "content_length", "has_content", "truncated", F.array_join("neighbors", ",").alias("neighbors"))


class Engine:
    """All public operators over one corpus. Arguments are checked first; faults come back as ``{"error": ..., "details": [...]}``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.at = spark, sf_dir
        self.registry = {"search": self._search, "section": self._section, "toc": self._toc, "catalog": self._catalog, "references": self._references, "deliveries": self._deliveries, "delivery": self._delivery, "related": self._related, "guide": self._guide, "specs": self._specs, "cause": self._cause}

    def call(self, name: str, **args) -> dict:
        if name not in self.registry:
            return {"error": f"no operator {name}"}
        if faults := parser.check(name, args):
            return {"error": "validation_error", "details": [{"field": f, "message": m} for f, m in faults]}
        return self.registry[name](**{k: v for k, v in args.items() if v is not None})

    def _search(self, query, spec=None, maxResults=5, page=1, mode="auto", includeScores=False, vector=None):
        return search.search(self.spark, self.at, query, spec=spec, max_results=maxResults, page=page, mode=mode, include_scores=includeScores, vector=vector)

    def _section(self, sectionId=None, specId=None, sectionNumber=None, includeNeighbors=False, neighborWindow=1, maxChars=None):
        section_id = sectionId or (f"{specId}:{sectionNumber}" if specId and sectionNumber else None)
        if not section_id:
            return {"error": "sectionId, or specId and sectionNumber, are needed"}
        tree = sections(self.spark, self.at)
        row = section_rows(tree, section_id, max_chars=maxChars, neighbors=neighborWindow if includeNeighbors else 0).first()
        if row is None:
            return {"error": f"no section {section_id}", "suggestions": [{"id": r["id"], "title": r["title"]} for r in navigation.suggested(tree, section_id).collect()]}
        out = {"section": {k: v for k, v in row.asDict().items() if k != "neighbors"}}
        if includeNeighbors:
            out["neighbors"] = row["neighbors"]
        if not row["has_content"]:
            out["navigation"] = self._navigation(tree, section_id)
        return out

    def _navigation(self, tree: DataFrame, section_id: str) -> dict:
        spec, number = navigation.split_id(section_id)
        near = tree.where((F.col("spec_id") == spec) & F.col("section_number").startswith(number + "."))
        briefs = toc(self.spark, self.at).where(F.col("spec_id") == spec)
        kids = navigation.children(near.where(F.col("parent") == section_id), briefs, 10).orderBy("n")
        below = navigation.suggestions(near).where(F.col("above") == section_id).orderBy("nth")
        entry = lambda r: {"section_id": r["id"], "section_title": r["title"], "content_length": r["content_length"], "has_content": r["content_length"] > 0}
        brief = lambda r: {"brief": r["summary"]} if r["summary"] else {}
        return {"navigation_only": True, "child_sections": [entry(r) | brief(r) for r in kids.withColumn("summary", fn.summary(F.col("brief"))).collect()], "suggested_sections": [entry(r) for r in below.collect()], "descendant_content_count": near.where("content_length > 0").count()}

    def _toc(self, specId, maxDepth=4, sectionPrefix=None, includeBriefs=True):
        spec = specs(self.spark, self.at).where(F.col("id") == specId).first()
        if spec is None:
            return {"error": f"no document {specId}", "available": [r["id"] for r in specs(self.spark, self.at).select("id").orderBy("id").limit(1000).collect()]}
        tree = sections(self.spark, self.at)
        rows = contents(tree, toc(self.spark, self.at), specId, max_depth=maxDepth, prefix=sectionPrefix, briefs=includeBriefs).collect()
        out = {"spec_id": specId, "title": spec["title"], "entries": [r.asDict() for r in rows]}
        if sectionPrefix and (row := navigation.by_id(tree, f"{specId}:{sectionPrefix}").first()) is not None and not row["content_length"]:
            out |= {"focus_section": row["id"], "navigation": self._navigation(tree, row["id"])}
        return out

    def _catalog(self, filter=None, family=None):
        return {"specs": [r.asDict() for r in deliveries.catalog(specs(self.spark, self.at), filter, family).collect()]}

    def _references(self, specId, direction="both", inCorpusOnly=False, maxResults=20):
        return graph.references(self.spark, self.at, specId, direction=direction, in_corpus_only=inCorpusOnly, max_results=maxResults)

    def _deliveries(self, query=None, publicationType=None, mappedSpec=None, range=None, onlyIngested=False, hasVersions=None, hasFiles=None, selectedForIngest=None, ingestStatus=None, maxResults=25):
        d = deliveries.Deliveries(self.spark, self.at)
        rows = deliveries.search_deliveries(d, text=query, publication_type=publicationType, mapped_spec=mappedSpec, range_name=range, only_ingested=onlyIngested, has_versions=hasVersions, has_files=hasFiles, selected=selectedForIngest, status=ingestStatus, max_results=maxResults)
        return {"status": {r["name"]: r["n"] for r in deliveries.catalog_status(self.spark, self.at).collect()}, "documents": [r.asDict() for r in rows.collect()]}

    def _delivery(self, documentId=None, publicationType=None, number=None, mappedSpec=None, includeFiles=False, maxVersions=25):
        found, top = deliveries.find_delivery(deliveries.Deliveries(self.spark, self.at), document_id=documentId, publication_type=publicationType, number=number, mapped_spec=mappedSpec, include_files=includeFiles, max_versions=maxVersions)
        row = found.first()
        return {"error": "no such delivery"} if row is None else {"document": row.asDict(), "versions": [r.asDict(recursive=True) for r in top.collect()]}

    def _related(self, sectionId=None, specId=None, sectionNumber=None, query=None, sameSpecOnly=True, maxResults=5):
        section_id = sectionId or (f"{specId}:{sectionNumber}" if specId and sectionNumber else None)
        if not section_id and not query:
            return {"error": "sectionId, specId and sectionNumber, or query are needed"}
        return {"anchor": section_id or query, "results": navigation.related(self.spark, self.at, section_id, query, same_spec=sameSpecOnly, max_results=maxResults)}

    def _guide(self, type):
        return codes.guide(type)

    def _specs(self):
        rows = specs(self.spark, self.at).select("id", "title", "total_sections").orderBy("id")
        return {"specs": [r.asDict() for r in rows.collect()]}

    def _cause(self, number, network="lte"):
        return codes.cause(self.spark, self.at, number, network)
