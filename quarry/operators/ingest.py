"""Corpus building: lines, headings, spans, page numbers, chunks, embedding text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..plans.registry import query
from ..sources import files
from ..sources.store import work_dir
from ..sources.tables import SECTIONS_SQL, SPACES, TOC_SQL, sections, table, toc

LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), hd AS (SELECT *, length(line) BETWEEN 1 AND 60 AS heading FROM ln)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return d.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "line", F.length("line").between(1, 60).alias("heading"))


def by_line():
    return Window.partitionBy("doc_id").orderBy("n")


@query("SELECT doc_id, CAST(g AS BIGINT) - 1 AS n, unnest AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS unnest, generate_subscripts(string_split(text, chr(10)), 1) AS g FROM documents) UNION ALL SELECT doc_id, -k, ['a', 'b', '', 'c', 'd'][k] FROM documents, (SELECT unnest(range(1, 6)) AS k)")
def doc_lines(spark, sf_dir):
    """Lines by any line end: each text's, and those of a text of five line ends."""
    d = table(spark, sf_dir, "documents")
    odd = F.lit("a\fb\u2028\r\nc\x85d\n")
    own = d.select("doc_id", F.posexplode(files.text_lines(F.col("text"))).alias("n", "line")).select("doc_id", F.col("n").cast("long").alias("n"), "line")
    return own.unionByName(d.select("doc_id", F.posexplode(files.text_lines(odd)).alias("n", "line")).select("doc_id", (-1 - F.col("n")).cast("long").alias("n"), "line"))


@query(f"WITH {LINES} SELECT doc_id, n, CASE n % 4 WHEN 1 THEN 'numbered' WHEN 2 THEN 'annex' ELSE 'named' END AS kind, CASE n % 4 WHEN 1 THEN n || '.2' WHEN 2 THEN 'Annex B' ELSE '' END AS number FROM ln WHERE n % 4 <> 0 AND (n % 4 <> 2 OR trim(line) <> '')")
def heading_scan(spark, sf_dir):
    """Headings among lines, of three in four of which are made one of the three kinds."""
    n = F.col("n") % 4
    made = F.when(n == 1, F.concat(F.col("n").cast("string"), F.lit(".2  Title "), "line")).when(n == 2, F.concat(F.lit("Annex B (informative): "), "line")).when(n == 3, "References").otherwise(F.concat(F.lit("- "), "line"))
    rows = lines(spark, sf_dir).where("n % 4 != 2 or trim(line) != ''").withColumn("made", made)
    return rows.select("doc_id", "n", fn.heading_kind(F.col("made")).alias("kind"), fn.heading_number(F.col("made")).alias("number")).where("kind is not null")


@query(f"WITH {LINES}, sp AS (SELECT doc_id, line, n, lead(n) OVER (PARTITION BY doc_id ORDER BY n) AS nxt FROM hd WHERE heading), e AS (SELECT doc_id, max(n) AS last FROM ln GROUP BY doc_id) SELECT sp.doc_id, n AS first_line, coalesce(nxt - 1, last) AS last_line FROM sp JOIN e ON sp.doc_id = e.doc_id")
def section_spans(spark, sf_dir):
    """Each heading's span: up to the next heading of any level, or the document's end."""
    w = Window.partitionBy("doc_id")
    rows = lines(spark, sf_dir).withColumn("last", F.max("n").over(w)).where("heading")
    return rows.select("doc_id", F.col("n").alias("first_line"), F.coalesce(F.lead("n").over(by_line()) - 1, "last").alias("last_line"))


@query(f"WITH {LINES} SELECT doc_id, n, coalesce(last_value(CASE WHEN heading THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING), 1) AS page FROM hd")
def page_ffill(spark, sf_dir):
    """The last marker so far, 1 before the first."""
    marker = F.last(F.when(F.col("heading"), F.col("n")), ignorenulls=True).over(by_line().rowsBetween(Window.unboundedPreceding, 0))
    return lines(spark, sf_dir).select("doc_id", "n", F.coalesce(marker, F.lit(1)).cast("long").alias("page"))


@query(f"WITH {LINES} SELECT doc_id, n, CAST(1 + sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS page FROM hd")
def virtual_pages(spark, sf_dir):
    count = F.sum(F.col("heading").cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0))
    return lines(spark, sf_dir).select("doc_id", "n", (count + 1).alias("page"))


@query("SELECT d.doc_id, coalesce(CASE WHEN quality IS NOT NULL THEN 'label ' || quality END, substr(text, 1, 40)) AS loader, coalesce(nullif(substr(text, 1, 40), ''), 'label ' || quality) AS only_null FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def brief_backfill(spark, sf_dir):
    """Back-fill from a join in both priorities: new first, and only where null."""
    new = F.concat(F.lit("label "), F.col("quality").cast("string"))
    old = F.substring("text", 1, 40)
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(new, old).alias("loader"), F.coalesce(F.nullif(old, F.lit("")), new).alias("only_null"))


@query("SELECT doc_id, s // 2800 AS chunk, substr(text, CAST(s + 1 AS BIGINT), 3000) AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 200, 1), 2800)) AS s FROM documents)")
def fixed_chunks(spark, sf_dir):
    """Windows of 3000 characters that overlap by 200, until one reaches the end."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 201, F.lit(0)), F.lit(2800))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(starts).alias("s"))
    return rows.select("doc_id", F.floor(F.col("s") / 2800).cast("long").alias("chunk"), F.substring("text", F.col("s") + 1, F.lit(3000)).alias("content"))


def packed(text, size: int = 3000, overlap: int = 200) -> F.Column:
    """Paragraphs packed greedily: one that would make a chunk longer than ``size`` starts a new one, which begins with the last ``overlap`` characters of the old."""
    paragraphs = F.filter(F.split(F.regexp_replace(text, r"\n--- Page \d+/\d+ ---\n", "\n"), r"\n\n+"), lambda p: F.trim(p, F.lit(" \n\t\r\f")) != "")
    clean = lambda x: F.trim(x, F.lit(" \n\t\r\f"))
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(s, p):
        full = (F.length(s["now"]) + F.length(p) > size) & (s["now"] != "")
        rest = F.when(F.length(s["now"]) > overlap, F.substring(s["now"], -overlap, overlap)).otherwise("")
        return F.struct(F.when(full, F.concat(s["done"], F.array(clean(s["now"])))).otherwise(s["done"]).alias("done"), F.concat(F.when(full, rest).otherwise(s["now"]), p, F.lit("\n\n")).alias("now"))

    return F.aggregate(paragraphs, state, add, lambda s: F.when(clean(s["now"]) != "", F.concat(s["done"], F.array(clean(s["now"])))).otherwise(s["done"]))


@query("""WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\n+'), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13)) <> '') AS ps FROM documents),
f AS (SELECT doc_id, ps, 1 AS i, CAST('' AS VARCHAR) AS now, CAST([] AS VARCHAR[]) AS done FROM p UNION ALL
 SELECT doc_id, ps, i + 1, CASE WHEN length(now) + length(ps[i]) > 300 AND now <> '' THEN CASE WHEN length(now) > 40 THEN right(now, 40) ELSE '' END ELSE now END || ps[i] || chr(10) || chr(10),
  CASE WHEN length(now) + length(ps[i]) > 300 AND now <> '' THEN list_append(done, trim(now, ' ' || chr(10) || chr(9) || chr(13))) ELSE done END FROM f WHERE i <= len(ps))
SELECT doc_id, unnest(CASE WHEN trim(now, ' ' || chr(10) || chr(9) || chr(13)) <> '' THEN list_append(done, trim(now, ' ' || chr(10) || chr(9) || chr(13))) ELSE done END) AS content FROM f WHERE i = len(ps) + 1""")
def para_chunks(spark, sf_dir):
    """Lines as paragraphs, packed to 300 characters with an overlap of 40, by a fold within the row."""
    chunks = packed(F.replace("text", F.lit("\n"), F.lit("\n\n")), 300, 40)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(chunks).alias("content"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles, count(*) AS chunks, count(*) FILTER (length(trim(text)) = 0 OR text IS NULL) AS rejected FROM conversations GROUP BY conv_id")
def chunk_groups(spark, sf_dir):
    """Chunks by source, in order, with the empty ones counted."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"), F.count("*").alias("chunks"), F.count(F.when(F.col("text").isNull() | (F.length(F.trim("text")) == 0), 1)).alias("rejected"))
    return rows.select("conv_id", F.array_join(F.col("x.role"), ",").alias("roles"), "chunks", "rejected")


@query("WITH " + SECTIONS_SQL + f" SELECT id, 'passage: ' || trim({SPACES.format("substr(trim('TS ' || spec_id || ' Section ' || section_number || rtrim(' ' || trim(" + SPACES.format('title') + ")) || chr(10) || trim(" + SPACES.format('content') + "), ' ' || chr(10)), 1, 4000)")}) AS passage FROM sec")
def embedding_text(spark, sf_dir):
    """A section's header line and content, cut to 4000 characters, as a passage."""
    x = fn.passage(F.concat(F.lit("ts_"), "spec_id"), F.col("section_number"), F.col("title"), F.col("content"))
    return sections(spark, sf_dir).select("id", fn.prefixed("passage:", x).alias("passage"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def embed_pending(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def index_reasons(counts: DataFrame, meta: DataFrame) -> DataFrame:
    """Why a vector index (sections, vectors: counts) is not to be used, by its metadata (signature, section_count, vec_row_count; none or one row) and the expected signature; available if there is no reason."""
    rows = counts.join(meta, F.lit(True), "left")
    has = F.col("signature").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(F.col("vectors") == 0, "no_vectors"), F.when(~has, "missing_metadata"), F.when(has & (F.col("signature") != F.col("expected")), "stale_policy"),
        F.when(has & (F.col("section_count") != F.col("sections")), "section_count_mismatch"), F.when(has & (F.col("vec_row_count") != F.col("vectors")), "metadata_vec_count_mismatch"), F.when(F.col("vectors") != F.col("sections"), "incomplete_index"),
    ))
    return rows.withColumn("reasons", F.array_join(reasons, ",")).withColumn("available", F.size(reasons) == 0)


@query("""WITH n AS (SELECT (SELECT count(*) FROM documents) AS d, (SELECT count(*) FROM embeddings) AS e)
SELECT 0 AS nth, d AS sections, d AS vectors, '' AS reasons, true AS available FROM n UNION ALL SELECT 1, d, e, CASE WHEN d <> e THEN 'section_count_mismatch,metadata_vec_count_mismatch,incomplete_index' ELSE 'section_count_mismatch,metadata_vec_count_mismatch' END, false FROM n
UNION ALL SELECT 2, d, 0, 'no_vectors,missing_metadata,incomplete_index', false FROM n UNION ALL SELECT 3, d, d, 'stale_policy', false FROM n""")
def index_freshness(spark, sf_dir):
    """A fresh index, one that lags behind, none at all, one of another policy."""
    d, e = (table(spark, sf_dir, t).agg(F.count("*").alias("n")) for t in ("documents", "embeddings"))

    def case(nth, vectors, signature, same):
        counts = d.select(F.col("n").alias("sections")).crossJoin(vectors.select(F.col("n").alias("vectors"))).withColumn("expected", F.lit("s1"))
        own = counts.select(F.lit(signature).alias("signature"), (F.col("sections") + (0 if same else 7)).alias("section_count"), (F.col("vectors") + (0 if same else 7)).alias("vec_row_count"))
        return index_reasons(counts, own if signature else own.limit(0)).select(F.lit(nth).alias("nth"), "sections", "vectors", "reasons", "available")

    none = d.select(F.lit(0).cast("long").alias("n"))
    return case(0, d, "s1", True).unionByName(case(1, e, "s1", False)).unionByName(case(2, none, None, True)).unionByName(case(3, d, "s0", True))


@query("SELECT a.doc_id AS id, a.text AS title, b.text AS section FROM (SELECT doc_id, substr(text, 1, 10) AS text FROM documents) a LEFT JOIN (SELECT item_id, substr(text, 1, 10) AS text FROM benchmark) b ON a.doc_id = b.item_id")
def meta_join(spark, sf_dir):
    """Records with the metadata of their number, where there is some."""
    meta = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.substring("text", 1, 10).alias("section"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 10).alias("title")).join(meta, "id", "left")


def embed(rows: DataFrame, embed_texts=None, dim: int = 64, key: str = "id", text: str = "text") -> DataFrame:
    """(key, embedding) of (key, text): ``embed_texts`` maps a list of texts to vectors, a batch at a time, and is built once a task.

    The default hashes words to signed places and scales to length one: it is deterministic and says nothing of meaning.
    """
    import numpy as np
    import pandas as pd

    def hashed(texts):
        import xxhash

        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dim] += 1 if h >> 63 else -1
            n = float(np.linalg.norm(out[i]))
            out[i] /= n or 1.0
        return out

    def run(frames):
        make = embed_texts or hashed
        for pdf in frames:
            for at in range(0, len(pdf), 16):
                part = pdf.iloc[at : at + 16]
                vectors = make(part[text].tolist())
                if len(vectors) != len(part) or any(len(v) != dim for v in vectors):
                    raise ValueError("the embedder gave vectors of another number or size")
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": [list(map(float, v)) for v in vectors]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def update_index(sections_: DataFrame, vectors: DataFrame, embed_texts=None, *, rebuild: bool = False, policy_matches: bool = True, spec_id: str | None = None) -> DataFrame:
    """The vectors after an update: those that are there stay, missing ones are made; all of the scope if it is rebuilt. A changed policy asks for a rebuild of all."""
    if not policy_matches and (spec_id or not rebuild):
        raise ValueError("the embedding policy changed: rebuild the whole index")
    target = sections_ if spec_id is None else sections_.where(F.col("spec_id") == spec_id)
    kept = vectors.join(target.select("id"), "id", "left_anti") if rebuild else vectors
    fresh = target if rebuild else target.join(vectors.select("id"), "id", "left_anti")
    return kept.unionByName(embed(fresh, embed_texts))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE 'new' END AS origin, 64 AS dim FROM documents")
def embed_index(spark, sf_dir):
    """An index of a third of the documents brought up to date; every vector of the right size."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("s").alias("spec_id"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    old = d.where("doc_id % 3 = 0").select("id", F.array_repeat(F.lit(9.0).cast("float"), 64).alias("embedding"))
    out = update_index(d.drop("doc_id"), old)
    return out.select("id", F.when(F.col("embedding")[0] == 9.0, "old").otherwise("new").alias("origin"), F.size("embedding").alias("dim"))


def records(spark, sf_dir) -> str:
    """A folder of structure files: two records and a damaged line a document, blank lines between; written once."""

    def build():
        d = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 30).alias("t"))
        meta = F.to_json(F.struct(F.lit("spec_meta").alias("type"), F.col("doc_id").cast("string").alias("spec_id"), F.col("t").alias("title"), F.lit(3).alias("total_pages")))
        entry = F.to_json(F.struct(F.lit("toc_entry").alias("type"), F.col("doc_id").cast("int").alias("page"), F.col("t").alias("title"), F.lit("1.2").alias("section_number")))
        return d.select(F.explode(F.array(meta, F.lit("  "), entry, F.lit('{"type": "toc_entry", '))).alias("value"))

    path = _folders.get((spark.sparkContext.applicationId, sf_dir))
    if path is None:
        path = _folders[spark.sparkContext.applicationId, sf_dir] = work_dir(spark, "records")
        build().write.text(path)
    return path


_folders: dict[tuple, str] = {}


@query("SELECT CAST(doc_id AS VARCHAR) AS spec_id, substr(text, 1, 30) AS title, 3 AS total_pages FROM documents")
def jsonl_meta(spark, sf_dir):
    """The metadata records of structure files."""
    good, _ = files.read_lines(spark, records(spark, sf_dir))
    return files.split_by_type(good)["spec_meta"].select("spec_id", "title", "total_pages")


@query("SELECT CAST(doc_id AS INTEGER) AS page, substr(text, 1, 30) AS title, '1.2' AS section_number FROM documents")
def jsonl_toc(spark, sf_dir):
    good, _ = files.read_lines(spark, records(spark, sf_dir))
    return files.split_by_type(good)["toc_entry"].select("page", "title", "section_number")


@query("SELECT count(*) AS bad, min('{\"type\": \"toc_entry\", ') AS line FROM documents")
def jsonl_bad_lines(spark, sf_dir):
    """Lines that are no JSON, told instead of failing."""
    _, bad = files.read_lines(spark, records(spark, sf_dir))
    return bad.agg(F.count("*").alias("bad"), F.min("line").alias("line"))


@query("SELECT 'legacy' AS source, substr(text, 1, 20) AS text FROM documents UNION ALL SELECT 's' || doc_id, '' FROM documents")
def legacy_chunks(spark, sf_dir):
    """Chunk files of both shapes."""
    path = _folders.get((spark.sparkContext.applicationId, sf_dir, "chunks"))
    if path is None:
        path = _folders[spark.sparkContext.applicationId, sf_dir, "chunks"] = work_dir(spark, "chunks")
        d = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 50).alias("g"))
        first = d.agg(F.to_json(F.collect_list(F.struct(F.substring("text", 1, 20).alias("content"), F.struct(F.lit("legacy").alias("source")).alias("metadata")))).alias("value"))
        second = d.agg(F.to_json(F.struct(F.collect_list(F.struct(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("spec"))).alias("chunks"))).alias("value"))
        for i, part in enumerate((first, second)):
            part.select("g", "value").write.option("lineSep", "\n").partitionBy("g").text(f"{path}/{i}")
    return files.read_chunks(spark, f"{path}/0").unionByName(files.read_chunks(spark, f"{path}/1")).select("source", "text")


@query("WITH " + SECTIONS_SQL + " SELECT id, content FROM sec WHERE depth = 0 AND l <= 2")
def jsonl_sections(spark, sf_dir):
    """Section files written a folder a document group, and read again."""
    key = spark.sparkContext.applicationId, sf_dir, "sections"
    if key not in _folders:
        _folders[key] = work_dir(spark, "section-lines")
        rows = sections(spark, sf_dir).where("depth = 0 and l <= 2").select(F.col("id").alias("section_id"), F.expr("cast(spec_id as int) % 4").cast("string").alias("spec_id"), "section_number", "content")
        files.write_lines(rows, _folders[key])
    good, _ = files.read_lines(spark, _folders[key] + "/*", files.SECTION)
    return good.select(F.col("section_id").alias("id"), "content")


def spans(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections of contents entries (spec_id, nth, page, section_number, title) over pages (spec_id, page, text).

    A heading's place is that of its line on its page, the first place of that line's text there, 0 if it is not found. A section
    ends where the next heading of any level begins, the last one with the document. Pages between are an interval join
    by document; each gives the part that belongs to the section.
    """
    lines_ = F.split("text", "\n")
    same = lambda x: fn.heading_number(x) == F.col("section_number")
    hit = F.filter(lines_, lambda x: (F.trim(x) != "") & (F.col("section_number") != "") & same(x))
    at = F.when(F.size(hit) > 0, F.greatest(F.position(F.get(hit, F.lit(0)), F.col("text")) - 1, F.lit(0))).otherwise(0)
    placed = entries.join(pages, ["spec_id", "page"], "left").withColumn("offset", F.coalesce(at, F.lit(0))).drop("text")
    last = pages.groupBy("spec_id").agg(F.max_by(F.struct("page", F.length("text").alias("size")), "page").alias("end"))
    w = Window.partitionBy("spec_id").orderBy("page", "offset", "nth")
    ordered = placed.join(last, "spec_id", "left").withColumns({"idx": F.row_number().over(w) - 1, "page_end": F.coalesce(F.lead("page").over(w), F.col("end.page")), "offset_end": F.coalesce(F.lead("offset").over(w), F.col("end.size"))})
    each = ordered.withColumnRenamed("page", "page_start").join(pages, "spec_id").where((F.col("page") >= F.col("page_start")) & (F.col("page") <= F.col("page_end")) & (F.col("text") != ""))
    begin = F.when(F.col("page") == F.col("page_start"), F.col("offset")).otherwise(0)
    stop = F.when(F.col("page") == F.col("page_end"), F.col("offset_end")).otherwise(F.length("text"))
    parts = each.withColumn("part", F.substring("text", begin + 1, F.greatest(stop - begin, F.lit(0))))
    keys = ["spec_id", "idx", "section_number", "title", "page_start", "page_end"]
    whole = parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "part"))), lambda x: x["part"]), "\n").alias("content"))
    out = ordered.select(*[F.col("page").alias("page_start") if k == "page_start" else k for k in keys]).join(whole, keys, "left").withColumn("content", F.trim(F.coalesce("content", F.lit("")), F.lit(" \n\t\r\f")))
    number = F.col("section_number")
    return out.select(F.concat_ws(":", "spec_id", F.when(number == "", F.concat(F.lit("_untitled_"), F.col("idx").cast("string"))).otherwise(number)).alias("section_id"), fn.without_number(F.col("title"), number).alias("section_title"), "page_start", "page_end", "content", F.length("content").alias("content_length"), fn.span_brief(F.col("content")).alias("brief"))


@query("""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS s, replace(replace(substr(text, 1, 40), chr(10), ' '), '  ', ' ') AS t, replace(substr(text, 41, 30), chr(10), ' ') AS u FROM documents),
x AS (SELECT s, '1' AS n, 'One' AS title, 1 AS a, 1 AS b, '1 One' || chr(10) || t || chr(10) AS c FROM d UNION ALL SELECT s, '1.1', 'Sub', 1, 3, '1.1 Sub' || chr(10) || u || chr(10) || 'middle ' || t || chr(10) || 'top ' || u || chr(10) FROM d
 UNION ALL SELECT s, 'Annex A', '(normative): End', 3, 3, 'Annex A (normative): End' || chr(10) || t FROM d)
SELECT s || ':' || n AS section_id, title AS section_title, a AS page_start, b AS page_end, trim(c, ' ' || chr(10) || chr(9) || chr(13)) AS content FROM x""")
def section_build(spark, sf_dir):
    """Three pages a document, three headings: two on one page, one over three pages, one at the end."""
    flat = lambda a, n: F.replace(F.substring("text", a, n), F.lit("\n"), F.lit(" "))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("spec_id"), F.replace(flat(1, 40), F.lit("  "), F.lit(" ")).alias("t"), flat(41, 30).alias("u"))
    text = lambda *x: F.concat(*(F.lit(y) if y not in ("t", "u") else F.col(y) for y in x))
    page = lambda n, x: F.struct(F.lit(n).alias("page"), x.alias("text"))
    pages = d.select("spec_id", F.explode(F.array(page(1, text("1 One\n", "t", "\n1.1 Sub\n", "u")), page(2, text("middle ", "t")), page(3, text("top ", "u", "\nAnnex A (normative): End\n", "t")))).alias("p")).select("spec_id", "p.*")
    entry = lambda n, p, number, title: F.struct(F.lit(n).alias("nth"), F.lit(p).alias("page"), F.lit(number).alias("section_number"), F.lit(title).alias("title"))
    entries = d.select("spec_id", F.explode(F.array(entry(1, 1, "1", "1 One"), entry(2, 1, "1.1", "1.1 Sub"), entry(3, 3, "Annex A", "Annex A (normative): End"))).alias("e")).select("spec_id", "e.*")
    return spans(entries, pages).drop("content_length", "brief")


#: fixed values: how header and footer lines of memos begin
RUNNING = r"(?i)^(?:RFC\s+\d+|Network Working Group|Request for Comments|STD:\s*\d+|BCP:\s*\d+|Obsoletes:|Updates:|Category:|ISSN:|Internet-Std|\S+\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})"
#: fixed values: a page mark
MARK = r"(?i)\[Page\s+(\d+)\]"


def memo_sections(rows: DataFrame) -> DataFrame:
    """Sections of memo texts, from their lines (spec_id, n from 0, line).

    A heading is a numbered line without indent, of up to five numbers and a title of three characters or more. The page of a line is
    that of the last page mark so far, the line's own included (so pages lag, as marks are footers). Marks and running lines
    are not content. ``nth`` numbers the sections of a text: of those that share a number an upsert keeps the last.
    """
    shape = r"^(\d+(?:\.\d+)*)\.?\s+(\S.*)$"
    title = F.regexp_replace(F.trim(F.regexp_extract("line", shape, 2)), r"\s+\d+\s*$", "")
    number = F.regexp_extract("line", shape, 1)
    head = F.col("line").rlike(shape) & (F.length(F.trim(title)) >= 3) & (F.size(F.split(number, r"\.")) <= 5)
    mark = F.regexp_extract("line", MARK, 1)
    w = Window.partitionBy("spec_id").orderBy("n")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumns({"head": head, "page": F.coalesce(F.last(F.when(mark != "", mark.cast("int")), ignorenulls=True).over(so_far), F.lit(1))})
    numbered = marked.withColumn("k", F.sum(F.col("head").cast("int")).over(so_far)).where("k > 0")
    cleaned = F.regexp_replace(F.regexp_replace("line", MARK, ""), r"\s+$", "")
    body = F.when(~F.col("head") & ~F.trim(cleaned).rlike(RUNNING), F.struct("n", cleaned.alias("line")))
    out = numbered.groupBy("spec_id", "k").agg(
        F.max(F.when(F.col("head"), number)).alias("section_number"), F.max(F.when(F.col("head"), F.trim(title))).alias("section_title"), F.min_by("page", "n").alias("page_start"), F.max_by("page", "n").alias("page_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda x: x["line"]), "\n").alias("content"),
    )
    content = F.trim("content", F.lit(" \n\t\r\f"))
    up = F.regexp_extract("section_number", r"^(.*)\.[^.]*$", 1)
    return out.select(F.concat_ws(":", "spec_id", "section_number").alias("section_id"), "section_title", "page_start", "page_end", fn.depth(F.col("section_number")).alias("depth"), F.when(up != "", F.concat_ws(":", "spec_id", up)).alias("parent_section"), content.alias("content"), fn.memo_brief(content).alias("brief"), F.col("k").alias("nth"))


@query("""WITH d AS (SELECT 'rfc_' || doc_id AS s, replace(substr(text, 1, 40), chr(10), ' ') AS t FROM documents) SELECT s || ':1' AS section_id, 'Introduction' AS section_title, 1 AS page_start, 1 AS page_end, 0 AS depth, CAST(NULL AS VARCHAR) AS parent_section, trim('x ' || t) AS content FROM d
UNION ALL SELECT s || ':1.1', 'Words of it', 1, 2, 1, s || ':1', trim(rtrim('y ' || t) || chr(10) || chr(10) || '   z ' || t) FROM d UNION ALL SELECT s || ':2', 'End', 2, 2, 0, NULL, '1.2.3.4.5.6 too deep' || chr(10) || '3 ab' FROM d""")
def rfc_sections(spark, sf_dir):
    """Memos with a running head, an indented contents line, page marks, a form feed, and lines that are nearly headings."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("rfc_"), F.col("doc_id").cast("string")).alias("spec_id"), F.replace(F.substring("text", 1, 40), F.lit("\n"), F.lit(" ")).alias("t"))
    t = F.col("t")
    text = F.concat_ws("\n", F.lit("RFC 1234   Title   May 2020"), F.lit("   1. Introduction .... 3"), F.lit("1.  Introduction   8"), F.concat(F.lit("x "), t), F.lit("1.1 Words of it"), F.concat(F.lit("y "), t), F.lit("Someone               Standards [Page 2]").alias("x"), F.lit("\fRFC 1234   Title   May 2020"), F.concat(F.lit("   z "), t), F.lit("2 End"), F.lit("1.2.3.4.5.6 too deep"), F.lit("3 ab"))
    rows = d.withColumn("text", F.replace(text, F.lit("Someone               Standards "), F.lit("RFC 1234 foot ")))
    return memo_sections(rows.select("spec_id", F.posexplode(files.text_lines(F.col("text"))).alias("n", "line"))).drop("brief", "nth")


@query("WITH " + TOC_SQL + " SELECT t.spec_id, t.section_number, coalesce('new ' || length(s.content), t.brief) AS loader, coalesce(t.brief, 'new ' || length(s.content)) AS only_null FROM toc t LEFT JOIN sec s ON s.spec_id = t.spec_id AND s.section_number = t.section_number")
def brief_backfill_toc(spark, sf_dir):
    """Briefs of contents rows from their sections: always, and only where there is none."""
    s = sections(spark, sf_dir).select("spec_id", "section_number", F.concat(F.lit("new "), F.col("content_length").cast("string")).alias("new"))
    return toc(spark, sf_dir).join(s, ["spec_id", "section_number"], "left").select("spec_id", "section_number", F.coalesce("new", "brief").alias("loader"), F.coalesce("brief", "new").alias("only_null"))
