"""Queries that apply the scalar functions to whole tables; their SQL states the results by rule or value, not by the same patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.tables import SECTIONS_SQL, SPACES, brief_sql, sections, table
from . import text as fn


def values(spark, pairs: list[tuple[str | None, str | None]], schema: str = "raw string, nth int"):
    return spark.createDataFrame([(a, i) for i, (a, _) in enumerate(pairs)], schema)


def expected(pairs: list[tuple[str | None, str | None]], name: str = "out") -> str:
    """SQL of the results that the values must have."""
    text = lambda x: "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"
    return " UNION ALL ".join(f"SELECT {i} AS nth, {text(b)} AS {name}" for i, (_, b) in enumerate(pairs))


def spelled(series, doc, part):
    """Ten spellings of an identifier in Spark."""
    s = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    return F.array(
        s("TS ", series, ".", doc), s("ts_1", series, doc), s("ts_1", series, doc, "_v18.9.0_LTE_NAS"), s("TR ", series, ".", doc, "-", part), s("tr_1", series, doc, "-", part, "_v15-08-00"),
        s("ts_", series, "_", doc, "_", part), s("ts_1", series, doc, "-", part, "_x"), s(" Some.Doc - ", series, " "), F.lit(""), F.lit(None).cast("string"), s("TR_1", series, doc, "_15.01.00"), s("ts_1", series, doc, "_5g_core"),
    )


@query("""WITH n AS (SELECT o_orderkey, CAST(o_orderkey % 90 + 10 AS VARCHAR) AS s, CAST(o_custkey % 900 + 100 AS VARCHAR) AS d, CAST(o_custkey % 9 + 1 AS VARCHAR) AS p FROM orders),
f AS (SELECT o_orderkey, 'ts_' || s || '_' || d AS a, 'tr_' || s || '_' || d AS b, '_' || p AS q, 'some_doc_' || s AS o FROM n)
SELECT o_orderkey, k AS nth, [a, a, a, b || q, b || q, a || q, a || q, o, 'unknown', 'unknown', b, a][k + 1] AS id FROM f, (SELECT unnest(range(0, 12)) AS k)""")
def fn_normalize_id(spark, sf_dir):
    """Identifiers in all their spellings."""
    c = lambda x: x.cast("string")
    raw = spelled(c(F.col("o_orderkey") % 90 + 10), c(F.col("o_custkey") % 900 + 100), c(F.col("o_custkey") % 9 + 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(raw).alias("nth", "raw")).select("o_orderkey", F.col("nth").cast("long").alias("nth"), fn.normalize_id(F.col("raw")).alias("id"))


FILES = [("ts_124301_v18.9.0_LTE_NAS.pdf", "ts_24_301|v18.9.0|"), ("ts_124501v18.2.0.pdf", "ts_24_501|v18.2.0|"), ("TS 24.301 v18.9.0.pdf", "ts_24_301|v18.9.0|"), ("in/ts_24_301_v18.9.0.pdf", "ts_24_301|v18.9.0|"), ("tr_38_901_v18.2.0.pdf", "tr_38_901|v18.2.0|"), ("ts_34_123_1_v9.0.1.pdf", "ts_34_123_1|v9.0.1|"), ("ts24301.pdf", "ts_24_301||"), ("Foo bar-2.pdf", "foo_bar_2||"), ("34229-1-j50.docx", "34229_1_j50||v19.5.0"), ("38523-1-a07.zip", "38523_1_a07||v10.0.7"), ("38523-1-z12.doc", "38523_1_z12||v0.1.2")]


@query(expected(FILES))
def fn_file_ids(spark, sf_dir):
    """Identifier, version and release version that file names tell."""
    raw = F.col("raw")
    return values(spark, FILES).select("nth", F.concat_ws("|", fn.id_of_file(raw), fn.version_of_file(raw), fn.release_of_file(raw)).alias("out"))


@query("SELECT p_partkey, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS title FROM part")
def fn_clean_title(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.clean_title(F.concat(F.lit("  "), F.col("p_name"), F.lit(" ....... "), F.col("p_size").cast("string"))).alias("title"))


@query("WITH " + SECTIONS_SQL + " SELECT id, parent, depth FROM sec")
def fn_parent_depth(spark, sf_dir):
    return sections(spark, sf_dir).select("id", fn.parent_id(F.col("id")).alias("parent"), fn.depth(F.col("section_number")).alias("depth"))


@query(f"WITH x AS (SELECT doc_id, trim({SPACES.format('text')}) AS x FROM documents) SELECT doc_id, {brief_sql('x')} AS brief FROM x")
def fn_brief(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.brief(F.col("text")).alias("brief"))


BRIEFS = [("A short one.", "A short one."), ("Is it? " + "word " * 60, "Is it?"), ("No! " + "word " * 60, "No!"), ("word " * 60, "word " * 35 + "word…"), ("x" * 300, "x" * 180 + "…"), ("  a \n b ", "a b"), (None, ""), (". " + "w" * 300, ". " + "w" * 178 + "…")]


@query(expected(BRIEFS))
def fn_brief_cases(spark, sf_dir):
    """Every branch of the brief."""
    return values(spark, BRIEFS).select("nth", fn.brief(F.col("raw")).alias("out"))


@query(rf"""WITH x AS (SELECT doc_id, text, trim({SPACES.format('text')}) AS x FROM documents), y AS (SELECT *, substr(x, 1, 200) AS c FROM x), z AS (SELECT *, length(regexp_extract(c, '^(.*?[.!?])\s', 1)) AS e, length(c) - length(string_split(c, ' ')[-1]) - 1 AS b FROM y)
SELECT doc_id, CASE WHEN length(x) <= 200 THEN x WHEN e >= 80 THEN substr(x, 1, e) WHEN b > 120 THEN substr(x, 1, b) || '…' ELSE c || '…' END AS memo, trim(substr(text, 1, 200)) AS span FROM z""")
def fn_memo_brief(spark, sf_dir):
    """The two other briefs: the first sentence only beyond 40 %, and the plain prefix."""
    return table(spark, sf_dir, "documents").select("doc_id", fn.memo_brief(F.col("text")).alias("memo"), fn.span_brief(F.col("text")).alias("span"))


@query(f"SELECT doc_id, CASE WHEN length(x) > 220 THEN substr(x, 1, 217) || '...' WHEN x <> '' THEN x END AS summary FROM (SELECT doc_id, trim({SPACES.format('text')}) AS x FROM documents)")
def fn_summarize(spark, sf_dir):
    """Briefs with the boilerplate put in front of each text, which must go before the cut."""
    notice = F.lit("ETSI TS 124 301 V18.9.0 (2024-10)3GPP TS 24.301 version 18.9.0 Release 18 etsi ")
    return table(spark, sf_dir, "documents").select("doc_id", fn.summary(F.concat(notice, "text")).alias("summary"))


@query("WITH " + SECTIONS_SQL + " SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title FROM sec")
def fn_normalize_text(spark, sf_dir):
    return sections(spark, sf_dir).select("id", fn.normalize_text(F.col("title")).alias("title"))


STOP_SQL = "('a', 'an', 'and', 'by', 'for', 'in', 'of', 'on', 'or', 'the', 'to', 'with', 'without')"


@query(f"SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN {STOP_SQL}) AS tokens FROM (SELECT doc_id, 'By what is it, without a ' || text AS x FROM documents)")
def fn_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.content_tokens(F.concat(F.lit("By what is it, without a "), "text")).alias("tokens"))


@query("""WITH n AS (SELECT p_partkey, p_partkey % 90 AS s, p_size AS d, CASE WHEN p_size % 2 = 0 THEN p_size % 30 END AS sub FROM part), m AS (SELECT *, (100000 + s * 1000 + d) || CASE WHEN sub IS NULL THEN '' ELSE lpad(CAST(sub AS VARCHAR), 2, '0') END AS number FROM n)
SELECT p_partkey, number, (CAST(number AS BIGINT) // 100 * 100) || '_' || (CAST(number AS BIGINT) // 100 * 100 + 99) AS dir, 'ts_' || lpad(CAST(s AS VARCHAR), 2, '0') || '_' || lpad(CAST(d AS VARCHAR), 3, '0') || CASE WHEN sub IS NULL THEN '' ELSE '_' || sub END AS id,
 'https://host/deliver/etsi_ts/' || (CAST(number AS BIGINT) // 100 * 100) || '_' || (CAST(number AS BIGINT) // 100 * 100 + 99) || '/' || number || '/18.09.00_60/ts_' || number || 'v180900p.pdf' AS url, '18.9.0' AS shown FROM m""")
def fn_number_map(spark, sf_dir):
    """Delivery numbers from series, document and part, and back; where their files lie."""
    sub = F.when(F.col("p_size") % 2 == 0, F.col("p_size") % 30)
    rows = table(spark, sf_dir, "part").select("p_partkey", fn.delivery_number(F.col("p_partkey") % 90, F.col("p_size"), sub).alias("number"))
    n, v = F.col("number"), F.lit("18.09.00")
    return rows.select("p_partkey", "number", fn.range_directory(n.cast("long")).alias("dir"), fn.mapped_id(F.lit("etsi_ts"), n).alias("id"), fn.delivery_url("https://host/deliver/", F.lit("ts"), n, v).alias("url"), fn.version_display(v).alias("shown"))


MAPPED = [("TS 24.301", "ts_24_301|TS 24.301|ts|24.301"), ("tr_37_901", "tr_37_901|TR 37.901||tr_37_901"), ("ts 34.123-1", "ts_34_123_1|TS 34.123-1|ts|34.123-1"), ("TS24.301", "ts_24_301|TS 24.301||TS24.301"), ("ts34.123-01", "ts_34_123_1|TS 34.123-1||ts34.123-01"), ("GSM 05.05", "gsm_05_05|GSM 05.05|gsm|05.05")]


@query(expected(MAPPED))
def fn_mapped_spec(spark, sf_dir):
    """Identifier and label of a mapped document, and its kind and number."""
    a, b = fn.normalize_mapped(F.col("raw")), fn.split_mapped(F.col("raw"))
    return values(spark, MAPPED).select("nth", F.concat_ws("|", a["id"], a["label"], b["kind"], b["number"]).alias("out"))


KINDS = [("TS", "etsi_ts"), (" etsi_TR ", "etsi_tr"), ("en", "etsi_en")]


@query(expected(KINDS))
def fn_kinds(spark, sf_dir):
    return values(spark, KINDS).select("nth", fn.normalize_kind(F.col("raw")).alias("out"))


MEMOS = [("rfc_3261", "3261|2022-06-01"), ("RFC8446", "8446|2022-06-01"), ("ts_24_301", "|2022-06-01")]


@query(expected(MEMOS))
def fn_memo_number(spark, sf_dir):
    return values(spark, MEMOS).select("nth", F.concat_ws("|", F.coalesce(fn.memo_number(F.col("raw")).cast("string"), F.lit("")), fn.iso_date(F.lit("2022-06-01T00:00:00Z"))).alias("out"))


@query("WITH " + SECTIONS_SQL + " SELECT id, upper('TS ' || spec_id) || ' §' || section_number AS label FROM sec")
def fn_label(spark, sf_dir):
    return sections(spark, sf_dir).select("id", fn.label(F.concat(F.lit("ts_"), "spec_id"), F.col("section_number")).alias("label"))


SERIES = [("ts_24_301", "24"), ("tr_37_901", None), ("rfc_3261", None), ("ts_34_123_1", "34")]


@query(expected(SERIES))
def fn_series(spark, sf_dir):
    return values(spark, SERIES).select("nth", fn.series_of(F.col("raw")).alias("out"))


HEADINGS = [("5.3.2 Some title", "numbered|5.3.2|Some title"), ("  12\tTop", "numbered|12|Top"), ("Annex A (normative): Foo", "annex|Annex A|(normative): Foo"), ("Annex B.1 Bar", "annex|Annex B.1|Bar"), ("Foreword", "named||Foreword"), ("SCOPE", "named||SCOPE"), ("plain text", "||plain text"), ("5.3.2", "||5.3.2"), ("", "||")]


@query(expected(HEADINGS))
def fn_headings(spark, sf_dir):
    """Kind, number and bare title of heading lines."""
    raw, number = F.col("raw"), fn.heading_number(F.col("raw"))
    return values(spark, HEADINGS).select("nth", F.concat_ws("|", F.coalesce(fn.heading_kind(raw), F.lit("")), number, fn.without_number(F.regexp_replace(raw, r"^\s+", ""), number)).alias("out"))


PREFIXED = [("  attach \n request ", "query: attach request|passage: attach request"), ("query: wrong prefix", "query: wrong prefix|passage: wrong prefix"), ("Passage:x", "query: x|passage: x"), ("", "query:|passage:"), (None, "query:|passage:")]


@query(expected(PREFIXED))
def fn_prefixed(spark, sf_dir):
    """Texts for the embedder as queries and as passages."""
    return values(spark, PREFIXED).select("nth", F.concat_ws("|", fn.prefixed("query:", F.col("raw")), fn.prefixed("passage:", F.col("raw"))).alias("out"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"type\":\"' || event_type || '\"}' AS made FROM events")
def json_props(spark, sf_dir):
    """JSON read to fields and written again."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("made"))


def scope_hash_of(fields: dict[str, object]):
    """Digest of the JSON with sorted keys and no blanks, so the order of the fields does not count."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


@query("SELECT c_custkey, sha256('{\"depth\":\"files\",\"key\":' || c_custkey || ',\"name\":\"' || c_name || '\"}') AS hash FROM customer")
def scope_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scope_hash_of({"name": F.col("c_name"), "key": F.col("c_custkey"), "depth": F.lit("files")}).alias("hash"))


@query("SELECT user_id, concat_ws('|', 'model', CAST(64 AS VARCHAR), 'query:', 'passage:', 'p' || user_id) AS signature FROM (SELECT DISTINCT user_id FROM events)")
def policy_signature(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", F.concat_ws("|", F.lit("model"), F.lit("64"), F.lit("query:"), F.lit("passage:"), F.concat(F.lit("p"), "user_id")).alias("signature"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, floor(l_discount * l_tax * 1000e0 + 0.5e0) / 1000e0 AS score FROM lineitem")
def fn_round3(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fn.round3(F.col("l_discount") * F.col("l_tax")).alias("score"))
