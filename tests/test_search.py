"""Query language, ranking record, cache and argument checks, against their stated cases."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.operators import parser
from quarry.operators import search as search_
from quarry.operators.parser import Cache, parse, units
from quarry.operators.postings import Index, normalised
from quarry.operators.search import hybrid, search
from quarry.operators.tools import Engine

DIR = "/root/testdata/sf0.001"


def test_parse():
    p = parse('spec:ts_24_301 section:5.5 "attach request" state -rejected')
    assert (p.spec, p.section, p.phrases, p.terms, p.negated) == ("ts_24_301", "5.5", ["attach request"], ["state"], ["rejected"])
    assert p.text == "attach request state"
    assert parse("attach OR detach").terms == ["attach", "detach"]
    assert parse("5g mm reject cause").terms == ["5gmm", "reject", "cause"] and parse("5G-SM x").terms == ["5gsm", "x"]
    assert parse("spec:A x", spec="b").spec == "a" and parse("x", spec="b").spec == "b"
    assert parse("a NOT B").negated == ["b"] and parse("a NOT").terms == ["a", "NOT"]
    assert (parse("x").alpha, parse("x").k) == (0.4, 10)
    assert parse("   ").terms == [] and parse("spec:a spec:b c").terms == ["spec:b", "c"]


def test_units():
    assert units(parse("a b")) == (["a", "b"], [], [])
    assert units(parse('"a b" c')) == (["c"], [["a", "b"]], [])
    # G1: OR means AND; G2: a query that only excludes finds nothing
    assert units(parse("a OR b")) == (["a", "b"], [], [])
    assert units(parse("NOT b")) is None and units(parse("-b")) is None and units(parse("")) is None
    # Other marks fall back to letters and digits, without exclusions and phrases
    assert units(parse("5.5.1")) == (["5", "5", "1"], [], [])
    assert units(parse('"x y" attach, -b')) == (["x", "y", "attach"], [], [])
    assert units(parse("foo-bar")) == (["foo", "bar"], [], [])
    assert units(parse("at*")) == (["at*"], [], []) and units(parse("foo_bar")) == ([], [["foo", "bar"]], [])
    assert units(parse("a AND b")) == (["a", "b"], [], [])


ROWS = [("alpha beta", "common one"), ("gamma", "common two alpha beta"), ("delta", "common three alpha alpha"), ("beta alpha", "common four"), ("eps", "common alpha x beta"), ("zeta", "rare common"), ("zeta", "rare common")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame([(i, "s" + str(i % 2), t.split(), c.split()) for i, (t, c) in enumerate(ROWS)], "key int, spec string, title array<string>, body array<string>")
    return Index.build(rows, f"file://{tmp_path_factory.mktemp('index')}/i")


@pytest.mark.parametrize("query", ["alpha", "common", "alpha beta", '"alpha beta"', "alpha NOT beta", "rare", "al*", '"common alpha" beta'])
def test_bm25_against_sqlite(index, query):
    """The same rows and scores as a full-text table with weights 10 and 1."""
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(title, content)")
    db.executemany("insert into t(rowid, title, content) values (?, ?, ?)", [(i, *r) for i, r in enumerate(ROWS)])
    want = dict(db.execute("select rowid, -bm25(t, 10.0, 1.0) from t where t match ?", (query,)))
    terms, phrases, without = units(parse(query))
    got = {r["key"]: r["score"] for r in index.search(terms, phrases, without).collect()}
    if "*" in query:  # a prefix is scored as the sum of its terms' counts
        assert set(got) == set(want)
    else:
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_filter_keeps_statistics(index):
    every = {r["key"]: r["score"] for r in index.search(["alpha"]).collect()}
    some = {r["key"]: r["score"] for r in index.search(["alpha"], spec="s0").collect()}
    assert some == {k: v for k, v in every.items() if k % 2 == 0}


def test_single_hit_scores_nothing(index):
    """The only row, as the worst, is 0; so are equal ones."""
    assert [r["score"] for r in normalised(index.search(["gamma"])).collect()] == [0.0]
    assert [r["score"] for r in normalised(index.search(["rare"])).collect()] == [0.0, 0.0]


def test_index_updates(spark, index):
    """An update leaves no ghosts in the counts."""
    new = spark.createDataFrame([(5, "s1", ["zeta"], ["plain"]), (9, "s1", ["iota"], ["rare"])], "key int, spec string, title array<string>, body array<string>")
    after = index.update(new, spark.createDataFrame([(0,)], "key int"))
    rows = [r for i, r in enumerate(ROWS) if i not in (0, 5)] + [("zeta", "plain"), ("iota", "rare")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(title, content)")
    db.executemany("insert into t(title, content) values (?, ?)", rows)
    for q in ("rare", "alpha", "zeta", "common"):
        want = sorted(-s for (s,) in db.execute("select bm25(t, 10.0, 1.0) from t where t match ?", (q,)))
        got = sorted(r["score"] for r in after.search([q]).collect())
        assert len(got) == len(want) and all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))
    assert after.table("stats").first()["n_docs"] == 7 and index.table("stats").first()["n_docs"] == 7


def test_cache():
    now = [0.0]
    c = Cache(3, 60, lambda: now[0])
    for k in "abc":
        c.put(k, k)
    assert c.get("a") == "a"
    c.put("d", "d")
    assert c.get("b") is None and c.get("d") == "d" and c.evictions == 1
    assert c.stats()["hitRate"] == "66.7%"
    now[0] = 61
    assert c.get("a") is None and len(c.rows) == 2
    assert Cache.key("q", page=1) == Cache.key("q") != Cache.key("q", page=2)


def test_modes():
    w = []
    assert parser.resolve_mode("auto", True, w) == "hybrid" and parser.resolve_mode("auto", False, w) == "keyword" and not w
    assert parser.resolve_mode("semantic", False, w) == "keyword" and w == ["mode_degraded: requested=semantic actual=keyword"]
    assert [parser.share_of_keywords(m, 0.4) for m in ("keyword", "semantic", "hybrid")] == [1.0, 0.0, 0.4]


def test_checks():
    assert parser.check("search", {"query": "x", "maxResults": 100, "mode": "auto"}) == []
    assert [f for f, _ in parser.check("search", {"query": "", "maxResults": 101, "page": 0, "mode": "x", "includeScores": 1})] == ["query", "maxResults", "page", "mode", "includeScores"]
    assert parser.check("guide", {}) and parser.check("no such operator", {"x": 1}) == []
    assert parser.clamp(500, 1, 100) == 100 and parser.clamp(-1, 1, 100) == 1


def test_engine(spark):
    e = Engine(spark, DIR)
    assert e.call("toc")["error"] == "validation_error" and e.call("x")["error"]
    got = e.call("search", query="thing", maxResults=3, mode="semantic", includeScores=True)
    assert got["mode_actual"] == "keyword" and got["warnings"] and len(got["results"]) == 3 and all(0 <= r["score"] <= 1 for r in got["results"])
    assert e.call("search", query="zzqqxx")["results"] == [] and e.call("search", query="  ")["results"] == [] and e.call("search", query="-thing")["results"] == []
    assert "cached" not in e.call("search", query="thing", mode="keyword") and e.call("search", query="thing", mode="keyword")["cached"]
    row = e.call("section", specId="7", sectionNumber="1", includeNeighbors=True, neighborWindow=2)
    assert row["section"]["id"] == "7:1" and row["neighbors"] == ["7:1.1", "7:1.1.1"]
    assert e.call("section", sectionId="7:999")["suggestions"] == [] and e.call("section")["error"]
    empty = e.call("toc", specId="5")
    assert empty["entries"][0]["origin"] == "sections" and e.call("toc", specId="x")["available"][0] == "0"
    assert {r["relation"] for r in e.call("related", sectionId="7:1.1", maxResults=9)["results"]} >= {"parent", "child", "sibling"}
    assert all(r["relation"] == "query_match" for r in e.call("related", query="thing")["results"])
    assert e.call("catalog", family="src8")["specs"] and len(e.call("specs")["specs"]) == 200
    refs = e.call("references", specId="ts_15_105", direction="outgoing", inCorpusOnly=True, maxResults=1)
    assert len(refs["outgoing"]) == 1 and refs["outgoing"][0]["cited_in_sections"] and "incoming" not in refs
    assert e.call("references", specId="15_10")["suggestions"]
    assert e.call("deliveries", hasVersions=True, maxResults=2)["status"]["documents"] == 150
    assert e.call("delivery")["error"] and e.call("guide", type="all").keys() == {"catalog", "delivery", "memo", "retrieval"}
    assert e.call("cause", number=999)["number"] == 111 and e.call("cause", number=7)["name"] == "EPS services not allowed"


def test_navigation_block(spark):
    """A heading without content offers what lies below it, generic titles last."""
    e = Engine(spark, DIR)
    from quarry.sources.tables import sections

    row = sections(spark, DIR).where("content_length = 0 and l = 1").orderBy("id").first()
    got = e.call("section", sectionId=row["id"])
    titles = [s["section_title"] for s in got["navigation"]["suggested_sections"]]
    generic = [t in ("General", "Abnormal cases here") for t in titles]
    assert got["navigation"]["descendant_content_count"] >= len(titles) > 0 and generic == sorted(generic)


def test_pages_end(spark):
    """No more than nine times the results asked for are ranked."""
    rows, _ = hybrid(spark, DIR, "or", max_results=1, page=10, mode="keyword")
    assert rows.count() == 0
    assert search(spark, DIR, "or", max_results=1, page=9, mode="keyword")["results"]


def test_no_content_without_snippet(spark):
    rows, mode = hybrid(spark, DIR, "thing", max_results=5, mode="hybrid", vector=[0.0] * 64)
    assert mode == "hybrid" and rows.where(F.col("score") > 1).count() == 0
    # What only the vectors found comes without text
    found = search(spark, DIR, "thing", max_results=5, mode="semantic", include_scores=True, vector=[0.0] * 64)["results"]
    assert found and all(r["content"] == "" and r["evidence"] == ["semantic"] for r in found)


def test_incoming_ignores_the_corpus_filter(spark):
    """G13."""
    from quarry.operators import graph

    one, two = (graph.references(spark, DIR, "ts_15_105", direction="incoming", in_corpus_only=x) for x in (True, False))
    assert one == two


def test_one_search_builds_no_whole_index(spark):
    """A single search writes the postings of its own terms, and ranks as with all."""
    name = "/root/testdata/sf0.001/."
    search_._indexes.pop(search_._key(spark, name, "sections"), None)
    asked = (["the", "thin*"], [["of", "the"]], ["or"])
    one = search_.index_for(spark, name, "sections", asked)
    terms = {r["term"] for r in one.table("postings").select("term").distinct().collect()}
    assert terms and all(t in ("the", "of", "or") or t.startswith("thin") for t in terms)
    whole = search_.index_of(spark, name, "sections")
    shown = lambda x: {(r["key"], round(r["score"], 9)) for r in x.search(*asked).collect()}
    assert shown(one) == shown(whole) and shown(one)
    assert search_.index_for(spark, name, "sections", asked) is whole
