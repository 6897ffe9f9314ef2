"""Readers on files with faults, spans and memos on small texts, embedding updates."""

import io
import json
import zipfile

import pytest

from quarry.operators import ingest
from quarry.sources import files


def test_json_lines(spark, tmp_path):
    (tmp_path / "a_structure.jsonl").write_text('{"type":"spec_meta","spec_id":"x"}\n\n{"type":"toc_entry","page":1}\n{bad\n[1]\n')
    (tmp_path / "b_structure.jsonl").write_text("\n")
    (tmp_path / "notes.txt").write_text("")
    good, bad = files.read_lines(spark, str(tmp_path / "*.jsonl"))
    parts = files.split_by_type(good)
    assert parts["spec_meta"].count() == 1 and parts["toc_entry"].first()["page"] == 1 and parts["page_text"].count() == 0
    assert "{bad" in {r["line"] for r in bad.collect()}
    assert [(r["name"], r["key"]) for r in files.discover(spark, str(tmp_path), r"^(.*)_structure\.jsonl$").collect()] == [("a_structure.jsonl", "a"), ("b_structure.jsonl", "b")]


def test_meta_and_chunks(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.json").write_text(json.dumps({"rfc_number": 7, "title": "T"}, indent=2))
    (tmp_path / "m" / "2.json").write_text("no json")
    assert sorted((r["rfc_number"] or 0, r["title"]) for r in files.read_meta(spark, str(tmp_path / "m")).collect()) == [(0, None), (7, "T")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.json").write_text(json.dumps([{"content": "a", "metadata": {"source": "s"}}, {"text": "b", "spec": "t"}]))
    (tmp_path / "c" / "2.json").write_text(json.dumps({"chunks": [{"text": None}]}))
    assert sorted(tuple(r)[:2] for r in files.read_chunks(spark, str(tmp_path / "c")).collect()) == [("s", "a"), ("t", "b"), ("unknown", "")]


def test_line_ends(spark, tmp_path):
    """Form feeds and separators end lines; a line end at the end makes no line."""
    (tmp_path / "t.txt").write_bytes("a\r\nb\fc d\n".encode() + b"\xff\n")
    assert [r["line"] for r in files.read_texts(spark, str(tmp_path / "t.txt")).orderBy("n").collect()] == ["a", "b", "c", "d", "�"]


def office(paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_office(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(office([("Heading1", "1 Scope"), ("Normal", "text")]))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("p2.docx", office([("Heading2", "2.1 Two")]))
        z.writestr("p1.docx", office([("Normal", "one")]))
    (tmp_path / "c.docx").write_bytes(b"damaged")
    rows = files.read_office(spark, str(tmp_path)).orderBy("path", "n").collect()
    assert [(r["text"], r["level"], r["warning"]) for r in rows] == [("1 Scope", 1, None), ("text", None, None), ("one", None, None), ("2.1 Two", 2, None), ("", None, "BadZipFile")]


def test_spans(spark):
    """Untitled entries keep their own ids, spans end at any heading, a heading is placed by its line's first occurrence."""
    pages = spark.createDataFrame([("s", 1, "see 1 One\n1 One\nbody\n1.1 Sub\nx"), ("s", 2, "more")], "spec_id string, page int, text string")
    entries = spark.createDataFrame([("s", 1, 1, "1", "1 One"), ("s", 2, 1, "1.1", "1.1 Sub"), ("s", 3, 2, "", "Untitled"), ("s", 4, 2, "", "Other"), ("s", 5, 2, "9", "9 Missing")], "spec_id string, nth int, page int, section_number string, title string")
    got = {r["section_id"]: r for r in ingest.spans(entries, pages).collect()}
    assert got["s:1"]["content"] == "1 One\n1 One\nbody" and got["s:1.1"]["content"] == "1.1 Sub\nx"
    assert {k for k in got if "untitled" in k} == {"s:_untitled_2", "s:_untitled_3"} and got["s:9"]["content"] == "more"
    assert got["s:9"]["section_title"] == "Missing" and got["s:1.1"]["page_end"] == 2


def test_memo_pages_lag(spark):
    """A page mark is a footer, so the lines after it keep its number until the next."""
    lines = ["1. First", "a", "[Page 1]", "b", "2. Second", "c", "[Page 2]"]
    rows = spark.createDataFrame([("m", i, x) for i, x in enumerate(lines)], "spec_id string, n int, line string")
    got = {r["section_id"]: (r["page_start"], r["page_end"], r["content"]) for r in ingest.memo_sections(rows).collect()}
    assert got == {"m:1": (1, 1, "a\n\nb"), "m:2": (1, 2, "c")}


def test_repeated_numbers(spark):
    """Of sections of one number the last stays."""
    from pyspark.sql import functions as F

    from quarry.operators.mutations import one_per_key

    rows = spark.createDataFrame([("m", i, x) for i, x in enumerate(["1. First", "a", "1. Again", "b"])], "spec_id string, n int, line string")
    left = one_per_key(ingest.memo_sections(rows), ["section_id"], F.desc("nth")).collect()
    assert [(r["section_id"], r["section_title"], r["content"]) for r in left] == [("m:1", "Again", "b")]


def test_embedding_updates(spark):
    rows = spark.createDataFrame([("a", "s", "x"), ("b", "t", "y")], "id string, spec_id string, text string")
    none = spark.createDataFrame([], "id string, embedding array<float>")
    ones = lambda texts: [[float(len(t))] * 64 for t in texts]
    first = ingest.update_index(rows, none, ones)
    assert first.count() == 2
    again = ingest.update_index(rows, first, lambda texts: [[9.0] * 64 for _ in texts])
    assert {r["embedding"][0] for r in again.collect()} == {1.0}
    part = ingest.update_index(rows, first, lambda texts: [[9.0] * 64 for _ in texts], rebuild=True, spec_id="t")
    assert sorted((r["id"], r["embedding"][0]) for r in part.collect()) == [("a", 1.0), ("b", 9.0)]
    with pytest.raises(ValueError):
        ingest.update_index(rows, first, policy_matches=False)
    with pytest.raises(Exception, match="another number or size"):
        ingest.embed(rows, lambda texts: [[1.0] for _ in texts]).collect()


def test_packed(spark):
    from pyspark.sql import functions as F

    texts = ["a" * 30 + "\n\n" + "b" * 30 + "\n\n\n \n\n" + "c" * 100, "", " \n\n "]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(ingest.packed(F.col("t"), 50, 10)).collect()]
    assert got[1:] == [[], []] and got[0] == ["a" * 30, "a" * 8 + "\n\n" + "b" * 30, "b" * 8 + "\n\n" + "c" * 100]


def test_readers_of_any_format(spark, tmp_path):
    from quarry.operators import upkeep

    (tmp_path / "a.bin").write_bytes(b"one|two")
    (tmp_path / "b.bin").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"x")

    def extract(name, data):
        if not data:
            raise ValueError("empty")
        return enumerate(data.decode().split("|"), 1)

    rows = upkeep.read_binary(spark, str(tmp_path), "*.bin", extract).collect()
    assert sorted((r["page"], r["text"]) for r in rows if r["warning"] is None) == [(1, "one"), (2, "two")]
    assert upkeep.first_there([None, "", str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path) and upkeep.first_there([]) is None
    assert upkeep.capabilities(None) == {"keyword": True, "semantic": False} and upkeep.capabilities(spark.range(1))["semantic"]
