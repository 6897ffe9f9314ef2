"""The operators against plain versions, on rows with nulls, repeats, clashing columns and none at all."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from quarry.llm import chat_format, decontaminate, html_extract, lm_score, near_dups, neighbours, pieces, quality, sstable, suffix_dedup

WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima", "Éire", "naïve"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, class_id string, row long"


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = sentence(1, 120)
    return [
        (1, base), (2, base), (3, base.replace("alpha", "omega", 1)), (4, None), (5, ""), (6, "short"), (7, sentence(2, 200) + "\n" + base[50:400]),
        (8, "x" * 400), (9, "日本語 " * 60), (10, "!!! ???"), (11, sentence(3, 3000)), (7, "again"), (None, base), (12, "a  b \t▁c\n\nd 🙂"),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, "x", 0) for i, t in rows], DOCS)


def test_decontaminate(spark, texts):
    items = spark.createDataFrame([(1, sentence(1, 120)), (2, None), (3, "Short"), (None, "日本語 日本語"), (4, "...")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.find_hits(frame(spark, texts), items).collect()}
    assert got[1, 120]["n_hit"] == 120 and got[1, 120]["items"] == ["1"] and got[1, 120]["spans"][0]["start"] == 0
    assert got[6, 1]["items"] == ["3"] and got[9, 60]["n_hit"] == 60 and got[9, 60]["items"] == []
    assert got[4, 0]["n_hit"] == 0 and got[10, 0]["items"] == [] and got[8, 1]["n_hit"] == 0
    assert decontaminate.drop_contaminated(frame(spark, texts), items).columns == [c.split()[0] for c in DOCS.split(", ")]
    blocks = {(r["doc_id"], r["n_words"]): r for r in decontaminate.find_hits(frame(spark, texts), items, block_bytes=300).collect()}
    assert blocks == got
    assert decontaminate.find_hits(frame(spark, texts), items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_hits(frame(spark, []), items).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a </s> b"), (1, 1, "assistant", "[INST] [\\INST] \\"), (1, 1, "assistant", None), (None, None, None, "é🙂"), (2, 5, "assistant", "<\\\\s><s>[/INST]")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    v = chat_format.vocabulary_path()
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.assemble(chat_format.format_turns(conv, v), v), v).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\na </s> b\nassistant\n\nassistant\n[INST] [\\INST] \\\n")
    assert got[1]["loss_sha256"] == sha("[INST] [\\INST] \\") and got[2]["loss_sha256"] == sha("<\\\\s><s>[/INST]")
    assert got[None]["turns_sha256"] == sha("\né🙂\n") and got[None]["loss_chars"] == 0
    for x in ("<s>", "</s>", "[INST]", "[/INST]", "[\\/INST]", "a<\\\\/s>b", "[[INST]"):
        assert chat_format.unescape(chat_format.escape(x)) == x and not any(c in chat_format.escape(x) for c in chat_format.CONTROL)


def test_pieces(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    r = random.Random(5)
    odd = ["".join(r.choice(" abct\nhe▁éñ\t日🙂.,!#$(<>)-_;x") for _ in range(r.randint(0, 40))) for _ in range(300)]
    rows = [*texts, *((100 + i, t) for i, t in enumerate(odd))]
    got = pieces.encode_documents(frame(spark, rows), pieces.model_path()).collect()
    assert len(got) == len(rows)
    for (i, t), g in zip(rows, got, strict=True):
        ids = library.encode(t or "")
        assert (g["doc_id"], g["ids"], g["decoded"]) == (i, ids, library.decode(ids))


def test_suffix(spark, texts):
    got = sorted((tuple(r) for r in suffix_dedup.digests(frame(spark, texts)).collect()), key=repr)
    seen, want = set(), []
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert got == sorted(want, key=repr)
    left = suffix_dedup.without_repeats(frame(spark, texts))
    assert left.where("doc_id = 2").count() == 0 and left.where("doc_id = 5").count() == 1
    assert all(r["n_chars"] == len(r["text"]) for r in left.where("text is not null").collect())
    assert suffix_dedup.digests(frame(spark, [])).count() == 0


def test_near(spark, texts):
    rows = [*texts, *((200 + i, sentence(50, 100).replace("echo", f"echo{i}", 1)) for i in range(40))]
    got = [(r["doc_id"], r["class_id"]) for r in near_dups.classes(frame(spark, rows), rare=0.5).collect()]
    assert (1, 1) in got and (2, 1) in got and (3, 1) in got and (None, 1) in got
    assert (4, 4) in got and (10, 10) in got and (6, 6) in got
    assert all((200 + i, 200) in got for i in range(40))
    assert near_dups.classes(frame(spark, [])).count() == 0
    assert near_dups.one_of_each(frame(spark, rows), rare=0.5).where("doc_id in (2, 3) or doc_id > 200").count() == 0


def test_shards(spark, texts, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    shards = sstable.write_shards(frame(spark, texts), f"file://{tmp_path}/s", path, end=2)
    got = sstable.read_shards(spark, shards).orderBy("start").collect()
    t, start = Tokenizer.from_file(path), 0
    for (i, text), g in zip(sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(g) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    found = [x for s in shards if (x := sstable.Shard(s["path"]).get(6)) is not None]
    assert len(found) == 1 and found[0][-1] == 2
    assert all(sstable.Shard(s["path"]).get(999) is None for s in shards)


def test_neighbours(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).tolist()) for i in range(300)]
    rows += [(400, rows[50][1]), (401, None), (402, [0.0] * 8), (403, [float("nan")] * 8), (404, [1.0, None] * 4), (None, [1.0] * 8), (405, [1.0] * 3), (406, [1e30] * 8)]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in neighbours.nearest(frame_, frame_.where("vec_id % 50 = 0")).collect()}
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)]
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, w in good if i != q)[:5]
            assert [got[q, k + 1][0] for k in range(5)] == [i for _, i in best]
            assert np.allclose([got[q, k + 1][1] for k in range(5)], [-s for s, _ in best], atol=1e-12)


def test_html(spark):
    page = '<html><head><title>T</title><script>"<p>no</p>"</script></head><body><nav><a href=x>menu</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One<br>two&nbsp; three<p>Four<div class="comments"><p>me too</p></div><aside>side</aside>tail</article><footer>f</footer>'
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (1, "u", page), (4, "u", "plain")], "page_id long, url string, html string")
    got = [r["text"] for r in html_extract.extract(pages).orderBy("page_id").collect()]
    assert got == ["A & B\nOne two three\nFour\ntail"] * 2 + ["", "", ""]
    assert html_extract.second_pass([1, None, None, 0]) == [1, 1, 0, 0] and html_extract.second_pass([None]) == [0]


def test_quality_and_scores(spark):
    rows = [(i, sentence(i, 40)) for i in range(160)] + [(500 + i, sentence(900 + i, 30) + " zqxjkv vvzzq") for i in range(20)] + [(600, "qq#w%e %%$$ ## " * 20), (601, None), (602, "")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(500 + i, 0, 1) for i in range(20)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(docs, labels).collect()}
    assert sum(kept[i] for i in range(160)) >= 155 and not any(kept[500 + i] for i in range(20)) and not kept[600] and kept[601] and kept[602]
    got = {r["doc_id"]: r for r in lm_score.score_documents(docs).collect()}
    cut = {i: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))] + [b""] for i, t in rows}
    seen = [w for i, ws in cut.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws]
    count = {w: seen.count(w) for w in set(seen)}
    for i, ws in cut.items():
        want = sum(np.log10((count.get(w, 0) + 1) / (len(seen) + len(count) + 1)) for w in ws)
        assert abs(got[i]["base_score"] - want) < 1e-6 and got[i]["n_tokens"] == len(ws) and got[i]["train_tokens"] == len(seen) and got[i]["score"] < 0


def test_quality_sparse_language(spark):
    """A language with few labels is filtered too, by limits over all languages."""
    rows = [(i, sentence(i, 40), "en") for i in range(160)] + [(500 + i, sentence(900 + i, 30) + " zqxjkv vvzzq", "en") for i in range(30)]
    rows += [(700 + i, sentence(700 + i, 40), "xx") for i in range(8)] + [(800 + i, sentence(800 + i, 30) + " zqxjkv vvzzq", "xx") for i in range(6)] + [(900, "qq#w%e %%$$ ## " * 20, "xx"), (901, sentence(2901, 40), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(500 + i, 0, 1) for i in range(30)] + [(700 + i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(docs, labels).collect()}
    assert not any(kept[800 + i] for i in range(6)) and not kept[900]
    assert sum(kept[700 + i] for i in range(8)) >= 7 and kept[901]
    assert sum(kept[i] for i in range(160)) >= 150


def test_quality_limits(spark):
    """Low texts that differ from trusted ones in a word of six are rejected: limits have no slack."""
    def odd(i):
        r = random.Random(i)
        return " ".join("".join(r.sample(w, len(w))) if r.random() < 0.17 else w for w in sentence(i, 60).split())

    rows = [(i, sentence(i, 60)) for i in range(200)] + [(1000 + i, odd(1000 + i)) for i in range(60)] + [(2000 + i, sentence(2000 + i, 30) + " zqxjkv vvzzq") for i in range(20)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(160)] + [(1000 + i, 0, 0) for i in range(40)] + [(2000 + i, 0, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(docs, labels).collect()}
    assert sum(kept[i] for i in range(200)) >= 190 and sum(kept[1000 + i] for i in range(60)) <= 10
    # without toxic labels the perplexity alone decides
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(docs, labels.where("toxic = 0")).collect()}
    assert sum(kept[1000 + i] for i in range(60)) <= 10


PROSE = "It was the best of the times that we had in the old town, and all of it is in the letters which he had from the men at the mill, but they were not the ones who would do what there was to do. "


def test_html_containers():
    """Articles and main elements are a prior only: the main text need not be in the first kind met."""
    cards = "".join(f"<article><h2><a href=x>Teaser number {i} of the page</a></h2></article>" for i in range(5))
    got = html_extract.main_text(f"<body><main><h1>Title</h1><p>{PROSE * 3}<p>{PROSE * 2}</main>{cards}")
    assert got.startswith("Title") and got.count("old town") == 5 and "Teaser" not in got
    got = html_extract.main_text(f"<body><article><p>{PROSE * 3}<ul><li><a href=x>More of these links</a><li><a href=y>And others</a></ul></article>")
    assert got.count("old town") == 3 and "links" not in got
    got = html_extract.main_text(f"<body><div>{PROSE * 4}</div><article><p>A short card</p></article>")
    assert got.count("old town") == 4


def test_html_names():
    """A word within a class or id drops nothing, nor does a class around the page's text."""
    for tag, name in (("article", "class='post has-sidebar'"), ("div", "class='content no-sidebar'"), ("div", "id='search-results'"), ("article", "class='post form-standard'"), ("main", "class='search'"), ("div", "class='sidebar'")):
        assert html_extract.main_text(f"<body><{tag} {name}><p>{PROSE * 3}</p></{tag}>").count("old town") == 3, name
    assert html_extract.main_text(f"<body><article><p>{PROSE * 3}</article><div class='site-footer'><p>{PROSE * 2}</p></div>").count("old town") == 3
