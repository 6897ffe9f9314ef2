"""The corpus pipeline against its stages done plainly, one after the other."""

import random
import re

import pytest

from quarry.llm import near_dups, pieces, quality, suffix_dedup

WORDS = [f"{a}{b}" for a in ("al", "bra", "char", "del", "ech", "fox", "gol", "hot") for b in ("pha", "vo", "lie", "ta", "o", "trot", "f", "el")]


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    shared = sentence(7, 60)
    item = sentence(8, 14)
    rows = [(i, sentence(i, 50), "en") for i in range(200)]
    rows += [(300 + i, sentence(300 + i, 40) + " zqxjkv vvzzq zqxjkv vvzzq", "en") for i in range(60)]  # toxic
    rows += [(400, rows[3][1], "en"), (401, rows[3][1].replace(".", " now."), "en"), (400, rows[3][1], "en")]  # copies, one row twice
    rows += [(500 + i, sentence(500 + i, 30) + "\n" + shared + "\n" + sentence(700 + i, 30), "en") for i in range(4)]  # a shared passage
    rows += [(600, sentence(600, 40) + " " + item + " " + sentence(601, 40), "en"), (601, None, "en"), (602, "", None), (None, sentence(602, 50), "en"), (603, "| | " * 50, "en")]
    at = f"{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame([(i, t, g, "s", len(t or ""), "x") for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, bytes string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(180)] + [(300 + i, 0, 1) for i in range(40)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return f"file://{at}", item


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "text", "n_chars").collect()), key=repr)


def test_stages(spark, corpus):
    import corpus_pipeline
    import sentencepiece

    at, item = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "suffix_dedup", "decontamination", "pieces"]

    good = stages["quality"](spark, docs, at)
    assert good.columns == names
    labels = spark.read.parquet(f"{at}/labels.parquet")
    kept = {(r["doc_id"], r["n_tokens"], round(r["perplexity"], 3)): r["kept"] for r in quality.classify(docs, labels).collect()}
    assert good.count() == sum(r["kept"] for r in quality.classify(docs, labels).collect()) and len(kept) <= docs.count()
    ids = {r["doc_id"] for r in good.collect()}
    assert not ids & set(range(300, 360)) and len(ids & set(range(200))) >= 190 and 603 not in ids and {600, 601, 602} <= ids

    good = good.persist()
    single = stages["near_dedup"](spark, good, at)
    assert single.columns == names
    seen, want = set(), []
    classes = {}
    for r in near_dups.classes(good).collect():
        classes.setdefault(r["doc_id"], r["class_id"])
    for r in sorted(good.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)):
        key = classes[r["doc_id"]] if re.search("[0-9a-z]", (r["text"] or "").lower()) and r["doc_id"] is not None else object()
        if key not in seen:
            want.append(r["doc_id"])
        seen.add(key)
    assert sorted(want, key=repr) == sorted((r["doc_id"] for r in single.collect()), key=repr)
    assert 400 not in want and 401 not in want

    single = single.persist()
    cut = stages["suffix_dedup"](spark, single, at)
    assert cut.columns == names
    before, windows = {}, set()
    for r in sorted(single.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        raw = (r["text"] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in windows:
                gone[p : p + 100] = b"\1" * 100
            windows.add(raw[p : p + 100])
        left = bytes(c for c, g in zip(raw, gone, strict=True) if not g).decode(errors="ignore")
        if left or not raw:
            before[r["doc_id"]] = r["text"] if r["text"] is None else left
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == before
    assert sum(len(t or "") for t in before.values()) < sum(len(r["text"] or "") for r in single.collect()) - 1000
    assert all(r["n_chars"] == len(r["text"] or "") for r in cut.collect())

    clean = stages["decontamination"](spark, cut, at)
    assert clean.columns == names
    asked = re.findall(r"\w+", item.lower())
    holds = lambda t: any(asked[i : i + 10] == w[k : k + 10] for w in (re.findall(r"[0-9a-z]+", (t or "").lower()),) for k in range(len(w)) for i in range(len(asked) - 9))
    want = {i: t for i, t in before.items() if not holds(t)}
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == want and 600 not in want

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    done = {r["doc_id"]: r["n_tokens"] for r in stages["pieces"](spark, clean, at).collect()}
    assert done == {i: len(library.encode(t or "")) for i, t in want.items()}
    whole = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, at).collect()}
    assert whole == done


def test_nothing(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
    assert suffix_dedup.without_repeats(spark.read.parquet(f"file://{tmp_path}/documents.parquet")).count() == 0
