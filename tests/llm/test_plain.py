"""The operators against plain versions of their methods, and on odd input."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import chat_format, decontaminate, html_extract, lm_score, near_dups, neighbours, pieces, quality, sstable, suffix_dedup
from quarry.llm.common import Rolling

WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima", "mike", "november", "oscar", "papa"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, class_id string, row long, label string, kept string, bytes string"


def sentence(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", ",", "."]) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0, "x", 0, "l", "k", "b") for i, t in rows], DOCS)


# --- near-duplicates


def bag(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    return w


def plain_classes(rows, rare):
    """All pairs, by weighted Jaccard of word shingles."""
    docs = [bag(t) for _, t in rows]
    share = Counter(w for d in docs for w in set(d))
    idf = {w: np.float32(math.log(1 / max(n / len(rows), rare))) for w, n in share.items()}
    bags = []
    for d in docs:
        spans = [d[i : i + 5] for i in range(max(1, len(d) - 4))] if d else []
        count, weight = Counter(map(tuple, spans)), {}
        for s in count:
            weight[s] = max(float(np.mean([idf[w] for w in s], dtype=np.float32)), 1e-3)
        bags.append((count, weight))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, near = set(), 0
    for i in range(len(rows)):
        for j in range(i):
            (a, wa), (b, wb) = bags[i], bags[j]
            if not a or not b:
                continue
            common = sum(min(n, b[s]) * wa[s] for s, n in a.items() if s in b)
            both = sum(n * wa[s] for s, n in a.items()) + sum(n * wb[s] for s, n in b.items()) - common
            if 1e-7 < abs(common / both - 0.8) < 1e-5:
                near += 1
            if common / both >= 0.8 - 1e-7:
                links.add((j, i))
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        k = find(i)
        least[k] = min(least.get(k, d), d)
    return [(d, least[find(i)]) for i, (d, _) in enumerate(rows)], near


def test_near_against_all_pairs(spark):
    """A text and 90 altered copies, so a bucket too large to be compared pair by pair, chains of copies of copies, and others."""
    many = [f"word{k}" for k in range(300)]
    base = sentence(1, 120, many)
    rows = [(0, base)]
    for k in range(90):
        r, w = random.Random(k), base.split()
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = r.choice(many)
        rows.append((k + 1, " ".join(w)))
    chain = sentence(2, 60, many)
    for k in range(8):
        w = chain.split()
        w[7 * k] = many[k]
        chain = " ".join(w)
        rows.append((200 + k, chain))
    rows += [(300 + k, sentence(50 + k, 30)) for k in range(30)] + [(400, None), (401, ""), (402, "... !!"), (403, "one"), (404, "One."), (405, "x " * 50_000)]
    want, near = plain_classes(rows, 0.6)
    assert not near
    got = near_dups.classes(frame(spark, rows), rare=0.6).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == sorted(want)
    assert len({c for _, c in want}) < len(want) - 40


def test_one_of_each_keeps_other_rows(spark):
    """Rows, not ids, are dropped; of equal rows one stays; a class of null ids keeps one."""
    a, b = sentence(1, 40), sentence(2, 40)
    rows = [(1, a), (7, a), (7, b), (8, b + " end"), (8, None), (8, None), (9, "?"), (None, sentence(3, 40)), (None, sentence(3, 40)), (None, a)]
    left = near_dups.one_of_each(frame(spark, rows), rare=0.5)
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")]
    got = Counter((r["doc_id"], r["text"]) for r in left.collect())
    assert got == Counter([(1, a), (7, b), (8, None), (8, None), (9, "?"), (None, sentence(3, 40))])


# --- quality


TOKEN = re.compile(r"[0-9a-z\x80-\U0010ffff]+|[^\x20\x09-\x0D0-9a-z\x80-\U0010ffff]+")


def tokens(text):
    return TOKEN.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def plain_model(texts, order):
    counts = [None] + [Counter() for _ in range(order)]
    for t in texts:
        w = ["<", *tokens(t), ">"]
        for n in range(1, order + 1):
            counts[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n > 1 or i)
    model = []
    for n in range(1, order + 1):
        c = counts[n]
        if n < order:
            before = Counter(g[1:] for g in counts[n + 1])
            c = Counter({g: v if g[0] == "<" else before[g] for g, v in c.items()})
        q = Counter(min(v, 5) for v in c.values())
        d = quality.discounts(q[1], q[2], q[3], q[4])
        total, weight = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            weight[g[:-1]] += d[min(v, 3) - 1]
        model.append((c, d, total, weight))
    return model, len(counts[1])


def plain_p(model, context, word):
    levels, words = model
    p = 1 / (words + 1)
    for n, (c, d, total, weight) in enumerate(levels):
        k = tuple(context[len(context) - n :]) if n else ()
        if len(k) < n or not total[k]:
            break
        v = c[(*k, word)]
        p = (v - d[min(v, 3) - 1] if v else 0) / total[k] + weight[k] / total[k] * p
    return p


def test_quality_against_plain_model(spark):
    rows = [(i, sentence(i, random.Random(i).randint(1, 40)), "en") for i in range(120)] + [(500 + i, sentence(900 + i, 30) + " zqxjkv vvzzq vvzzq", "en") for i in range(40)]
    rows += [(700, None, "en"), (701, "", None), (702, "Unseen words, only: qqq www eee!", "en"), (703, sentence(3, 20), "xx"), (704, "a", "en"), (1, sentence(77, 9), "en")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, k string, n int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(110)] + [(500 + i, 0, 1) for i in range(36)] + [(1, 1, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    from quarry.llm.common import Work

    work = Work(spark, "test")
    known = quality.known_texts(docs, labels, work)
    _, judge, _ = quality.fitted(docs, known, work)
    held = known.where("h % 4 != 0").collect()
    hashes = {r["_h"]: r["text"] for r in quality.keyed(docs).collect()}
    good = [hashes[r["h"]] for r in held if r["quality"] == 1 and not r["toxic"]]
    bad = [hashes[r["h"]] for r in held if r["toxic"] == 1]
    trusted, toxic = plain_model(good, 3), plain_model(bad, 1)
    got = [(r["doc_id"], r["n_tokens"], r["perplexity"], r["contrast"]) for r in quality.classify(docs, labels).collect()]
    want = []
    for i, text, _ in rows:
        w = tokens(text)
        if not w:
            want.append((i, 0, 1.0, 0.0))
            continue
        w = ["<", *w, ">"]
        logs = [math.log10(plain_p(trusted, w[max(0, k - 2) : k], w[k])) for k in range(1, len(w))]
        ratio = sorted((math.log10(plain_p(toxic, [], x)) - math.log10(plain_p((trusted[0][:1], trusted[1]), [], x)) for x in w[1:]), reverse=True)
        ratio = ratio[:3]
        want.append((i, len(w) - 2, 10 ** (-sum(logs) / len(logs)), sum(ratio) / len(ratio)))
    assert judge.own <= {"en"}
    for g, x in zip(sorted(got), sorted(want), strict=True):
        assert g[:2] == x[:2] and abs(g[2] / x[2] - 1) < 1e-3 and abs(g[3] - x[3]) < 1e-3, (g, x)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id >= 500 and doc_id < 540").count() == 0


def test_quality_fits_all_labelled_texts(spark):
    """Every trusted and toxic text is in a model, but the quarter that limits come from; there are more than 1,500 of a kind."""
    from quarry.llm.common import Work

    docs = spark.createDataFrame([(i, f"{'good' if i < 2400 else 'bad'} word {i}", "en") for i in range(2700)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 2400), int(i >= 2400)) for i in range(2700)], "doc_id long, quality int, toxic int")
    work = Work(spark, "quality")
    _, _, used = quality.fitted(docs, quality.known_texts(docs, labels, work), work)
    hashes = {r["_h"] for r in quality.keyed(docs).collect()}
    assert {r["h"] for r in used.collect()} == {h for h in hashes if h % 4}
    work.clear()


def test_quality_trigrams_travel_packed(spark):
    """Each trigram of a text once, in one of the parts, by context and by suffix, in fewer bytes than two hashes take."""
    texts = [sentence(i, 200) for i in range(300)]
    seeds = np.array([quality.seed("en")], np.uint64)
    docs = spark.createDataFrame([(quality.signed(int(seeds[0])), t) for t in texts], "seed long, text string").coalesce(1)
    want = Counter(g for w in (["<", *tokens(t), ">"] for t in texts) for g in zip(w, w[1:], w[2:], strict=False))
    for last in (False, True):
        blobs = [r["blob"] for i in range(4) for r in quality.trigrams(docs, seeds, last, i, 4).collect()]
        rows = [np.concatenate(x) for x in zip(*(quality.unpack_words(b, 3, 2) for b in blobs), strict=True)]
        of = rows[1] != 0
        assert len(set(zip(*(x[of].tolist() for x in rows[:3]), strict=True))) == of.sum() == len(want)
        assert rows[3][of].sum() == (len(want) if last else sum(want.values())) and rows[3][~of].sum() == (len(texts) if last else 0)
        assert sum(map(len, blobs)) < 16 * len(rows[0])


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in quality.classify(docs, none).collect())
    good = spark.createDataFrame([(1, 1, 0)], none.schema)
    assert quality.classify(docs, good).count() == 2
    assert quality.classify(docs.limit(0), good).count() == 0


def test_placed_against_plain_order(spark):
    """Shared elements, rarest last to be summed, as a plain count has them; no row for an element of one member, nor a Generate."""
    r = random.Random(8)
    sets = {i: {e: r.random() for e in r.sample(range(-60, 60), 12)} | {1000 + i: 2.0} for i in range(25)}
    rows = [(b"a", b"%02d" % i, b"%02d" % i, i % 2 == 0, sum(d.values()), 2.0 + i / 9, 1.0, list(d), list(d.values())) for i, d in sets.items()]
    told = spark.createDataFrame(rows, "a binary, b binary, label binary, open boolean, size double, excess double, slack double, every array<long>, heavy array<double>")
    work = near_dups.Work(spark, "near")
    out = near_dups.placed(told, work)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    n, want = Counter(e for d in sets.values() for e in d), {}
    for i, d in sets.items():
        total, least = 0.0, 2.0
        for e in sorted((e for e in d if n[e] > 1), key=lambda e: (-n[e], -e)):
            total += d[e]
            if total >= min((2.0 + i / 9 + 1.0) / 2, (2.0 + i / 9 + least) / 2 if i % 2 == 0 else math.inf):
                want[i, e] = total
    got = {(int(x["b"]), x["el"]): x["behind"] for x in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want
    work.clear()


def test_lm_scoring_holds_little_at_once():
    """What scoring holds beside the texts does not grow with the texts of a batch."""
    import tracemalloc

    scorer = lm_score.Scorer(lm_score.Mixer(), [np.zeros((2, 1 << b), np.float32) for b in lm_score.SIZES], np.zeros(0, np.uint64), np.zeros(0), 1, 100, 10)
    texts = pa.array([sentence(i % 7, 40) * 1000 for i in range(60)])
    few = scorer.parts(texts[:2])
    assert texts.nbytes > 8 << 20
    tracemalloc.start()
    every = scorer.parts(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20, peak
    assert np.allclose(every[3][:2], few[3]) and (every[0][:2] == few[0]).all()


def test_sharers_lose_no_pair_and_list_few(spark, tmp_path):
    """Every pair that shares enough of its differences is found; what most members differ in does not pair them all."""
    r, n, slack = random.Random(5), 60, 30.0
    rows, parts = [], {}
    for i in range(n):
        # all lack the same passage, of 40; each has something of its own, and some have a passage in pairs
        own = {1000 + i * 50 + j: 1.0 for j in range(5 if i < 20 else r.randint(20, 40))} | ({900 + i // 2: 45.0} if i < 20 else {})
        d = own | {j: 1.0 for j in range(40)}
        size = sum(d.values())
        parts[i] = d, size, size - (10 if i < 20 else r.uniform(2, 10))
        rows.append((b"a", b"%02d" % i, b"%02d" % i, True, size, parts[i][2], slack, list(d), list(d.values())))
    told = spark.createDataFrame(rows, "a binary, b binary, label binary, open boolean, size double, excess double, slack double, every array<long>, heavy array<double>")
    work = near_dups.Work(spark, "near")
    got = {(int(x["x"]), int(x["y"])) for x in near_dups.sharers(told, work).collect()}
    work.clear()
    both = lambda x, y: sum(w for k, w in parts[x][0].items() if k in parts[y][0])
    want = {(x, y) for x in range(n) for y in range(n) if x != y and parts[y][2] > slack and both(x, y) >= (parts[x][2] + parts[y][2]) / 2}
    assert want <= got and len(want) >= 10 and len(got) < n * (n - 1) / 4


# --- language model


def test_lm_score_against_plain_mixture(spark):
    """Scores are log10 of the mixture, whatever the length of a token, and the shares of all tokens add up to one at most."""
    rows = [(i, sentence(i, 30)) for i in range(40)] + [(100 + n, "q" * 10**n) for n in range(5)] + [(200, None), (201, ""), (200, "x")]
    docs = frame(spark, rows)
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["held_out"], r["score"], r["bits_per_byte"]) for r in lm_score.score_documents(docs).collect()]
    cut = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())] + [b""]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not out(i) for w in cut(t))
    total = sum(count.values())
    counts = lm_score.token_counts(docs.withColumn("h", lm_score.held_out(docs.doc_id)).where("not h"))
    tables = lm_score.bit_counts(counts)
    mixer = lm_score.learned(counts, tables)
    mixer.prepare(tables)

    def spelled(word):
        """Bit by bit."""
        data = word + b" "
        log = 0.0
        for at, byte in enumerate(data):
            part = np.frombuffer(data[: at + 1], np.uint8)
            bits = lm_score.Bits(part, np.array([0, len(part)]))
            for i in range(8):
                _, partial = bits.bit(i)
                x = np.float32(0)
                for k, s in enumerate(bits.slots(i, partial)):
                    zeros, ones = (tables[k][v][s[-1]] for v in (0, 1))
                    gate = min(int(math.log2(zeros + ones + 1)), lm_score.BUCKETS - 1)
                    x += np.float32(math.log((ones + 0.2) / (zeros + 0.2)) * mixer.weights[k, gate, i])
                x = (min(max(int((x + np.float32(lm_score.RANGE)) * np.float32(lm_score.FINE)), 0), 2 * lm_score.FINE * lm_score.RANGE - 1) + 0.5) / lm_score.FINE - lm_score.RANGE
                cell = min(max(x * 2 + 16, 0), lm_score.STEPS - 1.001)
                low = int(cell)
                refined = mixer.map[partial[-1], low] * (1 - cell + low) + mixer.map[partial[-1], low + 1] * (cell - low)
                p = min(max((refined + 1 / (1 + math.exp(-x))) / 2, 1e-6), 1 - 1e-6)
                log += math.log10(p if byte >> (7 - i) & 1 else 1 - p)
        return log

    memory = {}

    def score(word):
        if word not in memory:
            coded = spelled(word) + math.log10(lm_score.DISCOUNT * len(count) / total)
            own = math.log10((count[word] - lm_score.DISCOUNT) / total) if count[word] else -math.inf
            top = max(coded, own)
            memory[word] = top + math.log10(10 ** (coded - top) + 10 ** (own - top))
        return memory[word]

    for g in got:
        if g[0] in (200, 103, 104):
            continue
        text = dict(rows)[g[0]]
        words = cut(text)
        want = sum(map(score, words))
        assert g[1] == len(words) and g[2] == sum(w in count for w in words) and g[3] == out(g[0])
        assert abs(g[4] - want) < 1e-3 * max(1, abs(want)), (g, want)
        assert abs(g[5] - want / -math.log10(2) / max(1, len((text or "").encode()))) < 1e-2 * abs(g[5])
    long = {i: s for i, _, _, _, s, _ in got}
    assert long[100] > long[101] > long[102] > long[103] > long[104] > -math.inf
    # all tokens of up to two signs of a small alphabet, and those seen
    some = {bytes([a]) for a in range(256) if a not in (32, *range(9, 14))} | {b""} | set(count)
    assert sum(10 ** score(w) for w in some) <= 1


def test_lm_score_counts_occurrences(spark):
    """Bits are counted in every occurrence of a token, and weights learn from every one."""
    counts = spark.createDataFrame([(b"ab ", 700), (b"c ", 1), (b" ", 5)], "token binary, n long").repartition(1)
    tables = lm_score.bit_counts(counts)
    assert all(int(t.sum()) == 8 * (3 * 700 + 2 + 5) for t in tables)
    chunks = lm_score.occurrences(counts).collect()
    assert sum(r["n"] for r in chunks) == 706 and max(r["n"] for r in chunks) == lm_score.CHUNK and len(chunks) == 5
    twice = [lm_score.Mixer(), lm_score.Mixer()]
    for m, n in zip(twice, ([1, 1], [9, 1]), strict=True):
        m.learn(tables, np.frombuffer(b"ab c ", np.uint8), np.array([0, 3, 5]), 0, np.array(n))
    assert not np.allclose(twice[0].map, twice[1].map)


def test_lm_score_small_corpora(spark):
    for rows in ([], [(1, "a")], [(1, None), (2, "")], [(i, "b") for i in range(3)], [(5, "only held out"), (12, "x")]):
        got = lm_score.score_documents(frame(spark, rows)).collect()
        assert len(got) == len(rows) and all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


# --- token output and pieces


def test_ids_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(9)
    texts = ["".join(r.choice("abTHWYJtEz \n\t.,'01<|>éñ日ß🙂̧̱᷊̈̊̌́ÅẞİÑ") for _ in range(r.randint(0, 30))) for _ in range(5000)]
    texts += [None, "", "T̈", "<|endoftext|> A", "A<|ENDOFTEXT|>", "word " * 300_000]
    want = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    got = list(sstable.Encoder(path)(pa.array(texts)))
    assert all(g.tolist() == w.ids for g, w in zip(got, want, strict=True))


def test_shards_of_nothing(spark, tmp_path):
    import public_tokenizers

    shards = sstable.write_shards(frame(spark, []), f"file://{tmp_path}/s", public_tokenizers.path("word_bpe_49k.json"), end=2)
    assert sstable.read_shards(spark, shards).count() == 0


def test_piece_digests(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rows = [(1, None), (2, ""), (3, sentence(1, 50)), (3, "日本 🙂"), (None, "x"), (4, "ab " * 100_000)]
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.encoding_digests(frame(spark, rows), pieces.model_path()).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((i or 0, len(ids := library.encode(t or "")), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in rows)
    assert got == want
    assert pieces.encoding_digests(frame(spark, []), pieces.model_path()).count() == 0


# --- suffix dedup


def plain_cut(rows):
    seen, want = set(), []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        want.append((i, len(b), sum(gone), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(want, key=repr)


def test_suffix_collisions(monkeypatch, spark):
    """Windows whose fingerprints are equal but bytes are not stay."""
    index = suffix_dedup.Levels(100)
    r = np.random.default_rng(2)
    strings = [r.integers(0, 4, 400).astype(np.uint8) for _ in range(6)]
    strings += [np.concatenate((strings[0][50:200], r.integers(0, 4, 50).astype(np.uint8))), strings[3].copy()]
    seen, got, want = set(), [], []
    for s in strings:
        at = np.arange(len(s) - 99)
        weak = (Rolling(s)(at, at + 100) & np.uint64(15)).astype(np.uint64)
        later = index.scan(weak, s, at, np.zeros(len(at), int), np.array([0]), np.array([len(s)]))
        got.append(later.tolist())
        own = []
        for p in at.tolist():
            raw = s[p : p + 100].tobytes()
            own.append(raw in seen)
            seen.add(raw)
        want.append(own)
    assert got == want


def test_suffix_long_text(spark):
    """Texts beyond a slice, one periodic, one with a far repeat, and a document that repeats a part of them."""
    r = random.Random(4)
    far = "".join(r.choice("abcdefgh ") for _ in range(2_300_000))
    rows = [(1, far + far[1000:1500]), (2, "xyz" * 800_000), (3, far[2_099_900:2_100_200]), (4, "xyz" * 60)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.digests(frame(spark, rows)).collect()}
    assert got == {1: (2_300_500, 500, 1), 2: (2_400_000, 2_400_000 - 3, 1), 3: (300, 300, 1), 4: (180, 180, 1)}


# --- pages


def plain_second_pass(first):
    out = []
    for i, x in enumerate(first):
        if x is not None:
            out.append(x)
            continue
        best = min((abs(i - j) for j, y in enumerate(first) if y is not None), default=None)
        near = {first[j] for j in (i - best, i + best) if best and 0 <= j < len(first) and first[j] is not None} if best else {0}
        out.append(min(near))
    return out


def test_second_pass():
    r = random.Random(1)
    for _ in range(300):
        first = [r.choice([0, 1, None, None]) for _ in range(r.randint(0, 12))]
        assert html_extract.second_pass(first) == plain_second_pass(first)


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<a '" * 130_000 + '<b "' * 130_000, "<div><span></p></b>" * 60_000, "<div class=ad>x" * 60_000, "<" * 1_000_000, "<p>a" * 250_000, "<div>" * 100_000 + "</span>" * 100_000, "&amp" * 250_000])
def test_hostile_pages(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 3


PROSE = "It was the best of the times that we had in the old town, and all of it is in the letters which he had from the men at the mill, but they were not the ones who would do what there was to do. "


def test_pages_without_article():
    page = f"<body><div id=menu><a href=a>Home of all</a> <a href=b>About the firm</a></div><h2>A title</h2><div><p>{PROSE * 2}</p><p>Short one.</p><p>{PROSE * 2}</p></div><div><a href=x>{PROSE}</a></div><p>All rights reserved</p><form>{PROSE * 2}</form></body>"
    got = html_extract.main_text(page)
    assert got.count("old town") == 4 and "Short one." in got and "Home" not in got and got.startswith("A title")
    for name in ("class='notice-period'", "class='form-of-government'", "class='legal-history'", "id='share-prices'"):
        assert html_extract.main_text(f"<body><article><p>{PROSE}</p><div {name}>{PROSE * 2}</div></article>").count("old town") == 3, name


def test_no_pages(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


# --- the others on odd input


def test_chat_odd_input(spark):
    v = chat_format.vocabulary_path()
    schema = "conv_id long, turn long, role string, text string, ids string, first int"
    rows = [(1, t, ["user", "assistant"][t % 2], "x" * (t * 50_000), "", 0) for t in range(5)] + [(2, 0, "assistant", "<s>[/INST]\\</s>é🙂", "", 0)] * 2
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.assemble(chat_format.format_turns(spark.createDataFrame(rows, schema), v), v), v).collect()}
    assert got[1]["loss_chars"] == 200_000 and got[2]["n_turns"] == 2 and got[2]["loss_chars"] == 2 * len("<s>[/INST]\\</s>é🙂")
    assert chat_format.digests(chat_format.assemble(chat_format.format_turns(spark.createDataFrame([], schema), v), v), v).count() == 0
    offsets = chat_format.assemble(chat_format.format_turns(spark.createDataFrame(rows, schema), v), v).where("conv_id = 1").orderBy("turn").collect()
    at = 0
    for r in offsets:
        assert r["token_start"] == at
        at += len(r["ids"])


def test_decontaminate_long_text(spark):
    item = sentence(1, 12)
    rows = [(1, "zz " * 200_000 + item + " zz" * 10), (2, None)]
    items = spark.createDataFrame([(1, item, "x")], "item_id long, text string, doc_id string")
    got = {r["doc_id"]: r for r in decontaminate.find_hits(frame(spark, rows), items).collect()}
    assert got[1]["n_hit"] == 12 and got[1]["spans"][0]["start"] == 600_000 and got[2]["n_words"] == 0


def test_neighbour_blocks(spark):
    """Several query blocks give what one gives; ties go to smaller ids; no rows, no neighbours."""
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-2, 3, 4).astype(float).tolist()) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = table.where("vec_id % 5 = 0")
    one = sorted(tuple(x)[1:] for x in neighbours.nearest(table, asked).select("query_row", "query_id", "rank", "vec_id", "score").collect())
    many = sorted(tuple(x)[1:] for x in neighbours.nearest(table, asked, block=7).select("query_row", "query_id", "rank", "vec_id", "score").collect())
    assert one == many and len(one) > 100
    assert neighbours.nearest(table.limit(0), asked).count() == 0 and neighbours.nearest(table, asked.limit(0)).count() == 0
