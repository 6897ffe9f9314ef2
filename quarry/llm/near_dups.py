"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

A document is the bag of its runs of ``WIDTH`` words (all its words, if fewer). A
shingle weighs the mean IDF of its words, once per occurrence, so the similarity of two
bags is weighted Jaccard. IDF is ln(1 / share of documents with the word), for shares
under ``RARE`` that of RARE: so only words with a share of RARE or more need a table,
and there are at most (mean distinct words per document) / RARE of these, whatever the
size of the corpus. It is broadcast; the counts behind it cover all documents.

``BANDS`` x ``ROWS`` samples are drawn; documents that share a band are candidates, and
every pair of candidates is decided. In a bucket, first one member is compared with all others: the
one whose buckets hold the most members (of a text and its altered copies, the text). Of
the pairs that its class does not settle, each has a member outside it. Those of a small bucket are
compared; those of a large one are compared if they share enough of their differences
from the first member, which similar ones must (see ``sharers``), so no candidate is lost and
altered copies that differ in different places are not listed pair by pair. Links are kept if the weighted
Jaccard similarity, from whole texts, is at least ``threshold``; classes are their
connected components, named by the least document id.

Defined cases: documents of equal word sequences are one class without comparison;
those without words (null, empty, marks only) are a class each. Rows with a null id get
a null class unless their class has an id. Only the named columns are read.

Scale: equal texts collapse first, so a group of copies counts once. A member with many
partners is dealt out by salt, its text streamed once to each part. Links and labels
stay distributed; tables on the way are written to the shared folder and deleted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_WORD, LOWER, KeyTable, Rolling, U, Work, mix, powers, runs, slices, text_bytes, trim

WIDTH, BANDS, ROWS, THRESHOLD, RARE = 5, 12, 4, 0.8, 1e-3
FLUSH = 1 << 20
SALTED = 256
#: buckets of up to so many members are compared pair by pair where members are open
SMALL = 32
#: elements of a group's differences that are counted together
PACKED = 1 << 17


def word_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a slice of texts."""
    low = LOWER[data]
    starts, ends, rows = runs(IS_WORD[low], bounds)
    return Rolling(low)(starts, ends), rows


def slice_words(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, word hashes, rows within the slice)."""
    data, bounds = text_bytes(column)
    for a, b in slices(bounds):
        yield a, b, *word_runs(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])


def document_shares(docs: DataFrame, text: str, rare: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that a share of ``rare`` or more of the documents hold, and their shares."""

    def count(batches):
        words, counts = np.zeros(0, U), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([-batch.num_rows])], ["word", "n"])
            for _, _, h, rows in slice_words(batch[0]):
                _, once = np.unique(mix(h ^ rows.astype(U) * U(0xD1B54A32D192ED03)), return_index=True)
                new, n = np.unique(h[once], return_counts=True)
                words, at = np.unique(np.concatenate((words, new)), return_inverse=True)
                counts = np.bincount(at, np.concatenate((counts, n)), len(words)).astype(np.int64)
                if len(words) > FLUSH:
                    yield out()
                    words, counts = np.zeros(0, U), np.zeros(0, np.int64)
        yield out()

    counts = docs.select(F.col(text).cast("string")).mapInArrow(count, "word long, n long")
    total = docs.count()
    sums = counts.where("n > 0").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rare * total)
    table = sums.toArrow()
    return np.asarray(table["word"]).view(U).copy(), np.asarray(table["n"], np.float64) / max(1, total)


def tables(bits: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1): plain, at 2**bits even steps; and their logarithm, by the
    exponent and first 10 bits of a whole number up to 2**32 that is the share."""
    x = np.exp(np.linspace(math.log(1e-6), math.log(60), 200_000))
    share = -np.expm1(-x) - x * np.exp(-x)
    share[x < 1e-3] = x[x < 1e-3] ** 2 / 2
    log_x, log_share = np.log(x), np.log(share)
    even = (np.arange(1 << bits) + 0.5) / (1 << bits)
    u = np.arange(127 << 10, 160 << 10, dtype=np.uint32)
    value = (u << np.uint32(13) | np.uint32(1 << 12)).view(np.float32).astype(np.float64) / 2.0**32
    return np.exp(np.interp(np.log(even), log_share, log_x)).astype(np.float32), np.interp(np.log(np.minimum(value, 1 - 1e-12)), log_share, log_x).astype(np.float32)


R_TABLE, LOG_C = tables()


class Bags:
    """The weighted shingles of a slice of documents: elements sorted by document and hash."""

    def __init__(self, words: np.ndarray, rows: np.ndarray, n: int, known: KeyTable, idf: np.ndarray, rarest: float):
        at = known.find(words)
        weight = np.where(at >= 0, idf[at], np.float32(rarest)).astype(np.float32)
        ends = np.searchsorted(rows, np.arange(n), "right")
        sizes = np.diff(np.concatenate(([0], ends)))
        self.n_words = sizes
        local = np.arange(len(words)) - np.repeat(ends - sizes, sizes)
        first = np.flatnonzero((local == 0) | (local + WIDTH <= sizes[rows]))
        end = ends[rows[first]]
        h, total, count = np.zeros(len(first), U), np.zeros(len(first), np.float32), np.zeros(len(first), np.float32)
        words, weight = np.append(words, np.zeros(WIDTH, U)), np.append(weight, np.zeros(WIDTH, np.float32))
        for j in range(WIDTH):
            there = first + j < end
            h = h * U(0x9E3779B97F4A7C15) + np.where(there, words[first + j], U(0))
            total += np.where(there, weight[first + j], 0)
            count += there
        h, total, row = mix(h), total / np.maximum(count, 1), rows[first]
        order = np.argsort(h)
        order = order[np.argsort(row[order].astype(np.uint16) if n < 65536 else row[order], kind="stable")]
        h, self.row, self.weight = h[order], row[order], np.maximum(total[order], np.float32(1e-3))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (self.row[1:] != self.row[:-1])
        nth = np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, int)
        self.element = np.where(nth > 0, mix(h + nth.astype(U) * U(0xD1B54A32D192ED03)), h)
        self.starts = np.searchsorted(self.row, np.arange(n))

    def bag(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Elements, sorted, and weights of one document."""
        a, b = self.starts[i], self.starts[i + 1] if i + 1 < len(self.starts) else len(self.row)
        order = np.argsort(self.element[a:b])
        return self.element[a:b][order], self.weight[a:b][order]

    def band_keys(self) -> np.ndarray:
        """A row of band keys for each document that has words."""
        have = np.flatnonzero(self.n_words)
        starts, place = self.starts[have], np.arange(len(self.row), dtype=np.int64)
        log_w = np.log(self.weight)
        keys = np.zeros((len(have), BANDS), U)
        with np.errstate(over="ignore"):
            for k in range(BANDS * ROWS):
                x = (self.element ^ U((k + 1) * 0x9FB21C651E98DF25 & (1 << 64) - 1)) * U(0xD6E8FEB86659FD93)
                x ^= x >> U(32)
                x *= U(0xA0761D6478BD642F)
                r = R_TABLE[(x >> U(52)).astype(np.int32)]
                beta = ((x >> U(40)) & U(0xFFF)).astype(np.float32) * np.float32(1 / 4096)
                u = ((x & U(0xFFFFFFFF)) | U(1)).astype(np.float32).view(np.uint32) >> np.uint32(13)
                t = np.floor(log_w / r + beta)
                a = LOG_C[np.minimum(u - np.uint32(127 << 10), np.uint32(len(LOG_C) - 1))] - r * (t - beta + 1)
                bits = a.view(np.int32)
                bits = bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))
                best = np.minimum.reduceat(bits.astype(np.int64) << 32 | place, starts) & 0xFFFFFFFF
                sample = mix(self.element[best] + t[best].astype(np.int64).astype(U) * U(0x8CB92BA72F3D8DD7))
                band = k // ROWS
                keys[:, band] = mix(keys[:, band] * U(0x9E3779B97F4A7C15) + sample + U(band))
        return keys

    def nodes(self, words: np.ndarray) -> np.ndarray:
        """16 bytes that stand for a document's word sequence, for each document that has words."""
        sizes = self.n_words[self.n_words > 0]
        starts = np.cumsum(sizes) - sizes
        up = powers(int(sizes.max()) + 1 if len(sizes) else 1)[0]
        local = np.arange(len(words)) - np.repeat(starts, sizes)
        out = np.zeros((len(sizes), 2), U)
        if len(sizes):
            out[:, 0] = mix(np.add.reduceat(words * up[local], starts) + sizes.astype(U))
            out[:, 1] = mix(np.add.reduceat(mix(words + U(1)) * up[local], starts) ^ sizes.astype(U))
        return out


class Weights:
    """What workers need to build bags: the frequent words' IDF."""

    def __init__(self, words: np.ndarray, shares: np.ndarray, rare: float):
        self.words, self.idf, self.rarest = words, np.log(1 / shares).astype(np.float32) if len(shares) else np.zeros(1, np.float32), math.log(1 / rare)
        self.known: KeyTable | None = None

    def __getstate__(self):
        return self.__dict__ | {"known": None}

    def bags(self, words: np.ndarray, rows: np.ndarray, n: int) -> Bags:
        if self.known is None:
            self.known = KeyTable(self.words)
        return Bags(words, rows, n, self.known, self.idf, self.rarest)


def binary16(nodes: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(nodes), [None, pa.py_buffer(np.ascontiguousarray(nodes).tobytes())]).cast(pa.binary())


def sketches(docs: DataFrame, weights) -> DataFrame:
    """(doc_id, row, node, bands) of every document; node and bands are null for those without words."""

    def run(batches):
        for batch in batches:
            for a, b, words, rows in slice_words(batch["text"]):
                bags = weights.value.bags(words, rows, b - a)
                have = bags.n_words > 0
                at = pa.array(np.where(have, np.cumsum(have) - 1, 0), mask=~have)
                keys = bags.band_keys().view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["row"].slice(a, b - a), binary16(bags.nodes(words)).take(at), bands.take(at)], ["doc_id", "row", "node", "bands"])
            trim()

    return docs.mapInArrow(run, "doc_id long, row long, node binary, bands array<long>")


def node_texts(docs: DataFrame, weights) -> DataFrame:
    """(node, text) of every document with words; a task sends a node once in a while, not each time."""

    def run(batches):
        sent: set[bytes] = set()
        for batch in batches:
            for a, b, words, rows in slice_words(batch["text"]):
                bags = weights.value.bags(words[:0], rows[:0], 0)
                bags.n_words = np.bincount(rows, minlength=b - a)
                have = np.flatnonzero(bags.n_words)
                nodes = binary16(bags.nodes(words)).to_pylist()
                keep = []
                for i, node in enumerate(nodes):
                    if node not in sent:
                        sent.add(node)
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in keep], pa.binary()), batch["text"].take(pa.array(a + have[keep] if keep else [], pa.int64()))], ["node", "text"])
            if len(sent) > FLUSH // 4:
                sent.clear()

    return docs.mapInArrow(run, "node binary, text string")


def dealt(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, salt, b, text) of the pairs (a, b): a's own text first (b null), then those of its partners, once to each of its parts."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALTED).alias("parts"))
    salted = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")))
    members = salted.join(texts, salted.b == texts.node).select("a", "salt", "b", "text")
    centres = salted.select("a", "salt").distinct().join(texts, F.col("a") == texts.node).select("a", "salt", F.lit(None).cast("binary").alias("b"), "text")
    return members.unionByName(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())


class Against:
    """A bag that others are compared with."""

    def __init__(self, elements: np.ndarray, weights: np.ndarray):
        self.elements, self.weights = elements, weights.astype(np.float64)
        self.total = float(self.weights.sum())

    def common(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the (sorted) elements this bag has, and their places in it."""
        place = np.searchsorted(self.elements, elements)
        place[place == len(self.elements)] = 0
        return self.elements[place] == elements, place


def compared(pairs: DataFrame, texts: DataFrame, weights, result: Callable, schema: str) -> DataFrame:
    """(a, b, *result(bag of a, elements of b, weights of b)) of every pair."""

    def run(batches):
        centre = None
        for batch in batches:
            firsts, seconds = batch["a"].to_pylist(), batch["b"].to_pylist()
            for at, end, words, rows in slice_words(batch["text"]):
                bags, out = weights.value.bags(words, rows, end - at), []
                for i in range(end - at):
                    elements, w = bags.bag(i)
                    if seconds[at + i] is None:
                        centre = Against(elements, w)
                    else:
                        out.append((firsts[at + i], seconds[at + i], *result(centre, elements, w.astype(np.float64))))
                # a slice at a time: results may be longer than texts
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, (_, kind) in enumerate(kinds)], [k for k, _ in kinds])

    kinds = [("a", pa.binary()), ("b", pa.binary()), *((k, {"double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}[v]) for k, v in (x.split() for x in schema.split(", ")))]
    return dealt(pairs, texts).mapInArrow(run, "a binary, b binary, " + schema)


def verify(pairs: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """Each pair (a, b) with ``alike``: whether its weighted Jaccard similarity is at least ``threshold``."""

    def result(centre, elements, w):
        there, place = centre.common(elements)
        both = float(centre.weights[place[there]].sum())
        return (both >= threshold * (centre.total + float(w.sum()) - both) - 1e-9,)

    return compared(pairs, texts, weights, result, "alike boolean")


def differences(pairs: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """What b has that a has not, and what a has that b has not (elements ``every`` that weigh ``heavy``), the weight of
    all that (``size``), b's ``excess``, and k times the weight of a (``slack``).

    With D(x) the difference of x and a, |x - y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|. Similarity t asks that
    |x - y| <= k (|x| + |y|), k = (1 - t) / (1 + t): so |D(x) & D(y)| >= (e(x) + e(y)) / 2 with the excess
    e(x) = |D(x)| - k |x|. If y is not like a, e(y) > k |a|.
    """
    k = (1 - threshold) / (1 + threshold)

    def result(centre, elements, w):
        there, place = centre.common(elements)
        lost = np.ones(len(centre.elements), bool)
        lost[place[there]] = False
        every = np.concatenate((elements[~there], centre.elements[lost]))
        heavy = np.concatenate((w[~there], centre.weights[lost]))
        size = float(heavy.sum())
        return size, size - k * float(w.sum()), k * centre.total, every.view(np.int64), heavy

    return compared(pairs, texts, weights, result, "size double, excess double, slack double, every array<long>, heavy array<double>")


def placed(told: DataFrame, work: Work) -> DataFrame:
    """(a, b, label, open, size, excess, slack, least, el, behind) of the elements that a member's difference shares with another of the group.

    Each difference is put in one order for the group, the elements that fewest members have first; ``behind``: what an element and
    those after it weigh; ``least``: the least excess in the group. Elements that ``sharers`` leaves out on either side get no row.
    Until then the elements of a member travel in one row, those of a group in parts of ``PACKED`` by their hash.
    """
    groups = told.groupBy("a").agg(F.min("excess").alias("least"), F.ceil(F.sum(F.size("every")) / PACKED).alias("parts"))
    rows = work(told.join(groups, "a").withColumn("m", F.monotonically_increasing_id()))

    def packed(batches):
        for batch in batches:
            of, parts, members = batch["a"].to_pylist(), batch["parts"].to_pylist(), np.asarray(batch["m"])
            cuts = batch["every"].value_lengths().to_numpy(zero_copy_only=False)
            elements = np.asarray(batch["every"].flatten())
            ends, out, x = np.cumsum(cuts), [], 0
            while x < len(of):
                y = x + 1
                while y < len(of) and of[y] == of[x]:
                    y += 1
                el, m = elements[ends[x] - cuts[x] : ends[y - 1]], np.repeat(members[x:y], cuts[x:y])
                part = (mix(el.view(U)) % U(parts[x])).astype(np.int64)
                out += [(of[x], int(k), el[part == k].tobytes(), m[part == k].tobytes()) for k in np.unique(part)]
                x = y
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["a", "part", "els", "who"])

    def counted(batches):
        now, held = None, []

        def done():
            el, m = (np.concatenate([np.frombuffer(h[i], np.int64) for h in held]) for i in (0, 1))
            _, at, n = np.unique(el, return_inverse=True, return_counts=True)
            # elements of one member come first, so no other's ``behind`` holds them
            more = np.flatnonzero(n[at] > 1)
            more = more[np.argsort(m[more], kind="stable")]
            who, first = np.unique(m[more], return_index=True)
            ends = np.append(first[1:], len(more))
            pick = [more[x:y] for x, y in zip(first.tolist(), ends.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array([el[i].tobytes() for i in pick], pa.binary()), pa.array([n[at[i]].astype(np.int64).tobytes() for i in pick], pa.binary())], ["m", "els", "ns"])

        for batch in batches:
            for *key, els, who in zip(*(batch[c].to_pylist() for c in ("a", "part", "els", "who")), strict=True):
                if key != now:
                    if held:
                        yield done()
                    now, held = key, []
                held.append((els, who))
        if held:
            yield done()

    names = ["a", "b", "label", "open", "size", "excess", "slack", "least"]

    def ordered(batches):
        for batch in batches:
            at, els, behinds = [], [], []
            for i, (found, every, heavy, open_, size, excess, slack, least) in enumerate(zip(*(batch[c].to_pylist() for c in ("found", "every", "heavy", "open", "size", "excess", "slack", "least")), strict=True)):
                el, n = (np.concatenate([np.frombuffer(f[k], np.int64) for f in found]) for k in ("els", "ns"))
                order = np.lexsort((el, n))[::-1]
                el, every = el[order], np.asarray(every, np.int64)
                sort = np.argsort(every)
                behind = np.cumsum(np.asarray(heavy)[sort[np.searchsorted(every, el, sorter=sort)]])
                floor = min((excess + slack) / 2, (excess + least) / 2 if open_ else math.inf) - spare_of(slack, size)
                keep = behind >= floor
                at += [i] * int(keep.sum())
                els.append(el[keep])
                behinds.append(behind[keep])
            left = batch.select(names).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *els])), pa.array(np.concatenate([np.zeros(0), *behinds]))], [*names, "el", "behind"])

    dealt_out = rows.select("a", "parts", "m", "every").mapInArrow(packed, "a binary, part long, els binary, who binary").repartition("a", "part").sortWithinPartitions("a", "part")
    shared = dealt_out.mapInArrow(counted, "m long, els binary, ns binary").groupBy("m").agg(F.collect_list(F.struct("els", "ns")).alias("found"))
    kept = rows.join(shared, "m").select(*names, "every", "heavy", "found")
    return kept.mapInArrow(ordered, told.select("a", "b", "label", "open", "size", "excess", "slack").withColumns({"least": F.lit(0.0), "el": F.lit(0).cast("long"), "behind": F.lit(0.0)}).schema)


def spare_of(slack, size):
    """What sums of weights may differ by."""
    return 1e-6 * (1 + slack + size)


def sharers(told: DataFrame, work: Work) -> DataFrame:
    """(x, x_label, y, y_label, shared): members x and y of a group, y open, of different classes, that may be like each other.

    All that two members share lies at or behind the first element, in the group's order, that they share. They must share
    (e(x) + e(y)) / 2, so that element is not among the last of D(x) that weigh less than (e(x) + k |a|) / 2, as y is not like a,
    nor among those of D(y) that weigh less than its own excess and the least in the group, halved.
    """
    each = work(placed(told, work))
    spare = spare_of(F.col("slack"), F.col("size"))

    def side(c: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.col("a").alias(f"{c}_a"), F.col("el").alias(f"{c}_el"), F.col("behind").alias(f"{c}_behind"), F.col("b").alias(c), F.col("label").alias(f"{c}_label"), F.col("size").alias(f"{c}_size"), F.col("excess").alias(f"{c}_excess"))

    x = side("x", each.where(F.col("behind") >= (F.col("excess") + F.col("slack")) / 2 - spare))
    y = side("y", each.where("open").where(F.col("behind") >= (F.col("excess") + F.col("least")) / 2 - spare))
    need = (F.col("x_excess") + F.col("y_excess")) / 2
    most = F.least("x_size", "y_size", "x_behind", "y_behind")
    met = x.join(y, (F.col("x_a") == F.col("y_a")) & (F.col("x_el") == F.col("y_el")) & (F.col("x_label") != F.col("y_label")) & (need <= most * (1 + 1e-6) + 1e-6))
    return met.groupBy("x", "y").agg(F.first("x_label").alias("x_label"), F.first("y_label").alias("y_label"), F.count("*").cast("double").alias("shared"))


def components(edges: DataFrame, work: Work) -> DataFrame:
    """(node, label) of every node with an edge: the least node of its component."""
    both = work(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = work(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        mine = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("of"), F.col("label").alias("above"))
        step = work(mine.join(up, mine.next == up.of, "left").select("node", F.least("next", F.coalesce("above", "next")).alias("label"), F.col("label").alias("old")))
        done = step.where("old != label").isEmpty()
        work.drop(labels)
        if done:
            work.drop(both)
            return step.select("node", "label")
        labels = step


def merged(labels: DataFrame, found: DataFrame, work: Work) -> DataFrame:
    """``labels`` with the edges ``found`` (a, b) added: the components of the classes that these join, not of all nodes."""
    if found.isEmpty():
        return labels
    edges = work(labelled(labelled(found, labels, "a", "x"), labels, "b", "y"))
    moved = components(edges.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")), work)
    fresh = edges.where("a = x").select(F.col("a").alias("node")).unionByName(edges.where("b = y").select(F.col("b").alias("node"))).distinct()
    every = labels.unionByName(fresh.join(labels, "node", "left_anti").withColumn("label", F.col("node")))
    moved = moved.select(F.col("node").alias("label"), F.col("label").alias("next"))
    return work(every.join(moved, "label", "left").select("node", F.coalesce("next", "label").alias("label")))


def labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the class of the column ``node``, which is that node itself if it has no links."""
    at = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return rows.join(at, rows[node] == F.col("_node"), "left").withColumn(name, F.coalesce("_label", node)).drop("_node", "_label")


def link(members: DataFrame, texts: DataFrame, weights, threshold: float, work: Work) -> DataFrame:
    """(node, label) classes of the nodes in the buckets ``members`` (key, node), by every link within a bucket."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    scores = members.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("score"))
    scored = members.join(scores, "node")
    centres = scored.groupBy("key").agg(F.max_by("node", F.struct("score", "node")).alias("centre"), F.count("*").alias("size"))
    rows = work(members.join(centres, "key").select("key", "node", "centre", "size"))
    pairs = rows.where("centre != node").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    alike = work(verify(pairs, texts, weights, threshold).where("alike").select("a", "b"))
    labels = components(alike, work)
    # what is still to be decided has a member, not in its centre's class, on one side at least
    known = work(labelled(labelled(rows, labels, "node", "label"), labels, "centre", "own").withColumn("open", F.col("label") != F.col("own")))
    left = known.join(known.where("open").select("key").distinct(), "key", "left_semi").where("node != centre")
    few = left.where(F.col("size") <= SMALL)
    x, y = few.select("key", F.col("node").alias("x"), F.col("label").alias("x_label")), few.where("open").select("key", F.col("node").alias("y"), F.col("label").alias("y_label"))
    near = x.join(y, "key").where("x_label != y_label").select("x", "y", "x_label", "y_label", F.lit(0.0).alias("shared"))
    # in a large bucket, members that are like another one must share differences from the centre
    large = left.where(F.col("size") > SMALL).select(F.col("centre").alias("a"), F.col("node").alias("b"), "label", "open").distinct()
    told = work(differences(large.select("a", "b"), texts, weights, threshold).join(large, ["a", "b"]))
    # members so like the centre that they need share nothing are like each other: the one of least excess stands for them
    best = told.groupBy("a").agg(F.min_by(F.struct("b", "label"), F.struct("excess", "b")).alias("x")).select("a", F.col("x.b").alias("x"), F.col("x.label").alias("x_label"))
    first = best.join(told.where("open").select("a", F.col("b").alias("y"), F.col("label").alias("y_label")), "a").where("x_label != y_label")
    open_ = work(near.unionByName(sharers(told, work)).unionByName(first.select("x", "y", "x_label", "y_label", F.lit(0.0).alias("shared"))))
    # of each open member with each other class, first the pair that shares most; then the pairs whose classes are still two
    most = open_.groupBy("y", "x_label").agg(F.max_by("x", F.struct("shared", "x")).alias("x")).select(*ends()).distinct()
    labels = merged(labels, work(verify(most, texts, weights, threshold).where("alike").select("a", "b")), work)
    rest = open_.select(*ends()).distinct().join(most, ["a", "b"], "left_anti")
    rest = labelled(labelled(rest, labels, "a", "x"), labels, "b", "y").where("x != y").select("a", "b")
    return merged(labels, work(verify(rest, texts, weights, threshold).where("alike").select("a", "b")), work)


def ends() -> list[Column]:
    return [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]


def _classes(rows: DataFrame, threshold: float, rare: float, work: Work) -> DataFrame:
    """``rows`` (doc_id, text, and others) but the text, with ``node`` (null without words) and the class ``label``; written."""
    weights = rows.sparkSession.sparkContext.broadcast(Weights(*document_shares(rows, "text", rare), rare))
    sketch = work(sketches(rows, weights))
    nodes = sketch.where("node is not null").groupBy("node").agg(F.first("bands").alias("bands"))
    spread = nodes.select("node", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = work(spread.join(shared, "key").select("key", "node"))
    candidates = members.select("node").distinct()
    texts = work(node_texts(rows, weights).join(candidates, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    labels = link(members, texts, weights, threshold, work)
    out = work(labelled(sketch.drop("bands"), labels, "node", "label"))
    work.clear(out)
    return out


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, rare: float = RARE) -> DataFrame:
    """(doc_id, class_id) of every document: class_id is the least id of its class, its own id for documents without words."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), F.col(text).cast("string").alias("text"))
    out = _classes(rows, threshold, rare, Work(docs.sparkSession, "near"))
    least = out.where("node is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return out.join(least, "label", "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, rare: float = RARE) -> DataFrame:
    """``docs``, all columns, with one row of each class: that of least id (null ids last), of equal ids the first.

    Rows are told apart by their place, so a repeated id loses only the rows that are duplicates.
    Documents without words all stay.
    """
    work = Work(docs.sparkSession, "near")
    stored = work(docs.withColumn("_row", F.monotonically_increasing_id()))
    rows = stored.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("_row").alias("row"), F.col(text).cast("string").alias("text"))
    out = _classes(rows, threshold, rare, Work(docs.sparkSession, "near")).where("node is not null")
    turn = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    stays = out.groupBy("label").agg(F.min(turn)["row"].alias("stays"))
    gone = out.join(stays, "label").where("row != stays").select(F.col("row").alias("_row"))
    return stored.join(gone, "_row", "left_anti").select(*docs.columns)


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the class of every document."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
