"""Quality classifier: interpolated modified Kneser-Ney word trigrams of trusted text.

Trusted text is what ``labels`` call good (quality 1, toxic 0). A text is its words
(lower-cased A-Z) and its runs of marks, between a begin and an end token. By language, a
trigram model is fitted to trusted text: interpolated modified Kneser-Ney, three discounts
an order. A document has a perplexity a token under it. Word frequencies of text labelled toxic,
smoothed alike, give a second figure, the contrast: the mean of the document's three largest log10 ratios of a
token's probability there to its lowest-order probability in trusted text (repeats count). A document is
rejected if its perplexity lies outside a lower and an upper limit, or its contrast above
one. Limits are quantiles, by language, over all labelled trusted texts that are in no
model (the lower limit: over the fitted ones too).

Trigrams are counted by task and travel packed, as places in a list of their words, to the shard of their first two words'
64-bit hash, which has their context's sum too, and once more to that of their last two, which counts the bigrams; a part of the
shards at a time. Shards are files of counts;
discounts are small. Documents are copied to batch files, part by part; a batch asks each shard for the n-grams that
it holds, each once a batch, leaving out those that a Bloom filter of fixed size (broadcast) rules out; shards answer
with shares and weights, from which the batch interpolates and adds up by document. Fitted are all trusted and all toxic texts
but a quarter, by hash, that limits are taken from: files grow with the labelled text.

Defined cases: null or empty text has perplexity 1 and is kept; languages with under
``MIN_DOCS`` held-out trusted texts or fitted toxic ones, unlabelled ones too, are scored
by models of all languages together, with limits over all; null language is a language
of its own; repeated label rows, and rows of equal texts, must agree, else the text is
not trusted; without trusted or without toxic texts that rule rejects nothing; other columns pass
through. Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, IS_WORD, LOWER, KeyTable, Rolling, U, Work, mix, slices, text_bytes, trim, work_dir
from .suffix_dedup import load, write_batches

MIN_DOCS = 20
#: the kind of all languages that have too few labelled texts
POOLED = "\0all"
#: quantiles of trusted texts that a limit may be (the lower limit: from the other end), and the cost of a trusted text
LEVELS, COST = (0.98, 0.99, 0.995, 0.998, 0.999, 1.0), 2.0
#: ratios that the contrast is the mean of
TOP = 3
BEGIN, END = U(0x5BD1E9955BD1E995), U(0xC2B2AE3D27D4EB4F)
#: requests are numbered in order, those for other keys than single tokens from here on
OTHERS = 1 << 40
#: shards of the table, keys to a request, words of the filter, bytes of text taken at once
SHARDS, PART, BLOOM_WORDS, PIECE = 64, 256, 1 << 21, 1 << 20
BLOOM_SHIFT = U(64 - 21)
#: tokens that a task counts before it sends them; parts that documents are scored in, one after the other, and documents that make one
HELD, CHUNKS, CHUNK = 1 << 20, 8, 20000
#: parts of the shards that are counted one after the other, and texts that make one
PARTS, FEW = 4, 4000
#: batches that a copy of the table answers
SERVED = 256
KIND = np.where(IS_SPACE, 0, np.where(IS_WORD, 1, 2)).astype(np.uint8)


def seed(name: str) -> int:
    h = 0xCBF29CE484222325
    for b in name.encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in order; by sorting, as np.unique's hashing is slower on long arrays."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def second(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Keys of two tokens."""
    return mix(one * U(0x9E3779B97F4A7C15) + two)


def third(context: np.ndarray, three: np.ndarray) -> np.ndarray:
    """Keys of three tokens; they begin as their context's, so both are in one shard."""
    return mix(context * U(0x9E3779B97F4A7C15) + three * U(0xD1B54A32D192ED03)) >> U(6) | context & (U(63) << U(58))


class Grams:
    """The n-grams that end at each token of a slice of texts, as keys; ``rows`` are the tokens' texts.

    ``words`` are the distinct (token, seed) keys, of one token, in order; ``word`` is the place of each token's there.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, seeds: np.ndarray):
        low = LOWER[data]
        kind = KIND[low]
        change = np.ones(len(low), bool)
        change[1:] = kind[1:] != kind[:-1]
        cuts = bounds[1:-1]
        change[cuts[cuts < len(low)]] = True
        edges = np.flatnonzero(change)
        text = kind[edges] > 0
        starts, ends = edges[text], np.append(edges[1:], len(low))[text]
        rows = np.searchsorted(bounds, starts, "right") - 1
        n = np.bincount(rows, minlength=len(bounds) - 1)
        has = (n > 0).astype(np.int64)
        self.n, size = n, n + has
        first = np.cumsum(size) - size
        self.rows = np.repeat(np.arange(len(n)), size)
        token = np.full(len(self.rows), END)
        token[np.arange(len(starts)) + (np.cumsum(has) - has)[rows]] = Rolling(low)(starts, ends)
        self.seeds = seeds[self.rows]
        #: whether a token is the first of its text, and those that are not
        self.first = np.arange(len(token)) == first[self.rows]
        self.late = np.flatnonzero(~self.first)
        one = mix(token ^ self.seeds)
        self.words, self.word = np.unique(one, return_inverse=True)
        self.one = one
        begin = mix(BEGIN ^ self.seeds)
        self.before = np.where(self.first, begin, np.append(U(0), one[:-1]) if len(one) else begin)
        self.two = second(self.before, one)
        #: of three tokens, at the tokens in ``late``
        self.three = third(self.two[self.late - 1], one[self.late])
        #: keys by seed: the empty context, and the begin token
        self.kinds, self.kind = np.unique(seeds, return_inverse=True)

    def scored(self) -> Grams:
        """What scoring does not need is dropped: a batch is held whole."""
        del self.one, self.before, self.seeds
        self.rows, self.word = self.rows.astype(np.int32), self.word.astype(np.int32)
        return self

    def asked(self, bloom) -> tuple[np.ndarray, np.ndarray]:
        """Every key that scoring may look up and that the filter does not rule out: of single tokens, and of others."""
        kinds = ((self.words, mix(self.kinds), mix(BEGIN ^ self.kinds)), (self.two, self.three))
        return tuple(distinct(np.concatenate([k[bloom.may_have(k)] for k in some])) for some in kinds)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, like bytes together, compressed."""
    head = np.array([x for a in arrays for x in (a.itemsize, len(a))], "<i8").tobytes()
    body = head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    out, at = [], 16 * n
    for size, length in np.frombuffer(body, "<i8", 2 * n).reshape(-1, 2).tolist():
        raw = np.frombuffer(body, np.uint8, size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(raw.T).view(f"<u{size}").ravel())
        at += size * length
    return out


def steps_of(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys.dtype.type(0))


def pack_words(words: list[np.ndarray], *more: np.ndarray) -> bytes:
    """Rows of word keys, the first of them in order, as places in a list of their own, and columns ``more``."""
    known, at = np.unique(np.concatenate(words), return_inverse=True)
    at = at.astype(np.uint32).reshape(len(words), -1)
    order = np.lexsort(at[::-1])
    return pack(steps_of(known), steps_of(at[0][order]), *(x[order] for x in at[1:]), *(x[order] for x in more))


def unpack_words(blob: bytes, words: int, more: int) -> list[np.ndarray]:
    known, first, *rest = unpack(blob, 1 + words + more)
    known = np.cumsum(known, dtype=U)
    return [known[x] for x in (np.cumsum(first, dtype=np.uint32), *rest[: words - 1])] + rest[words - 1 :]


def by_shard(batches, column="shard"):
    """(shard, rows) of batches that come in order of shards."""
    now, held = None, []
    for batch in batches:
        shard = np.asarray(batch[column])
        edges = np.flatnonzero(shard[1:] != shard[:-1]) + 1
        for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)], strict=True):
            if x == y:
                continue
            if now is not None and shard[x] != now:
                yield int(now), pa.Table.from_batches(held)
                held = []
            now = shard[x]
            held.append(batch.slice(x, y - x))
    if now is not None:
        yield int(now), pa.Table.from_batches(held)


def sharded(keys: np.ndarray):
    """(shard, first, end) of keys in order."""
    cuts = np.append(np.searchsorted(keys, np.arange(SHARDS, dtype=U) << U(58)), len(keys)).tolist()
    return ((i, x, y) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y)


def save(folder: str, name: str, blob: bytes) -> str:
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    path = f"{path}/{name}-{TaskContext.get().taskAttemptId()}"
    with files.open_output_stream(path) as out:
        out.write(blob)
    return path


def saved(folder: str, path: str, n: int) -> list[np.ndarray]:
    with fs.FileSystem.from_uri(folder)[0].open_input_file(path) as f:
        return unpack(f.read(), n)


def kinds_of(c: np.ndarray, s: np.ndarray, seeds: int) -> bytes:
    """How many n-grams of each seed have a count of 1, 2, 3, 4."""
    return b"".join(np.bincount(s[c == i], minlength=seeds).astype("<i8").tobytes() for i in (1, 2, 3, 4))


def trigrams(texts: DataFrame, seeds: np.ndarray, last: bool, part: int, parts: int) -> DataFrame:
    """From (seed, text): (shard, blob) of trigrams by their first two words or, ``last``, by their last two, and then of first tokens as such without a first word; of the shards of one part."""

    def run(batches):
        held, size = [], 0

        def flush():
            key, w1, w2, w3, s = (np.concatenate(x) for x in zip(*held, strict=True))
            key, at, c = np.unique(key, return_index=True, return_counts=True)
            w1, w2, w3, s, c = w1[at], w2[at], w3[at], s[at], c.astype(np.uint32)
            if last:  # before these bigrams stand different tokens, however often
                c[w1 != 0] = 1
            for i, x, y in sharded(key):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([i], pa.int32()), "blob": pa.array([pack_words([w2[x:y], w1[x:y], w3[x:y]], c[x:y], s[x:y])], pa.binary())})

        for batch in batches:
            data, bounds = text_bytes(batch["text"])
            own = np.asarray(batch["seed"]).view(U)
            for a, b in slices(bounds, PIECE):
                g = Grams(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], own[a:b])
                late = g.late
                w1, w2, w3, s = g.before[late - 1], g.one[late - 1], g.one[late], g.seeds[late]
                key = third(g.two[late], w1) if last else g.three
                if last:
                    first = np.flatnonzero(g.first)
                    none = np.zeros(len(first), U)
                    w1, w2, w3, s = np.append(none, w1), np.append(g.before[first], w2), np.append(g.one[first], w3), np.append(g.seeds[first], s)
                    key = np.append(third(g.two[first], none), key)
                own_part = np.flatnonzero((key >> U(58)) % U(parts) == U(part))
                held.append((key[own_part], w1[own_part], w2[own_part], w3[own_part], np.searchsorted(seeds, s[own_part]).astype(np.uint16)))
                size += len(own_part)
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
            trim()
        if held:
            yield from flush()

    return texts.mapInArrow(run, "shard int, blob binary")


def counted(rows: list[list[np.ndarray]], keys) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, their summed counts (the last column but one), and the other columns."""
    *words, c, s = (np.concatenate(x) for x in zip(*rows, strict=True))
    key = keys(*words)
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    at = order[start]
    return key[start], np.add.reduceat(c[order].astype(np.int64), start), [x[at] for x in (*words, s)]


def context_sums(at: np.ndarray, n: int, c: np.ndarray) -> list[np.ndarray]:
    """Of each context: the sum of counts, and how many are 1, 2 and more."""
    total = np.zeros(n, np.int64)
    np.add.at(total, at, c)
    return [total, *(np.bincount(at[x], minlength=n) for x in (c == 1, c == 2, c > 2))]


def count_trusted(texts: DataFrame, seeds: np.ndarray, folder: str, work: Work) -> tuple[dict[int, dict[int, str]], dict[int, np.ndarray], DataFrame]:
    """Files of bigrams and trigrams by order and shard, counts of counts by order and seed, and (k, s, total, m1, m2, m3, c) of single tokens: of what they are the context of, and after how many they stand."""
    spark, m = texts.sparkSession, len(seeds)
    note = lambda i, path, stats: {"shard": pa.array([i], pa.int32()), "path": pa.array([path]), "blob": pa.array([stats], pa.binary())}

    def three(batches):
        for i, part in by_shard(batches):
            rows = [unpack_words(x, 3, 2) for x in part["blob"].to_pylist()]
            key, c, (w2, w1, w3, s) = counted(rows, lambda w2, w1, w3: third(second(w1, w2), w3))
            del rows
            contexts, first, at = np.unique(second(w1, w2), return_index=True, return_inverse=True)
            sums = context_sums(at, len(contexts), c)
            narrow = lambda x: x.astype(np.uint32)
            path = save(folder, f"3-{i}", pack(steps_of(key), narrow(c), narrow(sums[0][at]), s, steps_of(contexts), *map(narrow, sums), s[first]))
            yield pa.RecordBatch.from_pydict(note(i, path, kinds_of(c, s, m)))
            trim()

    def two(batches):
        names = ("k", "s", "total", "m1", "m2", "m3", "c")
        for i, part in by_shard(batches):
            rows = [unpack_words(x, 3, 2) for x in part["blob"].to_pylist()]
            _, c, (w2, w1, w3, s) = counted(rows, lambda w2, w1, w3: third(second(w2, w3), w1))
            del rows
            # a bigram counts the tokens before it, or its occurrences where none can stand there
            key, c, (w2, w3, s) = counted([[w2, w3, np.where(w1 != 0, 1, c), s]], second)
            path = save(folder, f"2-{i}", pack(steps_of(key), c.astype(np.uint32), s))
            words, at = np.unique(np.append(w2, w3), return_inverse=True)
            own = np.zeros(len(words), np.int64)
            own[at] = np.append(s, s)
            columns = [words.view(np.int64), own, *context_sums(at[: len(key)], len(words), c), np.bincount(at[len(key) :], minlength=len(words))]
            yield pa.RecordBatch.from_pydict(note(i, path, kinds_of(c, s, m)) | {x: pa.array([None], pa.int64()) for x in names})
            for x in range(0, len(words), 50000):
                some = [pa.array(v[x : x + 50000].astype(np.int64)) for v in columns]
                yield pa.RecordBatch.from_pydict({"shard": pa.nulls(len(some[0]), pa.int32()), "path": pa.nulls(len(some[0]), pa.string()), "blob": pa.nulls(len(some[0]), pa.binary())} | dict(zip(names, some, strict=True)))
            trim()

    schema, more = "shard int, path string, blob binary", "k long, s long, total long, m1 long, m2 long, m3 long, c long"
    files, stats, tokens = {2: {}, 3: {}}, {n: np.zeros((4, m), np.int64) for n in (2, 3)}, []
    # only one part's trigrams are on their way at a time
    parts = min(PARTS, texts.count() // FEW + 1)
    for n, last, reduced in ((3, False, three), (2, True, two)):
        for i in range(parts):
            dealt = trigrams(texts, seeds, last, i, parts).repartition(SHARDS // parts, "shard").sortWithinPartitions("shard")
            done = work(dealt.mapInArrow(reduced, f"{schema}, {more}" if last else schema))
            found = done.where("path is not null").select("shard", "path", "blob").collect()
            files[n] |= {r["shard"]: r["path"] for r in found}
            stats[n] = sum((np.frombuffer(r["blob"], "<i8").reshape(4, m) for r in found), stats[n])
            work.free()
            if last:
                tokens.append(done)
    second_ = reduce(DataFrame.unionAll, tokens)
    words = work(second_.where("k is not null").groupBy("k", "s").agg(*(F.sum(x).alias(x) for x in ("total", "m1", "m2", "m3", "c"))))
    work.drop(*tokens)
    return files, stats, words


def count_words(texts: DataFrame, seeds: np.ndarray) -> DataFrame:
    """From (seed, text): (k, s, c) of every token, counted as it occurs."""

    def run(batches):
        for batch in batches:
            data, bounds = text_bytes(batch["text"])
            own = np.asarray(batch["seed"]).view(U)
            for a, b in slices(bounds, PIECE):
                g = Grams(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], own[a:b])
                of = np.zeros(len(g.words), np.int64)
                of[g.word] = np.searchsorted(seeds, g.seeds)
                yield pa.RecordBatch.from_arrays([pa.array(g.words.view(np.int64)), pa.array(of), pa.array(np.bincount(g.word, minlength=len(g.words)).astype(np.int64))], ["k", "s", "c"])
            trim()

    return texts.mapInArrow(run, "k long, s long, c long").groupBy("k", "s").agg(F.sum("c").alias("c"))


def lowest(words: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """Of (k, s, c): (k, s, p) of every token, and the probability of an unseen one by seed."""
    spark, c = words.sparkSession, F.col("c")
    of = words.where("c > 0").groupBy("s").agg(F.count("*").alias("words"), F.sum("c").alias("total"), F.sum((c > 2).cast("long")).alias("m3"), *(F.sum((c == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4))).collect()
    steps = []
    for r in of:
        d = discounts(r["n1"], r["n2"], r["n3"], r["n4"])
        steps.append((r["s"], r["total"], *d, (d[0] * r["n1"] + d[1] * r["n2"] + d[2] * r["m3"]) / r["total"] / (r["words"] + 1)))
    step = F.broadcast(spark.createDataFrame(steps, "s long, all long, d1 double, d2 double, d3 double, rest double"))
    less = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
    return words.where("c > 0").join(step, "s").select("k", "s", ((c - less) / F.col("all") + F.col("rest")).alias("p")), {x[0]: x[-1] for x in steps}


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(x, 0.05), top) for x, top in ((1 - 2 * y * n2 / n1, 1.0), (2 - 3 * y * n3 / n2, 2.0), (3 - 4 * y * n4 / n3 if n3 else 0.9, 3.0)))


class Model:
    """The models' files by order and shard, in a shared folder, and discounts by order and seed; small on the driver.

    Files of order 3 have trigrams (key, count, sum of its context, seed) and their contexts (key, sum, how many counts
    are 1, 2, more, seed); of order 2 bigrams (key, count, seed); of order 1 keys and the values of ``single``.
    """

    def __init__(self, folder: str, files: dict[int, dict[int, str]], less: dict[int, np.ndarray]):
        self.folder, self.files, self.less = folder, files, less

    def single(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of single tokens, in order, and of each: probability, weight and sum of counts as a context, contrast; a last row of none."""
        k, *values = saved(self.folder, self.files[1][shard], 5) if shard in self.files[1] else [np.zeros(0, U), *[np.zeros(0, np.uint32)] * 4]
        return np.append(np.cumsum(k, dtype=U), ~U(0)), np.stack([np.append(v.view("<f4"), np.float32(np.nan)) for v in values], 1)

    def others(self, shard: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys, in order, with values: of bigrams the count left after the discount, of trigrams the share left of their context's sum, of contexts the weight."""
        out = []
        if shard in self.files[2]:
            k, c, s = saved(self.folder, self.files[2][shard], 3)
            out.append((k, c - self.less[2][np.minimum(c, 3).astype(np.int64) - 1, s]))
        else:
            out.append((np.zeros(0, U), np.zeros(0)))
        if shard in self.files[3]:
            k, c, of, s, u, total, m1, m2, m3, su = saved(self.folder, self.files[3][shard], 10)
            d = self.less[3]
            out += [(k, (c - d[np.minimum(c, 3).astype(np.int64) - 1, s]) / of), (u, (d[0, su] * m1 + d[1, su] * m2 + d[2, su] * m3) / total)]
        else:
            out += [(np.zeros(0, U), np.zeros(0))] * 2
        return [(np.append(np.cumsum(k, dtype=U), ~U(0)), np.append(v, np.nan).astype("<f4")) for k, v in out]


def model(trusted: DataFrame, toxic: DataFrame, names: list[int], folder: str, work: Work) -> Model:
    """Models of (seed, text) rows, each seed a language of its own; ``names`` are all seeds."""
    spark, seeds = trusted.sparkSession, np.sort(np.array(names, U))
    files, stats, words = count_trusted(trusted, seeds, folder, work)
    less = {n: np.array([discounts(*x) for x in kinds.T.tolist()]).reshape(-1, 3).T for n, kinds in stats.items()}
    good, rare = lowest(words)
    bad, rare_bad = lowest(work(count_words(toxic, seeds)))
    both = [(s, rare[s], rare_bad[s]) for s in rare if s in rare_bad]
    rest = F.broadcast(spark.createDataFrame(both, "s long, g0 double, b0 double"))
    d = F.broadcast(spark.createDataFrame([(i, *x) for i, x in enumerate(less[2].T.tolist())], "s long, d1 double, d2 double, d3 double"))
    weights = words.where("total > 0").join(d, "s").select("k", "s", "total", ((F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total")).alias("weight"))
    rows = good.join(weights, ["k", "s"], "full_outer").join(bad.withColumnRenamed("p", "q"), ["k", "s"], "full_outer").join(rest, "s", "left")
    known = F.col("p").isNotNull() | F.col("q").isNotNull()
    contrast = F.when(known, F.log10(F.coalesce("q", "b0")) - F.log10(F.coalesce("p", "g0")))
    rows = rows.select("k", F.col("p").alias("a"), F.col("weight").alias("b"), F.col("total").cast("double").alias("t"), contrast.alias("c"))
    empty = mix(seeds).view(np.int64).tolist()
    unseen = [(empty[s], p, None, None, math.log10(rare_bad[s] / p) if s in rare_bad else None) for s, p in rare.items()]
    rows = rows.unionByName(spark.createDataFrame(unseen, "k long, a double, b double, t double, c double"))

    def run(batches):
        for i, part in by_shard(batches):
            k = np.asarray(part["k"]).view(U)
            order = np.argsort(k)
            values = [part[x].combine_chunks().fill_null(float("nan")).to_numpy(zero_copy_only=False)[order].astype("<f4").view("<u4") for x in "abtc"]
            path = save(folder, f"1-{i}", pack(steps_of(k[order]), *values))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([i], pa.int32()), "path": pa.array([path])})

    rows = rows.withColumn("shard", F.shiftrightunsigned("k", 58).cast("int")).repartition(SHARDS, "shard").sortWithinPartitions("shard")
    files[1] = {r["shard"]: r["path"] for r in work(rows.mapInArrow(run, "shard int, path string")).collect()}
    return Model(folder, files, less)


def planes(rows: np.ndarray) -> bytes:
    """Rows of eight bytes, the first bytes of all rows first and so on: like bytes together, which shuffles compress."""
    return rows.view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T)


def pack_floats(rows: np.ndarray) -> bytes:
    """Rows of float32 by column, like bytes together, which shuffles compress."""
    return np.ascontiguousarray(rows.T).view(np.uint8).reshape(rows.shape[1], -1, 4).transpose(0, 2, 1).tobytes()


def floats(blob: bytes, columns: int) -> np.ndarray:
    """The rows of ``pack_floats``, one after the other."""
    raw = np.frombuffer(blob, np.uint8).reshape(columns, 4, -1).transpose(0, 2, 1)
    return np.ascontiguousarray(raw).view("<f4").reshape(columns, -1).T.ravel()


class Bloom:
    """A blocked Bloom filter of fixed size: three bits in one 64-bit word a key."""

    def __init__(self, spark: SparkSession, model: Model):
        size = BLOOM_WORDS // SHARDS

        def run(batches):
            for batch in batches:
                for i in batch["id"].to_pylist():
                    words = np.zeros(size, U)
                    for keys, _ in (model.single(i), *model.others(i)):
                        keys = keys[:-1]
                        bits = U(0)
                        for x in (20, 26, 32):
                            bits = bits | U(1) << (keys >> U(x) & U(63))
                        np.bitwise_or.at(words, (keys >> BLOOM_SHIFT).astype(np.int64) - i * size, bits)
                    trim()
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([i], pa.int64()), "words": pa.array([words.tobytes()], pa.binary())})

        found = spark.range(0, SHARDS, 1, SHARDS // 4).mapInArrow(run, "shard long, words binary").collect()
        self.words = np.frombuffer(b"".join(r["words"] for r in sorted(found, key=lambda r: r["shard"])), U)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        want = U(0)
        for x in (20, 26, 32):
            want = want | U(1) << (keys >> U(x) & U(63))
        return self.words[(keys >> BLOOM_SHIFT).astype(np.int64)] & want == want


class Judge:
    """The languages that have models and limits of their own, and limits by language (``POOLED`` for all others)."""

    def __init__(self, own: set[str], limits: dict[str, tuple[float, float, float]]):
        self.own, self.limits = own, limits

    def kind(self, lang: str | None) -> str:
        return lang if lang in self.own else POOLED

    def seeds(self, langs: list[str]) -> np.ndarray:
        kinds = {x: seed(self.kind(x)) for x in set(langs)}
        return np.array([kinds[x] for x in langs], U)

    def kept(self, langs: list[str], perplexity: np.ndarray, contrast: np.ndarray, n: np.ndarray) -> np.ndarray:
        low, high, most = np.array([self.limits.get(self.kind(x), (-math.inf, math.inf, math.inf)) for x in langs]).reshape(-1, 3).T
        return (n == 0) | (perplexity >= low) & (perplexity <= high) & (contrast <= most)


def batch_grams(table: pa.Table, judge: Judge):
    """(first row, end, n-grams) of the slices of a batch file."""
    data, bounds = text_bytes(table["text"])
    seeds = judge.seeds(table["_lang"].to_pylist())
    for a, b in slices(bounds, PIECE):
        yield a, b, Grams(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], seeds[a:b])


def batch_keys(grams, bloom: Bloom) -> list[np.ndarray]:
    """What a batch asks for, in order: single tokens, and others."""
    found = list(zip(*(g.asked(bloom) for _, _, g in grams), strict=True)) or [[], []]
    return [distinct(np.concatenate([np.zeros(0, U), *some])) for some in found]


def batch_scores(m: int, grams: list, bloom: Bloom, keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, log10 perplexity a token, and contrast of each text of a batch, from the answers to its keys."""
    known = [KeyTable(k) for k in keys]
    none = [len(k) for k in keys]
    # one row more, for keys without an answer
    (a1, b1, t1, c1), (a, b) = ([np.append(column, np.nan).astype(np.float64) for column in v.T] for v in values)
    # unseen contexts leave all to the shorter n-gram
    b1, b, a, t1 = np.nan_to_num(b1, nan=1.0), np.nan_to_num(b, nan=1.0), np.nan_to_num(a), np.nan_to_num(t1, nan=np.inf)

    def place(which, asked):
        """Rows of the answers to keys."""
        out = np.full(len(asked), none[which])
        may = np.flatnonzero(bloom.may_have(asked))
        at = known[which].find(asked[may])
        out[may] = np.where(at >= 0, at, none[which])
        return out

    n, perplexity, contrast = np.zeros(m, np.int64), np.zeros(m), np.full(m, -99.0)
    for x, y, g in grams:
        if not len(g.rows):
            continue
        kind = g.kind[g.rows]
        word, empty = place(0, g.words), place(0, mix(g.kinds))
        at = word[g.word]
        p = np.where(np.isnan(a1[at]), a1[empty][kind], a1[at])
        before = np.append(0, at[:-1])
        before[g.first] = place(0, mix(BEGIN ^ g.kinds))[kind[g.first]]
        two = place(1, g.two)
        p = a[two] / t1[before] + b1[before] * p
        p[g.late] = a[place(1, g.three)] + b[two[g.late - 1]] * p[g.late]
        p = np.log10(p)
        size = np.bincount(g.rows, minlength=y - x)
        n[x:y] = g.n
        perplexity[x:y] = -np.bincount(g.rows, np.nan_to_num(p), y - x) / np.maximum(1, size)
        r = np.nan_to_num(np.where(np.isnan(c1[at]), c1[empty][kind], c1[at]), nan=-99.0)
        # the largest of each text, one after the other
        starts = (np.cumsum(size) - size)[size > 0]
        total = np.zeros(len(starts))
        for _ in range(TOP):
            best = np.maximum.reduceat(r, starts)
            total += np.where(np.isinf(best), 0, best)
            hit = np.flatnonzero(r == np.repeat(best, size[size > 0]))
            r[hit[np.unique(g.rows[hit], return_index=True)[1]]] = -np.inf
        contrast[x:y][size > 0] = total / np.minimum(size[size > 0], TOP)
    contrast[n == 0] = -99
    return n, perplexity, contrast


def with_scores(docs: DataFrame, model: Model, judge: Judge, columns: list[str], work: Work) -> DataFrame:
    """``columns`` of ``docs``, and _lang, _h, _n, _p, _c: language, hash, tokens, log10 perplexity a token and contrast; written.

    Every document is in one of up to ``CHUNKS`` parts, by its hash; these follow each other, so that only one's copies and requests are on disk.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Bloom(spark, model))
    chunks = min(CHUNKS, docs.count() // CHUNK + 1)
    rows = keyed(docs).select(*dict.fromkeys([*columns, "text"]), "_lang", "_h")
    path = work_dir(spark, "quality-scores")
    for i in range(chunks):
        steps = Work(spark, "quality")
        some = rows.where(F.pmod(F.shiftrightunsigned("_h", 20), F.lit(chunks)) == i) if chunks > 1 else rows
        scored = scored_part(some, model, judge, columns, shared, steps)
        scored.write.mode("append").option("compression", "zstd").parquet(path)
        steps.clear()
        work.free()
    out = spark.read.schema(scored.schema).parquet(path)
    work.paths[id(out)] = path, out
    return out


def scored_part(rows: DataFrame, model: Model, judge: Judge, columns: list[str], shared, work: Work) -> DataFrame:
    spark = rows.sparkSession
    folder = work_dir(spark, "quality")
    manifest = write_batches(rows, folder, "text")
    work.paths[id(manifest)] = folder + "-list", manifest
    work.folders.append(folder)
    n_batches = manifest.count()
    copies = n_batches // SERVED + 1

    def ask(batches):
        for batch in batches:
            for number, path in zip(batch["batch"].to_pylist(), batch["path"].to_pylist(), strict=True):
                keys = batch_keys(batch_grams(load(folder, path), judge), shared.value)
                trim()
                parts = []
                for single, some in enumerate(keys):
                    cuts = np.searchsorted(some, np.arange(SHARDS, dtype=U) << U(58))
                    parts += [(s, single * OTHERS + at, planes(np.diff(some[at : min(at + PART, end)], prepend=U(0)))) for s, (a, end) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), len(some)], strict=True)) for at in range(a, end, PART)]
                for i in range(0, len(parts), 2048):
                    s, at, blob = zip(*parts[i : i + 2048], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(s) + SHARDS * (number % copies), pa.int64()), pa.array(np.full(len(s), number), pa.int64()), pa.array(at, pa.int64()), pa.array(blob, pa.binary())], ["shard", "batch", "at", "blob"])

    def answer(batches):
        now, single, others = None, None, None
        for batch in batches:
            shard, asked = np.asarray(batch["shard"]), np.asarray(batch["at"])
            edges = np.flatnonzero((shard[1:] != shard[:-1]) | ((asked[1:] < OTHERS) != (asked[:-1] < OTHERS))) + 1
            for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)], strict=True):
                if x == y:
                    continue
                if shard[x] != now:
                    now, single, others = shard[x], None, None
                    single, others = model.single(int(now) % SHARDS), model.others(int(now) % SHARDS)
                part, out = batch.slice(x, y - x), []
                want = [np.cumsum(unplaned(blob).view(U).ravel(), dtype=U) for blob in part["blob"].to_pylist()]
                sizes, want = [len(w) for w in want], np.concatenate(want)
                if asked[x] < OTHERS:
                    at = np.searchsorted(single[0], want)
                    found = single[1][at]
                    found[single[0][at] != want] = np.nan
                else:
                    (k2, v2), (k3, v3), (ku, vu) = others
                    at, at3, atu = np.searchsorted(k2, want), np.searchsorted(k3, want), np.searchsorted(ku, want)
                    first = np.where(k2[at] == want, v2[at], np.where(k3[at3] == want, v3[at3], np.float32(np.nan)))
                    found = np.stack([first, np.where(ku[atu] == want, vu[atu], np.float32(np.nan))], 1)
                found = np.ascontiguousarray(found.astype("<f4"))
                ends = np.cumsum(sizes).tolist()
                out = [pack_floats(found[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([part["batch"], part["at"], pa.array(out, pa.binary())], ["batch", "at", "blob"])
            trim()

    schema = rows.select(*columns, "_lang", "_h").withColumns({"_n": F.lit(0).cast("long"), "_p": F.lit(0.0), "_c": F.lit(0.0)}).schema

    def score(batches):
        number, path, held = None, None, []

        def done():
            table = load(folder, path)
            grams = [(a, b, g.scored()) for a, b, g in batch_grams(table, judge)]
            keys = batch_keys(grams, shared.value)
            flat, cut = np.concatenate([np.zeros(0, "<f4"), *held]), 4 * len(keys[0])
            found = batch_scores(table.num_rows, grams, shared.value, keys, [flat[:cut].reshape(-1, 4), flat[cut:].reshape(-1, 2)])
            held.clear()
            trim()
            table = table.select([*columns, "_lang", "_h"])
            for name, c in zip(("_n", "_p", "_c"), found, strict=True):
                table = table.append_column(name, pa.array(c))
            return table.combine_chunks().to_batches(max_chunksize=2000)

        for batch in batches:
            for n, p, at, blob in zip(batch["batch"].to_pylist(), batch["path"].to_pylist(), batch["at"].to_pylist(), batch["blob"].to_pylist(), strict=True):
                if n != number:
                    if number is not None:
                        yield from done()
                    number, path, held = n, p, []
                else:
                    held.append(floats(blob, 4 if at < OTHERS else 2))
        if number is not None:
            yield from done()

    parts = max(1, n_batches)
    asked = manifest.repartition(parts, "batch").mapInArrow(ask, "shard long, batch long, at long, blob binary")
    answers = asked.repartition(SHARDS * copies, "shard").sortWithinPartitions("shard", "at").mapInArrow(answer, "batch long, at long, blob binary")
    rows = manifest.unionByName(answers, allowMissingColumns=True).repartition(parts, "batch").sortWithinPartitions("batch", F.col("path").desc_nulls_last(), "at")
    return rows.select("batch", "path", "at", "blob").mapInArrow(score, schema)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_lang``, and ``_h``, the hash that stands for language and text."""
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("")), F.col("text").cast("string")
    return docs.withColumns({"_lang": lang, "_h": F.xxhash64(lang, text)})


def known_texts(docs: DataFrame, labels: DataFrame, work: Work) -> DataFrame:
    """(lang, h, quality, toxic) of every distinct labelled text; labels that differ make it low or toxic."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    keys = keyed(docs).where("length(text) > 0").select(F.col("doc_id").cast("long").alias("_id"), F.col("_lang").alias("lang"), F.col("_h").alias("h"))
    return work(keys.join(marks, "_id").groupBy("lang", "h").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")))


def limits(scored: DataFrame, known: DataFrame, used: DataFrame, own_langs: set[str], work: Work) -> dict[str, tuple[float, float, float]]:
    """Limits by kind, from every distinct labelled text that is in no model; the lower limit from the fitted ones too, which lie lower.

    Of each limit's ``LEVELS`` of the trusted texts, the one that rejects most of the low and toxic texts,
    a share of the trusted texts rejected counting ``COST`` times a share of the others.
    """
    texts = scored.where("_n > 0").groupBy(F.col("_h").alias("h")).agg(F.first("_p").alias("p"), F.first("_c").alias("c"))
    fits = used.withColumn("fit", F.lit(True))
    rows = known.where("quality is not null and toxic is not null").join(fits, "h", "left").join(texts, "h").withColumn("held", F.col("fit").isNull())
    good = F.expr("quality = 1 and toxic = 0")
    own = rows.where(F.col("lang").isin(list(own_langs))).select(F.col("lang").alias("kind"), "p", "c", "held", good.alias("good"))
    rows = work(own.unionByName(rows.select(F.lit(POOLED).alias("kind"), "p", "c", "held", good.alias("good"))))
    # rank errors of the sketch are under a millionth
    levels, lows = list(LEVELS), [1 - x for x in LEVELS]
    cut = lambda c, at: F.percentile_approx(c, at, 1_000_000)
    held = lambda c: F.when(F.col("held"), F.col(c))
    cuts = {r["kind"]: (r["low"], r["high"], r["most"]) for r in rows.where("good").groupBy("kind").agg(cut(F.col("p"), lows).alias("low"), cut(held("p"), levels).alias("high"), cut(held("c"), levels).alias("most")).collect()}
    out = {}
    for kind, found in cuts.items():
        if None in found:
            continue
        beyond = [F.col("p") < x for x in found[0]] + [held("p") > x for x in found[1]] + [held("c") > x for x in found[2]]
        share = lambda x, of: F.coalesce(F.avg(F.when(F.col("good") == of, x.cast("double"))), F.lit(0.0))
        gain = rows.where(F.col("kind") == kind).agg(*(share(x, False) - COST * share(x, True) for x in beyond)).first()
        n = len(LEVELS)
        # of equal gains the widest limit
        out[kind] = tuple(found[i][max(range(n), key=lambda k: (gain[i * n + k], k))] for i in range(3))
    return out


def among(rows: DataFrame, some: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``h`` is not in ``some``: a filter of fixed size, two bits in one 64-bit word an ``h``."""
    size = 1 << 19
    bit = "shiftleft(1L, cast(shiftrightunsigned(h, {}) & 63 as int))"
    found = some.groupBy(F.col("h").bitwiseAND(F.lit(size - 1)).alias("w")).agg(F.bit_or(F.expr(" | ".join(bit.format(x) for x in (20, 26)))).alias("bits")).toArrow()
    words = np.zeros(size, U)
    words[np.asarray(found["w"])] = np.asarray(found["bits"]).view(U)
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for batch in batches:
            h = np.asarray(batch["h"]).view(U)
            want = U(1) << (h >> U(20) & U(63)) | U(1) << (h >> U(26) & U(63))
            yield batch.filter(pa.array(shared.value[(h & U(size - 1)).astype(np.int64)] & want == want))

    return rows.mapInArrow(run, rows.schema)


def fitted(docs: DataFrame, known: DataFrame, work: Work) -> tuple[Model, Judge, DataFrame]:
    """The models, a judge without limits, and the hashes of the texts in the models."""
    spark = docs.sparkSession
    known = known.withColumn("held", F.pmod("h", F.lit(4)) == 0).withColumn("kind", F.when(F.expr("quality = 1 and toxic = 0"), "trusted").when(F.expr("toxic = 1"), "toxic"))
    counts = {(r["kind"], r["held"], r["lang"]): r["n"] for r in known.where("kind is not null").groupBy("kind", "held", "lang").agg(F.count("*").alias("n")).collect()}
    langs = {x for _, _, x in counts}
    own = {x for x in langs if counts.get(("trusted", True, x), 0) >= MIN_DOCS and counts.get(("toxic", False, x), 0) >= MIN_DOCS}
    used = work(known.where("not held and kind is not null").select("kind", "h"))
    # by text again, each once; a filter keeps most other texts from being shuffled
    texts = keyed(docs).select(F.col("_lang").alias("lang"), F.col("text").cast("string").alias("text"), F.col("_h").alias("h"))
    texts = among(texts, used).join(used, "h").dropDuplicates(["h"])
    seeds = F.broadcast(spark.createDataFrame([(x, signed(seed(x))) for x in own], "lang string, seed long"))
    each = texts.join(seeds, "lang").select("kind", "seed", "text")
    # the pooled models are fitted if some document needs them
    if not keyed(docs).where(~F.col("_lang").isin(list(own))).isEmpty():
        each = each.unionByName(texts.select("kind", F.lit(signed(seed(POOLED))).alias("seed"), "text"))
    each = work(each)
    steps, folder = Work(spark, "quality"), work_dir(spark, "quality-model")
    work.folders.append(folder)
    names = [seed(x) for x in (*own, POOLED)]
    table = model(*(each.where(F.col("kind") == k).select("seed", "text") for k in ("trusted", "toxic")), names, folder, steps)
    steps.clear()
    work.drop(each)
    work.free()
    return table, Judge(own, {}), used.select("h")


def trained(docs: DataFrame, labels: DataFrame, columns: list[str]) -> tuple[Model, Judge, DataFrame, Work]:
    """The classifier of a corpus and its labels, as models and judge, and ``columns`` of the documents with their scores."""
    work = Work(docs.sparkSession, "quality")
    known = known_texts(docs, labels, work)
    table, judge, used = fitted(docs, known, work)
    scored = with_scores(docs, table, judge, columns, work)
    judge.limits = limits(scored, known, used, judge.own, work)
    return table, judge, scored, work


def judged(scored: DataFrame, judge: Judge) -> DataFrame:
    """``scored`` with ``_kept``."""

    def run(batches):
        for batch in batches:
            n, p, c = (np.asarray(batch[x]) for x in ("_n", "_p", "_c"))
            kept = judge.kept(batch["_lang"].to_pylist(), p, c, n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept)], [*batch.schema.names, "_kept"])

    return scored.mapInArrow(run, scored.withColumn("_kept", F.lit(True)).schema)


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("_n").alias("n_tokens"), F.pow(F.lit(10.0), "_p").alias("perplexity"), F.when(F.col("_n") > 0, F.col("_c")).otherwise(0.0).alias("contrast"), F.col("_kept").alias("kept"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, perplexity a token, contrast, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    _, judge, scored, work = trained(docs, labels, ["doc_id"])
    work.clear(scored)
    return _named(judged(scored, judge))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all columns, without the documents that the classifier rejects."""
    _, judge, scored, work = trained(docs, labels, docs.columns)
    work.clear(scored)
    return judged(scored, judge).where("_kept").select(*docs.columns)


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the classifier, fitted to the labelled documents, over all documents."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
