"""The inverted index: postings by term, and field-weighted BM25 over them.

``build`` writes three tables: ``postings`` (bucket, term, key, spec, positions in title and body,
length), one row a term and document, partitioned by the hash of the term and sorted by term;
``terms`` (bucket, term, df); and ``stats`` (number of documents, mean length), one row. A
search reads the partitions and row groups of its own terms, not the documents.
"""

from __future__ import annotations

from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K1, B, TITLE_WEIGHT = 1.2, 0.75, 10.0
BUCKETS = 32
POSTING = "term string, key {key}, spec string, len int, title_at array<int>, body_at array<int>, bucket int"


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(rows: DataFrame, match: Column | None = None) -> DataFrame:
    """Postings of (key, spec, title tokens, body tokens), of the terms that ``match``."""
    each = lambda name, field: F.transform(name, lambda t, i: F.struct(t.alias("term"), F.lit(field).alias("field"), (i + 1).alias("at")))
    words = rows.withColumn("len", F.size("title") + F.size("body")).select("key", "spec", "len", F.explode(F.concat(each("title", 0), each("body", 1))).alias("w")).select("key", "spec", "len", "w.*").where(F.lit(True) if match is None else match)
    places = lambda field: F.sort_array(F.collect_list(F.when(F.col("field") == field, F.col("at"))))
    return words.groupBy("term", "key").agg(F.first("spec").alias("spec"), F.first("len").alias("len"), places(0).alias("title_at"), places(1).alias("body_at")).withColumn("bucket", bucket(F.col("term")))


def of_query(terms: list[str], phrases: list[list[str]] = (), without: list[str] = ()) -> Column:
    """Rows of the terms that a search asks for."""
    asked = [*terms, *(w for p in phrases for w in p), *without]
    begins = [F.col("term").startswith(w[:-1]) for w in asked if w.endswith("*")]
    return reduce(lambda a, b: a | b, begins, F.col("term").isin([w for w in asked if not w.endswith("*")]))


def of_terms(terms: list[str]) -> Column:
    """Rows of these terms, by partition and by row group."""
    seen = sorted({xxhash.xxh64_intdigest(t.encode(), 42) for t in terms})
    return F.col("bucket").isin(sorted({(h - (1 << 64) if h >> 63 else h) % BUCKETS for h in seen})) & F.col("term").isin(sorted(set(terms)))


class Index:
    """Where an index lies, and how to search and update it.

    An update writes a new generation beside the older ones: postings of new and changed documents, the keys
    whose older postings no longer count, and the changes to the counts.
    """

    def __init__(self, spark: SparkSession, path: str, generation: int = 0):
        self.spark, self.path, self.generation, self._key = spark, path, generation, None

    @classmethod
    def build(cls, rows: DataFrame, path: str, match: Column | None = None) -> Index:
        """Index (key, spec, title tokens, body tokens); only for searches of terms that ``match``, if given."""
        out = cls(rows.sparkSession, path)
        out._key = dict(rows.dtypes)["key"]
        out._write(rows, None, match)
        return out

    def _write(self, rows: DataFrame, old: DataFrame | None, match: Column | None = None) -> None:
        """The tables of this generation; ``old`` are postings that it takes the place of."""
        at = f"gen={self.generation}"
        postings(rows, match).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term", "key").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/postings/{at}")
        new = self._read(f"{self.path}/postings/{at}", POSTING)
        count = lambda x, sign: x.groupBy("bucket", "term").agg((F.count("*") * sign).alias("df"), (F.sum(F.size("body_at")) * sign).alias("tf"))
        changes = count(new, 1) if old is None else count(new, 1).unionByName(count(old, -1)).groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
        changes.sortWithinPartitions("bucket", "term").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/terms/{at}")
        size = F.size("title") + F.size("body")
        total = rows.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_len"))
        if old is not None:
            gone = old.select("key", "len").distinct().agg((-F.count("*")).alias("n_docs"), (-F.coalesce(F.sum("len"), F.lit(0))).cast("long").alias("total_len"))
            total = total.unionByName(gone)
        total.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/{at}")

    def _read(self, path: str, columns: str | None) -> DataFrame:
        """A table of one generation; the key's type is that of the first generation, as a later one may be empty."""
        if columns is None:
            return self.spark.read.parquet(path)
        if self._key is None:
            self._key = dict(self.spark.read.parquet(f"{self.path}/postings/gen=0").dtypes)["key"]
        return self.spark.read.schema(columns.format(key=self._key)).parquet(path)

    def update(self, rows: DataFrame, deleted: DataFrame | None = None) -> Index:
        """The index after new and changed documents (as for ``build``) and ``deleted`` keys; this one stays as it is. A document without any token counts from its next change on."""
        out = Index(self.spark, self.path, self.generation + 1)
        gone = rows.select("key") if deleted is None else rows.select("key").unionByName(deleted.select("key"))
        gone.distinct().write.mode("overwrite").parquet(f"{self.path}/gone/gen={out.generation}")
        keys = self.spark.read.parquet(f"{self.path}/gone/gen={out.generation}")
        out._write(rows, self.live().join(keys, "key", "left_semi"))
        return out

    def table(self, name: str) -> DataFrame:
        """A table's rows up to this generation; counts are summed over them."""
        parts = [self._read(f"{self.path}/{name}/gen={g}", POSTING if name == "postings" else None).withColumn("gen", F.lit(g)) for g in range(self.generation + 1)]
        rows = reduce(DataFrame.unionByName, parts)
        if name == "terms" and self.generation:
            return rows.groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where("df > 0")
        if name == "stats":
            return rows.agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len")).withColumn("avg_len", F.col("total_len") / F.col("n_docs"))
        return rows.drop("gen") if name == "terms" else rows

    def live(self, match: Column | None = None) -> DataFrame:
        """The postings that count, of those that ``match``."""
        rows = self.table("postings")
        rows = rows if match is None else rows.where(match)
        if self.generation == 0:
            return rows
        gone = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/gone/gen={g}").withColumn("gen", F.lit(g)) for g in range(1, self.generation + 1)])
        last = gone.groupBy("key").agg(F.max("gen").alias("last"))
        return rows.join(last, "key", "left").where("last is null or gen >= last").drop("last")

    def search(self, terms: list[str], phrases: list[list[str]] = (), without: list[str] = (), spec: str | None = None, any_terms: bool = False) -> DataFrame:
        """(key, spec, score), higher is better, of the documents that hold all terms and phrases and none of ``without``.

        A term with a trailing ``*`` stands for all terms that begin so. Counts of documents are those of the whole
        index, whatever ``spec`` filters. ``any_terms``: one of the terms is enough.
        """
        units = [[t] for t in dict.fromkeys(terms)] + [list(p) for p in phrases]
        plain = [w for u in units for w in u if not w.endswith("*")] + [w for w in without if not w.endswith("*")]
        begins = [w[:-1] for u in units for w in u if w.endswith("*")] + [w[:-1] for w in without if w.endswith("*")]
        if begins:
            match = reduce(lambda a, b: a | b, [F.col("term").startswith(b) for b in begins] + [F.col("term").isin(plain)])
            rows = self.live(match)
        else:
            rows = self.live(of_terms(plain))
        is_ = lambda w: F.col("term").startswith(w[:-1]) if w.endswith("*") else F.col("term") == w
        names, parts = [], []
        for i, unit in enumerate(units):
            for f in ("title_at", "body_at"):
                if len(unit) == 1:
                    parts.append(F.sum(F.when(is_(unit[0]), F.size(f)).otherwise(0)).alias(f"{f}{i}"))
                else:
                    parts += [F.first(F.when(F.col("term") == w, F.col(f)), ignorenulls=True).alias(f"{f}{i}_{j}") for j, w in enumerate(unit)]
            names.append(i)
        found = rows.groupBy("key", "spec", "len").agg(*parts, *(F.max(is_(w)).alias(f"no{j}") for j, w in enumerate(without)))
        for i, unit in enumerate(units):
            if len(unit) > 1:
                for f in ("title_at", "body_at"):
                    at = F.col(f"{f}{i}_0")
                    for j in range(1, len(unit)):
                        at = F.array_intersect(at, F.transform(f"{f}{i}_{j}", back(j)))
                    found = found.withColumn(f"{f}{i}", F.when(at.isNotNull(), F.size(at)).otherwise(0))
        times = {i: F.col(f"title_at{i}") + F.col(f"body_at{i}") for i in names}
        stats = self.table("stats")
        simple = {i: unit[0] for i, unit in enumerate(units) if len(unit) == 1 and not unit[0].endswith("*")}
        if simple:
            known = self.table("terms").where(of_terms(list(simple.values())))
            stats = stats.crossJoin(known.agg(*(F.coalesce(F.max(F.when(F.col("term") == t, F.col("df"))), F.lit(0)).alias(f"df{i}") for i, t in simple.items())))
        if len(simple) < len(units):
            stats = stats.crossJoin(found.agg(*(F.count(F.when(times[i] > 0, 1)).alias(f"df{i}") for i in names if i not in simple)))
        held = [times[i] > 0 for i in names]
        match = reduce((lambda a, b: a | b) if any_terms else (lambda a, b: a & b), held)
        for j in range(len(without)):
            match = match & ~F.col(f"no{j}")
        if spec is not None:
            match = match & (F.col("spec") == spec)
        score = reduce(lambda a, b: a + b, [_part(i) for i in names])
        return found.where(match).crossJoin(F.broadcast(stats)).select("key", "spec", score.alias("score"))


def search_many(index: Index, asked: list[list[str]], k: int = 10) -> DataFrame:
    """(nth, key, score, rank): the best k of each of many queries of plain terms, all of which must occur, in one job."""
    spark = index.spark
    rows = [(i, t, len(set(q))) for i, q in enumerate(asked) for t in sorted(set(q))]
    wanted = spark.createDataFrame(rows, "nth int, term string, need int")
    match = of_terms([t for _, t, _ in rows])
    known = index.table("terms").where(match).select("term", "df").crossJoin(F.broadcast(index.table("stats")))
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = known.select("term", F.when(raw > 0, raw).otherwise(1e-6).alias("idf"), "avg_len")
    f = F.size("title_at") * TITLE_WEIGHT + F.size("body_at")
    part = F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = index.live(match).join(F.broadcast(idf), "term").select("term", "key", part.alias("part"))
    found = scored.join(F.broadcast(wanted), "term").groupBy("nth", "key").agg(F.sum("part").alias("score"), F.count("*").alias("n"), F.first("need").alias("need")).where("n = need")
    rank = F.row_number().over(Window.partitionBy("nth").orderBy(F.desc(F.round("score", 9)), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("nth", "key", "score", "rank")


def back(n: int):
    return lambda x: x - n


def _part(i: int) -> Column:
    """One unit's share of a score."""
    df, f = F.col(f"df{i}"), F.col(f"title_at{i}") * TITLE_WEIGHT + F.col(f"body_at{i}")
    raw = F.log((F.col("n_docs") - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))


def normalised(scored: DataFrame) -> DataFrame:
    """Scores to [0, 1] by the least and largest of the rows; one distinct score becomes 0."""
    w = Window.partitionBy(F.lit(0))
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn("score", (F.col("score") - lo) / F.when(hi > lo, hi - lo).otherwise(1.0))
