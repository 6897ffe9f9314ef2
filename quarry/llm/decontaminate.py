"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Text is lower-cased (A-Z) and cut to words ``[0-9a-z]`` and non-ASCII; every run
of ``window`` consecutive item words (an item of fewer words: all of them) is a
pattern over word numbers. A document is scanned once; a word inside any match is
hit, and hits are mapped back to character offsets of the original text.

Defined cases: null or empty text has no words and no hits. An item without words
has no pattern. An item whose id is null still marks words, but is not named.
Repeated documents give a row each, repeated items count once by id. Only the
named columns are read, so other columns may have any names.

Scale: the scan is a map over documents. Items are broadcast in blocks of at most
``block_bytes`` of text (measured first); with more than one block the marks
found so far are written to the shared folder between passes, so memory stays
that of one block's automaton.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: capital letters to small ones, other ASCII that is no part of a word to a space
TABLE = bytes(c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
CAPITALS = {c: c + 32 for c in range(65, 91)}
BLOCK_BYTES = 1536 << 10
OUT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


class Scanner:
    """The automaton of one block of items.

    Each word of the items is a character, so matches begin at words only and a block's words are as
    many as there are characters; other words are blanks.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.codes: dict[bytes, str] = {}
        owners: dict[str, set] = {}
        for item, text in items:
            row = [self.codes.get(w) or self._add(w) for w in words(text)]
            for i in range(max(1, len(row) - window + 1) if row else 0):
                owners.setdefault("".join(row[i : i + window]), set()).add(item)
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton()
            for pattern, who in owners.items():
                self.automaton.add_word(pattern, (len(pattern), who))
            self.automaton.make_automaton()

    def _add(self, word: bytes) -> str:
        n = 33 + len(self.codes)
        code = self.codes[word] = chr(n if n < 0xD800 else n + 0x800)  # surrogates are no characters
        return code

    def scan(self, found: list[bytes]) -> list[tuple[int, int, set]]:
        """Matches as (first word, end, items)."""
        if self.automaton is None or not found:
            return []
        get = self.codes.get
        return [(end + 1 - n, end + 1, who) for end, (n, who) in self.automaton.iter("".join([get(w, " ") for w in found]))]


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """Character spans, in the original text, of the runs of hit words."""
    at = [m.span() for m in WORD.finditer(text.translate(CAPITALS))]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def blocks_of(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list]:
    """The items, in lists of about block_bytes of text."""
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where(F.length("t") > 0)
    size = rows.agg(F.sum(F.octet_length("t"))).collect()[0][0] or 0
    n = -(-size // block_bytes) or 1
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r["i"], r["t"]) for r in part.collect()]


def find_hits(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (ids sorted as strings) and the hit spans of the original text."""
    spark = docs.sparkSession
    state = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    seen = state.withColumns({"hit": F.lit(None).cast("binary"), "items": F.array().cast("array<string>")})
    blocks = list(blocks_of(items, item_id, item_text, block_bytes)) or [[]]
    for k, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(block)
        if k:
            seen = written(seen, "decontaminate")
        mark = _report if k == len(blocks) - 1 else _mark
        seen = seen.mapInArrow(lambda it, shared=shared, mark=mark: mark(it, shared.value, window), OUT if mark is _report else seen.schema)
    return seen


_scanners: dict[tuple, Scanner] = {}


def _scanner(items: list, window: int) -> Scanner:
    key = (id(items), len(items), window)
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(items, window)
        _scanners[key].items = items  # keeps the id taken
    return _scanners[key]


def _marked(batch: pa.RecordBatch, scanner: Scanner) -> Iterator[tuple[str, int, np.ndarray | None, list[str]]]:
    """Text, number of words, mask of hit words (None without any) and items of each row."""
    for text, hit, names in zip(batch["text"].to_pylist(), batch["hit"].to_pylist(), batch["items"].to_pylist(), strict=True):
        found = words(text)
        mask = np.frombuffer(hit, np.uint8).copy() if hit else None
        if matches := scanner.scan(found):
            mask = np.zeros(len(found), np.uint8) if mask is None else mask
            for a, b, _ in matches:
                mask[a:b] = 1
            names = sorted({*names, *(x for m in matches for x in m[2] if x is not None)})
        yield text, len(found), mask, names


def _mark(batches: Iterator[pa.RecordBatch], items: list, window: int) -> Iterator[pa.RecordBatch]:
    scanner = _scanner(items, window)
    for batch in batches:
        rows = list(_marked(batch, scanner))
        hits = pa.array([None if m is None else m.tobytes() for _, _, m, _ in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], hits, pa.array([r[3] for r in rows], pa.list_(pa.string()))], ["doc_id", "text", "hit", "items"])


def _report(batches: Iterator[pa.RecordBatch], items: list, window: int) -> Iterator[pa.RecordBatch]:
    scanner = _scanner(items, window)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        rows = list(_marked(batch, scanner))
        columns = [
            pa.array([n for _, n, _, _ in rows], pa.int64()),
            pa.array([0 if m is None else int(m.sum()) for _, _, m, _ in rows], pa.int64()),
            pa.array([r[3] for r in rows], pa.list_(pa.string())),
            pa.array([[] if m is None else spans_of(text, m) for text, _, m, _ in rows], kind),
        ]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_words", "n_hit", "items", "spans"])


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, all columns, without the documents that hold a window of an item."""
    spark = docs.sparkSession
    out = docs
    for block in blocks_of(items, item_id, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            scanner = _scanner(shared.value, window)
            for batch in batches:
                flags = [not scanner.scan(words(t)) for t in batch[batch.schema.get_field_index(text)].to_pylist()]
                yield batch.filter(pa.array(flags, pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out


def decontamination_query(spark, sf_dir: str) -> DataFrame:
    """op1: the marks of every document against every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = find_hits(docs, items)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS p
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM pat),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS p FROM pos, sizes WHERE i + n - 1 <= len(ws)),
m AS (SELECT doc_id, i, win.n, item_id FROM win JOIN pat ON win.p = pat.p AND win.n = pat.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
