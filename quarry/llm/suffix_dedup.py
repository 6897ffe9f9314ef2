"""Suffix-array dedup: remove every byte covered by a ``length``-byte string that also starts earlier.

Earlier means a smaller document id (null first; repeated ids in a fixed order), or
an earlier place in the same document. Strings are judged on the input.

1. Documents are copied to batch files of bounded size in the shared folder. Every
   window of ``length`` bytes has one anchor, the least hash among its ``GRAM``-byte
   strings (the leftmost, if equal), so equal windows have equal anchors. Batches
   send their anchors' hashes; those met twice come back to the batches that hold them.
2. Batches send the bytes around such anchors to a shard chosen by the anchor's hash;
   equal ones within a batch go once, with the places of the others.
3. A shard takes them in document order, in batches. Each batch gets its suffix array:
   its window starts, sorted. They are merge-scanned against the existing levels, all
   of them earlier, for matches of ``length`` bytes; what is new becomes a level, and
   levels of about equal size merge, so there are O(log n). Suffixes are ordered by the
   64-bit fingerprint of their first ``length`` bytes: equal prefixes are adjacent,
   which is all that the merge scan asks of the order. Windows of equal fingerprints are compared byte
   by byte.
4. The covered spans return to the batches, which cut them out.

Defined cases: null or empty text has no bytes; a text under ``length`` bytes stays
whole; a text of any size is cut to pieces that overlap by ``length`` - 1 bytes.

Scale: work and shuffles grow in proportion to the bytes; a hot passage travels once
per batch; a shard's memory is the bytes of its distinct contexts and sixteen more per distinct window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, Rolling, U, ragged, slices, text_bytes, trim, work_dir

GRAM = 24
BATCH_BYTES = 16 << 20
PLACE = U((1 << 24) - 1)


def write_batches(docs: DataFrame, folder: str, text: str) -> DataFrame:
    """Copies ``docs`` to files of about BATCH_BYTES of text; a row (number, path) for each."""

    def run(batches):
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        task = TaskContext.get()
        held, size, nth = [], 0, 0

        def flush():
            nonlocal held, size, nth
            number = task.partitionId() << 24 | nth
            name = f"{path}/{number}-{task.taskAttemptId()}.parquet"
            pq.write_table(pa.Table.from_batches(held), name, filesystem=files, compression="zstd", compression_level=7, use_dictionary=False)
            held, size, nth = [], 0, nth + 1
            trim()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([name], pa.string())], ["batch", "path"])

        for batch in batches:
            _, bounds = text_bytes(batch[batch.schema.get_field_index(text)])
            for a, b in slices(bounds, BATCH_BYTES):
                if held and size + bounds[b] - bounds[a] > BATCH_BYTES:
                    yield flush()
                held.append(batch.slice(a, b - a))
                size += int(bounds[b] - bounds[a])
        if held:
            yield flush()

    manifest = docs.mapInArrow(run, "batch long, path string")
    manifest.write.parquet(folder + "-list")
    return docs.sparkSession.read.schema("batch long, path string").parquet(folder + "-list")


def load(folder: str, name: str) -> pa.Table:
    return pq.read_table(name, filesystem=fs.FileSystem.from_uri(folder)[0])


def pieces(bounds: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows as (row, first byte, end): long rows come in pieces that overlap by length - 1."""
    for a, b in slices(bounds):
        size = int(bounds[b] - bounds[a])
        if b - a > 1 or size <= SLICE + length:
            yield np.arange(a, b), bounds[a:b], bounds[a + 1 : b + 1]
        else:
            for at in range(int(bounds[a]), int(bounds[b]) - length + 1, SLICE):
                yield np.array([a]), np.array([at]), np.array([min(at + SLICE + length - 1, int(bounds[b]))])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows within [start, end) of the rows of ``data``: first window, end of windows and anchor hash, for each run of windows with one anchor."""
    n = len(data) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U)
    grams = Rolling(data).every(GRAM)
    key = grams & ~PLACE | np.arange(len(grams), dtype=U)  # the place breaks ties to the left
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    at = (key[:n] & PLACE).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    change = np.ones(n, bool)
    change[1:] = at[1:] != at[:-1]
    change[starts[long]] = True
    edge = np.flatnonzero(change & inside)
    over = np.append(np.flatnonzero(change | ~inside), n)
    return edge, over[np.searchsorted(over, edge, "right")], grams[at[edge]]


def batch_anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As anchors(), over all rows, in places of ``data``."""
    for _, starts, ends in pieces(bounds, length):
        low, high = int(starts[0]), int(ends[-1])
        first, over, h = anchors(data[low:high], starts - low, ends - low, length)
        yield first + low, over + low, h


def first_of_equal(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the place of the first equal one, and whether it is that."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    first = np.empty(len(s), np.int64)
    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(s) else order
    return first, first == np.arange(len(s))


class Levels:
    """The suffix arrays so far: sorted keys of windows, of geometric sizes, each with the place of its bytes in ``pool``."""

    def __init__(self, length: int):
        self.length, self.levels = length, []
        self.pool, self.used = np.zeros(1 << 16, np.uint8), 0
        #: windows whose key is that of other bytes
        self.odd: set[bytes] = set()

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where the bytes of each of the sorted keys are, -1 if no level holds it."""
        out = np.full(len(keys), -1)
        for level, at_level in self.levels:
            at = np.searchsorted(level, keys)
            at[at == len(level)] = 0
            out = np.where(level[at] == keys, at_level[at], out)
        return out

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        if len(keys):
            self.levels.append((keys, places))
            while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
                (a, p), (b, q) = self.levels.pop(), self.levels.pop()
                both, at = np.concatenate((a, b)), np.concatenate((p, q))
                order = np.argsort(both, kind="stable")  # two sorted runs: a merge
                self.levels.append((both[order], at[order]))

    def keep(self, data: np.ndarray) -> int:
        """Append bytes to the pool; where they are."""
        at, need = self.used, self.used + len(data)
        if need > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(need - len(self.pool), len(self.pool)), np.uint8)))
        self.pool[at:need] = data
        self.used = need
        return at

    def scan(self, prints: np.ndarray, data: np.ndarray, at: np.ndarray, owner: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which windows, in document order, are strings met before; the others are new to the index.

        ``at`` are the windows' places in ``data``, ``owner`` their contexts, which begin at ``starts`` and have ``sizes``. Equal keys
        are compared by their bytes.
        """
        keys, first, which = np.unique(prints, return_index=True, return_inverse=True)
        place = self.places(keys)
        new = place < 0
        who = owner[first[new]]
        bring, nth = np.unique(who, return_inverse=True)
        kept, _ = ragged(starts[bring], sizes[bring])
        begin = self.keep(data[kept]) + np.cumsum(sizes[bring]) - sizes[bring]
        place[new] = begin[nth] + at[first[new]] - starts[who]
        self.add(keys[new], place[new])
        later = np.ones(len(prints), bool)
        later[first[new]] = False
        where = np.flatnonzero(later)
        for i in where[~self.equal(data, at[where], place[which[where]])].tolist():
            raw = data[at[i] : at[i] + self.length].tobytes()
            later[i] = raw in self.odd
            self.odd.add(raw)
        return later

    def equal(self, data: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the windows of ``data`` at ``at`` are those of the pool at ``place``: whole windows where a run along both begins, the last byte within one."""
        n, step = self.length, np.arange(self.length)
        if not len(at):
            return np.zeros(0, bool)
        run = np.zeros(len(at), bool)
        run[1:] = (at[1:] == at[:-1] + 1) & (place[1:] == place[:-1] + 1)
        ok = data[at + n - 1] == self.pool[place + n - 1]
        heads = np.flatnonzero(~run)
        for i in range(0, len(heads), 20_000):
            h = heads[i : i + 20_000]
            ok[h] = (data[at[h][:, None] + step] == self.pool[place[h][:, None] + step]).all(1)
        if not ok.all():
            # within a run with a fault, every window by itself
            number = np.cumsum(~run) - 1
            for i in np.flatnonzero(np.isin(number, np.unique(number[~ok]))).tolist():
                ok[i] = np.array_equal(data[at[i] : at[i] + n], self.pool[place[i] : place[i] + n])
        return ok


CONTEXT = "h long, doc_id long, batch long, row long, at long, bytes binary, others binary"


def covered(manifest: DataFrame, folder: str, doc_id: str, text: str, length: int) -> DataFrame:
    """(batch, row, start, end) of covered bytes, in places of the row's text."""

    def send_hashes(batches):
        for batch in batches:
            for number, path in zip(batch["batch"].to_pylist(), batch["path"].to_pylist(), strict=True):
                data, bounds = text_bytes(load(folder, path)[text])
                found = [h for _, _, h in batch_anchors(data, bounds, length)]
                h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, U), np.zeros(0))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), number)), pa.array(n > 1)], ["h", "batch", "more"])

    def met_twice(batches):
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

        def done(h, b, more):
            same = h[1:] == h[:-1]
            twice = more.copy()
            twice[1:] |= same
            twice[:-1] |= same
            return pa.RecordBatch.from_arrays([pa.array(b[twice]), pa.array(h[twice])], ["batch", "h"])

        for batch in batches:
            h, b, more = (np.concatenate((a, np.asarray(c.to_numpy(zero_copy_only=False), a.dtype))) for a, c in zip(held, batch.columns, strict=True))
            cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
            if cut:
                yield done(h[:cut], b[:cut], more[:cut])
            held = h[cut:], b[cut:], more[cut:]
        yield done(*held)

    def send_contexts(batches):
        for number, path, (hashes,) in per_batch(batches, 1):
            if len(hashes):
                yield from contexts(number, load(folder, path), np.sort(hashes).view(U))
                trim()

    def contexts(number, table, suspects):
        suspects = np.sort(suspects)
        ids = table[doc_id].combine_chunks() if table[doc_id].num_chunks != 1 else table[doc_id].chunk(0)
        ids = ids.cast(pa.int64())
        order = np.asarray(pa.compute.sort_indices(ids, null_placement="at_start"))
        data, bounds = text_bytes(table[text])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        rows, places, sizes, hs, prints = [], [], [], [], []
        for first, over, h in batch_anchors(data, bounds, length):
            if not len(h):
                continue
            at = np.searchsorted(suspects, h)
            at[at == len(suspects)] = 0
            keep = suspects[at] == h
            first, over, h = first[keep], over[keep], h[keep]
            if not len(h):
                continue
            low, high = int(first[0]), int((over + length - 1).max())
            prints.append(Rolling(data[low:high])(first - low, over + length - 1 - low) ^ h)
            rows.append(np.searchsorted(bounds, first, "right") - 1)
            places.append(first)
            sizes.append(over - first + length - 1)
            hs.append(h)
        if not rows:
            return
        rows, places, sizes, hs, prints = map(np.concatenate, (rows, places, sizes, hs, prints))
        turn = np.lexsort((places, rank[rows]))  # earliest first
        rows, places, sizes, hs, prints = rows[turn], places[turn], sizes[turn], hs[turn], prints[turn]
        leader, own = first_of_equal(prints)
        lead = np.flatnonzero(own)
        follow = np.flatnonzero(~own)
        follow = follow[np.argsort(leader[follow], kind="stable")]
        cuts = np.searchsorted(leader[follow], np.append(lead, len(rows)))
        within = places - bounds[rows]
        for a in range(0, len(lead), 20000):
            part = lead[a : a + 20000]
            raw = [data[p : p + n].tobytes() for p, n in zip(places[part].tolist(), sizes[part].tolist(), strict=True)]
            others = []
            for x, y in zip(cuts[a : a + len(part)].tolist(), cuts[a + 1 : a + 1 + len(part)].tolist(), strict=True):
                f = follow[x:y]
                others.append(np.stack((rows[f], within[f]), 1).astype("<i8").tobytes() if y > x else None)
            columns = [pa.array(hs[part].view(np.int64)), ids.take(pa.array(rows[part])), pa.array(np.full(len(part), number)), pa.array(rows[part]), pa.array(within[part]), pa.array(raw, pa.binary()), pa.array(others, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "batch", "row", "at", "bytes", "others"])

    def match(batches):
        index = Levels(length)
        for batch in batches:
            raw = batch["bytes"]
            sizes = np.asarray(pa.compute.binary_length(raw)).astype(np.int64)
            data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
            numbers, rows, places = (np.asarray(batch[c]) for c in ("batch", "row", "at"))
            out = [[], [], [], []]
            starts = np.cumsum(sizes) - sizes
            for a, b in slices(np.append(starts, len(data))):
                low = int(starts[a])
                at, owner = ragged(starts[a:b] - low, sizes[a:b] - length + 1)
                own = data[low : low + int(sizes[a:b].sum())]
                later = index.scan(Rolling(own)(at, at + length), own, at, owner, starts[a:b] - low, sizes[a:b])
                edge = np.diff(np.concatenate(([0], later.astype(np.int8), [0])))
                same = np.flatnonzero(owner[1:] == owner[:-1]) + 1
                border = np.setdiff1d(np.arange(1, len(owner)), same, assume_unique=True)
                both = border[later[border] & later[border - 1]]
                begin = np.union1d(np.flatnonzero(edge == 1), both)
                end = np.union1d(np.flatnonzero(edge == -1), both)
                who = a + owner[begin]
                offset = places[who] - starts[who] + low
                out[0].append(numbers[who])
                out[1].append(rows[who])
                out[2].append(at[begin] + offset)
                out[3].append(at[end - 1] + offset + length)
            for i, o in enumerate(batch["others"].to_pylist()):
                if o:
                    pairs = np.frombuffer(o, "<i8").reshape(-1, 2)
                    out[0].append(np.full(len(pairs), numbers[i]))
                    out[1].append(pairs[:, 0])
                    out[2].append(pairs[:, 1])
                    out[3].append(pairs[:, 1] + sizes[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out], ["batch", "row", "start", "end"])

    hashes = manifest.repartition(tasks(manifest), "batch").mapInArrow(send_hashes, "h long, batch long, more boolean")
    twice = hashes.repartition("h").sortWithinPartitions("h").mapInArrow(met_twice, "batch long, h long")
    held = with_batches(twice, manifest).mapInArrow(send_contexts, CONTEXT)
    return held.repartition("h").sortWithinPartitions("doc_id", "batch", "row", "at").drop("h", "doc_id").mapInArrow(match, "batch long, row long, start long, end long")


def with_batches(values: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows for each batch together, after one that names its file."""
    rows = manifest.unionByName(values, allowMissingColumns=True)
    return rows.repartition(tasks(manifest), "batch").sortWithinPartitions("batch", F.col("path").desc_nulls_last())


def tasks(manifest: DataFrame) -> int:
    """A task for each batch, up to some thousands: the manifest is small, so its bytes say nothing of the work."""
    return min(max(manifest.count(), 1), 10_000)


def per_batch(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, str, list[np.ndarray]]]:
    """Number, path and the other columns' values of each batch, from the rows of with_batches()."""
    now, path, held = None, None, []
    for batch in batches:
        numbers = np.asarray(batch["batch"])
        edges = np.flatnonzero(numbers[1:] != numbers[:-1]) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if now is None or numbers[a] != now:
                if now is not None:
                    yield now, path, [np.concatenate(x) for x in zip(*held, strict=True)]
                now, path, held = int(numbers[a]), part["path"][0].as_py(), []
                held.append([np.zeros(0, np.int64)] * n)
                part = part.slice(1)
            held.append([np.asarray(c.to_numpy(zero_copy_only=False)).astype(np.int64) for c in part.columns[2 : 2 + n]])
    if now is not None:
        yield now, path, [np.concatenate(x) for x in zip(*held, strict=True)]


def cut(table: pa.Table, text: str, spans: list[np.ndarray]) -> Iterator[tuple[int, int, int, bytes]]:
    """Bytes, removed bytes, removed runs and what is left, of each row."""
    data, bounds = text_bytes(table[text])
    rows, start, end = spans
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, bounds[rows] + start, 1)
    np.add.at(edge, bounds[rows] + end, -1)
    gone = np.cumsum(edge[:-1]) > 0
    any_gone = np.zeros(len(bounds) - 1, bool)
    any_gone[rows] = True
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if not any_gone[i]:
            yield b - a, 0, 0, raw[a:b]
        else:
            g = gone[a:b]
            yield b - a, int(g.sum()), int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[0]), data[a:b][~g].tobytes()


def dedup(docs: DataFrame, finish: Callable, schema, *, doc_id: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """``finish(table, rows of cut())`` for every batch of ``docs``."""
    folder = work_dir(docs.sparkSession, "suffix")
    manifest = write_batches(docs, folder, text)
    spans = covered(manifest, folder, doc_id, text, length)

    def run(batches):
        for _, path, found in per_batch(batches, 3):
            table = load(folder, path)
            yield from finish(table, list(cut(table, text, found)))
            trim()

    return with_batches(spans, manifest).mapInArrow(run, schema)


def digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, digest of the rest."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def finish(table, found):
        ids = table["doc_id"].combine_chunks()
        columns = [pa.array([r[i] for r in found], pa.int64()) for i in range(3)]
        sha = pa.array([hashlib.sha256(r[3]).hexdigest() for r in found], pa.string())
        yield pa.RecordBatch.from_arrays([ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids, *columns, sha], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return dedup(rows, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length=length)


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", length: int = 100) -> DataFrame:
    """``docs``, all columns, with the repeated bytes cut out of the text (and what that leaves of a
    multi-byte character), ``n_chars`` counted anew; documents that lose all their text go."""
    names = docs.columns

    def finish(table, found):
        for batch in table.add_column(len(names), "_row", pa.array(np.arange(len(found)))).to_batches(max_chunksize=2000):
            rows = batch["_row"].to_pylist()
            left = [found[i][3].decode(errors="ignore") if found[i][1] else None for i in rows]
            keep = pa.array([not found[i][1] or bool(t) for i, t in zip(rows, left, strict=True)], pa.bool_())
            columns = dict(zip(names, batch.columns[:-1], strict=True))
            old = columns[text]
            columns[text] = pa.array([o if t is None else t for o, t in zip(old.to_pylist(), left, strict=True)], old.type)
            if n_chars in columns:
                count = columns[n_chars]
                columns[n_chars] = pa.array([c if t is None else len(t) for c, t in zip(count.to_pylist(), left, strict=True)], count.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(keep)

    return dedup(docs, finish, docs.schema, doc_id=doc_id, text=text, length=length)


def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: what every document loses to strings of 100 bytes that start earlier."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
