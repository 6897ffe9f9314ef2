"""Token-ID / binary output: sorted-string-table shards of token ids.

A shard holds documents in ascending id order. Layout: data blocks, then the block
index, the Bloom filter and a footer. An entry is ``shared, unshared, length`` as
varints, the rest of the key and the ids (little-endian, two bytes each if all fit,
else four; a leading byte says which); the first entry of a block shares nothing.
The index holds each block's first key, offset, length and crc32; the footer the
places of index and filter, the counts and a magic number. ``Shard.get`` asks the
filter, bisects the index and reads one block.

A key is a byte (0: null id), the id as eight big-endian bytes with the sign bit
turned, and four bytes that number rows of the same id (ordered by text).

Defined cases: null or empty text gives the end id only; null ids come first;
repeated ids are all kept. Only the named columns are read.

Scale: one range shuffle of the texts; encoding and writing stream through each
range. A task writes to a name of its own, then renames, and only the names that
finished tasks return are read, so lost or doubled tasks leave no trace. The driver
sees one row per shard. Document starts are prefix sums: within a shard while
reading, across shards from the shards' counts.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import WordCache
from .common import ragged, slices, text_bytes, work_dir

BLOCK = 64 << 10
MAGIC = b"QSST0001"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: bytes of text whose words are told apart at once
PART = 8 << 20
MANIFEST = "path string, min_key binary, n_docs long, n_tokens long"


def key_of(doc_id: int | None, nth: int = 0) -> bytes:
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", nth)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def pack(ids: np.ndarray) -> bytes:
    return b"\2" + ids.astype("<u2").tobytes() if len(ids) == 0 or ids.max() < 65536 else b"\4" + ids.astype("<u4").tobytes()


def unpack(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def bloom_places(keys: np.ndarray, n_bits: int) -> np.ndarray:
    """Bits of each key (by its id part only), by double hashing."""
    with np.errstate(over="ignore"):
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        g = h * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
        return (h[:, None] + g[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(n_bits)


def bloom_key(doc_id: int | None) -> int:
    return (1 << 64) - 1 if doc_id is None else (doc_id + (1 << 63)) & ((1 << 64) - 1)


class Writer:
    """Writes entries, given in key order, to a stream."""

    def __init__(self, out):
        self.out, self.at, self.block, self.last, self.first = out, 0, bytearray(), b"", b""
        self.index, self.ids, self.n_tokens = [], [], 0

    def add(self, doc_id: int | None, nth: int, ids: np.ndarray) -> None:
        key, value = key_of(doc_id, nth), pack(ids)
        if not self.block:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=True)) if a != b), len(key))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.ids.append(bloom_key(doc_id))
        self.n_tokens += len(ids)
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = bytes(self.block)
            self.out.write(data)
            self.index.append((self.first, self.at, len(data), zlib.crc32(data)))
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        index = b"".join(varint(len(k)) + k + struct.pack("<QII", at, n, crc) for k, at, n, crc in self.index)
        n_bits = max(64, len(self.ids) * BLOOM_BITS)
        bits = np.zeros(n_bits, bool)
        bits[bloom_places(np.array(self.ids, np.uint64), n_bits).ravel()] = True
        bloom = struct.pack("<Q", n_bits) + np.packbits(bits).tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.ids), self.n_tokens, MAGIC))
        self.out.close()


class Shard:
    """Reads a shard: all of it, or one document."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        index_at, index_n, bloom_at, bloom_n, self.n_docs, self.n_tokens, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        data, at, self.index = self.read(index_at, index_n), 0, []
        while at < index_n:
            n, at = read_varint(data, at)
            self.index.append((data[at : at + n], *struct.unpack_from("<QII", data, at + n)))
            at += n + 16
        bloom = self.read(bloom_at, bloom_n)
        self.n_bits = struct.unpack_from("<Q", bloom)[0]
        self.bloom = np.unpackbits(np.frombuffer(bloom, np.uint8, offset=8), count=self.n_bits)

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, start, n, crc = self.index[block]
        data, at, key = self.read(start, n), 0, b""
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {block} is damaged")
        while at < n:
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, unpack(data[at + rest : at + rest + size])
            at += rest + size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for b in range(len(self.index)):
            for key, ids in self.entries(b):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first row of that id, found by filter, index and one block."""
        if not self.index or not self.bloom[bloom_places(np.array([bloom_key(doc_id)], np.uint64), self.n_bits)].all():
            return None
        key = key_of(doc_id)
        block = bisect.bisect_right(self.index, key, key=lambda x: x[0]) - 1
        return next((ids for k, ids in self.entries(max(block, 0)) if k == key), None)


class Encoder:
    """Ids of whole texts: the vocabulary drops white space, so words between blanks are encoded one by one.

    Words are cut and told apart in Arrow, a slice of texts at a time; each distinct one is
    looked up once a slice and its ids are copied to its places. Texts with a reserved string
    go to the library as they are.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.cache = WordCache(self.compute, 500_000)

    def compute(self, words: list[str]) -> list[bytes]:
        """Ids of words without blanks: many are encoded as one text, and its ids dealt out by the places they come from."""
        out = []
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            places = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.offsets))
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])
            cuts, raw = (4 * np.searchsorted(places, starts)).tolist(), np.array(found.ids, "<u4").tobytes()
            out += [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        reserved = pa.compute.match_substring(texts, "<|")
        plain = pa.compute.if_else(reserved, pa.scalar("", pa.large_string()), texts)
        data, bounds = text_bytes(plain)
        odd = set(np.flatnonzero(np.asarray(reserved.to_numpy(zero_copy_only=False))).tolist())
        for a, b in slices(bounds, PART):
            ids, cuts = self.words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            for i in range(a, b):
                yield self.whole(texts[i].as_py()) if i in odd else ids[cuts[i - a] : cuts[i - a + 1]]

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice, and the bounds of each text's."""
        folded = np.where(data == 10, np.uint8(32), data)
        # the vocabulary composes characters before it lowers them, and some compose in lower case only
        capital = (folded >= 65) & (folded < 91)
        capital[:-1] &= data[1:] < 128
        folded[capital] += 32
        texts = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(folded))
        lists = pa.compute.split_pattern(texts, " ")
        words = lists.values.dictionary_encode()
        found = self.cache.get(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        which = np.asarray(words.indices)
        at, _ = ragged(starts[which], sizes[which])
        cuts = np.concatenate(([0], np.cumsum(sizes[which])))
        return pool[at], cuts[np.asarray(lists.offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def write_shards(docs: DataFrame, folder: str, vocabulary: str, *, end: int, doc_id: str = "doc_id", text: str = "text") -> list[dict]:
    """Write the shards of ``docs`` under ``folder`` (a URI that all machines reach); what each holds, in id order, with the tokens before it as ``start``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        encode, files, writer, last, nth, low = encoder(vocabulary), None, None, object(), 0, None
        for batch in batches:
            for i, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"]), strict=True):
                if writer is None:
                    files, path = fs.FileSystem.from_uri(folder)
                    files.create_dir(path, recursive=True)
                    name = f"{uuid.uuid4().hex}.sst"
                    writer, low = Writer(files.open_output_stream(f"{path}/_{name}")), key_of(i)
                nth = nth + 1 if i == last else 0
                last = i
                writer.add(i, nth, np.append(ids, np.uint32(end)))
        if writer:
            writer.close()
            files.move(f"{path}/_{name}", f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([low], pa.binary()), pa.array([len(writer.ids)], pa.int64()), pa.array([writer.n_tokens], pa.int64())], ["path", "min_key", "n_docs", "n_tokens"])

    shards = sorted((r.asDict() for r in ordered.mapInArrow(run, MANIFEST).collect()), key=lambda r: bytes(r["min_key"]))
    start = 0
    for s in shards:
        s["start"] = start
        start += s["n_tokens"]
    return shards


def read_shards(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """Per document of the shards: its id, the tokens before it, their number and crc32."""
    rows = spark.createDataFrame([(s["path"], s["start"]) for s in shards], "path string, start long")
    rows = rows.repartition(max(1, len(shards)))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                start, out = r["start"], []
                for i, ids in Shard(r["path"]).scan():
                    out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(out) == 20000:
                        yield _batch(out)
                        out = []
                yield _batch(out)

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_output_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's ids, written to shards and read from them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write_shards(docs, work_dir(spark, "shards"), public_tokenizers.path("word_bpe_49k.json"), end=2)
    return read_shards(spark, shards)
