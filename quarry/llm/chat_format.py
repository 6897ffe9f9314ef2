"""Chat formatting: token sequences with reserved ids, a loss mask and reversible escapes.

A conversation is ``<s>``, then per turn ``[INST] role [/INST] text </s>`` (without
the spaces). Role and text are escaped and encoded on their own with a byte-level
vocabulary, which is lossless; the control strings become reserved ids above that
vocabulary, so no text can produce them. In the string form, a control string that
occurs in a text gets a backslash after its first character (one more, if some are
there), so texts never hold a control string and the escape can be undone.
The mask covers the text tokens of assistant turns; segment bounds are prefix sums
of segment lengths, within the turn and through the conversation.

Defined cases: null text or role is empty; a null conversation id is a conversation
of its own; rows of one conversation are ordered by turn (null first), then role,
then text; repeated rows are turns of their own.

Scale: encoding is a map over rows, so a hot conversation's work spreads. Only the
running token offset, which depends on all earlier turns, needs a conversation's
rows in order: they are sorted by Spark (which spills) and streamed, one row at a
time, never gathered.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ragged

#: fixed values: the control strings, in the order of their reserved ids
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
BEGIN, END, OPEN, CLOSE = range(4)
_HEADS, _TAILS = "[<]", [c[1:] for c in CONTROL]
_ESCAPE = re.compile(r"([<\[])(\\*)(" + "|".join(re.escape(t) for t in sorted(_TAILS, key=len, reverse=True)) + ")")
TRAINED_ROLE = "assistant"
FORMATTED = "conv_id long, turn long, role string, ids array<int>, mask_start int, mask_end int, text string"
ASSEMBLED = FORMATTED + ", first boolean, token_start long"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] + m[2][1:] + m[3], text)


class Template:
    """Encodes turns and reads them back."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.table = None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts; equal ones are encoded once."""
        kinds = list(dict.fromkeys(texts))
        found = dict(zip(kinds, (np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch(kinds, add_special_tokens=False)), strict=True))
        return [found[t] for t in texts]

    def turns(self, roles: list[str], texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, list[str]]:
        """Ids, mask bounds and the string form of each turn; the bounds are prefix sums of the segments' lengths."""
        spoken, said = [escape(r) for r in roles], [escape(t) for t in texts]
        names, bodies = self.encode(spoken), self.encode(said)
        control = [np.array([self.base + c], np.int32) for c in range(len(CONTROL))]
        segments = [x for name, body in zip(names, bodies, strict=True) for x in (control[OPEN], name, control[CLOSE], body, control[END])]
        sizes = np.fromiter(map(len, segments), np.int64, len(segments)).reshape(-1, 5)
        ends = np.cumsum(sizes, 1)
        ids = ids_array(np.concatenate(segments) if segments else np.zeros(0, np.int32), ends[:, -1])
        trained = np.array([r == TRAINED_ROLE for r in spoken], bool)
        return ids, ends[:, 2], np.where(trained, ends[:, 3], ends[:, 2]), [f"{CONTROL[OPEN]}{r}{CONTROL[CLOSE]}{t}{CONTROL[END]}" for r, t in zip(spoken, said, strict=True)]

    def bytes_of(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vocabulary's bytes one after the other, and the start and length of each id's; control ids have none."""
        if self.table is None:
            # fixed values: byte-level vocabularies spell bytes that do not print by letters from 256 on
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            others = [b for b in range(256) if b not in set(plain)]
            letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
            added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            words = [b""] * (self.base + len(CONTROL))
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                words[i] = added[i] if i in added else bytes(letters[c] for c in token)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            self.table = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes
        return self.table

    def read(self, ids: pa.ListArray, first: np.ndarray, mask_start: np.ndarray, mask_end: np.ndarray) -> Iterator[tuple[str, str, str]]:
        """Role, text and text under the mask of each turn's ids."""
        flat, bounds = np.asarray(ids.values), np.asarray(ids.offsets).astype(np.int64)
        flat, bounds = flat[bounds[0] : bounds[-1]], bounds - bounds[0]
        pool, starts, sizes = self.bytes_of()
        at, _ = ragged(starts[flat], sizes[flat])
        raw = pool[at].tobytes()
        cuts = np.concatenate(([0], np.cumsum(sizes[flat])))
        close = np.flatnonzero(flat == self.base + CLOSE)
        # no text can make a control id, so each turn has one that closes its role
        says = lambda a, b: unescape(raw[a:b].decode(errors="replace"))
        roles: dict[bytes, str] = {}
        columns = (cuts[bounds[:-1] + first + 1], cuts[close], cuts[close + 1], cuts[bounds[1:] - 1], cuts[bounds[:-1] + mask_start], cuts[bounds[:-1] + mask_end])
        for a, b, c, d, m, n in zip(*(x.tolist() for x in columns), strict=True):
            role = roles.get(raw[a:b])
            if role is None:
                role = roles[raw[a:b]] = says(a, b)
            text = says(c, d)
            yield role, text, text if (m, n) == (c, d) else says(m, n)


def ids_array(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat.astype(np.int32)))


_templates: dict[str, Template] = {}


def template(vocabulary: str) -> Template:
    if vocabulary not in _templates:
        _templates[vocabulary] = Template(vocabulary)
    return _templates[vocabulary]


def format_turns(conversations: DataFrame, vocabulary: str, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row of ids, mask bounds and string form for each turn."""
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        t = template(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, first, last, said = t.turns(part["role"].to_pylist(), part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["conv_id"], part["turn"], part["role"], ids, pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(said, pa.string())], ["conv_id", "turn", "role", "ids", "mask_start", "mask_end", "text"])

    return rows.mapInArrow(run, FORMATTED)


def assemble(turns: DataFrame, vocabulary: str) -> DataFrame:
    """The turns in order, the first with the opening id, each with its token offset in its conversation."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        begin = template(vocabulary).base + BEGIN
        # the last conversation's id and whether it is null, and the tokens of it so far
        last, offset = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv, there = np.asarray(batch["conv_id"].fill_null(0)), np.asarray(batch["conv_id"].is_valid().to_numpy(zero_copy_only=False))
            first = np.ones(n, bool)
            first[1:] = (conv[1:] != conv[:-1]) | (there[1:] != there[:-1])
            first[0] = (conv[0], there[0]) != last
            ids = batch["ids"]
            bounds = np.asarray(ids.offsets).astype(np.int64)
            flat = np.asarray(ids.values)[bounds[0] : bounds[-1]]
            flat = np.insert(flat, bounds[:-1][first] - bounds[0], begin)
            sizes = np.diff(bounds) + first
            # tokens before a turn, in its conversation
            total = np.cumsum(sizes)
            before = total - sizes
            opens = np.maximum.accumulate(np.where(first, np.arange(n), -1))
            start = before - np.where(opens >= 0, before[opens], -offset)
            last, offset = (conv[-1], there[-1]), int(start[-1] + sizes[-1])
            shift = first.astype(np.int32)
            text = pa.compute.binary_join_element_wise(pa.array(np.where(first, CONTROL[BEGIN], "").tolist(), pa.string()), batch["text"], "")
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["turn"], batch["role"], ids_array(flat, sizes), pa.array(np.asarray(batch["mask_start"]) + shift), pa.array(np.asarray(batch["mask_end"]) + shift), text, pa.array(first), pa.array(start)], [*batch.schema.names, "first", "token_start"])

    return ordered.mapInArrow(run, ASSEMBLED)


def digests(assembled: DataFrame, vocabulary: str) -> DataFrame:
    """Per conversation, what its ids and mask give when read back; needs the order that assemble() leaves."""

    def run(batches):
        t = template(vocabulary)
        state, out = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            opens = np.asarray(batch["first"].to_numpy(zero_copy_only=False))
            sizes = pa.compute.utf8_length(batch["text"]).to_pylist()
            turns = t.read(batch["ids"], opens.astype(np.int64), np.asarray(batch["mask_start"]).astype(np.int64), np.asarray(batch["mask_end"]).astype(np.int64))
            for conv, first, size, (role, text, loss) in zip(batch["conv_id"].to_pylist(), opens.tolist(), sizes, turns, strict=True):
                if first:
                    if state:
                        out.append(_row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += size
            if len(out) >= 5000:
                yield _table(out)
                out = []
        if state:
            out.append(_row(state))
        yield _table(out)

    return assembled.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _row(s: list) -> tuple:
    return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all conversations and one whose texts consist of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, TRAINED_ROLE, said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(probe)
    vocabulary = vocabulary_path()
    return digests(assemble(format_turns(rows, vocabulary), vocabulary), vocabulary)


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/INST\]|INST\]|/s>|s>)', '\1\\\2\3', 'g') AS r2,
            regexp_replace(text, '([<\[])(\\*)(/INST\]|INST\]|/s>|s>)', '\1\\\2\3', 'g') AS t2 FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r2, t2)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r2, t2) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(6 + length(r2) + 7 + length(t2) + 4) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
