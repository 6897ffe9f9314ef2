"""SentencePiece encoding and decoding with a merge-type (BPE) vocabulary.

The encoding of a text's prefix ends in one certain token, so a table of that last
token for each prefix holds the whole encoding. The automaton gives the pieces that
end at a position; a piece fits if it starts the text, or if the pair of the last
token before it and itself is what merging would leave, which the pieces' own last
merges tell. Ids are then read off backwards.

Text splits, without changing the result, before a run of blanks and around
characters that no piece holds (they become byte pieces), so the table is built for
one word at a time and cached by word.

Defined cases: null or empty text has no ids and decodes to the empty text; a blank
sign (U+2581) in a text counts as a blank, as in the library. Rows map one to one,
so repeated rows and any other columns do not matter.

Scale: a map over documents; whole texts; the cache of words is bounded.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import WordCache
from .common import trim

BLANK = "▁"
#: pair tests remembered at most
FIT_CACHE = 400_000
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Pieces:
    """A vocabulary of merge type, read from a model file."""

    def __init__(self, model: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(m.vocab_size())
        self.strings = [m.id_to_piece(i) for i in ids]
        self.bytes = {i: int(self.strings[i][3:5], 16) for i in ids if m.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.special = {i for i in ids if m.is_control(i) or m.is_unknown(i)}
        self.unknown = m.unk_id()
        plain = [i for i in ids if i not in self.bytes and i not in self.special and not m.is_unused(i)]
        # single characters come first, then pieces by falling score: a number is a rank
        plain.sort(key=lambda i: (len(self.strings[i]) > 1, -m.get_score(i), i))
        self.ids = plain
        self.text = [self.strings[i] for i in plain]
        self.rank = {s: n for n, s in enumerate(self.text)}
        self.chars = {s for s in self.text if len(s) == 1}
        self.left, self.right, self.pairs = list(range(len(plain))), list(range(len(plain))), {}
        # a piece that begins with a blank after another character would forbid splitting before blanks
        self.split_blanks = not any(BLANK in s.lstrip(BLANK) for s in self.text)
        self.automaton = ahocorasick.Automaton()
        for n, s in enumerate(self.text):
            if len(s) > 1:
                for cut in range(1, len(s)):
                    a, b = self.rank.get(s[:cut]), self.rank.get(s[cut:])
                    if a is not None and b is not None:
                        self.pairs[a, b] = n
        for n, s in enumerate(self.text):
            if len(s) == 1 or self._last_merge(n, s):
                self.automaton.add_word(s, n)
        self.automaton.make_automaton()
        self.sizes = [len(s) for s in self.text]
        self.fit: dict[int, bool] = {}

    def _last_merge(self, n: int, s: str) -> bool:
        """Merge the piece's characters; true, and its last merge noted, if they become the piece."""
        row = [self.rank.get(c, -1) for c in s]
        while len(row) > 1:
            best = min(((self.pairs.get(p, 1 << 30), i) for i, p in enumerate(zip(row, row[1:], strict=False))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                return False
            if len(row) == 2:
                self.left[n], self.right[n] = row
            row[best[1] : best[1] + 2] = [best[0]]
        return row == [n]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the characters of a and b leaves just these two."""
        limit, pairs, left, right = 1 << 30, self.pairs, self.left, self.right
        while True:
            whole = pairs.get((a, b))
            if whole is not None and whole < limit:
                return False
            if a > b:
                limit = a
                a = right[a]
                if a == limit:
                    limit = b + 1
                    b = left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = left[b]
                if b + 1 == limit:
                    limit = a
                    a = right[a]
                    if a == limit:
                        return True

    def known(self, word: str) -> list[int]:
        """Ids of a word of known characters."""
        last, fit = [-1] * len(word) + [0], self.fit
        sizes = self.sizes
        for end, n in self.automaton.iter(word):
            if last[end] < 0:
                before = end - sizes[n]
                if before < 0:
                    last[end] = n
                else:
                    a = last[before]
                    yes = fit.get(a << 20 | n)
                    if yes is None:
                        yes = self._remember(a, n)
                    if yes:
                        last[end] = n
        out, at, ids = [], len(word) - 1, self.ids
        while at >= 0:
            n = last[at]
            out.append(ids[n])
            at -= sizes[n]
        out.reverse()
        return out

    def _remember(self, a: int, b: int) -> bool:
        if len(self.fit) > FIT_CACHE:
            self.fit.clear()
        yes = self.fit[a << 20 | b] = self.fits(a, b)
        return yes

    def word(self, word: str) -> list[int]:
        if self.chars.issuperset(word):
            return self.known(word)
        out, at, chars = [], 0, self.chars
        for i, c in enumerate(word):
            if c not in chars:
                if at < i:
                    out += self.known(word[at:i])
                out += [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown]
                at = i + 1
        return out + self.known(word[at:]) if at < len(word) else out

    def piece(self, i: int) -> str | int:
        """What an id stands for: a byte, or text."""
        return self.bytes[i] if i in self.bytes else "" if i in self.special else self.strings[i].replace(BLANK, " ")

    def decode(self, ids: list[int]) -> str:
        out = b"".join(bytes([p]) if isinstance(p, int) else p.encode() for p in map(self.piece, ids))
        return out.decode(errors="replace").removeprefix(" ")


class Codec:
    """Encodes whole texts by cached words."""

    def __init__(self, model: str, cache: int = 150_000):
        self.pieces = Pieces(model)
        self.names = [str(i) for i in range(len(self.pieces.strings))]
        self.backs = [bytes([p]) if isinstance(p, int) else p.encode() for p in map(self.pieces.piece, range(len(self.names)))]
        self.pattern = self._pattern()
        self.cache = WordCache(self.compute, cache)

    def _pattern(self) -> re.Pattern:
        """Parts that can be encoded alone: they end before blanks, at line ends and before
        marks after other characters, unless some piece reaches across such a place."""
        if not self.pieces.split_blanks:
            return re.compile(r"(?s).+")
        line = "" if "\n" in self.pieces.chars else "\n"
        marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        inner = {p for s in self.pieces.text for p in zip(s, s[1:], strict=False)}
        while odd := {(a, b) for a, b in inner if b in marks and a not in marks and a != BLANK}:
            letters = {b for a, b in odd if a.isalpha() or a.isdecimal()}
            marks = marks - letters if letters else marks | {a for a, _ in odd}
        m = "".join(map(re.escape, sorted(marks)))
        parts = [rf" *[{m}]+[^ {line}{m}]*", rf" *[^ {line}{m}]+"] if marks else [rf" *[^ {line}]+"]
        return re.compile("|".join([*parts, *([line] if line else []), " +"]))

    def compute(self, words: list[str]) -> list[tuple[str, int, bytes]]:
        """Ids, as text, number of ids, and decoded bytes of each word."""
        out, name, back, encode = [], self.names, self.backs, self.pieces.word
        for w in words:
            ids = encode(w.replace(" ", BLANK))
            out.append((",".join([name[i] for i in ids]), len(ids), b"".join([back[i] for i in ids])))
        return out

    def parts(self, text: str | None) -> list[tuple[str, int, bytes]]:
        return self.cache.get(self.pattern.findall(" " + text.replace(BLANK, " "))) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[0].split(",")]

    def decoded(self, parts: list[tuple[str, int, bytes]]) -> bytes:
        return b"".join([p[2] for p in parts]).removeprefix(b" ").decode(errors="replace").encode()


_codecs: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


def encode_documents(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its ids and the text that they decode to."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        c = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [c.parts(t) for t in part["text"].to_pylist()]
                ids = pa.array([[int(i) for p in f for i in p[0].split(",")] for f in found], pa.list_(pa.int32()))
                back = pa.array([c.decoded(f).decode() for f in found], pa.string())
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids, back], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As encode_documents, with digests in place of ids and text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        c = codec(model)
        for batch in batches:
            out: list[tuple] = []
            for t in batch["text"].to_pylist():
                parts = c.parts(t)
                ids = ",".join([p[0] for p in parts])
                out.append((sum([p[1] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(c.decoded(parts)).hexdigest()))
            n, a, b = map(list, zip(*out, strict=True)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            trim()

    return rows.mapInArrow(run, ENCODED)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document encoded and decoded."""
    return encoding_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
