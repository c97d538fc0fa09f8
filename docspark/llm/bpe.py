"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text there is one last token of its encoding. It is found among the vocabulary's tokens
that end the prefix (an automaton over the vocabulary gives them, longest first) as the one that fits the last
token of the prefix before it; two tokens fit if merging them never forms a token across their border earlier
than they form themselves. Following the last tokens back from the end gives the ids. Time is linear in the text.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose ids, and pairs whose fit, a Python worker keeps; emptied beyond, which changes time only.
KEPT = 700_000
#: How byte-level vocabularies cut text into pieces; white space as Unicode defines it.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def _byte_letters() -> dict[str, int]:
    """The letter by which such vocabularies write each byte: itself if printable, else the next free one from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """A byte-level vocabulary (Hugging Face JSON) with its automaton and merge tables."""

    def __init__(self, rules: str):
        import ahocorasick
        import regex

        data, letters = json.loads(rules), _byte_letters()
        vocab = data["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.rank: dict[int, int] = {}  # of the merge that makes a token; bytes have none
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            made = vocab[left + right]
            self.joined[vocab[left], vocab[right]] = rank
            if made not in self.rank:
                self.rank[made], self.halves[made] = rank, (vocab[left], vocab[right])
        self.automaton = ahocorasick.Automaton()
        for i in vocab.values():
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.pieces = regex.compile(PIECES)
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.fits: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}

    def _fit(self, left: int, right: int) -> bool:
        """True if ``left`` and ``right`` side by side stay two tokens: undo their merges, latest first, and see
        whether a pair across the border would have been merged before the merge undone last."""
        rank, never = self.rank, 1 << 60
        undone = never  # of the merge undone last
        last_is_right = True
        while True:
            across = self.joined.get((left, right), never)
            # Of equal ranks the leftmost goes first: a pair across the border comes before the merge of ``right``.
            if across < undone or across == undone != never and last_is_right:
                return False
            of_left, of_right = rank.get(left, -1), rank.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                undone, left, last_is_right = of_left, self.halves[left][1], False
            else:
                undone, right, last_is_right = of_right, self.halves[right][0], True

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        last, fits, sizes = [-1] * (len(data) + 1), self.fits, self.size_of
        for end, token in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - sizes[token]
            if start:
                before = last[start]
                if before < 0:
                    continue
                pair = before << 32 | token
                good = fits.get(pair)
                if good is None:
                    good = fits[pair] = self._fit(before, token)
                if not good:
                    continue
            last[end] = token
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end -= sizes[last[end]]
        return out[::-1]

    def _plain(self, text: str) -> bytes:
        out: list[bytes] = []
        if len(text) < 1 << 20:
            blocks = iter([self.pieces.findall(text)])
        else:  # a very long text in blocks of pieces
            found = (m[0] for m in self.pieces.finditer(text))
            blocks = iter(lambda: list(itertools.islice(found, 1 << 16)), [])
        for block in blocks:
            if len(self.kept) > KEPT:
                self.kept.clear()
            if len(self.fits) > KEPT:
                self.fits.clear()
            kept = self.kept
            for piece in set(block).difference(kept):
                kept[piece] = array("i", self.encode_piece(piece)).tobytes()
            out += map(kept.__getitem__, block)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as 32-bit integers."""
        out: list[bytes] = []
        at = 0
        for special in self.split.finditer(text):
            out += [self._plain(text[at : special.start()]), array("i", [self.added[special[0]]]).tobytes()]
            at = special.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:])]), np.int32)


_made: dict[str, Bpe] = {}


def _bpe(rules: _Held) -> Bpe:
    """This worker's tables, made once."""
    if rules.name not in _made:
        _made.clear()
        _made[rules.name] = Bpe(rules.held.value)
    return _made[rules.name]


class _Held:
    """The vocabulary (a file of a few MB) as a broadcast, with a name under which workers keep their tables."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as file:
            text = file.read()
        self.held = spark.sparkContext.broadcast(text)
        self.name = hashlib.sha256(text.encode()).hexdigest()


def bpe_encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs`` (doc_id, text), as the vocabulary at ``tokenizer_path``
    encodes it without special tokens added. Null and empty texts have no ids. Strings of special tokens in a
    text become their ids. Repeated rows are encoded each; other columns are ignored."""
    rules = _Held(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(rules)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                ids = [bpe.encode(t or "") for t in some.column("text").to_pylist()]
                ends = list(itertools.accumulate(map(len, ids), initial=0))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``encoded`` (doc_id, ids); bytes that aren't UTF-8 become U+FFFD.
    Null ids decode to an empty text; unknown ids are left out."""
    rules = _Held(encoded.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bpe(rules).bytes_of
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                texts = [b"".join([table.get(x, b"") for x in ids or ()]).decode("utf-8", "replace") for ids in some.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
