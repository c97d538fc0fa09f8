"""Packing by concatenate and cut: token totals, prefix sums, global offsets, fixed windows."""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docspark.plans.storage import written

#: Words, and pieces of words, whose ids a Python worker keeps; a table is emptied beyond, which changes time only.
KEPT_WORDS, KEPT_PIECES = 800_000, 500_000


class _Ids(dict):
    """Ids of words (runs without ASCII white space, which no token of this vocabulary holds), as bytes.

    Words of letters below U+0100 are lower-cased and cut as the vocabulary's rules say, and each different piece goes
    through the library's model once; all other words go through the whole library.
    """

    def __init__(self, rules: str, width: str):
        import json

        import regex
        from tokenizers import Tokenizer

        from docspark.llm.bpe import _byte_letters

        self.library = Tokenizer.from_str(rules)
        self.library.no_padding()
        self.library.no_truncation()
        self.model, self.code = self.library.model, {"<u2": "H", "<u4": "I"}[width]
        parts = json.loads(rules)["pre_tokenizer"]["pretokenizers"]
        self.cut = regex.compile(parts[0]["pattern"]["Regex"]).findall
        self.plain = regex.compile("[!-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]+").fullmatch
        self.letters = {byte: letter for letter, byte in _byte_letters().items()}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() or " " in piece:
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > KEPT_WORDS:
            self.clear()
        pieces = self.pieces
        if len(pieces) > KEPT_PIECES:
            pieces.clear()
        text = word.decode("utf-8", "replace")
        if word.isalpha():  # ASCII letters only
            text = text.lower()
            out = pieces.get(text)
            if out is None:
                out = pieces[text] = self._piece(text)
        elif b"<|" not in word and self.plain(text):
            found = []
            for piece in self.cut(text.lower()):
                ids = pieces.get(piece)
                if ids is None:
                    ids = pieces[piece] = self._piece(piece)
                found.append(ids)
            out = b"".join(found)
        else:
            out = array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = out
        return out


_kept: dict[str, _Ids] = {}


def _tokenised(rules, name: str, end_id: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _kept:
            _kept.clear()
            _kept[name] = _Ids(rules.value, width)
        ids_of, part, at = _kept[name].__getitem__, TaskContext.get().partitionId(), 0
        last = np.array([end_id], width).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                words = ((t or "").encode("utf-8", "surrogatepass").split() for t in some.column("text").to_pylist())
                ids = [b"".join([*map(ids_of, w), last]) for w in words]
                sizes = [len(x) // np.dtype(width).itemsize for x in ids]
                starts = list(itertools.accumulate(sizes, initial=at))
                at = starts.pop()
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64()), some.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["part", "at", "doc_id", "doc_tokens", "ids"])

    return run


def _cut(window: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc_id, first, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "doc_tokens", "ids"))):
                values = np.frombuffer(ids, width).astype("<u4")
                start = 0
                while start < n:
                    length = min(window - (first + start) % window, n - start)
                    out.append((doc_id, start, length, n, (first + start) // window, (first + start) % window, values[start : start + length].tobytes()))
                    start += length
                    held += length
                    if held > 1 << 21:
                        yield _pieces(out)
                        out, held = [], 0
            yield _pieces(out)

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    columns = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(columns)], names=names)


def concatenate_and_cut(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, vocabulary: int = 49_408) -> DataFrame:
    """Token ids of all documents on one line, cut into windows of ``window`` ids.

    First pass: every document's ids and its offset in its partition are written; partition totals (one number a
    partition) are summed up in order. Second pass: with its partition's sum each document knows its global offset,
    and is cut where a window ends; such a boundary makes one more record. Only the last window is not full.

    ``docs`` has doc_id (long) and text. Returns one row per piece: doc_id, start (ids of its document before it),
    length, doc_tokens, sequence_id, offset (in its sequence), ids (little-endian unsigned 32-bit). A document's
    ids end with ``end_id``. Null and empty texts are that id alone. Repeated rows are packed each. No rows, no
    pieces. The order of documents is that of the input's partitions; a retried task gives the same order.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        text = file.read()
    rules = spark.sparkContext.broadcast(text)  # a vocabulary of a few MB
    width = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    schema = "part int, at long, doc_id long, doc_tokens long, ids binary"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = written(docs.mapInArrow(_tokenised(rules, f"{hashlib.sha256(text.encode()).hexdigest()} {width}", end_id, width), schema), "packing-ids")
    totals = lines.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))  # a row for each partition of the input
    placed = lines.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("first"), "doc_tokens", "ids")
    return placed.mapInArrow(_cut(window, width), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
