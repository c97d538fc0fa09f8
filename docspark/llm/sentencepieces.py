"""Exact SentencePiece encoding of BPE models that keeps offsets, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map knows, and every normalised
character records the source byte it comes from. Pieces are merged by score; their bounds are then projected through
that alignment to byte spans of the original text.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Chunks whose ids a Python worker keeps; emptied beyond, which changes time only.
KEPT = 450_000
NEVER = float("inf")
#: Characters of a text that are cut into chunks at a time.
BLOCK = 1 << 20


def compiled_rules(blob: bytes) -> dict[str, str]:
    """What each source string of a compiled character map becomes: a double-array trie (its size in front), then the targets."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, targets = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
    offset = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
    found, todo = {}, [(offset(units[0]), b"")]
    while todo:
        base, key = todo.pop()
        if base < len(units) and units[base] >> 31 and key:  # the unit of label 0 holds a value
            at = units[base] & 0x7FFFFFFF
            found[key.decode()] = targets[at : targets.index(b"\0", at)].decode()
        for label in range(1, 256):
            child = base ^ label
            if child < len(units) and units[child] & 0x800000FF == label:
                todo.append((child ^ offset(units[child]), key + bytes([label])))
    return found


class Normaliser:
    """Longest-prefix replacement, white space rules and alignment of a model's normaliser."""

    def __init__(self, rules: dict[str, str], dummy: bool, squeeze: bool):
        self.rules, self.dummy, self.squeeze = rules, dummy, squeeze
        self.sizes: dict[str, list[int]] = {}  # lengths of rules by first character, longest first
        for key in rules:
            self.sizes.setdefault(key[0], []).append(len(key))
        self.sizes = {c: sorted(set(n), reverse=True) for c, n in self.sizes.items()}

    @staticmethod
    def _starts(text: str) -> np.ndarray:
        """Source byte of every character, and the number of bytes."""
        if text.isascii():
            return np.arange(len(text) + 1, dtype=np.int32)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        out = np.zeros(len(code) + 1, np.int32)
        np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), out=out[1:])
        return out

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters (and its end) the source byte it begins at."""
        if not text:
            return "", np.zeros(1, np.int32)
        starts = self._starts(text)
        if not self.rules:
            made, place = text, starts
        else:
            parts, places, at, done = [], [], 0, 0
            for i, c in enumerate(text):
                if i < at or c not in self.sizes:
                    continue
                for n in self.sizes[c]:
                    new = self.rules.get(text[i : i + n]) if i + n <= len(text) else None
                    if new is not None:
                        parts += [text[done:i], new]
                        places += [starts[done:i], np.full(len(new), starts[i], np.int32)]
                        at = done = i + n
                        break
            made = "".join([*parts, text[done:]])
            place = np.concatenate([*places, starts[done:]])
        if self.squeeze:
            made, place = self._squeezed(made, place)
            if not made:
                return "", place
        if self.dummy:
            made, place = " " + made, np.concatenate([place[:1], place])
        return made.replace(" ", SPACE), place

    @staticmethod
    def _squeezed(made: str, place: np.ndarray) -> tuple[str, np.ndarray]:
        """Without spaces at either end, and with one for each run within; at the end the sign for a space counts as one."""
        code = np.frombuffer(made.encode("utf-32-le", "surrogatepass"), "<u4")
        space = code == 0x20
        if space.all():
            return "", np.zeros(1, np.int32)
        keep = ~(space & np.concatenate([[True], space[:-1]]))
        last = len(made.rstrip(" " + SPACE))
        keep[last:] = False
        if not last or not keep.any():
            return "", place[int(np.argmin(space)) :][:1]
        return code[keep].tobytes().decode("utf-32-le", "surrogatepass"), np.append(place[:-1][keep], place[last])


class Pieces:
    """A BPE model file with its normaliser, pieces and scores."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        if trainer.model_type != trainer.BPE or not spec.escape_whitespaces or trainer.treat_whitespace_as_suffix or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("only BPE models with escaped white space before words, without user-defined or unused pieces")
        self.normalise = Normaliser(compiled_rules(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        self.strip = spec.add_dummy_prefix or spec.remove_extra_whitespaces
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.coded = {s: i << 32 | len(s) for s, i in self.id_of.items()}
        self.cost = {p.piece: -p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE} if trainer.byte_fallback else {}
        self.bytes_at = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.unknown, self.begin, self.end = (next((i for i, p in enumerate(proto.pieces) if p.piece == name), -1) for name in (trainer.unk_piece, trainer.bos_piece, trainer.eos_piece))
        self.surface: dict[int, bytes] = {i: b"" for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.surface |= {i: s.replace(SPACE, " ").encode() for s, i in self.id_of.items()} | self.bytes_at | {self.unknown: trainer.unk_surface.encode()}
        self.leading = {i for s, i in self.id_of.items() if s.startswith(SPACE)}
        self.silent = {i for i, b in self.surface.items() if not b and i not in self.bytes_at}
        # Where no piece holds two neighbours of some kinds, no merge crosses their border and texts are cut there.
        numbers = "".join(sorted({c for s in self.id_of for c in s if c.isalnum() and not c.isalpha()}))
        letter, other = rf"[^\W\d_{numbers}]", rf"(?:[\d_{numbers}]|[^\w{SPACE}])"
        holds = lambda *borders: any(re.search("|".join(borders), s) for s in self.id_of)
        if holds(f"[^{SPACE}]{SPACE}"):
            self.chunks = lambda s: [s]
        elif holds(letter + other, other + letter):
            self.chunks = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        else:
            self.chunks = re.compile(f"{SPACE}*(?:{letter}+|{other}+)|{SPACE}+").findall
        self.kept: dict[str, bytes] = {}

    def _merged(self, chunk: str) -> list[str]:
        """Symbols after all merges: cheapest first, of equal ones the leftmost."""
        if len(chunk) > 100:
            return self._merged_by_queue(list(chunk))
        symbols, cost, never = list(chunk), self.cost.get, NEVER
        costs = [cost(a + b, never) for a, b in itertools.pairwise(chunk)]
        while costs:
            least = min(costs)
            if least == never:
                break
            i = costs.index(least)
            one = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del costs[i]
            if i:
                costs[i - 1] = cost(symbols[i - 1] + one, never)
            if i < len(costs):
                costs[i] = cost(one + symbols[i + 1], never)
        return symbols

    def _merged_by_queue(self, symbols: list[str]) -> list[str]:
        """The same for long chunks, in n log n."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        cost = self.cost
        queue = [(cost[both], i, both) for i in range(len(symbols) - 1) if (both := symbols[i] + symbols[i + 1]) in cost]
        heapq.heapify(queue)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i]
            if j >= len(symbols) or not symbols[i] or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j], after[i] = both, "", after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(symbols) and (new := symbols[left] + symbols[right]) in cost:
                    heapq.heappush(queue, (cost[new], left, new))
        return [s for s in symbols if s]

    def _encoded(self, chunk: str) -> bytes:
        """Ids of a chunk (upper halves) and how many of its characters each covers; of a character in bytes the last one covers it."""
        symbols = self._merged(chunk)
        try:
            return array("Q", [self.coded[s] for s in symbols]).tobytes()
        except KeyError:
            pass
        ids, sizes = [], []
        for symbol in symbols:
            known = self.id_of.get(symbol)
            if known is None and self.byte_ids:
                some = [self.byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass")]
                ids += some
                sizes += [0] * (len(some) - 1) + [1]
            elif known is None and ids and ids[-1] == self.unknown:
                sizes[-1] += len(symbol)
            else:
                ids.append(self.unknown if known is None else known)
                sizes.append(len(symbol))
        return array("Q", [i << 32 | n for i, n in zip(ids, sizes)]).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text without begin and end, and the bounds of their byte spans, one more than ids."""
        made, place = self.normalise(text)
        found: list[bytes] = []
        at = 0
        while at < len(made):
            stop = min(at + BLOCK, len(made))
            while 0 < stop < len(made) and not (made[stop] == SPACE != made[stop - 1]):
                stop += 1
            chunks = self.chunks(made[at:stop])
            if len(self.kept) > KEPT:
                self.kept.clear()
            kept, long = self.kept, {}
            for chunk in set(chunks).difference(kept):
                (kept if len(chunk) < 64 else long)[chunk] = self._encoded(chunk)
            found += [long[c] if c in long else kept[c] for c in chunks] if long else map(kept.__getitem__, chunks)
            at = stop
        both = np.frombuffer(b"".join(found), "<u8")
        ends = np.zeros(len(both) + 1, np.int64)
        np.cumsum(both & np.uint64(0xFFFFFFFF), out=ends[1:])
        return (both >> np.uint64(32)).astype("<u4"), place[ends]

    def _text(self, ids: list[int]) -> str:
        surface = self.surface
        try:
            if self.silent.isdisjoint(ids[1:-1]):
                return b"".join([surface.get(i, b"") for i in ids]).decode()
        except UnicodeDecodeError:
            pass
        out = []  # bytes side by side are decoded together; each that begins no character becomes one U+FFFD
        for _, run in itertools.groupby(ids, lambda i: i in self.bytes_at):
            data = b"".join([surface.get(i, b"") for i in run])
            while data:
                try:
                    out.append(data.decode())
                    break
                except UnicodeDecodeError as e:
                    out += [data[: e.start].decode(), "\ufffd"]
                    data = data[e.start + 1 :]
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if i not in self.silent), None) if self.strip else None
        text = self._text(ids)
        if first in self.leading:
            return text[1:]
        return text


_made: dict[str, Pieces] = {}


def _pieces(held) -> Pieces:
    """This worker's model, read once."""
    name, model = held
    if name not in _made:
        _made.clear()
        _made[name] = Pieces(model.value)
    return _made[name]


def _held(spark, path: str):
    """The model (a file of under a MB) as a broadcast, and a name under which workers keep it."""
    with open(path, "rb") as file:
        model = file.read()
    return hashlib.sha256(model).hexdigest(), spark.sparkContext.broadcast(model)


def sentencepiece_encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, bounds) of every row of ``docs`` (doc_id, text), as the BPE model at ``model_path`` encodes it, with begin and end ids.

    ids are little-endian unsigned 32-bit integers in a binary; the i-th id covers the bytes bounds[i] to bounds[i + 1] of
    the text's UTF-8 (begin and end cover none; of a character in byte pieces the last one covers it). Null and empty
    texts have the begin and end ids alone. Texts are encoded whole, in blocks of bounded size where spaces allow it.
    Repeated rows are encoded each; no rows give none; other columns are ignored.
    """
    held = _held(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(held)
        begin, end = (np.array([i], "<u4").tobytes() for i in (model.begin, model.end))
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                done = [model.encode(t or "") for t in some.column("text").to_pylist()]
                ids = [begin + a.tobytes() + end for a, _ in done]
                bounds = [np.concatenate([b[:1], b, b[-1:]]) for _, b in done]
                ends = list(itertools.accumulate(map(len, bounds), initial=0))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bounds)))], names=["doc_id", "ids", "bounds"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, bounds array<int>")


def sentencepiece_decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, bounds, decoded) of every row of ``encoded``; bytes that aren't UTF-8 become U+FFFD each.
    Null ids decode to an empty text; ids that the model doesn't have are left out."""
    held = _held(encoded.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(held)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                texts = [model.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in some.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("doc_id", "ids", "bounds")), pa.array(texts, pa.string())], names=["doc_id", "ids", "bounds", "decoded"])

    return encoded.select("doc_id", "ids", "bounds").mapInArrow(run, "doc_id long, ids binary, bounds array<int>, decoded string")
