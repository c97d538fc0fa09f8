"""Vectorised hashes of words and word shingles, over whole texts in blocks of bounded size."""

from __future__ import annotations

import numpy as np

_B = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]  # A-Z count as a-z
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        ones = np.full(max(n, 2 * _BLOCK), base, np.uint64)
        ones[0] = 1
        _powers[name] = np.multiply.accumulate(ones)
    return _powers[name][:n]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word (run without x20, x09-x0D) of some bytes."""
    raw = np.frombuffer(data, np.uint8)
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _power("up", _B, len(raw)), out=total[1:])
    return start, mix((total[end] - total[start]) * _power("down", pow(_B, -1, 1 << 64), len(raw) + 1)[start])


def _pieces(data: bytes) -> list[bytes]:
    """Cut between words, so that no piece is much longer than a block unless one word is."""
    out, at = [], 0
    while len(data) - at > 2 * _BLOCK:
        cut = at + _BLOCK
        while cut < len(data) and not _SPACE[data[cut]]:
            cut += 1
        out.append(data[at:cut])
        at = cut
    return [*out, data[at:]]


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """For each text, the hashes of its words in order; null and empty texts have none. A-Z are folded to a-z."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            start, value = _words(b"\n".join(held))
            ends = np.cumsum([len(x) + 1 for x in held])
            out.extend(np.split(value, np.searchsorted(start, ends[:-1])))
        held, size = [], 0

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > 2 * _BLOCK:
            flush()
            out.append(np.concatenate([_words(x)[1] for x in _pieces(data)]))
            continue
        held.append(data)
        size += len(data)
        if size > _BLOCK:
            flush()
    flush()
    return out


def word_blocks(texts: list[str | bytes | None]):
    """All words in blocks: (index of its text for each word, the block's bytes, start, end and hash of each word).

    The bytes have two spaces before and after; texts longer than two blocks come in several.
    """
    held: list[bytes] = []
    owner: list[int] = []
    size = 0

    def made():
        raw = np.frombuffer(b"  " + b"\n".join(held) + b"  ", np.uint8)
        edge = np.flatnonzero(_SPACE[raw][1:] != _SPACE[raw][:-1]) + 1
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[raw] * _power("up", _B, len(raw)), out=total[1:])
        value = mix((total[end] - total[start]) * _power("down", pow(_B, -1, 1 << 64), len(raw) + 1)[start])
        ends = np.cumsum([len(x) + 1 for x in held]) + 2
        return np.array(owner)[np.searchsorted(ends, start, "right")], raw, start, end, value

    for i, text in enumerate(texts):
        for piece in _pieces(text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")):
            held.append(piece)
            owner.append(i)
            size += len(piece)
            if size > _BLOCK:
                yield made()
                held, owner, size = [], [], 0
    if held:
        yield made()


def _factor(j: int) -> np.uint64:
    return np.uint64(((2 * j + 1) * 0xD6E8FEB86659FD93 + 0x1000193 * j * j * 2) & _MASK | 1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; fewer words make one shingle of all of them; none makes none."""
    if not len(words):
        return words
    size = min(k, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total += words[j : j + n] * _factor(j)
    return mix(total)
