"""Texts of a batch as byte arrays of bounded size, for vectorised counting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def chunks(texts: pa.Array, step: int, overlap: int = 0, fold=None, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, docs): pieces of whole texts laid end to end, where each begins, and the text it is of.

    A text longer than ``size`` comes in several pieces; all but its last have a multiple of ``step`` bytes, and
    ``overlap`` further bytes that the next piece has again. Null and empty texts have no piece.
    """
    held, starts, docs, n = [], [], [], 0
    size -= size % step
    for i, text in enumerate(texts):
        text = text.as_py()
        if not text:
            continue
        raw = (fold(text) if fold else text).encode("utf-8", "surrogatepass")
        for at in range(0, len(raw), size):
            piece = raw[at : at + size + overlap]
            if at and len(piece) <= overlap:
                continue
            held.append(piece)
            starts.append(n)
            docs.append(i)
            n += len(piece)
            if n >= size:
                yield np.frombuffer(b"".join(held), np.uint8), np.array(starts), np.array(docs)
                held, starts, docs, n = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(starts), np.array(docs)


_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_SLICE = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_LONG = 64


def _drawn(code: np.ndarray) -> np.ndarray:
    """A number for each byte at each place of a word, as if drawn at random."""
    return mixed((code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


_NEAR = _drawn(np.arange(_LONG * 256)).reshape(_LONG, 256)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of every word between ASCII white space."""
    edge = np.diff(np.concatenate(([0], (~_SPACE[raw]).astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word between ASCII white space; the hash is the same wherever the word stands.

    It is the sum of the numbers drawn for the word's bytes at their places: no polynomial, whose value at an odd base
    modulo 2**64 is the same for many regular words.
    """
    start, end = word_bounds(raw)
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, total = start[order], np.zeros(len(start), np.uint64)
    live = np.searchsorted(-size[order], -np.arange(_LONG))  # words longer than each place come first
    for place in range(_LONG):
        n = live[place]
        if not n:
            break
        total[:n] += _NEAR[place][raw[at[:n] + place]]
    for k in range(np.searchsorted(-size[order], -_LONG) if len(size) else 0):
        for a in range(_LONG, int(size[order[k]]), _SLICE):
            part = raw[at[k] + a : min(at[k] + a + _SLICE, end[order[k]])]
            total[k] += _drawn(np.arange(a, a + len(part)) << 8 | part).sum(dtype=np.uint64)
    h = np.empty(len(start), np.uint64)
    h[order] = total
    return start, mixed(h + size.astype(np.uint64))
