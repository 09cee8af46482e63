"""SimHash near-duplicates by fuzzy hashing with the Golay code.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each seen as a vector of 23 bits. The binary
Golay code of that length is perfect: every vector lies within 3 bits of exactly one of its 4,096 codewords. Of two
vectors at most 2 bits apart, some vector between them is at most 1 bit from either, so the codeword nearest to it lies
within 4 bits of both. A segment's keys are the codewords within 4 bits, one or six of them.

Two fingerprints that differ in at most 4 bits meet at a key of one of two kinds. If some segment has no difference, one
of the other two has at most 2: that pair of segments makes a key, the first as it is and the second by its codewords.
If every segment has a difference, none has more than 2, and the codewords of all three make a key. Keys have 33 to 36
bits, so buckets stay small up to billions of fingerprints. Fingerprints are joined on keys and verified in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints under one key that are compared pair by pair; beyond it they meet at the fingerprints between them.
BUCKET = 4096
#: Fingerprints of a bucket whose bits are compared all with all at once.
_TOGETHER = 64
#: Shingles that are hashed at once, few enough for their arrays to stay in cache.
_SHINGLES = 1 << 14
#: A-Z to lower case.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def xxh64(raw: bytes, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of the stretches ``raw[start : start + size]``, all at once; short ones, as shingles are, cost least."""
    padded = np.frombuffer(raw + bytes(8), np.uint8)
    wide = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    half = np.ndarray(len(padded) - 3, "<u4", padded, strides=(1,))
    n = size.astype(np.uint64)
    plus = lambda *x: np.uint64((seed + sum(map(int, x))) % (1 << 64))
    mix = lambda acc, lane: _rotated(acc + lane * _P2, 31) * _P1
    h, at, left = np.full(len(start), plus(_P5)), start.copy(), size.copy()
    long = np.flatnonzero(size >= 32)
    if len(long):
        acc = [np.full(len(long), s) for s in (plus(_P1, _P2), plus(_P2), plus(), plus(-int(_P1)))]
        stripes, live = size[long] // 32, np.arange(len(long))
        for k in range(int(stripes.max())):
            live = live[stripes[live] > k]
            for i in range(4):
                acc[i][live] = mix(acc[i][live], wide[start[long[live]] + 32 * k + 8 * i])
        v = sum((_rotated(x, r) for x, r in zip(acc, (1, 7, 12, 18), strict=True)), np.zeros(len(long), np.uint64))
        for x in acc:
            v = (v ^ mix(np.zeros(len(x), np.uint64), x)) * _P1 + _P4
        h[long] = v
        at[long] += stripes * 32
        left[long] -= stripes * 32
    h += n
    for k in range(3):
        some = np.flatnonzero(left >= 8 * (k + 1))
        if not len(some):
            break
        lane = mix(np.zeros(len(some), np.uint64), wide[at[some] + 8 * k])
        h[some] = _rotated(h[some] ^ lane, 27) * _P1 + _P4
    at, left = at + left // 8 * 8, left % 8
    some = np.flatnonzero(left >= 4)
    h[some] = _rotated(h[some] ^ half[at[some]].astype(np.uint64) * _P1, 23) * _P2 + _P3
    at, left = at + left // 4 * 4, left % 4
    for k in range(3):
        some = np.flatnonzero(left > k)
        h[some] = _rotated(h[some] ^ padded[at[some] + k].astype(np.uint64) * _P5, 11) * _P1
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """The XXH64 of every shingle, in order and with repeats; fewer words than ``shingle`` are one shingle, none are no shingle."""
    return hashes_of([text], shingle, seed)[0]


def hashes_of(texts: list[str | None], shingle: int, seed: int, at_once: int = 1 << 22) -> list[np.ndarray]:
    """``shingle_hashes`` of several texts; those of about ``at_once`` bytes together are hashed in one go, and so are the pieces of longer ones."""
    out: list[np.ndarray] = []
    held: list[bytes] = []

    def flush() -> None:
        whole = b" ".join(held)
        raw = np.frombuffer(whole, np.uint8)
        begin = np.cumsum([0] + [len(t) + 1 for t in held])
        gap = np.flatnonzero(raw == 32)
        start, end = np.concatenate(([0], gap + 1)), np.append(gap, len(raw))
        first = np.searchsorted(start, begin[:-1])
        count = np.diff(np.append(first, len(start)))
        # a text without words holds one empty word here
        count = np.where(np.diff(begin) == 1, 0, count)
        many = np.where(count > 0, np.maximum(1, count - shingle + 1), 0)
        of = np.repeat(np.arange(len(held)), many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        lo = first[of] + nth
        hi = np.minimum(lo + shingle, first[of] + count[of]) - 1
        h = np.concatenate([xxh64(whole, start[lo[i : i + _SHINGLES]], end[hi[i : i + _SHINGLES]] - start[lo[i : i + _SHINGLES]], seed) for i in range(0, len(lo), _SHINGLES)] or [np.empty(0, np.uint64)])
        out.extend(np.split(h, np.cumsum(many)[:-1]))

    size = 0
    for text in texts:
        held.append(b" ".join(text.encode("utf-8", "surrogatepass").translate(_LOWER).split()) if text else b"")
        size += len(held[-1]) + 1
        if size >= at_once:
            flush()
            held, size = [], 0
    if held:
        flush()
    return out


def folded(h: np.ndarray) -> int:
    """Bit set if it is in over half of the hashes; zero if there are none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    return folded(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, *, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row of ``docs`` (doc_id, text); ``fp`` is the fingerprint as a signed long. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([folded(h) for h in hashes_of(b.column(1).to_pylist(), shingle, seed)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


@cache
def codeword_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each of 2**23 vectors: the index of its nearest codeword, and by syndrome the codewords within 4 bits.

    The second has a row of up to 6 differences (codeword xor vector) for each of 2,048 syndromes, -1 where there are fewer.
    """
    rest = np.arange(1 << 23, dtype=np.int32)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    near: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for ones in combinations(range(23), weight):
            e = sum(1 << i for i in ones)
            near[rest[e]].append(e)
    table = np.full((2048, max(map(len, near))), -1, np.int32)
    for s, errors in enumerate(near):
        table[s, : len(errors)] = errors
    return rest.astype(np.int16), table


def segment_keys(segment: np.ndarray) -> np.ndarray:
    """Indices (their 12 message bits) of the codewords within 4 bits of each vector, -1 where there are fewer."""
    rest, table = codeword_keys()
    errors = table[rest[segment]]
    return np.where(errors >= 0, (segment[:, None] ^ errors) >> 11, -1)


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    u = fps.view(np.uint64)
    return [(u >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def _crossed(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, row) of every combination of the rows' numbers of 12 bits, -1 being none."""
    out, good = parts[0], parts[0] >= 0
    for p in parts[1:]:
        out = (out[:, :, None] << 12 | np.maximum(p, 0)[:, None, :]).reshape(len(out), -1)
        good = (good[:, :, None] & (p >= 0)[:, None, :]).reshape(len(good), -1)
    return out[good], np.nonzero(good)[0]


def pair_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of 26 bits, index into fps) of every pair of segments and of their codewords: a looser meeting than that of ``bucket_keys``."""
    near = [segment_keys(x).astype(np.int64) for x in _segments(fps)]
    made = [(key | p << 24, at) for p, (a, b) in enumerate(combinations(near, 2)) for key, at in [_crossed(a, b)]]
    return np.concatenate([k for k, _ in made]), np.concatenate([at for _, at in made])


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index into fps) such that fingerprints at most 4 bits apart share one: a segment as it is beside the codewords of another, and the codewords of all three."""
    own = _segments(fps)
    near = [segment_keys(x).astype(np.int64) for x in own]
    made = []
    for kind, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        good = near[j] >= 0
        made.append(((own[i][:, None] << 12 | np.maximum(near[j], 0))[good] | kind << 36, np.nonzero(good)[0]))
    key, at = _crossed(*near)
    made.append((key | 6 << 36, at))
    return np.concatenate([k for k, _ in made]), np.concatenate([at for _, at in made])


def bit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def forest(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join whatever links within ``radius`` join in ``fps``: from each reached one to those it reaches first."""
    left, links = fps, []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, front = front[0], front[1:]
            close = bit_distance(left, np.full(len(left), at)) <= radius
            if close.any():
                links.append((np.full(close.sum(), at), left[close]))
                front, left = np.concatenate((front, left[close])), left[~close]
    return links


def _link_buckets(radius: int):
    """Rows come sorted by key; a bucket may go on over several batches."""

    def one(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((start, [len(key)])))
        none = np.empty(0, np.int64)
        a, b = [none], [none]
        left = start[size > _TOGETHER].tolist()
        for n in np.unique(size[(size > 1) & (size <= _TOGETHER)]).tolist():
            of = start[size == n]
            for i in range(0, len(of), max(1, (1 << 22) // (n * n))):
                part = of[i : i + max(1, (1 << 22) // (n * n))]
                x = fp[part[:, None] + np.arange(n)]
                near = bit_distance(x[:, :, None], x[:, None, :]) <= radius
                near[:, np.arange(n), np.arange(n)] = False
                rows, hub = np.arange(len(x)), near.sum(2).argmax(1)
                by_hub = near[rows, hub]
                # mostly all that have company have that of the hub
                apart = near.any(2) & ~by_hub
                apart[rows, hub] = False
                apart = apart.any(1)
                g, at = np.nonzero(by_hub & ~apart[:, None])
                a.append(x[g, hub[g]])
                b.append(x[g, at])
                left += part[apart].tolist()
        sizes = dict(zip(start.tolist(), size.tolist(), strict=True))
        for s in left:
            for x, y in forest(fp[s : s + sizes[s]], radius):
                a.append(x)
                b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
        return pairs[0], pairs[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            key = np.concatenate((key, batch.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, batch.column(1).to_numpy(zero_copy_only=False)))
            if len(key) >= 200_000 and key[0] != key[-1]:
                cut = int(np.searchsorted(key, key[-1]))
                a, b = one(key[:cut], fp[:cut])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            a, b = one(key, fp)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), 20_000):
            key, at = bucket_keys(fps[i : i + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[i : i + 20_000][at])], ["key", "fp"])


def _emit_middles(radius: int):
    flips = np.array([sum(1 << i for i in ones) for w in range(radius // 2 + 1) for ones in combinations(range(64), w)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 500):
                part = fps[i : i + 500]
                middle = (part.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(middle), pa.array(np.repeat(part, len(flips)))], ["middle", "fp"])

    return run


def fingerprint_links(fps: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between different fingerprints of ``fps`` (fp, distinct) that differ in at most 4 bits, enough of them to join all that any such links join.

    A key with more than ``bucket`` fingerprints is not compared pair by pair. Its fingerprints meet at the fingerprints
    within 2 bits: any two at one such place are at most 4 bits apart, and any two at most 4 apart have such a place.
    """
    radius = 4
    keyed = written(fps.mapInArrow(_emit_keys, "key long, fp long"), "golay-keys")
    n = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    large = n.filter(F.col("n") > bucket).select("key")
    some_large = not large.isEmpty()
    small = keyed.join(large, "key", "left_anti") if some_large else keyed
    pairs = small.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_buckets(radius), "a long, b long")
    if some_large:
        middles = written(keyed.join(large, "key", "left_semi").select("fp").distinct().mapInArrow(_emit_middles(radius), "middle long, fp long"), "middles")
        hub = middles.groupBy("middle").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("middle", "a")
        pairs = pairs.union(middles.join(hub, "middle").filter("fp <> a").select("a", F.col("fp").alias("b")))
    return pairs.distinct()


def near_duplicate_groups(docs: DataFrame, *, shingle: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text; other columns are left out).

    Fingerprints that differ in at most 4 bits are linked; component_id is the smallest doc_id reachable. Texts without
    words (null too) share fingerprint zero. Equal fingerprints stand for one node, so groups of copies, whatever their
    size, cost one key; repeated rows appear as often as they come; a null id joins a group but never names one unless
    it is alone.
    """
    found = written(fingerprints(docs, shingle=shingle), "fingerprints")
    nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    groups = connected_components(fingerprint_links(nodes.select("fp"), bucket=bucket))
    named = nodes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return found.join(named.select("fp", "component").join(lowest, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The fingerprint and group of every row of ``docs`` (doc_id, text).

    Null and word-free texts have fingerprint zero and are linked like any other; repeated rows and ids appear as often as they
    come; a null id names a group only if it has no other. Without documents there is no row. Other columns are left out.
    """
    out = near_duplicate_groups(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
