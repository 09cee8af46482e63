"""Scores of documents under a language model: prediction by partial matching over bytes.

A text is its UTF-8 bytes and an end mark, after ORDER marks that stand before every text. The model is the trie of all
contexts of up to ORDER bytes of the training texts with the counts of what follows them. A byte is predicted by the longest
known context; what that has not seen escapes to the context one byte shorter, where what the longer ones have seen is
excluded, and at last to all bytes alike. Escapes are estimated by method D: of n symbols of u kinds, each kind gives half
a count to the escape. Probabilities after any context sum to one.

Counts are those of update exclusion: a context counts its symbols where no longer context had seen them, so each kind of
one longer context counts once; the longest contexts count all.

The trie has no bound, so no task holds it. Texts stand in blocks; a block gives its different grams (ORDER bytes of
context and the symbol) once, packed by buckets. In a bucket all grams meet that agree in the last SHARD bytes of context,
a part of the trie that is complete for the longer contexts; the shorter ones, whose number is bounded by the bytes, reach
every task. The logarithms for a block's grams then come back to the block. Words, for the base score, go the same way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from math import ceil, fsum, log10, sqrt
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, new_path, written
from .textbytes import mixed

#: Bytes of the longest context; a gram of these and a symbol is one long.
ORDER = 5
#: Bytes of context that a part of the trie shares.
SHARD = 3
#: UTF-8 bytes of the texts of a block, or one text.
BLOCK_BYTES = 64 << 20
#: Bytes that no UTF-8 has: what stands before a text, and its end.
BEFORE, END = 0xFE, 0xFF
#: Symbols: all bytes but BEFORE.
SYMBOLS = 255
_BYTE = np.uint64(8)
_SLICE = 1 << 22
#: Blocks whose grams of a bucket one task takes.
SALTED = 1024


def _low(n: int) -> np.uint64:
    """The mask of n bytes."""
    return np.uint64((1 << 8 * n) - 1)


def grams(raw: bytes, order: int = ORDER, size: int = _SLICE) -> Iterator[np.ndarray]:
    """The gram of every byte of a text and of its end, in order, in pieces."""
    full = bytes([BEFORE]) * order + raw + bytes([END])
    for at in range(0, len(raw) + 1, size):
        part = np.frombuffer(full[at : at + size + order], np.uint8)
        g = np.zeros(len(part) - order, np.uint64)
        for i in range(order + 1):
            g = g << _BYTE | part[i : len(g) + i]
        yield g


def word_keys(words: list[bytes]) -> np.ndarray:
    """128 bits of every word, as two numbers."""
    return np.frombuffer(b"".join(blake2b(w, digest_size=16).digest() for w in words), np.uint64).reshape(-1, 2)


def tokens(raw: bytes) -> list[bytes]:
    """Words with A-Z lower-cased; the end, which is no word, is the empty one."""
    return [*raw.lower().split(), b""]


def _text(value) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


def _found(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The value of each wanted key in sorted ``keys``, 0 if it is not there."""
    if not len(keys):
        return np.zeros(len(want))
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], 0.0)


class Trie:
    """The contexts of one length: counts of each symbol after each, sums and kinds of them, and ``shared``, what the symbols that a context has seen count after the context one byte shorter."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shorter: Trie | None, length: int):
        self.keys, self.counts = keys, counts
        self.contexts, at = np.unique(keys >> _BYTE, return_inverse=True)
        self.sums, self.kinds = np.bincount(at, self.counts, len(self.contexts)), np.bincount(at, minlength=len(self.contexts)).astype(np.float64)
        below = _found(shorter.keys, shorter.counts, keys & _low(length)) if shorter else np.zeros(len(keys))
        self.shared = np.bincount(at, below, len(self.contexts))


def shorter_counts(keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of ``length`` bytes of context, each counted once for each different one of ``keys``, one byte longer, that ends in it."""
    u, n = np.unique(keys & _low(length + 1), return_counts=True)
    return u, n.astype(np.float64)


def tries(keys: np.ndarray, counts: np.ndarray, longest: int, least: int, shorter: Trie | None = None) -> list[Trie]:
    """The tries of ``least`` to ``longest`` bytes of context, made of the longest's grams and their counts; ``shorter`` is the one before the first."""
    found = {longest: (keys, counts)}
    for k in range(longest - 1, least - 1, -1):
        found[k] = shorter_counts(found[k + 1][0], k)
    made = []
    for k in range(least, longest + 1):
        shorter = Trie(*found[k], shorter, k)
        made.append(shorter)
    return made


def log_probs(want: np.ndarray, by_length: list[Trie]) -> np.ndarray:
    """log10 of the probability of each gram's symbol after its context."""
    out, left = np.zeros(len(want)), np.ones(len(want), bool)
    gone_n, gone_kinds = np.zeros(len(want)), np.zeros(len(want))  # counts and kinds that are excluded
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(len(by_length) - 1, -1, -1):
            t, key = by_length[k], want & _low(k + 1)
            n, kinds, shared = (_found(t.contexts, v, key >> _BYTE) for v in (t.sums, t.kinds, t.shared))
            count = _found(t.keys, t.counts, key)
            here, escapes = left & (count > 0), left & (count == 0) & (n > gone_n)
            out[here] += np.log10((count - 0.5) / (n - gone_n))[here]
            out[escapes] += np.log10((kinds - gone_kinds) / 2 / (n - gone_n))[escapes]
            left &= ~here
            seen = n > 0
            gone_n, gone_kinds = np.where(seen, shared, 0), np.where(seen, kinds, 0)
    out[left] -= np.log10(SYMBOLS - gone_kinds[left])
    return out


class Lookup:
    """Values by key in a table of slots, for many look-ups at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys, first = np.unique(keys, return_index=True)
        values = values[first]
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits)
        taken, at = np.zeros(1 << self.bits, bool), self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = ~taken[at[left]]
            # of several that want a slot the last one written gets it
            self.keys[at[left[free]]] = keys[left[free]]
            self.values[at[left[free]]] = values[left[free]]
            taken[at[left[free]]] = True
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, want: np.ndarray) -> np.ndarray:
        """Every key wanted must be there: a block gave them all."""
        at = self._slot(want)
        out, wrong = self.values[at], np.flatnonzero(self.keys[at] != want)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.values[at[wrong]]
            wrong = wrong[self.keys[at[wrong]] != want[wrong]]
        return out


def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 24, 0
        for b in batches:
            made = []
            for n in b.column("size").to_pylist():
                if held and held + n > block_bytes:
                    block, held = block + 1, 0
                held += n + 1
                made.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.int64()), *b.columns], ["block", *b.schema.names])

    return run


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def summed(parts: list[Counts]) -> Counts:
    """(keys, more, n) with each (key, more) once, sorted; ``more`` is empty where keys are whole."""
    keys, more, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(more):
        keys, at = np.unique(keys, return_inverse=True)
        return keys, more, np.bincount(at, n, len(keys)).astype(np.int64)
    order = np.lexsort((more, keys))
    keys, more, n = keys[order], more[order], n[order]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])))
    return keys[new], more[new], np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n


class _Counted:
    """Counts of keys that come in pieces."""

    def __init__(self):
        self.parts: list[Counts] = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        self.held = 0

    def add(self, part: Counts) -> None:
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > 2 * _SLICE:
            self.parts = [self.total()]
            self.held = len(self.parts[0][0])

    def total(self) -> Counts:
        return summed(self.parts)


PACKED = "bucket int, keys binary, more binary, n binary"


def _packed(block: int | None, rows: list[tuple[int, Counts]]) -> pa.RecordBatch:
    """Rows of a bucket and its counts, with the block if there is one."""
    cols = [pa.array([b for b, _ in rows], pa.int32()), *(pa.array([c[i].tobytes() for _, c in rows], pa.binary()) for i in range(3))]
    names = ["bucket", "keys", "more", "n"]
    return pa.RecordBatch.from_arrays(cols, names) if block is None else pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), block)), *cols], ["block", *names])


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[int, Counts]]:
    for bucket, keys, more, n in zip(*(b.column(c) for c in ("bucket", "keys", "more", "n")), strict=True):
        yield bucket.as_py(), (np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(more.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int64))


def _bucketed(counts: Counts, bucket: np.ndarray) -> list[tuple[int, Counts]]:
    order = np.argsort(bucket, kind="stable")
    bucket, parts = bucket[order], [c[order] if len(c) else c for c in counts]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(bucket))
    return [(int(bucket[lo]), tuple(c[lo:hi] for c in parts)) for lo, hi in zip(cuts.tolist(), ends.tolist(), strict=True)]


def _items(order: int, buckets: int):
    """Rows (block, trains, text): what each block needs, its grams and, in the buckets after theirs, its words, with their counts in its training texts."""
    none = np.zeros(0, np.uint64)

    def flush(block: int, counted: _Counted, waiting: list[list[np.ndarray]], words: list[Counter]) -> pa.RecordBatch:
        for weight in (0, 1):
            count(counted, waiting[weight], weight)
        g = counted.total()
        shard = mixed(g[0] >> _BYTE & _low(SHARD)) % np.uint64(buckets)
        known = [*words[1], *(w for w in words[0] if w not in words[1])]
        keys = word_keys(known)
        w = keys[:, 0].copy(), keys[:, 1].copy(), np.array([words[1].get(w, 0) for w in known], np.int64)
        return _packed(block, _bucketed(g, shard.astype(np.int64)) + _bucketed(w, (w[1] % np.uint64(buckets)).astype(np.int64) + buckets))

    def count(counted: _Counted, waiting: list[np.ndarray], weight: int) -> None:
        if waiting:
            keys, n = np.unique(np.concatenate(waiting), return_counts=True)
            counted.add((keys, none, n * weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            for block, trains, text in zip(b.column("block").to_pylist(), b.column("trains").to_pylist(), b.column("text"), strict=True):
                if block != now:
                    if now is not None:
                        yield flush(now, counted, waiting, words)
                    now, counted, waiting, size, words = block, _Counted(), [[], []], [0, 0], [Counter(), Counter()]
                raw, weight = _text(text), int(trains)
                words[weight].update(tokens(raw))
                for g in grams(raw, order):
                    waiting[weight].append(g)
                    size[weight] += len(g)
                    if size[weight] >= _SLICE:
                        count(counted, waiting[weight], weight)
                        waiting[weight], size[weight] = [], 0
        if now is not None:
            yield flush(now, counted, waiting, words)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: one row for each bucket of a task."""
    now, counted = None, _Counted()
    for b in batches:
        for bucket, counts in _unpacked(b):
            if bucket != now:
                if now is not None:
                    yield _packed(None, [(now, counted.total())])
                now, counted = bucket, _Counted()
            counted.add(counts)
    if now is not None:
        yield _packed(None, [(now, counted.total())])


def _shorter(order: int, buckets: int):
    """The grams of one byte of context less than SHARD, with the number of different bytes before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, (keys, _, n) in _unpacked(b):
                if bucket < buckets:
                    k, many = shorter_counts(np.unique(keys[n > 0] & _low(SHARD + 1)), SHARD - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(many)], ["k", "n"])

    return run


def _code(order: int, buckets: int, low):
    """The merged buckets: beside each gram the logarithm of its probability in place of its count; words keep theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter = tries(*low.value, SHARD - 1, 0)
        for b in batches:
            for bucket, (keys, more, n) in _unpacked(b):
                if bucket < buckets:
                    values = log_probs(keys, shorter + tries(keys[n > 0], n[n > 0].astype(np.float64), order, SHARD, shorter[-1]))
                else:
                    values = n.astype(np.float64)
                yield _packed(None, [(bucket, (keys, more, values))])

    return run


def _given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, of each the coded one (without a block) first: for every other, its keys with their values."""
    known = None
    for b in batches:
        for block, (bucket, (keys, more, n)) in zip(b.column("block"), _unpacked(b), strict=True):
            if not block.is_valid:
                known = keys, more, n.view(np.float64)
                continue
            if len(more):
                # the first half of the key finds the first word that has it, the second half tells words apart
                at = np.searchsorted(known[0], keys)
                while len(wrong := np.flatnonzero(known[1][at] != more)):
                    at[wrong] += 1
            else:
                at = np.searchsorted(known[0], keys)
            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([bucket], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([known[2][at].tobytes()], pa.binary())], ["block", "bucket", "keys", "found"])


def _known_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many training tokens the buckets of words hold, and how many different ones."""
    for b in batches:
        n = [c for _, (_, _, c) in _unpacked(b)]
        yield pa.RecordBatch.from_arrays([pa.array([int(c.sum()) for c in n], pa.int64()), pa.array([int((c > 0).sum()) for c in n], pa.int64())], ["n", "kinds"])


def _scores(order: int, buckets: int, train_tokens: int, train_kinds: int):
    """The texts of a block and the values of its grams and words: the texts' scores."""
    whole = train_tokens + 0.1 * (train_kinds + 1)

    def run(texts: pa.Table, values: pa.Table) -> pa.Table:
        is_gram = values.column("bucket").to_numpy() < buckets

        def lookup(which: np.ndarray) -> Lookup:
            part = values.filter(pa.array(which))
            return Lookup(*(np.frombuffer(b"".join(part.column(c).to_pylist()), kind) for c, kind in (("keys", np.uint64), ("found", np.float64))))

        by_gram, by_word, cache = lookup(is_gram), lookup(~is_gram), {}
        n_tokens, n_known, base, score = [], [], [], []
        for text in texts.column("text"):
            raw = _text(text)
            counts = Counter(tokens(raw))
            new = [w for w in counts if w not in cache]
            if new:
                cache.update(zip(new, by_word(word_keys(new)[:, 0].copy()).tolist(), strict=True))
            total = found = 0
            logs = []
            for w, n in counts.items():
                c = cache[w]
                total += n
                found += n if c else 0
                logs.append(n * log10((c + 0.1) / whole))
            n_tokens.append(total)
            n_known.append(found)
            base.append(fsum(logs))
            score.append(fsum(float(by_gram(g).sum()) for g in grams(raw, order)))
        numbers = pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(np.full(len(score), train_tokens, np.int64)), pa.array(base, pa.float64()), pa.array(score, pa.float64())
        return pa.table([texts.column("doc_id"), texts.column("held_out"), *numbers], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _kept_in_place(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``df`` as a table bucketed by ``key`` in the shared folder: what comes later to the same key finds it there, unmoved."""
    spark, name = df.sparkSession, f"tidemark_{uuid4().hex}"
    df.write.option("compression", "zstd").option("path", new_path(spark, "ppm-texts")).bucketBy(parts, key).sortBy(key).saveAsTable(name)
    kept = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files are outside the warehouse
    return kept


def scored(docs: DataFrame, trains, held_out, *, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text), learned from those where ``trains`` holds.

    ``score`` is log10 of the model's probability of the text and its end, ``base_score`` that of its tokens by their counts
    alone. A null text is empty: one token, the end. Repeated rows appear and train as often as they come. Without training
    rows every symbol has the same probability. A text is scored whole in one task, whatever its length; other columns are left out.
    """
    if not SHARD <= order <= 7:
        raise ValueError("contexts have 3 to 7 bytes")
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = docs.select("doc_id", "text", F.coalesce(trains, F.lit(False)).alias("trains"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    rows = _kept_in_place(marked.mapInArrow(_blocks(block_bytes), f"block long, doc_id {id_type}, text string, trains boolean, held_out boolean, size long"), "block", parts)
    size, blocks = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_distinct("block")).first()
    # a block has a row for every bucket, so buckets grow with the root of the text
    buckets, salts = max(64, 4 * ceil(sqrt(size / (1 << 20)))), max(1, blocks // SALTED)

    items = written(rows.select("block", "trains", "text").mapInArrow(_items(order, buckets), f"block long, {PACKED}"), "ppm-items").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    bucket = ["bucket", "keys", "more", "n"]
    merged = items.repartition(parts, "bucket", "salt").sortWithinPartitions("bucket").select(*bucket).mapInArrow(_merged, PACKED)
    counts = written(merged.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_merged, PACKED), "ppm-counts")
    # at most 2**24 of them, whatever the input
    low = counts.mapInArrow(_shorter(order, buckets), "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").toArrow()
    low = spark.sparkContext.broadcast((low.column("k").to_numpy().astype(np.uint64), low.column("n").to_numpy()))
    n, kinds = counts.filter(F.col("bucket") >= buckets).mapInArrow(_known_words, "n long, kinds long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()

    coded = counts.mapInArrow(_code(order, buckets, low), PACKED).select(F.lit(None).cast("long").alias("block"), *bucket, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    asked = coded.union(items.select("block", *bucket, "salt")).repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("block").asc_nulls_first())
    found = asked.drop("salt").mapInArrow(_given_back, "block long, bucket int, keys binary, found binary")
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.select("block", "doc_id", "held_out", "text").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_scores(order, buckets, n, kinds), schema)


def op12_ppm(spark: SparkSession, docs: DataFrame, **bounds) -> DataFrame:
    """The scores of every document, learned from those whose crc32 of the id as text modulo 10 is not 0.

    A null id neither trains nor is held out. Null and empty texts are scored by their end alone; without documents there is
    no row. Repeated rows and ids appear and train as often as they come.
    """
    bucket = id_bucket("doc_id", 10)
    return scored(docs, bucket != 0, bucket == 0, **bounds)
