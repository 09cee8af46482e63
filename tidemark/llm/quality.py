"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Each passage is encoded, a gated attention weighs the passages, and
the weighted sum of their codes is scored; only the document has a label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_bucket, written
from .textbytes import chunks, word_hashes

PASSAGE = 512
#: Kinds of bytes: lower, upper, digit, space, line end, stop, comma, mark, other symbol, bar, first and next bytes of longer letters.
_KINDS = np.array(
    [
        0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in (32, 9) else 4 if b in (10, 13) else 5 if b == 46 else 6 if b == 44 else 7 if b in (33, 63) else 9 if b == 124 else 10 if b >= 192 else 11 if b >= 128 else 8
        for b in range(256)
    ]
)
KINDS, SHAPES, TRIGRAMS, SKETCH = 12, 144, 64, 512
FEATURES = KINDS + SHAPES + TRIGRAMS + 3


def passages(raw: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, document) of each passage: shares of byte kinds, of neighbouring kinds and of hashed trigrams, words that follow themselves, how many different 8-byte windows there are, and length."""
    sizes = np.diff(np.append(starts, len(raw)))
    many = -(-sizes // PASSAGE)
    first = np.cumsum(many) - many
    at = np.arange(len(raw))
    p = np.repeat(first, sizes) + (at - np.repeat(starts, sizes)) // PASSAGE
    total = int(many.sum())
    n = np.bincount(p, minlength=total)

    def shares(bins: np.ndarray, of: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(of * width + bins, minlength=total * width).reshape(total, width) / n[:, None]

    kind = _KINDS[raw]
    out = [shares(kind, p, KINDS)]
    same = p[1:] == p[:-1]
    out.append(shares((kind[:-1] * KINDS + kind[1:])[same], p[1:][same], SHAPES))
    wide = raw.astype(np.uint64)
    for step, width in ((3, TRIGRAMS), (8, SKETCH)):
        if len(raw) < step:
            out.append(np.zeros((total, width)))
            continue
        m = len(raw) - step + 1
        h = np.zeros(m, np.uint64)
        for i in range(step):
            h = (h << np.uint64(8)) | wide[i : i + m]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - width.bit_length() + 1)
        inside = p[:m] == p[step - 1 :]
        out.append(shares(h[inside].astype(np.int64), p[:m][inside], width))
    sketch = out.pop()
    word, h = word_hashes(raw)
    again = np.bincount(p[word[1:]], h[1:] == h[:-1], minlength=total) / np.maximum(1, np.bincount(p[word], minlength=total))
    out += [again[:, None], (sketch > 0).sum(1, keepdims=True) / n[:, None], (n / PASSAGE)[:, None]]
    return np.concatenate(out, 1), np.repeat(docs, many)


class GatedAttention:
    """code = relu(x E + e); a = w . (tanh(code V) * sigmoid(code U)); score = sigmoid(c . sum(softmax(a) code) + b)."""

    def __init__(self, mean, scale, params):
        self.mean, self.scale, self.params = mean, scale, params

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, code) of passages; a weight is exp(a), and a is bounded by the sum of |w|."""
        E, e, V, U, w, _, _ = self.params
        code = np.maximum(0, (x - self.mean) / self.scale @ E + e)
        return np.exp((np.tanh(code @ V) / (1 + np.exp(-(code @ U)))) @ w), code

    def score(self, weight: np.ndarray, total: np.ndarray) -> np.ndarray:
        """From the sums of weights and of weighted codes of each document; no passages give the bias alone."""
        z = total / np.where(weight > 0, weight, 1)[:, None]
        return 1 / (1 + np.exp(-(z @ self.params[5] + self.params[6])))

    @staticmethod
    def fit(bags: list[np.ndarray], labels: np.ndarray, *, code: int = 24, gate: int = 12, epochs: int = 40, batch: int = 128, rate: float = 0.004, decay: float = 1e-4, seed: int = 1) -> GatedAttention:
        """By Adam on bags drawn with both labels equally often; the gradient is written out."""
        rng = np.random.default_rng(seed)
        every = np.concatenate(bags) if bags else np.zeros((1, FEATURES))
        mean, scale = every.mean(0), every.std(0) + 0.01
        D = every.shape[1]
        P = [rng.standard_normal((D, code)) / np.sqrt(D), np.zeros(code), rng.standard_normal((code, gate)) / np.sqrt(code), rng.standard_normal((code, gate)) / np.sqrt(code), rng.standard_normal(gate) * 0.1, np.zeros(code), np.zeros(1)]
        model = GatedAttention(mean, scale, P)
        if not len(labels):
            return model
        bags = [(b - mean) / scale for b in bags]
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
        m1, m2 = [np.zeros_like(p) for p in P], [np.zeros_like(p) for p in P]
        steps = max(1, epochs * len(bags) // batch)
        for t in range(1, steps + 1):
            pick = rng.choice(len(bags), batch, p=weight / weight.sum())
            x = np.concatenate([bags[i] for i in pick])
            cut = np.cumsum([0] + [len(bags[i]) for i in pick])[:-1]
            bag = np.repeat(np.arange(batch), [len(bags[i]) for i in pick])
            E, e, V, U, w, c, b = P
            pre = x @ E + e
            h = np.maximum(0, pre)
            th, sg = np.tanh(h @ V), 1 / (1 + np.exp(-(h @ U)))
            g = th * sg
            ex = np.exp(g @ w)
            at = ex / np.add.reduceat(ex, cut)[bag]
            z = np.add.reduceat(at[:, None] * h, cut)
            dy = (1 / (1 + np.exp(-(z @ c + b))) - labels[pick]) / batch
            dz = dy[:, None] * c
            da = (h * dz[bag]).sum(1)
            ds = at * (da - np.add.reduceat(at * da, cut)[bag])
            dg = ds[:, None] * w
            dth, dsg = dg * sg * (1 - th * th), dg * th * sg * (1 - sg)
            dpre = (at[:, None] * dz[bag] + dth @ V.T + dsg @ U.T) * (pre > 0)
            grads = [x.T @ dpre + decay * E, dpre.sum(0), h.T @ dth, h.T @ dsg, g.T @ ds, z.T @ dy + decay * c, np.array([dy.sum()])]
            lr = rate * (1 - 0.9 * t / steps)
            for k, d in enumerate(grads):
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                P[k] -= lr * m1[k] / (1 - 0.9**t) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
        return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(quality, x): the passages of each text, however many pieces it comes in, as one bag."""
    for b in batches:
        label, held = b.column("quality").to_numpy(), {}
        for raw, starts, docs in chunks(b.column("text"), PASSAGE):
            x, of = passages(raw, starts, docs)
            for i in np.unique(of).tolist():
                held.setdefault(i, []).append(x[of == i].astype(np.float32))
        bags = [np.concatenate(x).ravel() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(label[list(held)], pa.int64()), pa.array(bags, pa.list_(pa.float32()))], ["quality", "x"])


def fitting_sample(docs: DataFrame, labels: DataFrame, *, docs_per_label: int, longest: int, fit_bytes: int) -> DataFrame:
    """(doc_id, quality, th): the documents to fit on, and the hash of the text meant where an id has several."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    sizes = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("quality") == 1, min(1.0, docs_per_label / sizes.get(1, 1))).otherwise(min(1.0, docs_per_label / sizes.get(0, 1)))
    taken = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # ids and lengths of about docs_per_label documents a label: one task orders them
    one = F.min(F.struct(F.octet_length("text").cast("long").alias("n"), F.xxhash64("text").alias("th")))
    sized = docs.select("doc_id", "text").filter("text <> ''").join(F.broadcast(taken), "doc_id").groupBy("doc_id", "quality").agg(one.alias("s")).select("doc_id", "quality", "s.*")
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return sized.filter(F.col("n") <= longest).withColumn("bytes", F.sum("n").over(order)).filter(F.col("bytes") <= fit_bytes // 2).select("doc_id", "quality", "th")


def fit(docs: DataFrame, labels: DataFrame, *, docs_per_label: int = 2000, longest: int = 1 << 20, fit_bytes: int = 64 << 20) -> GatedAttention:
    """A model learned from ``labels`` (doc_id, quality 0 or 1) of ``docs`` (doc_id, text).

    It is fitted on a bounded sample: about ``docs_per_label`` documents of each label, chosen by a hash of the id, none
    longer than ``longest`` bytes, and ``fit_bytes`` of text in all, half for each label. That table of ids is broadcast, and
    the driver gets the passages of those texts, 1.8 times their bytes. Null labels and ids are left out, repeated ones
    count once (the larger label and the shortest text hold). Without labels every score is 0.5.
    """
    taken = written(fitting_sample(docs, labels, docs_per_label=docs_per_label, longest=longest, fit_bytes=fit_bytes), "quality-sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").filter(F.xxhash64("text") == F.col("th")).dropDuplicates(["doc_id"])
    bags = texts.select("quality", "text").mapInArrow(_bags, "quality long, x array<float>").toArrow()
    # the order of rows must not change the model
    rows = sorted(((y, np.array(x, np.float64).reshape(-1, FEATURES)) for y, x in zip(bags.column("quality").to_pylist(), (c.values.to_numpy() for c in bags.column("x")), strict=True)), key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return GatedAttention.fit([x for _, x in rows], np.array([y for y, _ in rows], np.float64))


def score(docs: DataFrame, model: GatedAttention) -> DataFrame:
    """(doc_id, score) of every whole text of ``docs`` (doc_id, text; other columns are left out). Null and empty texts have no passage and get the bias alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            weight, total = np.zeros(b.num_rows), np.zeros((b.num_rows, len(m.params[5])))
            for raw, starts, of in chunks(b.column("text"), PASSAGE):
                x, doc = passages(raw, starts, of)
                a, code = m.encode(x)
                np.add.at(weight, doc, a)
                np.add.at(total, doc, a[:, None] * code)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(m.score(weight, total))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op7_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The quality of every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, quality) that are not held out.

    Null and empty texts have no passage and all have one score; without labels every score is 0.5. A null id is not held
    out and has no label; repeated rows are scored each. Without documents there is no row. Other columns are left out.
    """
    model = fit(docs, labels.filter(id_bucket("doc_id", 5) != 0))
    held = F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
