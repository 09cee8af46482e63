"""Language identification by n-gram filters with a bitmask of languages.

A bit-sliced Bloom filter is one table of language bitmasks: bit l of a row belongs to the filter of language l, so the
rows an n-gram hashes to, taken together by AND, give all languages that (may) contain it in one look-up. A text's
n-grams are counted by language, the counts are freed of expected false positives, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_bucket, written
from .textbytes import chunks

GRAM = 5
HASHES = 2
#: Rows of the filter at most: with 8 bytes for each 64 languages this bounds what is broadcast.
MAX_ROWS = 1 << 22
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def grams(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, piece) of every window of GRAM bytes within a piece; all that is no letter of ASCII nor beyond it is a space."""
    if len(raw) < GRAM:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    folded = _FOLD[raw].astype(np.uint64)
    n = len(raw) - GRAM + 1
    gram = folded[:n].copy()
    for i in range(1, GRAM):
        gram <<= np.uint64(8)
        gram |= folded[i : i + n]
    piece = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(raw))))
    inside = piece[:n] == piece[GRAM - 1 :]
    return gram[inside], piece[:n][inside]


def rows_of(gram: np.ndarray, rows: int) -> list[np.ndarray]:
    shift = np.uint64(64 - (rows.bit_length() - 1))
    return [(gram * m) >> shift for m in _MULTIPLIERS[:HASHES]]


@dataclass
class LanguageFilters:
    langs: list[str]
    table: np.ndarray  # (rows, words) of 64 languages each
    false_positive: np.ndarray
    coverage: np.ndarray  # of a language's own n-grams, the share that its filter has
    prior: int

    @staticmethod
    def build(langs: list[str], gram: np.ndarray, lang: np.ndarray, coverage: np.ndarray, prior: int) -> LanguageFilters:
        most = int(np.bincount(lang, minlength=1).max()) if len(lang) else 1
        rows = min(MAX_ROWS, 1 << max(10, (8 * most - 1).bit_length()))
        table = np.zeros((rows, -(-max(1, len(langs)) // 64)), np.uint64)
        for at in rows_of(gram, rows):
            np.bitwise_or.at(table, (at, lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
        full = np.array([(table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(langs))])
        return LanguageFilters(langs, table, full**HASHES, coverage, prior)

    def hits(self, gram: np.ndarray, piece: np.ndarray, pieces: int) -> np.ndarray:
        """(pieces, languages): how many of a piece's n-grams each language's filter has."""
        at = rows_of(gram, len(self.table))
        out = np.zeros((pieces, len(self.langs)), np.int64)
        for w in range(self.table.shape[1]):
            column = self.table[:, w]
            mask = column[at[0]]
            for x in at[1:]:
                mask &= column[x]
            some = np.flatnonzero(mask)
            mask, where = mask[some], piece[some]
            for i in range(w * 64, min(len(self.langs), w * 64 + 64)):
                out[:, i] = np.bincount(where[(mask >> np.uint64(i % 64) & np.uint64(1)).astype(bool)], minlength=pieces)
        return out

    def decide(self, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score); score is the winner's part of all languages' shares."""
        if not self.langs:
            return np.full(len(n), -1), np.zeros(len(n))
        free = np.maximum(0, hits - n[:, None] * self.false_positive) / (1 - np.minimum(self.false_positive, 0.999))
        share = free / self.coverage
        total = share.sum(1)
        best = np.where(total > 0, share.argmax(1), self.prior)
        return best, np.where(total > 0, share.max(1) / np.where(total > 0, total, 1), 0.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lang = b.column("l").to_numpy()
        for raw, starts, docs in chunks(b.column("text"), 1, GRAM - 1, str.lower, 4 << 20):
            gram, piece = grams(raw, starts)
            of = lang[docs[piece]]
            for i in np.unique(of):
                g, n = np.unique(gram[of == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i), pa.int64()), pa.array(g.view(np.int64)), pa.array(n)], ["l", "gram", "n"])


def fit(train: DataFrame, *, docs_per_lang: int = 1500, floor: int = 18, most_grams: int = 1 << 22, rival: float = 0.5) -> LanguageFilters:
    """Filters learned from ``train`` (text, lang, and row if it has that), of which about ``docs_per_lang`` documents of each language are used, chosen by a hash of row and text.

    ``row`` tells rows of one text apart, so that of a text that repeats as many rows are used as of others, and a
    language of few texts is learned from these; equal rows of one text are used all or not at all. It is no input of the filters.

    A language's filter gets the n-grams that make up at least 2**-floor of its own (so 2**floor of them at most), occur
    five times, and are at least ``rival`` times as frequent as in any other language, for texts hold passages of others.
    With many languages the floor rises, so that all of them together have ``most_grams`` n-grams at most.
    """
    train = train.filter("lang is not null and text is not null")
    draw = F.xxhash64(*(c for c in ("row", "text") if c in train.columns))
    sizes = sorted((r.lang, r.n) for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    langs = [lang for lang, _ in sizes]
    if not langs:
        return LanguageFilters([], np.zeros((1024, 1), np.uint64), np.empty(0), np.empty(0), 0)
    floor = min(floor, (most_grams // len(langs)).bit_length() - 1)
    known = F.create_map(*(F.lit(x) for i, (lang, n) in enumerate(sizes) for x in (lang, i)))
    share = F.create_map(*(F.lit(x) for lang, n in sizes for x in (lang, int(min(1, docs_per_lang / n) * 1_000_000))))
    taken = train.filter(F.pmod(draw, F.lit(1_000_000)) < share[F.col("lang")]).select(known[F.col("lang")].cast("long").alias("l"), "text")
    counts = written(taken.mapInArrow(_count, "l long, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n")), "lang-grams")
    totals = {r.l: r.n for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    rate = F.col("n") / F.create_map(*(F.lit(x) for i in range(len(langs)) for x in (i, float(max(1, totals.get(i, 0))))))[F.col("l")]
    rated = counts.withColumn("rate", rate)
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = rated.filter((F.col("n") >= 5) & (F.col("rate") >= 2.0**-floor)).join(top, "gram").filter(F.col("rate") >= rival * F.col("top")).select("l", "gram", "n").toArrow()
    lang, gram, n = (kept.column(c).to_numpy() for c in ("l", "gram", "n"))
    coverage = np.array([max(1, n[lang == i].sum()) / max(1, totals.get(i, 0)) for i in range(len(langs))])
    return LanguageFilters.build(langs, gram.view(np.uint64), lang, coverage, int(np.argmax([k for _, k in sizes])))


def predict(docs: DataFrame, model: LanguageFilters, *, with_text: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names, and ``_letter``, are replaced); only ``text`` is looked at.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if no language was learned. A text
    that no filter knows gets the most frequent language with score 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            hits, n = np.zeros((b.num_rows, len(m.langs)), np.int64), np.zeros(b.num_rows, np.int64)
            for raw, starts, of in chunks(b.column("text"), 1, GRAM - 1, str.lower):
                gram, piece = grams(raw, starts)
                np.add.at(hits, of, m.hits(gram, piece, len(starts)))
                np.add.at(n, of, np.bincount(piece, minlength=len(starts)))
            best, score = m.decide(hits, n)
            known = b.column("_letter").to_numpy(zero_copy_only=False).astype(bool) & (best >= 0)
            pred = [m.langs[i] if k else "und" for i, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))], [*kept, "lang_pred", "score"])

    docs = docs.drop("lang_pred", "score", "_letter")
    # texts need not come back if nobody asked for them
    kept = [c for c in docs.columns if c != "text"] if not with_text else docs.columns
    schema = T.StructType([*(f for f in docs.schema if f.name in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.withColumn("_letter", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))).mapInArrow(run, schema)


def learned(docs: DataFrame) -> LanguageFilters:
    """Filters from the documents whose id's remainder by 4 is not 2."""
    return fit(docs.filter(id_bucket("doc_id", 4) != 2).select("text", "lang", F.col("doc_id").alias("row")))


def op2_language(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The language of every row of ``docs`` (doc_id, text, lang), learned from documents that are not held out.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if there is nothing to learn from. Null
    languages and texts teach nothing; a null id is not held out; repeated rows are told apart nowhere and each is told.
    Without documents there is no row. Other columns are left out.
    """
    out = predict(docs.select("doc_id", "text"), learned(docs))
    return out.select("doc_id", F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
