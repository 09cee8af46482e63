import random

import numpy as np
import pyarrow as pa
import zlib

from tidemark.llm import langid, quality
from tidemark.llm.textbytes import chunks

WORDS = {"aa": "the and of with that this".split(), "bb": "der die das und nicht ein".split(), "cc": "él ñu que los del más".split()}
SCHEMA = "doc_id long, text string, lang string, source string, score string"


def sentence(rnd, lang, n=60):
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "", "s", "er"]) for _ in range(n))


def corpus(n=400):
    rnd = random.Random(1)
    langs = [rnd.choice("aa bb cc".split()) for _ in range(n)]
    return [(i, sentence(rnd, lang) + " " + sentence(rnd, rnd.choice("aa bb cc".split()), 10), lang if i % 9 else None, "s", "x") for i, lang in enumerate(langs)], langs


def test_chunks_cover_texts_once():
    texts = pa.array(["abc", None, "", "x" * 25, "é" * 7])
    got = {}
    for raw, starts, docs in chunks(texts, 1, 0, None, 8):
        for a, b, d in zip(starts, [*starts[1:], len(raw)], docs, strict=True):
            got[d] = got.get(d, b"") + raw[a:b].tobytes()
    assert got == {0: b"abc", 3: b"x" * 25, 4: ("é" * 7).encode()}


def test_filter_hits_are_those_of_sets_up_to_false_positives():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 40, 2000).astype(np.uint64)) for _ in range(70)]
    gram, lang = np.concatenate(sets), np.repeat(np.arange(70), [len(s) for s in sets])
    m = langid.LanguageFilters.build([str(i) for i in range(70)], gram, lang, np.ones(70), 0)
    hits = m.hits(gram, lang, 70)
    assert (np.diag(hits) == [len(s) for s in sets]).all()
    own, score = m.decide(hits, np.array([len(s) for s in sets]))
    assert (own == np.arange(70)).all() and ((score > 0) & (score <= 1)).all()
    free = (hits - np.array([len(s) for s in sets])[:, None] * m.false_positive)[~np.eye(70, dtype=bool)]
    assert abs(free.mean()) < 10


def test_languages_of_held_out_documents(spark):
    rows, langs = corpus()
    odd = [(1000, None, "aa", None, ""), (1001, "", "bb", None, ""), (1002, "12 ,.; 3", "aa", None, ""), (1003, "Ж", None, None, ""), (None, "und nicht ein die das", None, None, ""), (1004, sentence(random.Random(2), "bb", 200_000), None, None, ""), (5, rows[5][1], None, None, "")]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    out = langid.op2_language(spark, df).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows + odd) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([by[i].lang_pred == lang for i, lang in enumerate(langs)]) > 0.97
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred in WORDS
    assert by[None].lang_pred == "bb" and by[1004].lang_pred == "bb"
    assert sorted(map(str, out)) == sorted(map(str, langid.op2_language(spark, df.repartition(5)).collect()))
    assert langid.op2_language(spark, df.limit(0)).collect() == []


def test_languages_are_those_of_a_plain_count(spark):
    """Each text's n-grams looked up one by one in the sets that the filters hold, and shares compared."""
    rows, _ = corpus(150)
    df = spark.createDataFrame(rows, SCHEMA)
    m = langid.learned(df)
    odd = [(200, "A" + "é" * 300 + " the of", None, None, ""), (201, "the", None, None, ""), (201, "the", None, None, ""), (202, "x " * 300_000, None, None, "")]
    out = sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.predict(spark.createDataFrame(rows + odd, SCHEMA).repartition(3), m).collect())

    def plain(text):
        raw = "".join(c for c in text.lower()).encode()
        folded = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in raw)
        grams = [int.from_bytes(folded[i : i + langid.GRAM], "big") for i in range(len(folded) - langid.GRAM + 1)]
        shares = []
        for k in range(len(m.langs)):
            hit = [all(int(m.table[int(at[0]), k // 64]) >> k % 64 & 1 for at in langid.rows_of(np.array([g], np.uint64), len(m.table))) for g in dict.fromkeys(grams)]
            known = dict(zip(dict.fromkeys(grams), hit, strict=True))
            n = sum(known[g] for g in grams)
            fp = m.false_positive[k]
            shares.append(max(0.0, n - len(grams) * fp) / (1 - min(fp, 0.999)) / m.coverage[k])
        if not sum(shares):
            return m.langs[m.prior], 0.0
        return m.langs[shares.index(max(shares))], round(max(shares) / sum(shares), 9)

    assert out == sorted((i, *plain(t)) for i, t, *_ in rows + odd)


def test_languages_of_one_repeated_text_are_learned(spark):
    """Three languages of a single text each beside one of many: all are told, whatever the hash of their texts."""
    words = ["alpha beta gamma delta epsilon", "uno dos tres cuatro cinco seis", "ichi ni san yon go roku nana"]
    rows = [(4 * i + k % 2, f"w{i % 97} zz{i % 89} qq{i % 83} yy{i % 79}", "yy") for k, i in enumerate(range(4000))]
    for j, text in enumerate(words):
        rows += [(4 * (10_000 * (j + 1) + i) + i % 2, text, f"l{j}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.select("text", "lang", docs.doc_id.alias("row")), docs_per_lang=100)
    told = langid.predict(spark.createDataFrame([(w, f"l{j}") for j, w in enumerate(words)] + [("w1 zz2 qq3 yy4", "yy")], "text string, want string"), model).collect()
    assert all(r.lang_pred == r.want and r.score > 0.3 for r in told)


def test_a_document_is_one_bag_and_its_score_that_of_a_plain_pass(spark):
    rnd = random.Random(6)
    texts = [sentence(rnd, "aa", 40), "Ä1. " * 700_000, "x", sentence(rnd, "cc", 900)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0, 1, 0]), pa.array(texts)], ["quality", "text"])
    bags = [np.array(x, np.float64).reshape(-1, quality.FEATURES) for b in quality._bags(iter([batch])) for x in b.column("x").to_pylist()]
    assert [len(b) for b in bags] == [-(-len(t.encode()) // quality.PASSAGE) for t in texts]
    m = quality.GatedAttention.fit(bags, np.array([1.0, 0, 1, 0]), epochs=3, batch=4)
    got = [r.score for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).orderBy("doc_id").collect()]
    E, e, V, U, w, c, b = m.params
    for x, score in zip(bags, got, strict=True):
        h = np.maximum(0, (x - m.mean) / m.scale @ E + e)
        a = np.exp((np.tanh(h @ V) / (1 + np.exp(-(h @ U)))) @ w)
        z = (a[:, None] * h).sum(0) / a.sum()
        assert abs(score - (1 / (1 + np.exp(-(z @ c + b))))[0]) < 1e-4


def test_fitting_sample_is_bounded(spark):
    rnd = random.Random(9)
    docs = [(i, sentence(rnd, "aa", rnd.randint(5, 200))) for i in range(200)] + [(200, "z" * 50_000), (3, "again"), (None, "t"), (201, None)]
    labels = [(i, i % 2) for i in range(202)] + [(None, 1), (5, None), (4, 1)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int")
    taken = quality.fitting_sample(d, lab, docs_per_label=60, longest=5_000, fit_bytes=20_000).collect()
    size = {}
    for i, t in docs:
        size[i] = min(size.get(i, 1 << 60), len((t or "").encode()))
    for y in (0, 1):
        assert 0 < sum(size[r.doc_id] for r in taken if r.quality == y) <= 10_000
    assert len({r.doc_id for r in taken}) == len(taken) and not {200, 201, None} & {r.doc_id for r in taken}
    assert sorted(map(str, taken)) == sorted(map(str, quality.fitting_sample(d.repartition(2), lab, docs_per_label=60, longest=5_000, fit_bytes=20_000).collect()))


def test_gradient_is_right_enough_to_learn_one_bad_passage():
    rng = np.random.default_rng(3)
    bags, labels = [], []
    for i in range(300):
        b = rng.standard_normal((rng.integers(2, 9), 10))
        if i % 2:
            b[0, 3] += 6
        bags.append(b)
        labels.append(i % 2)
    m = quality.GatedAttention.fit(bags[:200], np.array(labels[:200], float), epochs=60)
    right = 0
    for b, y in zip(bags[200:], labels[200:], strict=True):
        a, code = m.encode(b)
        right += (m.score(np.array([a.sum()]), (a[:, None] * code).sum(0)[None])[0] >= 0.5) == y
    assert right > 90


def test_quality_of_held_out_documents(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        text, good = sentence(rnd, "aa", 250), rnd.random() < 0.6
        if not good:
            at = rnd.randint(0, 800)
            text = text[:at] + " ### $$$ " + text[at : at + 600].upper() + "!! " * 20 + text[at + 600 :]
        rows.append((i, text, None, None, "x"))
        labels.append((i, int(good), 0))
    odd = [(900, None, None, None, ""), (901, "", None, None, ""), (902, "y" * 3_000_000, None, None, ""), (None, "a b", None, None, "")]
    lab = spark.createDataFrame(labels + [(900, 1, 0), (None, 1, 0), (3, None, 0), (0, labels[0][1], 1)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    out = {r.doc_id: r for r in quality.op7_quality(spark, df, lab).collect()}
    assert len(out) == len(rows + odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held) and np.mean([out[i].predicted == labels[i][1] for i in held]) > 0.93
    assert {r.score for r in quality.op7_quality(spark, df.limit(5), lab.limit(0)).collect()} == {0.5}
    assert quality.op7_quality(spark, df.limit(0), lab).collect() == []
