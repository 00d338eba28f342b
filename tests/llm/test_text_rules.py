"""Repetition rules, language ID, toxicity and quality."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidewright.llm import _text, langid, quality_cnn, queries, repetition, toxicity

from conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF01 = "/root/testdata/sf0.1"


def windows(words, k):
    c = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return {i + o for i in range(len(words) - k + 1) if c[tuple(words[i : i + k])] > 1 for o in range(k)}


def by_hand(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    longest = 0
    while longest < len(words) and windows(words, longest + 1):
        longest += 1
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(windows(words, 3)), len(windows(words, 4)), longest)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é\n#\t"), max_size=60) | st.none(), max_size=6))
def test_repetition_by_hand(texts):
    raw, offs = _text.texts(pa.array(texts, pa.string()))
    m = repetition.measure(raw, offs, 4)
    assert [tuple(int(m[c][i]) for c in repetition.COLUMNS) for i in range(len(texts))] == [by_hand(t or "") for t in texts]


def test_suffix_array_of_a_long_run():
    order, lcp = repetition.suffix_array(np.zeros(5000, np.int64), np.full(5000, 5000))
    assert list(order) == list(range(4999, -1, -1))
    assert list(lcp) == list(range(5000))


def test_repetition_of_odd_rows(odd_docs, no_docs, docs_of):
    rows = {(r["doc_id"], r["text"]): r for r in repetition.repetition(odd_docs).collect()}
    assert rows[1, None]["n_words"] == 0
    assert rows[1, None]["base_failed"]
    assert not rows[7, [k for k in rows if k[0] == 7][0][1]]["kept"]
    assert repetition.repetition(no_docs).count() == 0
    plain = " ".join(f"w{i}" for i in range(300))
    passage = " ".join(f"p{i}" for i in range(70))
    kept = {r["doc_id"]: r["kept"] for r in repetition.repetition(docs_of([(1, plain), (2, f"{plain} {passage} x {passage}")])).collect()}
    assert kept == {1: True, 2: False}


def test_languages_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in queries.op6_langid(spark, SF).collect()}
    lang = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    held = [d for d, r in got.items() if r["held_out"]]
    assert 150 < len(held) < 350
    assert np.mean([got[d]["lang_pred"] == lang[d] for d in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def out_of_place(text, profile, top):
    """Distance of a text's profile, by the definition."""
    symbols = [int(x) for x in langid._SYMBOL[np.frombuffer(text.encode(), np.uint8)]]
    padded, grams = [0, *symbols, 0], Counter()
    b = langid._BITS
    for i, x in enumerate(padded):
        if x:
            grams[x] += 1
            grams[1 << 3 * b | x << b | padded[i + 1]] += 1
            if padded[i - 1] == 0:
                grams[1 << 3 * b | x] += 1
            grams[2 << 3 * b | padded[i - 1] << 2 * b | x << b | padded[i + 1]] += 1
    mine = sorted(grams, key=lambda g: (-grams[g], g))[:top]
    place = {g: i for i, g in enumerate(profile)}
    return sum(abs(i - place[g]) if g in place else top for i, g in enumerate(mine))


def test_rank_distance_by_hand():
    texts = ["the cat and the hat", "der Hund und die Katze", "été", "x"]
    profiles = {"a": np.array([97, 101, 116, 1 << 21 | 116]), "b": np.array([100, 110, 101, 1 << 21 | 100, 114])}
    raw, offs = _text.texts(pa.array(texts))
    best, _ = langid.identify(raw, offs, profiles, 10)
    want = [int(np.argmin([out_of_place(t, list(p), 10) for p in profiles.values()])) for t in texts]
    assert list(best) == want


def test_languages_of_odd_rows(odd_docs, no_docs, spark):
    profiles = langid.train(odd_docs)
    got = {r["doc_id"]: r for r in langid.predict(odd_docs, profiles).collect() if r["doc_id"]}
    assert [got[d]["lang_pred"] for d in (1, 2, 3, 9)] == ["und"] * 4
    assert got[8]["lang_pred"] in profiles
    dash = spark.createDataFrame([(1, "—…"), (2, "ñ")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in langid.predict(dash, profiles).orderBy("doc_id").collect()] == [True, False]
    assert langid.train(no_docs) == {}
    assert {r["lang_pred"] for r in langid.predict(odd_docs, {}).collect()} == {"und"}
    assert langid.predict(no_docs, profiles).count() == 0


def auc(label, score):
    order = np.argsort(np.argsort(score))
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / pos.sum() / max(1, (~pos).sum())


def held_out(spark, query, label):
    got = query(spark, SF01).filter("held_out").toPandas()
    known = duckdb.sql(f"select doc_id, {label} as y from '{SF01}/labels.parquet'").df()
    return got.merge(known)


def test_toxicity_of_held_out_documents(spark):
    x = held_out(spark, queries.op4_toxicity, "toxic")
    assert auc(x["y"].to_numpy(), x["score"].to_numpy()) > 0.9
    assert ((x["predicted"] == 1) & (x["y"] == 0)).sum() < 0.04 * len(x)


def test_quality_of_held_out_documents(spark):
    x = held_out(spark, queries.op5_quality_cnn, "quality")
    assert auc(x["y"].to_numpy(), x["score"].to_numpy()) > 0.95
    assert ((x["predicted"] == 0) & (x["y"] == 1)).sum() < 0.03 * len(x)


def symbols(text):
    """The symbols of a text, by the definition."""
    out = []
    for x in (int(v) for v in toxicity._SYMBOL[np.frombuffer(text.encode(), np.uint8)]):
        if x or (out and out[-1]):
            out.append(x)
    return out


def ngrams_by_hand(text):
    padded = [0] * (toxicity.ORDER - 1) + symbols(text)
    return [tuple(padded[i : i + toxicity.ORDER]) for i in range(len(padded) - toxicity.ORDER + 1)]


def code_of(gram):
    return sum(x << toxicity.BITS * i for i, x in enumerate(reversed(gram)))


def test_ngrams_of_the_toxicity_model():
    texts = ["You clown, you!", None, "", "..a  b", "Été", "x", "--", "the end"]
    code, row = toxicity.grams(*_text.texts(pa.array(texts)))
    for i, t in enumerate(texts):
        assert [int(c) for c in code[row == i]] == [code_of(g) for g in ngrams_by_hand(t or "")]


def kneser_ney(texts):
    """Log-ratio of each n-gram and of each context, straight from the formulas, with no table and no join."""
    n, counts = toxicity.ORDER, [Counter(g for t, c in texts if c == cls for g in ngrams_by_hand(t)) for cls in (0, 1)]
    seen = set(counts[0]) | set(counts[1])

    def discount(c):
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return once / (once + 2 * twice) if once and twice else 0.5

    levels, now = {}, seen
    for size in range(n - 1, 0, -1):
        levels[size] = Counter(g[1:] for g in now)
        now = set(levels[size])

    def shared(g):
        if not g:
            return 1 / (1 << toxicity.BITS)
        c = levels[len(g)]
        d, all_, kinds = discount(c), sum(v for k, v in c.items() if k[:-1] == g[:-1]), sum(k[:-1] == g[:-1] for k in c)
        return (c[g] - d) / all_ + d * kinds / all_ * shared(g[1:])

    out = {}
    for h in {g[:-1] for g in seen}:
        left, own = [], []
        for c in counts:
            d, all_, kinds = discount(c), sum(v for k, v in c.items() if k[:-1] == h), sum(k[:-1] == h for k in c)
            left.append(d * kinds / all_ if all_ else 1.0)
            own.append(lambda g, c=c, d=d, a=all_: (c[g] - d) / a if c[g] else 0.0)
        out[h] = np.log(left[1] / left[0])
        for g in (g for g in seen if g[:-1] == h):
            like = [f(g) + x * shared(g[1:]) for f, x in zip(own, left, strict=True)]
            out[g] = np.log(like[1] / like[0])
    return out


TALK = [("you are a clown and a fool", 1), ("the fool on the hill", 0), ("clown shoes and a red nose", 0), ("you clown you fool", 1), ("a walk up the hill with you", 0), ("été en été", 1)]


def test_toxicity_models_by_hand(docs_of):
    docs = docs_of([(i, t) for i, (t, _) in enumerate(TALK)]).withColumn("cls", F.element_at(F.array(*[F.lit(c) for _, c in TALK]), (F.col("doc_id") + 1).cast("int"))).withColumn("tuned", F.lit(False))
    counts = toxicity.count(docs)
    totals = counts.agg(F.sum("n0"), F.sum("n1"), F.sum("t0")).first()
    assert tuple(totals) == (*[sum(len(ngrams_by_hand(t)) for t, c in TALK if c == cls) for cls in (0, 1)], 0)
    got = {r["key"]: r["ratio"] for r in toxicity.fit(counts).collect()}
    mark = 1 << (toxicity.BITS * toxicity.ORDER)
    want = {code_of(g) | (mark if len(g) < toxicity.ORDER else 0): x for g, x in kneser_ney(TALK).items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_lookup_finds_every_key():
    rng = np.random.Generator(np.random.PCG64(4))
    keys = np.unique(rng.integers(0, 1 << 36, 5000))
    table = toxicity.Lookup(keys, np.arange(len(keys), dtype=np.float32) + 1)
    asked = np.r_[keys, rng.integers(0, 1 << 36, 5000)]
    ratio, found = table.of(asked)
    place = {int(k): i + 1 for i, k in enumerate(keys)}
    assert [float(x) for x in ratio] == [float(place.get(int(k), 0)) for k in asked]
    assert list(found) == [int(k) in place for k in asked]
    assert not toxicity.Lookup(keys[:0], np.zeros(0, np.float32)).of(asked)[1].any()


def test_a_large_model_is_joined(odd_docs, spark, monkeypatch):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 0), (8, 1), (9, 0), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(toxicity.labelled(odd_docs, labels, "toxic"))
    model.weights[:] = np.linspace(-1, 1, toxicity.FEATURES)
    found = []
    for most in (toxicity.SENT_ENTRIES, 0):
        monkeypatch.setattr(toxicity, "SENT_ENTRIES", most)
        found.append(sorted((str(r["doc_id"]), str(r["text"]), round(r["score"], 5)) for r in toxicity.compare(odd_docs, model).collect()))
    assert found[0] == found[1]
    assert len({x[2] for x in found[0]}) > 1


def test_models_of_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(5, 1, 1), (6, 0, 0), (7, 0, 0), (8, 1, 0), (8, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for rows in (labels, labels.limit(0), labels.filter("doc_id = 6")):
        model = toxicity.train(toxicity.labelled(odd_docs, rows, "toxic"))
        got = toxicity.compare(odd_docs, model).collect()
        assert len(got) == 13
        assert all(0 <= r["score"] <= 1 for r in got)
        assert toxicity.compare(no_docs, model).count() == 0
        net = quality_cnn.train(odd_docs, rows)
        got = quality_cnn.score(odd_docs, net).collect()
        assert len(got) == 13
        assert all(0 <= r["score"] <= 1 for r in got)
        assert quality_cnn.score(no_docs, net).count() == 0


def test_training_takes_every_chunk():
    for n in (0, 1, 7, 8, 255, 256, 262, 263, 264, 512, 520, 700, 5000):
        rng = np.random.Generator(np.random.PCG64(n))
        raw = rng.integers(97, 120, n).astype(np.uint8)
        net = quality_cnn._train([b"a b c", b"zzzz" * 300], np.array([1, 0], np.float32), 1)
        _, begin, places = quality_cnn.chunks_of(np.array([n]))
        answers = quality_cnn.convolve(raw, net)
        own = np.stack([answers[b // quality_cnn.STRIDE :][:p].max(0) for b, p in zip(begin, places, strict=True)])
        assert np.allclose(own, quality_cnn.chunk_maxima(answers))


def test_long_texts_are_counted_in_parts(monkeypatch):
    raw, offs = _text.texts(pa.array(["the été cat " * 700]))
    whole = langid._counted(raw, offs)
    monkeypatch.setattr(langid, "PIECE", 1000)
    assert all((a == b).all() for a, b in zip(whole, langid.counted(raw, offs), strict=True))


def test_pooling_covers_the_whole_text():
    rng = np.random.Generator(np.random.PCG64(1))
    net = quality_cnn.Network(rng.normal(0, 1, (256, quality_cnn.EMBED)).astype(np.float32), rng.normal(0, 1, (quality_cnn.WIDTH * quality_cnn.EMBED, quality_cnn.FILTERS)).astype(np.float32), np.zeros(quality_cnn.FILTERS, np.float32), np.zeros(2 * quality_cnn.FILTERS + 1, np.float32))
    raw = rng.integers(32, 127, 400_000).astype(np.uint8)
    whole = quality_cnn.pooled(raw, np.array([0, len(raw)]), net)[0, : quality_cnn.FILTERS]
    direct = quality_cnn.convolve(raw, net).max(0)
    assert np.allclose(whole, direct, atol=1e-4)


@pytest.mark.parametrize("size", [0, 1, 7, 8, 511, 512, 513, 5000])
def test_pooling_of_any_length(size):
    net = quality_cnn._train([b"a b c", b"zzzz" * 300], np.array([1, 0], np.float32), 1)
    out = quality_cnn.pooled(np.full(size, 97, np.uint8), np.array([0, size]), net)
    assert np.isfinite(out).all()
