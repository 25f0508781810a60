"""Language ID and quality classifier: parts against plain versions, accuracy on held-out rows."""

from __future__ import annotations

import zlib

import numpy as np
from helpers import DATA

from quire.llm import language_id, quality_classifier
from quire.llm.sampling import bounded_sample, sample_per_group

SF = DATA.replace("sf0.001", "sf0.01")


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_language_query_on_held_out_documents(spark):
    rows = language_id.op6_language_id(spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    test = [r for r in rows if r["held_out"]]
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in test]
    assert np.mean(right) > 0.97
    assert abs(np.mean([r["score"] for r in test]) - np.mean(right)) < 0.05  # calibrated


def test_ngram_counts_match_a_plain_count():
    text = "Été, ab"
    at, counts = language_id.features(text, 14)
    assert counts.sum() == sum(len(f" {text.lower()} ") - n for n in range(3))
    assert language_id.features("", 14)[1].sum() == 3
    assert language_id.features("ABC")[0].tolist() == language_id.features("abc")[0].tolist()


def test_elastic_net_leaves_weights_out():
    random = np.random.default_rng(0)
    rows, y = [], random.integers(0, 2, 300)
    for label in y:
        rows.append((np.array([0 + label, *random.choice(np.arange(2, 100), 5, replace=False)]), np.ones(6)))
    strong, _ = language_id.follow_the_regularised_leader(rows, y, 100, 2, l1=2.0)
    weak, _ = language_id.follow_the_regularised_leader(rows, y, 100, 2, l1=0.0)
    assert (strong[2:] == 0).mean() > 0.5 > (weak[2:] == 0).mean()
    assert strong[0, 0] > 0 > strong[1, 0]


def test_temperature_undoes_overconfidence():
    random = np.random.default_rng(1)
    y = random.integers(0, 2, 4000)
    logits = np.zeros((4000, 2))
    logits[np.arange(4000), np.where(random.random(4000) < 0.8, y, 1 - y)] = np.log(4) * 5
    assert abs(language_id.calibrated_temperature(logits, y) - 5) < 0.3


def test_language_of_messy_rows(spark, messy, no_docs):
    model = language_id.train(messy)
    rows = language_id.identify(messy, model).collect()
    assert len(rows) == messy.count()
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (2, 3, 4, 7)} == {("und", 0.0)}
    assert all(r["lang_pred"] in {"en", "fr", "de"} for r in rows if r["doc_id"] in (1, 5, 6, 8, -9))
    kept = language_id.identified(messy, model, 0.0)
    assert kept.columns == messy.columns and {r["doc_id"] for r in kept.collect()} == {1, None, 5, 6, 8, -9}
    untrained = language_id.train(no_docs)
    assert {r["lang_pred"] for r in language_id.identify(messy, untrained).collect()} == {"und"}
    assert language_id.identify(no_docs, model).count() == 0


def test_quality_query_on_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in quality_classifier.op1_quality_classifier(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if held_out(r["doc_id"])]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == held_out(d) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for d, r in rows.items())
    assert np.mean([rows[r["doc_id"]]["predicted"] == r["quality"] for r in labels]) > 0.95


def test_sum_of_squares_identity_is_all_pairs():
    random = np.random.default_rng(2)
    x, w, v = random.normal(size=(3, 6)), random.normal(size=6), random.normal(size=(6, 4))
    m = quality_classifier.FactorisationMachine(np.zeros(1), np.ones(1), 0.3, w, v)
    pairs = [0.3 + r @ w + sum((v[i] @ v[j]) * r[i] * r[j] for i in range(6) for j in range(i)) for r in x]
    assert np.allclose(m.logits(np.tile(np.arange(6), 3), x.ravel(), np.array([0, 6, 12])), pairs)


def test_interactions_are_learned():
    random = np.random.default_rng(3)
    found, y = [], []
    for _ in range(600):
        a, b = random.integers(0, 2, 2)
        found.append((np.array([a, 2 + b]), np.full(2, 0.7), [0.0] * quality_classifier.N_STATS))
        y.append(a ^ b)
    m = quality_classifier.fit(found, np.array(y, np.float32), bits=4, epochs=40, rate=0.3)
    assert ((m.logits(*m.rows(found, 4)) > 0) == np.array(y)).mean() > 0.95


def test_quality_of_messy_rows(spark, messy, no_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (8, 0), (3, 0), (2, None), (7, 9), (None, 1), (99, 1)], "doc_id long, quality int")
    model = quality_classifier.train(messy, labels)
    rows = quality_classifier.score(messy, model).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    same = [r["score"] for r in rows if r["doc_id"] == 1]
    assert len(set(same)) == 2
    assert {r["score"] for r in quality_classifier.score(messy, quality_classifier.train(messy, labels.where("false"))).collect()} == {0.5}
    assert quality_classifier.score(no_docs, model).count() == 0 and quality_classifier.train(no_docs, labels) is None


def test_sample_is_bounded_and_stable(spark):
    rows = spark.range(1000)
    one, other = ({r["id"] for r in bounded_sample(x, "id", 50).collect()} for x in (rows.repartition(3), rows.repartition(7)))
    assert one == other and len(one) == 50
    assert bounded_sample(rows.where("false"), "id", 50).count() == 0 and bounded_sample(rows, "id", 5000).count() == 1000


def test_samples_are_bounded_under_ties_and_hold_rare_groups(spark):
    same = spark.range(3000).selectExpr("cast(null as long) id", "'en' lang", "'same text' text")
    rare = spark.range(3).selectExpr("id", "'eo' lang", "concat('t', id) text")
    many = spark.range(5000).selectExpr("id + 10 id", "if(id % 2 = 0, 'en', 'fr') lang", "concat('x', id) text")
    chosen = sample_per_group(same.unionByName(rare).unionByName(many), "lang", ["id", "text"], 300, 10)
    counts = {r["lang"]: r["count"] for r in chosen.dropDuplicates().groupBy("lang").count().collect()}
    assert counts["eo"] == 3 and counts["fr"] == 100 and counts["en"] <= 100
    assert bounded_sample(same.select("id"), "id", 5).count() == 1


def gram_feature(gram):
    """The feature of a 1-, 2- or 3-gram, in plain integers."""
    a, b, c = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D
    p = [ord(x) for x in gram]
    value = p[0] * a if len(p) == 1 else p[0] * b + p[1] * a * c
    if len(p) == 3:
        value = (p[0] * b + p[1] * a * c) * b + p[2] * a * a + c
    value %= 1 << 32
    return (value ^ value >> 15) * a % (1 << 32) >> 32 - language_id.BITS


def test_prediction_is_the_plain_formula(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.train(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    for row in docs.limit(20).collect():
        text = f" {row['text'].lower()} "
        counts = {}
        for n in (1, 2, 3):
            for i in range(len(text) - n + 1):
                at = gram_feature(text[i : i + n])
                counts[at] = counts.get(at, 0) + 1
        x = {at: np.log1p(c) * model.idf[at] for at, c in counts.items()}
        length = sum(v * v for v in x.values()) ** 0.5
        z = [sum(v / length * model.weights[at, k] for at, v in x.items()) + model.bias[k] for k in range(len(model.languages))]
        p = np.exp(np.array(z) / model.temperature - max(z) / model.temperature)
        p /= p.sum()
        assert got[row["doc_id"]]["lang_pred"] == model.languages[int(p.argmax())] and abs(got[row["doc_id"]]["score"] - p.max()) < 1e-9
