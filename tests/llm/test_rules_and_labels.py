import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import langid, quality_classifier, quality_rules, votes


def test_statistics_equal_the_plain_ones(spark, sf, texts):
    for r in quality_rules.op1_quality_rules(spark, sf).collect():
        s = brute.stats(texts[r.doc_id].text)
        assert {k: r[k] for k in s} == s
        assert r.base_failed == (s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"])
        assert not (r.kept and r.base_failed)


def test_rules_keep_good_documents(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality_rules.op1_quality_rules(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == bool(labels[r.doc_id]) for r in rows) >= 0.95 * len(rows)


def test_rules_on_odd_rows(edge, nothing):
    out = quality_rules.judge(edge)
    rows = out.collect()
    assert len(rows) == edge.count() and all(r.kept is not None for r in rows)
    assert {r.doc_id: r.stats.n_words for r in rows if r.doc_id in (2, 3, 4, 8)} == {2: 0, 3: 0, 4: 0, 8: 60_000}
    for r in rows:
        s = brute.stats(r.text)
        assert {k: r.stats[k] for k in s} == s
    assert out.columns.count("kept") == 1 and quality_rules.judge(nothing).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.8
    right = [(0.95, 0.6), (0.9, 0.4), (0.99, 0.5), (0.93, 0.7)]
    v = np.stack([np.where(rng.random(4000) < 0.2, 0, np.where(y, np.where(rng.random(4000) < g, 1, -1), np.where(rng.random(4000) < b, -1, 1))) for g, b in right], 1)
    model = votes.fit(v, np.ones(len(v)))
    assert np.abs(model.right - np.array(right)).max() < 0.12
    assert ((model.posterior(v) > 0.5) == y).mean() > 0.9
    assert votes.fit(v[:0], np.ones(0)).prior == 0.8
    assert (votes.unpack([0, 26, 13], 3) == [[-1, -1, -1], [1, 1, 1], [0, 0, 0]]).all()


def test_language_of_held_out_documents(spark, sf, texts):
    rows = langid.op4_language_id(spark, sf).collect()
    assert all(r.held_out == brute.is_held_out(r.doc_id) for r in rows)
    test = [r for r in rows if r.held_out and texts[r.doc_id].lang]
    assert sum(r.lang_pred == texts[r.doc_id].lang for r in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_on_odd_rows(docs, edge, nothing):
    model = langid.train(docs)
    rows = langid.predict(edge, model).collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert langid.predict(nothing, model).count() == 0
    none = langid.train(nothing)
    assert none[0] == [] and {r.lang_pred for r in langid.predict(edge, none).collect()} == {"und"}


def plain_sum(w, prob, names):
    """Sum over all segmentations, longest prefix last."""
    alpha = [1.0] + [0.0] * len(w)
    for i in range(len(w)):
        for j in range(i + 1, len(w) + 1):
            if w[i:j] in names:
                alpha[j] += alpha[i] * prob[names[w[i:j]]]
    return alpha[-1]


@pytest.fixture(scope="module")
def lattice_case():
    p = langid.pieces(langid.public_tokenizers.path(langid.VOCABULARY))
    prob = np.random.default_rng(2).random((p.size, 2)) / p.size
    longest = max(p.names, key=len)
    words = [b"the", b"thing", b"\xc3\xa9t\xc3\xa9", b"x", max((n for n in p.names if n[:1] != b" "), key=len), b"a" + longest.strip() + b"ing", b"International" * 4]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return p, prob, words, data, ends - [len(w) for w in words], ends, {n: i for i, n in enumerate(p.names, 1)}


def test_forward_sums_all_segmentations(lattice_case):
    p, prob, words, data, starts, ends, names = lattice_case
    logs = langid.word_logs(p, np.log(prob), data, starts, ends)
    for i, w in enumerate(words):
        for k in range(2):
            assert logs[i, k] == pytest.approx(np.log(plain_sum(b" " + w.lower(), prob[:, k], names)), rel=1e-9)


def test_expected_counts_are_derivatives_of_the_log_sum(lattice_case):
    p, prob, words, data, starts, ends, names = lattice_case
    got = langid.expected(p, np.log(prob), data, starts[3:6], ends[3:6], np.zeros(3, np.int64), np.ones(3))[:, 0]
    for piece in (b" ", b"x", b"a", b"i"):
        up = prob[:, 0].copy()
        up[names[piece]] *= 1 + 1e-6
        rise = sum(np.log(plain_sum(b" " + w.lower(), up, names) / plain_sum(b" " + w.lower(), prob[:, 0], names)) for w in words[3:6])
        assert got[names[piece]] == pytest.approx(rise / 1e-6, rel=1e-3, abs=1e-6)


def test_rare_pieces_and_long_words_do_not_underflow():
    p = langid.pieces(langid.public_tokenizers.path(langid.VOCABULARY))
    prob = np.full((p.size, 2), 0.05 / 1e12)
    prob[p.names.index(b"e") + 1, 0] = 1e-3
    word = bytes(range(128, 192)) * 400 + b"e"
    logs = langid.word_logs(p, np.log(prob), np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
    assert np.isfinite(logs).all() and logs[0, 0] > logs[0, 1]
    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
    assert 0 <= 1 / odds.sum() <= 1

def test_classifier_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table has too few labels to learn from
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in quality_classifier.op3_quality_classifier(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    good = [i for i in labels if labels[i].quality and not labels[i].toxic]
    bad = [i for i in labels if not labels[i].quality or labels[i].toxic]
    assert sum(rows[i].kept for i in good) >= 0.95 * len(good)
    assert sum(not rows[i].kept for i in bad) >= 0.8 * len(bad)


def test_classifier_on_odd_rows(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (8, 0)], "doc_id long, toxic int")
    rows = quality_classifier.classify(edge, labels=labels).collect()
    assert len(rows) == edge.count()
    assert all(not r.kept for r in rows if r.doc_id in (2, 3, 4)) and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality_classifier.classify(nothing).count() == 0
    assert edge.agg(F.count("*")).first()[0] == len(rows)
