"""Multiple-instance toxicity: learning from document labels, finding sentences."""

import math

from pyspark.sql import functions as F

from paritas.llm import common, toxicity
from tests.conftest import SF_MID

FIT = toxicity.Fit(per_class=200, steps=120)


def bags():
    clean = [("The cat sat down. A dog ran away! It was fine.\nGood day here.", 0)] * 30 + [("Nice words only. And more of them.", 0)] * 30
    return clean + [(f"The cat sat down. You awful creep {w}. It was fine.", 1) for w in ("now", "here", "away", "down")] * 10


def test_noisy_or_and_offending_sentence():
    scorer = toxicity.Scorer(toxicity.train(bags(), FIT))
    text = "It was fine. İ you awful creep! Good day here."
    score, found = scorer.score(text)
    assert score > 0.7 and [text[s:e].strip() for s, e, _ in found] == ["İ you awful creep"]
    assert scorer.score("Good day here. A dog ran away!")[0] < 0.1
    p = [toxicity.Scorer(scorer.model).score(x)[0] for x in text.split(".") if x.strip(" !.")]
    assert scorer.score("")[0] == 0 and scorer.score("... !\n")[0] == 0 and max(p) <= score + 1e-9
    parts = [z for _, _, w in toxicity.sentences(text) for z in [scorer.model.bias + sum(map(scorer.weight, w))]]
    assert math.isclose(score, 1 - math.prod(1 - 1 / (1 + math.exp(-z)) for z in parts), rel_tol=1e-9)


def test_one_class_only():
    assert toxicity.Scorer(toxicity.train([("a b", 1)], FIT)).score("a b")[0] < 0.01


def test_training_rows_are_bounded_allowed_and_whole(sp):
    docs = sp.createDataFrame([(i, f"text {i}", 1) for i in range(50)] + [(3, "text 3", 1), (60, None, 1), (None, "x", 1)],
                              "doc_id bigint, text string, toxic int")
    labels = sp.createDataFrame([(i, 0, i % 2) for i in range(60)] + [(3, 0, 0), (4, 0, None), (None, 0, 1)],
                                "doc_id bigint, quality int, toxic int")
    fit = toxicity.Fit(per_class=10)
    got = toxicity.training_rows(docs, labels, F.col("row_key") % 5 != 0, fit).collect()
    assert len(got) == 20 and sum(r.row_label for r in got) == 10
    assert all(int(r.row_text.split()[1]) % 5 and r.row_label == int(r.row_text.split()[1]) % 2 for r in got)


def test_spark_scores_and_edge_cases(sp):
    model = toxicity.train(bags(), FIT)
    df = sp.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, "You awful creep away.", 9.0), (3, "You awful creep away.", 9.0)],
                            "doc_id bigint, text string, score double")
    got = sorted((r.doc_id, round(r.score, 3) > 0.7, len(r.offending)) for r in toxicity.scored(df, model).collect())
    assert got == [(1, False, 0), (2, False, 0), (3, True, 1), (3, True, 1)]
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert toxicity.scored(df.limit(0), model).count() == 0


def test_held_out_accuracy(sp):
    docs, labels = common.table(sp, SF_MID, "documents"), common.table(sp, SF_MID, "labels")
    model = toxicity.fitted(docs, labels, common.crc_of(F.col("row_key")) % 3 != 1)
    got = toxicity.scored(docs, model).join(labels, "doc_id").where(common.crc_of(F.col("doc_id")) % 3 == 1).collect()
    wrong_clean = [r for r in got if r.toxic == 0 and r.score >= toxicity.THRESHOLD]
    caught = [r for r in got if r.toxic == 1 and r.score >= toxicity.THRESHOLD]
    assert len(got) > 80 and not wrong_clean and len(caught) >= 0.5 * sum(r.toxic for r in got)


def test_training_against_numeric_gradients():
    """The same steps with every sentence in a plain loop and the gradient of the
    noisy-or likelihood by central differences."""
    fit = toxicity.Fit(per_class=200, steps=25)
    rows = bags()[::3]
    model = toxicity.train(rows, fit)
    names = sorted(model.weights)
    docs = [([[f for w in words for f in toxicity.features(w) if f in model.weights] for _, _, words in toxicity.sentences(t)], y) for t, y in rows]

    def loss(w):
        total = 0.0
        for sents, y in docs:
            clean = math.prod(1 - 1 / (1 + math.exp(-(w[""] + sum(w[f] for f in s)))) for s in sents)
            total -= math.log(1 - clean) if y else math.log(clean)
        return total / len(docs) + fit.l2 / 2 * sum(w[f] ** 2 for f in names)

    w = dict.fromkeys(names, 0.0) | {"": fit.start}
    m, v, e = dict.fromkeys(w, 0.0), dict.fromkeys(w, 0.0), 1e-6
    for step in range(1, fit.steps + 1):
        g = {f: (loss({**w, f: w[f] + e}) - loss({**w, f: w[f] - e})) / (2 * e) for f in w}
        for f in w:
            m[f], v[f] = 0.9 * m[f] + 0.1 * g[f], 0.99 * v[f] + 0.01 * g[f] ** 2
            w[f] -= fit.rate * (m[f] / (1 - 0.9 ** step)) / (math.sqrt(v[f] / (1 - 0.99 ** step)) + 1e-8)
    assert len(names) > 5 and math.isclose(w[""], model.bias, abs_tol=1e-3)
    assert all(math.isclose(w[f], model.weights[f], abs_tol=1e-3) for f in names)
