import numpy as np

from chorale.llm import catalog, quality, toxicity
from chorale.llm.store import Scratch
from odd_rows import no_docs, odd_docs  # noqa: F401

TABLES = "/root/testdata/sf0.1"


def accuracy(spark, name, label):
    rows = catalog.QUERIES[name](spark, TABLES).join(spark.read.parquet(f"{TABLES}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert rows.score.between(0, 1).all() and set(rows.predicted) <= {0, 1}
    y, s = rows[label].to_numpy(), rows.score.rank().to_numpy()
    auc = (s[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (y == 0).sum())
    return auc, rows.predicted[y == 1].mean(), rows.predicted[y == 0].mean()


def test_quality_held_out(spark):
    auc, hit, false = accuracy(spark, "op4_quality", "quality")
    assert auc > 0.99 and hit > 0.98 and false < 0.1


def test_toxicity_held_out(spark):
    auc, hit, false = accuracy(spark, "op5_toxicity", "toxic")
    assert auc > 0.9 and hit > 0.75 and false < 0.03


def test_trees_walk_as_nested_tests(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(int)
    m = quality.grow(x, y, trees=20, depth=3)

    def one(row):
        out = m.base
        for t in range(len(m.value)):
            i = 0
            while i < 7:
                i = 2 * i + 1 + (row[m.feature[t, i]] > m.cut[t, i])
            out += m.value[t, i - 7]
        return 1 / (1 + np.exp(-out))
    p = m.probabilities(x)
    assert np.allclose(p, [one(v) for v in x]) and ((p > 0.5) == y).mean() > 0.95
    assert quality.grow(x[:3], np.array([1, 1, 1])).probabilities(x[:2]).tolist() == [0.8, 0.8]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (6, 0, 1), (6, 0, 1), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    for scored in (quality.scored, toxicity.scored):
        got = scored(odd_docs, labels, Scratch(spark)).collect()
        assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
        assert {r["score"] for r in scored(odd_docs, labels.limit(0), Scratch(spark)).collect()} == {0.5}
        assert scored(no_docs, labels, Scratch(spark)).count() == 0
    kept = toxicity.with_scores(odd_docs, toxicity.fit([], []))
    assert set(kept.columns) == set(odd_docs.columns)
