import numpy as np
import pytest

from lectern.llm import boosting, quality, toxicity
from lectern.llm.queries import op3_toxicity, op7_quality

from .conftest import ODD, SCHEMA

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "label", "accuracy"), [(op3_toxicity, "toxic", 0.93), (op7_quality, "quality", 0.93)])
def test_held_out_accuracy(spark, query, label, accuracy):
    out = query(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = out.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet").where(f"{label} IS NOT NULL"), "doc_id").select("score", "predicted", label).collect()
    assert rows and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) >= accuracy


def test_held_out_toxic_documents_are_found(spark):
    """Of held-out toxic documents nine in ten are found, and four in five of those found are toxic."""
    folder = SF.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    rows = op3_toxicity(spark, folder).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    caught = sum(r.predicted and r.toxic for r in rows)
    assert caught >= 0.9 * sum(r.toxic for r in rows) > 0 and caught >= 0.8 * sum(r.predicted for r in rows)


def test_forest_equals_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 5)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.1)).astype(float)
    forest = boosting.grow(x, y, trees=15, depth=3)

    def walk(row):
        total = forest.start
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return total

    assert np.allclose(forest.margins(x), [walk(r) for r in x])
    assert ((forest.scores(x) >= 0.5) == y).mean() > 0.95


def test_label_model_weighs_voters():
    """A voter that is mostly right is found more accurate than one that guesses, and copies of one voter correlate."""
    rng = np.random.default_rng(5)
    y = rng.random(3000) < 0.3
    noisy = [np.where(rng.random(3000) < p, y, ~y).astype(int) for p in (0.95, 0.9, 0.55)]
    votes = np.stack([*noisy, noisy[2], np.where(rng.random(3000) < 0.98, y, ~y).astype(int)], 1)
    posterior, accuracy, correlations = toxicity.label_model(votes, votes.mean(1))
    assert ((posterior > 0.5) == y).mean() > 0.95
    assert accuracy[0] > accuracy[1] > accuracy[2] and correlations[2, 3] > 0.9


@pytest.fixture(scope="module")
def marked(spark, docs):
    """Documents of which one in three insults, in words of its own; copies of one document that holds rare words too."""
    texts = [f"the river runs by house {i} and tree {i * 7} quietly" + (" you zorgle and blimpo" if i % 3 == 0 else "") for i in range(240)]
    texts += ["a river of qwxyz runs here, zorgle"] * 12
    labels = spark.createDataFrame([(i, 1, int("zorgle" in t)) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    return docs(texts), labels, texts


def test_lexicon_counts_copies_once(marked):
    frame, labels, _ = marked
    rows = quality.training_rows(frame, labels, "toxic", "doc_id", "text", 1000)
    words = {w for k, w in toxicity.mine(rows) if k == 0}
    assert {"zorgle", "blimpo"} <= words and "qwxyz" not in words


def test_without_toxic(marked):
    frame, labels, texts = marked
    left = {r.doc_id for r in toxicity.without_toxic(frame, labels).collect()}
    assert left == {i for i, t in enumerate(texts) if "zorgle" not in t}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_tables(spark, docs, marked, module):
    _, labels, _ = marked
    frame = docs([*ODD, "word", None], ids=[*range(len(ODD)), None, None])
    clash = frame.selectExpr("*", "1 AS score", "2 AS predicted", "3 AS label", "'x' AS `group`")
    rows = module.classify(clash, labels).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert rows[3].score == rows[4].score
    none = labels.limit(0)
    assert len({r.score for r in module.classify(frame, none).collect()}) == 1
    assert module.classify(spark.createDataFrame([], SCHEMA), labels).count() == 0


@pytest.mark.parametrize("label", ["toxic", "quality"])
def test_repeated_rows_do_not_push_out_a_class(spark, docs, label):
    """The bound on training rows never falls on one class, whether documents repeat or ids have several texts."""
    texts = [f"the river runs by house {i} and tree {i * 7}" + (" you zorgle" if i % 10 == 0 else "") for i in range(200)]
    labels = spark.createDataFrame([(i, int("zorgle" in t), int("zorgle" in t)) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    most = quality.training_rows(docs(texts), labels, label, "doc_id", "text", 1000).count()

    def trained(frame):
        rows = quality.training_rows(frame, labels, label, "doc_id", "text", most)
        return quality.training_table(rows, quality.table, len(quality.FEATURES), most)

    (x, y), (again_x, again_y) = trained(docs(texts)), trained(docs(texts + texts[:150], ids=[*range(200), *range(150)]))
    assert len(y) == most and (x == again_x).all() and (y == again_y).all() and 0 < y.mean() < 1
    _, y = trained(docs(texts + [t + " more" for t in texts], ids=[*range(200), *range(200)]))
    assert len(y) == most and 0 < y.mean() < 1


@pytest.mark.parametrize("text", ["A" * 300 + "b" * 700, "ab" * 5000 + "C", ("É" + "é" * 511) * 4 + "x" * 400, "ΩÄ😀ſab", "", None])
def test_share_of_capitals_is_of_the_whole_text(text):
    upper = toxicity.Lexicon.of({}).describe([text])[0, -3]
    assert upper == pytest.approx(sum(map(str.isupper, text or "")) / max(1, len(text or "")))
