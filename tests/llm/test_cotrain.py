import numpy as np
import pytest
from corpus_rows import edge, frame, row  # noqa: F401

from qualmark.llm import cotrain


def corpus(n, seed=1, signal=0.9):
    """Bad documents use words of their own; their source tells most of them."""
    rng = np.random.default_rng(seed)
    good, foul = [f"good{i}" for i in range(300)], [f"foul{i}" for i in range(12)]
    for i in range(n):
        bad = bool(rng.random() < 0.3)
        ws = list(rng.choice(good, 40))
        if bad:
            ws[3:6] = rng.choice(foul, 3)
        source = "dump" if bad == (rng.random() < signal) else "press"
        yield row(i, " ".join(ws), "en", source), int(bad)


@pytest.fixture(scope="module")
def data(spark, frame):
    made = list(corpus(2400))
    labels = [(r[0], 1 - y, 0) if i % 2 else (r[0], 1, y) for i, (r, y) in enumerate(made) if i % 3 == 0]
    return frame([r for r, _ in made]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), \
        {r[0]: y for r, y in made}


def test_unlabelled_documents(data):
    df, labels, truth = data
    model = cotrain.train(df, labels)
    got = {r.doc_id: r for r in cotrain.score(df, model).collect()}
    bad = [got[i].kept for i, y in truth.items() if y and i % 3]
    good = [got[i].kept for i, y in truth.items() if not y and i % 3]
    assert np.mean(bad) < 0.1 and np.mean(good) > 0.97
    assert all(0 <= s <= 1 for r in got.values() for s in (r.text_score, r.meta_score, r.score))
    kept = cotrain.keep_good(df, model)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, r in got.items() if r.kept)


def test_views_teach_each_other():
    """A view with few labels of its own gains from the pool the other labels."""
    rng = np.random.default_rng(3)

    def make(n):
        y = rng.integers(0, 2, n)
        return [(np.array([int(v) * 50 + int(rng.integers(50))]), np.array([int(v) * 3 + 1])) for v in y], y.tolist()

    rows, labels = make(16)
    held, truth = make(60)
    pool, hidden = make(600)
    alone = cotrain.co_train(rows, labels, held, truth, [])
    taught = cotrain.co_train(rows, labels, held, truth, pool, share=0.3)
    right = [np.mean([(m.text.bad(r[0]) > 0.5) == y for r, y in zip(pool, hidden)]) for m in (alone, taught)]
    assert right[1] > right[0] + 0.1 and right[1] > 0.95


def test_picks_are_sure_and_bounded():
    view = cotrain.View(10, 0.0)
    view.weights[1] = [-6, 6]
    view.weights[2] = [6, -6]
    pool = [np.array([i % 4]) for i in range(20)]
    got = cotrain._picks(view, pool, {1}, 0.25)
    assert len(got) == 5 and all(y == (i % 4 == 1) and i % 4 in (1, 2) and i != 1 for i, y in got)


def test_edge(spark, edge, data):
    df, rows = edge
    labels = spark.createDataFrame([(4, 1, None), (4, 0, 0), (5, None, 1), (6, None, None), (None, 0, 0), (7, 1, 0),
                                    (8, 1, 0), (13, 0, 0), (16, 1, 0)], "doc_id long, quality int, toxic int")
    got = cotrain.score(df, cotrain.train(df, labels)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    model = cotrain.train(data[0], data[1])
    assert cotrain.score(df, model).count() == len(rows)


def test_without_labels_and_empty(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = frame([row(1, "text"), row(2, None)])
    assert cotrain.train(df, none) is None
    assert [tuple(r) for r in cotrain.score(df, None).collect()] == [(1, 0.0, 0.0, 0.0, True), (2, 0.0, 0.0, 0.0, True)]
    assert cotrain.keep_good(df, None).count() == 2
    assert cotrain.score(frame([]), cotrain.train(frame([]), none)).collect() == []


def test_cutoff_spares_good_documents():
    rng = np.random.default_rng(6)
    rows = [(rng.integers(0, 20, 3), np.array([1])) for _ in range(300)]
    labels = [int(r[0][0] < 8) for r in rows]
    held = [(rng.integers(0, 20, 3), np.array([1])) for _ in range(200)]
    model = cotrain.co_train(rows, labels, held, [0] * 200, [])
    gone = sum(model(*r)[2] >= model.cutoff for r in held)
    assert gone <= 2
