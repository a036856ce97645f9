from collections import Counter
from math import comb

import numpy as np
import pytest
from corpus_rows import edge, frame, prose, row  # noqa: F401

from qualmark.llm import quality_rules as q

BLANK = " \t\n\x0b\x0c\r"


def base(text):
    text = text or ""
    ws = text.encode().split()
    lines, seen, again = text.split("\n"), set(), 0
    for x in lines:
        if x.strip(BLANK):
            again += x in seen
            seen.add(x)
    count = Counter(zip(ws, ws[1:], ws[2:]))
    inside = {j for i, g in enumerate(zip(ws, ws[1:], ws[2:])) if count[g] > 1 for j in range(i, i + 3)}
    return (len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in text), again, len(inside),
            len(ws) < 50 or 100 * len(inside) > 50 * len(ws))


def test_base_on_edge(spark, edge):
    df, rows = edge
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 0), (77, None, None)],
                                   "doc_id long, quality int, toxic int")
    got = q.apply_rules(df, labels).collect()
    assert sorted(str(tuple(r)[:7]) for r in got) == sorted(str((r[0], *base(r[1]))) for r in rows)
    assert all(r.kept == (not r.base_failed) for r in got)  # too few labels for any cutoff


def test_many_different_words():
    ws = [str(i % 3000) for i in range(6000)]
    assert q.repeated_words(ws) == 6000 and q.repeated_words(ws[:3000]) == 0


@pytest.mark.parametrize("k, n", [(0, 10), (3, 40), (7, 900), (5, 5), (0, 1)])
def test_exact_bound(k, n):
    u = q.upper_bound(k, n, 0.05)
    if k < n:
        assert sum(comb(n, i) * u ** i * (1 - u) ** (n - i) for i in range(k + 1)) == pytest.approx(0.05, rel=1e-6)
    else:
        assert u == 1.0


def test_choice_stops_at_the_first_failure():
    assert q.choose([0, 0, 900, 0], 1000, 0.02, 0.05) == 2
    assert q.choose([0, 0], 20, 0.02, 0.05) == 0  # too few to tell
    assert q.choose([], 0, 0.02, 0.05) == 0


def test_bad_documents_go_and_the_risk_holds(spark, frame):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(3000):
        good = i % 4 > 0
        text = prose(i, 70)
        if not good:
            text = " ".join(w + rng.choice(["%%", "##", "$$"]) for w in text.split())
        rows.append(row(i, text, ["en", "fr"][i % 2 if i < 2500 else 0]))
        labels.append((i, int(good), 0))
    rows += [row(9000 + i, prose(9000 + i, 60), "xx") for i in range(5)] + [row(9990, prose(1, 60), None)]
    df, known = frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in q.apply_rules(df, known).collect()}
    good = [got[i].kept for i, y, _ in labels if y]
    assert np.mean(good) >= 1 - q.RISK
    assert not any(got[i].kept for i, y, _ in labels if not y)
    assert all(got[9000 + i].kept for i in range(5)) and got[9990].kept  # strata without labels
    chosen = q.thresholds(q.measures(df, "lang"), known).collect()
    assert {r.stratum for r in chosen} == {"en", "fr"} and all(r.bound <= q.RISK for r in chosen)


def test_empty_tables(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.apply_rules(frame([]), labels).collect() == []
    assert q.apply_rules(frame([row(1, prose(1, 60))]), labels).collect()[0].kept
