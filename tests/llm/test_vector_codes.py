"""Product quantisation by Orchard's search against plain nearest neighbours."""

import numpy as np
import pytest

from qualmark.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, ints string, n string"


def brute(rows, entries=256, rounds=4):
    """rows: (vec_id, vector, label), kept ones with unique ids."""
    rows = sorted(rows, key=lambda r: r[0])
    x = np.floor(np.array([r[1] for r in rows], np.float32).astype(np.float64) * 1024).astype(np.int64)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % 4))).reshape(len(rows), 4, -1)
    books = [x[:entries, p].copy() for p in range(4)]
    for last in [False] * rounds + [True]:
        dist = [((x[:, p][:, None] - books[p][None]) ** 2).sum(2) for p in range(4)]
        at = [d.argmin(1) for d in dist]
        for p in range(4) if not last else ():
            for e in range(len(books[p])):
                if (at[p] == e).any():
                    books[p][e] = x[at[p] == e, p].sum(0) // (at[p] == e).sum()
    error = sum(d.min(1) for d in dist)
    total = {}
    for r, e in zip(rows, error):
        total[r[2]] = total.get(r[2], 0) + int(e)
    return [(r[0], "".join(f"{a[i]:02x}" for a in at), int(error[i]), total[r[2]], vc.books_sha(books))
            for i, r in enumerate(rows)]


def vectors(n, dim, seed=1, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (9, dim))
    x = centres[rng.integers(0, 9, n)] + rng.normal(0, spread, (n, dim))
    return [(int(i * 11 % n * 7 - 50), [float(v) for v in x[i].astype(np.float32)], [None, 1, 2][i % 3]) for i in range(n)]


@pytest.mark.parametrize("n,dim", [(700, 16), (300, 6), (40, 4)])
def test_against_plain(spark, n, dim):
    rows = vectors(n, dim)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, vc.digest(df).collect())) == brute(rows)


def test_odd_rows(spark):
    """NULLs, non-finite values, other lengths, copies and a missing id."""
    rows = vectors(60, 8)
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None, 1), (1001, [nan] * 8, 1), (1002, [1.0] * 7 + [inf], 1), (1003, [None] + [1.0] * 7, 2),
           (1004, [1.0] * 7, 1), (1005, [], 1)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows + odd], SCHEMA)
    assert sorted(map(tuple, vc.digest(df).collect())) == brute(rows)
    more = rows + rows[:5] + [(None, rows[0][1], 1)] + [(5000, [1e30] * 8, 1)]
    got = vc.digest(spark.createDataFrame([(*r, "x", "y", "z") for r in more], SCHEMA)).collect()
    assert len(got) == len(more) and sum(r.vec_id is None for r in got) == 1
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, set()).add((r.code, r.error))
    assert all(len(v) == 1 for v in by_id.values())
    for none in ([], [r for r in odd if r[0] != 1004]):
        empty = vc.digest(spark.createDataFrame([(*r, "x", "y", "z") for r in none], SCHEMA))
        assert empty.collect() == []
        assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_search_is_exact_and_skips():
    """The walk finds what measuring every entry finds, with ties to the lower
    index, and measures far fewer entries where they lie in clusters."""
    rng = np.random.default_rng(3)
    entries = np.concatenate([rng.integers(-9, 9, (32, 4)) + 1000 * i for i in range(8)])
    entries[40] = entries[3]
    x = entries[rng.integers(0, len(entries), 5000)] + rng.integers(-3, 4, (5000, 4))
    index, dist, measured = vc.Book(entries).nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (dist == every.min(1)).all()
    assert measured < 0.3 * every.size


def test_decode(spark):
    rows = vectors(400, 8, spread=0.01)
    ints, width = vc.integers(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA))
    books = vc.train(ints, width)
    got = {r.vec_id: r.approx for r in vc.decode(vc.encode(ints, books, width), books, 8).collect()}
    assert max(abs(a - b) for i, v, _ in rows for a, b in zip(v, got[i])) < 0.1
