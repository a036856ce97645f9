import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from corpus_rows import edge, frame, prose, row  # noqa: F401

from qualmark.llm import base, minhash


def expected(rows, k, percent):
    sets = []
    for r in rows:
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "").encode().split()
        sets.append({tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws and r[0] is not None else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    out = []
    for i, r in enumerate(rows):
        ws = (r[1] or "").split()
        n = len(sets[i]) if r[0] is not None else (
            len({tuple(ws[x:x + k]) for x in range(max(1, len(ws) - k + 1))}) if ws else 0)
        c = None if r[0] is None else low[find(i)]
        out.append((r[0], n, c, c is None or c == r[0]))
    return out


def same(df, want):
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def crowd():
    """A hub whose copies are linked with it only, a chain, and a pair that
    meets in buckets without a link."""
    rng = np.random.default_rng(3)
    base = prose(20, 120).split()
    rows = [row(500, " ".join(base))]
    for i in range(40):
        ws = list(base)
        ws[int(rng.integers(5, 55))] = f"p{i}"
        ws[int(rng.integers(60, 115))] = f"q{i}"
        rows.append(row(501 + i if i % 2 else 100 + i, " ".join(ws)))
    ws = prose(21, 150).split()
    for i in range(12):
        ws[i * 12 + 3] = f"step{i}"
        rows.append(row(900 - i, " ".join(ws)))
    for i in range(25):
        rows.append(row(2000 + i, prose(22, 60) + " " + prose(3000 + i, 25)))
    return rows


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_against_all_pairs(edge, frame, k, percent):
    df, rows = edge
    same(minhash.near_duplicates(df, k, percent), expected(rows, k, percent))
    rows = crowd()
    same(minhash.near_duplicates(frame(rows), k, percent), expected(rows, k, percent))


def test_two_texts_of_one_id(frame):
    """Both texts of a repeated doc_id find their near copies."""
    rows = []
    for i in range(6):
        for j in range(2):
            text = prose(700 + 2 * i + j, 80)
            rows += [row(i, text), row(10 + 2 * i + j, text + " end"), row(30 + 2 * i + j, "start " + text)]
    rows += [row(50, prose(800, 60)), row(50, prose(801, 60)), row(50, prose(801, 60))]
    want = expected(rows, 3, 85)
    assert {r[2] for r in want if r[0] < 50} == set(range(6))
    same(minhash.near_duplicates(frame(rows), 3, 85), want)


def test_small_chunks(frame, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 4)
    rows = crowd()
    same(minhash.near_duplicates(frame(rows), 3, 85), expected(rows, 3, 85))


def test_long_sets_and_small_places(frame, monkeypatch):
    """Sets larger than the sketches, over several places."""
    monkeypatch.setattr(minhash, "CHUNK", 3)
    monkeypatch.setattr(minhash, "LOWEST", 60)
    monkeypatch.setattr(minhash, "NEAREST", 0)
    rows = crowd()
    same(minhash.near_duplicates(frame(rows), 3, 85), expected(rows, 3, 85))


def test_common_counts():
    rng = np.random.default_rng(8)
    rows = [np.unique(rng.integers(0, 60 if i % 2 else 4000, 30)).astype(np.uint32) for i in range(70)] + [
        np.empty(0, np.uint32)]
    got = minhash.common_counts(rows)
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j:
                assert got[i, j] == len(np.intersect1d(rows[i], rows[j]))


def test_empty_table(frame):
    assert minhash.near_duplicates(frame([])).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (95, 100), (7, 7)]
    got = {r.node: r.component for r in
           minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == 1 for i in range(1, 61))
    assert got[100] == got[95] == 90


def test_band_width_keeps_the_miss_rate():
    for s in (0.7, 0.8, 0.85, 0.95):
        r = minhash.band_rows(s)
        assert (1 - s ** r) ** (minhash.BINS // r) < 1e-9


def test_densified_bins_agree_as_often_as_sets():
    rng = np.random.default_rng(5)
    order = minhash._borrow_order(minhash.BINS)
    for size, common in ((12, 9), (400, 300)):
        share = []
        for _ in range(60):
            h = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64) * 2
            a, b = np.unique(h[:size]), np.unique(np.concatenate([h[:common], h[size:]]))
            share.append((minhash.signature(a, order) == minhash.signature(b, order)).mean())
        assert abs(np.mean(share) - common / (2 * size - common)) < 0.05


def test_python_gets_small_batches(spark, frame, monkeypatch):
    """A pair carries two whole texts: batches of the session's 10,000 rows filled workers and JVM."""
    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    rows, seen, write = crowd(), [], minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, name: (
        seen.append(spark.conf.get(names[0])), write(df, name))[1])
    before = [spark.conf.get(n) for n in names]
    same(minhash.near_duplicates(frame(rows), 3, 85), expected(rows, 3, 85))
    assert set(seen) == {"1024"}
    assert [spark.conf.get(n) for n in names] == before
    monkeypatch.setattr(minhash, "_placed", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        minhash.near_duplicates(frame(rows), 3, 85)
    assert [spark.conf.get(n) for n in names] == before


def test_rows_become_objects_in_pieces(spark, monkeypatch):
    """A batch of long lists was turned into Python objects 256 rows at a time, whatever their size."""
    batch = pa.RecordBatch.from_pydict({"members": [[b"x" * 1000] * 1000] * 40})
    monkeypatch.setattr(base, "in_python", lambda df, run, kind: run)
    run = base.map_rows(None, lambda: lambda members: [(len(members),)], "n long")
    tracemalloc.start()
    got = [n for b in run(iter([batch])) for n in b.column(0).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [1000] * 40 and peak < 10 << 20
