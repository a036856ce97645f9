"""Both substring operators against windows counted one by one."""

import hashlib
import random

import numpy as np
import pytest
from corpus_rows import edge, frame, prose, row  # noqa: F401

from qualmark.llm import repeats, seed_dedup, suffix_dedup
from qualmark.llm.suffix_dedup import previous_factors


def expected_words(rows, window=13):
    first = {}
    for r in rows:
        ws = (r[1] or "").split()
        if r[0] is not None:
            for i in range(len(ws) - window + 1):
                g = tuple(ws[i:i + window])
                first[g] = min(first.get(g, r[0]), r[0])
    out = []
    for r in rows:
        ws = (r[1] or "").encode().split()
        plain = (r[1] or "").split()
        gone = set()
        for i in range(len(ws) - window + 1 if r[0] is not None else 0):
            if first[tuple(plain[i:i + window])] < r[0]:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((r[0], len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def expected_bytes(rows, window=400):
    count = {}
    for r in rows:
        b = (r[1] or "").encode()
        if r[0] is not None:
            for i in range(len(b) - window + 1):
                count[b[i:i + window]] = count.get(b[i:i + window], 0) + 1
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1 if r[0] is not None else 0):
            if count[b[i:i + window]] > 1:
                gone[i:i + window] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((r[0], len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def same(df, want):
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def crowd():
    """One passage in many surroundings, more than are compared in one go, and
    a crowd of near copies."""
    passage, base = prose(7, 80), prose(8, 200).split()
    rng = random.Random(9)
    rows = [row(100 + i, prose(1000 + i, 30) + " " + passage + " " + prose(2000 + i, 30)) for i in range(90)]
    for i in range(90):
        ws = list(base)
        for _ in range(3):
            ws[rng.randrange(len(ws))] = f"edit{rng.randrange(5)}"
        rows.append(row(300 + i, " ".join(ws)))
    return rows


def test_words_edge(edge):
    df, rows = edge
    same(seed_dedup.removal_digest(df), expected_words(rows))


def test_bytes_edge(edge):
    df, rows = edge
    same(suffix_dedup.removal_digest(df), expected_bytes(rows))


def test_crowds(frame):
    rows = crowd()
    same(seed_dedup.removal_digest(frame(rows)), expected_words(rows))
    same(suffix_dedup.removal_digest(frame(rows)), expected_bytes(rows))


def test_every_key_split(frame, monkeypatch):
    """With a low limit nearly all groups take the way of the large ones."""
    monkeypatch.setattr(repeats, "LIMIT", 1)
    rows = crowd()[60:140]
    same(seed_dedup.removal_digest(frame(rows)), expected_words(rows))
    same(suffix_dedup.removal_digest(frame(rows)), expected_bytes(rows))


@pytest.mark.parametrize("operator, expected", [(seed_dedup, expected_words), (suffix_dedup, expected_bytes)])
def test_splits_read_the_texts_of_split_runs_only(frame, monkeypatch, operator, expected):
    """All texts that share a passage are read once to compare; what a split and
    the steps behind it read are the texts of the large group."""
    monkeypatch.setattr(repeats, "LIMIT", 4)
    read, with_text = [], repeats._with_text

    def noted(classes, kept):
        read.append(kept.count())
        return with_text(classes, kept)

    monkeypatch.setattr(repeats, "_with_text", noted)
    passage, rows = prose(7, 80), []
    for i in range(42):
        shared = passage if i < 12 else prose(100 + i // 2, 80)
        rows.append(row(i, prose(1000 + i, 30) + " " + shared + " " + prose(2000 + i, 30)))
    same(operator.removal_digest(frame(rows)), expected(rows))
    assert len(read) >= 2 and read[0] == 42 and max(read[1:]) <= 12


@pytest.mark.parametrize("limit", [repeats.LIMIT, 1])
def test_words_twice_in_the_later_document(frame, monkeypatch, limit):
    """Equal runs of one document, of which only a part occurs in an earlier one:
    each place is cleared, also over two texts of a doc_id and on the way of the
    large groups."""
    monkeypatch.setattr(repeats, "LIMIT", limit)
    rows = []
    for i in range(12):
        a, p, b, c, d = (prose(9000 + 10 * i + j, n) for j, n in enumerate((20, 13 + i, 20, 30, 30)))
        rows += [row(20 * i + 3, " ".join([a, p, b])), row(20 * i + 5, " ".join([c, p, d, c, p, d])),
                 row(20 * i + 7, " ".join([c, p, d])), row(20 * i + 5, " ".join([d, c, p, d]))]
    want = expected_words(rows)
    assert [r[2] for r in want[1::4]] == [2 * (13 + i) for i in range(12)]
    same(seed_dedup.removal_digest(frame(rows)), want)


def test_texts(frame):
    rows = [row(1, prose(1, 40)), row(2, "start " + prose(1, 40) + " end")]
    got = {r.doc_id: r.text for r in seed_dedup.remove_repeats(frame(rows)).collect()}
    assert got == {1: prose(1, 40), 2: "start end"}
    out = {r.doc_id: (bytes(r.kept), list(r.removed)) for r in
           suffix_dedup.remove_copies(frame([row(1, "a" + prose(2, 200)), row(2, "b" + prose(2, 200))])).collect()}
    body = prose(2, 200).encode()
    assert out == {1: (b"a" + body, []), 2: (b"b", [1, 1 + len(body)])}  # the first copy stays


def test_empty_table(frame):
    assert seed_dedup.removal_digest(frame([])).collect() == []
    assert suffix_dedup.removal_digest(frame([])).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_previous_factors(seed):
    rng = random.Random(seed)
    s = [rng.choice("ab") for _ in range(rng.randrange(1, 30))]
    n = len(s)

    def common(i, j):
        k = 0
        while i + k < n and j + k < n and s[i + k] == s[j + k]:
            k += 1
        return k

    order = sorted(range(n), key=lambda i: s[i:])
    lcp = [0] + [common(a, b) for a, b in zip(order, order[1:])]
    got = dict(zip(order, previous_factors(order, lcp)))
    assert [got[i] for i in range(n)] == [max((common(i, j) for j in range(i)), default=0) for i in range(n)]


@pytest.mark.parametrize("span", [1, 2, 9, 40])
def test_leftmost_minima(span):
    rng = np.random.default_rng(span)
    grams = rng.integers(0, 50, 300).astype(np.uint64) << np.uint64(50)
    want = [p + int(np.argmin(grams[p:p + span])) for p in range(len(grams) - span + 1)]
    assert repeats.leftmost_minima(grams, span).tolist() == want
