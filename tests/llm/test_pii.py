import random
import re

import numpy as np
import pytest
from corpus_rows import edge, frame, prose, row  # noqa: F401

from qualmark.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind in pii.KINDS:
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_is_the_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choice("0123459.-+@ ()ab%é") for _ in range(rng.randrange(60)))
        assert pii.order(pii.base_spans(text)) == brute(text)


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "7" * 300_000, "+1" + "(" * 200_000, "@" * 100_000, "1." * 100_000, "a@" * 50_000):
        pii.base_spans(text)
        assert len(pii.chunks(text)) <= len(text)


def card(rng):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(digits + c for c in "0123456789" if pii.luhn(digits + c))


def sample(n, seed=1):
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    for i in range(n):
        span = [f"w{d(1)}.{d(2)}@mail{d(1)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)),
                card(rng), f"+1 ({d(3)}) 555-{d(4)}", f"Version {d(1)}.0", "plain"][i % 6]
        yield i, f"{prose(i, 12)} {span} {prose(i + 1, 9)}".replace("w", "v").replace("1", "i", 0)


@pytest.fixture(scope="module")
def field(frame):
    clean = [row(i, re.sub(r"v\d+", "word", t)) for i, t in sample(600)]
    return pii.train(frame(clean), epochs=3)


def test_sums_and_best_by_enumeration():
    chunk, field = pii.Chunk("a1@b.c +1 2"), pii.Field()
    rng = np.random.default_rng(0)
    field.w, field.step = rng.normal(size=field.w.shape), rng.normal(size=field.step.shape)
    n, k = len(chunk.tokens), len(pii.KINDS)
    cand = {(i, j): rows for j, ends in enumerate(chunk.ends) for i, rows in ends}

    def ways(at):
        if at == n:
            yield []
            return
        for (i, j), y in [((at, at + 1), k)] + [(c, y) for c in cand if c[0] == at for y in range(k)]:
            for rest in ways(j):
                yield [(i, j, y), *rest]

    scored = []
    for way in ways(0):
        total, last = 0.0, k
        for i, j, y in way:
            total += field.step[last, y] + (field.w[cand[i, j]].sum(0)[y] if y < k else 0)
            last = y
        scored.append((total, way))
    z = np.logaddexp.reduce([s for s, _ in scored])
    got, prob, steps = field.marginals(chunk)
    assert got == pytest.approx(z)
    for j, ends in enumerate(chunk.ends):
        for x, (i, _) in enumerate(ends):
            for y in range(k):
                assert prob[j][x][y] == pytest.approx(sum(np.exp(s - z) for s, w in scored if (i, j, y) in w), abs=1e-9)
    assert steps.sum() == pytest.approx(sum(np.exp(s - z) * len(w) for s, w in scored))
    best = max(scored, key=lambda x: x[0])[1]
    assert field.decode(chunk) == [x for x in best if x[2] < k]


def test_finds_forms_beyond_the_patterns(field):
    rng = random.Random(77)
    found = total = 0
    for _, text in sample(120, seed=50):
        text = re.sub(r"v\d+", "word", text)
        for kind, lo, hi in pii.base_spans(text):
            other = pii.rewrite(kind, text[lo:hi], rng)
            hidden = text[:lo] + other + text[hi:]
            if not any(lo <= s < lo + len(other) for _, s, _ in pii.base_spans(hidden)):
                total += 1
                found += (kind, lo, lo + len(other)) in field.spans(hidden, pii.base_spans(hidden))
    assert total > 40 and found >= 0.6 * total


def test_leaves_clean_numbers(field):
    for text in ("Version 2.0.", "page 12 of 300", "in 1994 1995 1996", "2021-03-04 10:20:30", "3.14", "$4.50 or 5%",
                 "the Apache License, Version 2.0."):
        assert field.spans(text, pii.base_spans(text)) == []


def test_edge(edge, field):
    df, rows = edge
    got = pii.digest(pii.find(df, field)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    masked = pii.redact(df, field)
    assert masked.columns == df.columns and masked.count() == len(rows)
    assert pii.digest(pii.find(df.limit(0), field)).collect() == []


def test_redaction_and_digest(spark, frame, field):
    text = "Tel +1 (743) 555-3824, mail a.b@c.example.com; ip 10.0.0.1."
    df = frame([row(1, text), row(2, None)])
    out = {r.doc_id: r for r in pii.redact(df, field).collect()}
    assert out[1].text == "Tel [PHONE], mail [EMAIL]; ip [IP]." and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[2].n_chars is None
    got = {r.doc_id: r for r in pii.digest(pii.find(df, field)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 1)
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text))
    import hashlib
    assert got[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[1].spans == want
    assert pii.mask("abcdef", [("card", 1, 4), ("phone", 2, 5)]) == "a[CARD]f"


def test_nothing_to_learn_from(frame):
    assert not pii.train(frame([])).trained
    field = pii.train(frame([row(1, "no digits"), row(2, "7 apples")]))
    assert not field.trained and field.spans("+1 743", []) == []
