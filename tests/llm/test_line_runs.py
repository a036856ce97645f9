"""Line dedup against a plain loop, the store over sessions, and its plans."""

import hashlib

import pytest

from qualmark.llm import line_runs
from corpus_rows import edge_rows, frame, row  # noqa: F401

BLANK = " \t\n\x0b\x0c\r"


def brute(rows):
    first = {}
    big = 1 << 70  # rows without doc_id stand behind all others
    def keys(text):
        return ["".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANK)) for x in (text or "").split("\n")]
    for r in rows:
        for k in keys(r[1]):
            d = big if r[0] is None else r[0]
            first[k] = min(first.get(k, d), d)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x, k in zip(lines, keys(r[1])) if len(k) < 10 or first[k] >= (big if r[0] is None else r[0])]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


SHARED = "  A line that Many documents hold\t"
ROWS = edge_rows() + [
    row(30, f"{SHARED}\nshort\nown line number one"), row(31, f"short\n{SHARED.strip().lower()}\nown line number two"),
    row(31, f"short\n{SHARED}\nanother text of the same id"), row(32, f"{SHARED}\n{SHARED}\n\n{SHARED}"),
    row(-9, "own line number two\nown line number two"), row(None, f"{SHARED}\nline of rows without an id"),
    row(None, "line of rows without an id\nline of rows without an id"), row(33, "Élan vital\nélan vital"),
    row(34, "Élan vital"), row(35, "ninechars\nten chars!\n" * 300), row(36, "ten chars!"), row(37, "\r\nten chars!\r\n"),
]


@pytest.mark.parametrize("batches", [1, 2, 9])
def test_against_loop(frame, batches):
    got = line_runs.dedup(frame(ROWS), batches)
    assert [f.name for f in got.schema][:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.deduped.encode()).hexdigest()) for r in got.collect()]
    assert sorted(rows, key=str) == brute(ROWS)


def test_digest_and_empty(frame):
    assert sorted(map(tuple, line_runs.digest(frame(ROWS)).collect()), key=str) == brute(ROWS)
    empty = line_runs.digest(frame([]))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_batches_as_they_come(spark, frame):
    """A later batch loses what an earlier one holds, whatever its ids; runs of a
    level are merged; a store can be opened again from its manifest."""
    store = line_runs.RunStore(spark, buckets=3, fanout=2)
    texts = ["the first line here\nthe second line here", "the second line here\nthe third line here",
             "the third line here\nthe fourth line here", "the first line here", "the fourth line here\nthe fifth one"]
    gone = []
    for i, text in enumerate(texts):
        if i == 3:
            manifest = store.manifest
            for name in sum(store.levels, []):
                spark.sql(f"DROP TABLE {name}")
            store = line_runs.RunStore(spark, manifest=manifest)
        seen = line_runs.occurrences(frame([row(100 - i, text)]))
        gone.append([r.pos for r in line_runs.admit(seen, store).collect()])
    assert gone == [[], [0], [0], [0], [0]]
    assert any(store.levels[1:]) and all(len(names) <= store.fanout for names in store.levels)
    held = [r for names in store.levels for n in names for r in store.run(n).collect()]
    assert len(held) == len(set(held)) == 5
    store.close()


def test_runs_join_without_shuffle(spark, frame, monkeypatch):
    """The batch is shuffled and sorted once; the runs' buckets are neither."""
    plans = []
    write = line_runs.RunStore._write

    def shown(self, keys):
        with line_runs._sorted_scans(spark):
            plans.append(keys._jdf.queryExecution().executedPlan().toString())
        return write(self, keys)

    monkeypatch.setattr(line_runs.RunStore, "_write", shown)
    store = line_runs.RunStore(spark, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")), fanout=9)
    for i in range(3):
        line_runs.admit(line_runs.occurrences(frame([row(i, f"line number {i} of all\nthe same line")])), store)
    assert plans[2].count("SortMergeJoin") == 2
    assert plans[2].count("Exchange hashpartitioning") == 1 and plans[2].count("Sort [") == 1
    store.close()
