import hashlib
import re

from corpus_rows import edge, frame, prose, row  # noqa: F401

from qualmark.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(rows, items):
    windows = {}
    for item, text in items:
        ws = fold(text)
        if item is not None and ws:
            for i in range(max(1, len(ws) - 12)):
                windows.setdefault(tuple(ws[i:i + 13]), set()).add(item)
    out = []
    for r in rows:
        ws = fold(r[1])
        hit, found = set(), set()
        for w, ids in windows.items():
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i:i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found |= ids
        names = ",".join(sorted(map(str, found)))
        out.append((r[0], len(ws), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def same(df, want):
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


ITEMS = [(1, prose(1, 90)), (2, "one"), (3, "one two"), (4, "le le le"), (5, None), (6, ""), (None, "one"),
         (7, prose(1, 30)), (7, prose(1, 30)), (10, " ".join(prose(5, 20000, 5000).split()[300:340])),
         (11, "le " * 13), (12, "Été été"), (13, prose(4, 60).upper())]


def test_edge_in_one_and_in_many_blocks(spark, edge):
    df, rows = edge
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    same(decontam.digest(decontam.find_benchmark(df, items)), expected(rows, ITEMS))
    same(decontam.digest(decontam.find_benchmark(df, items, block_words=40)), expected(rows, ITEMS))


def test_long_item_in_parts(spark, edge):
    """An item beyond the words of a block is cut, and no window is lost."""
    df, rows = edge
    long = [(1, prose(1, 90) + " " + prose(5, 20000, 5000)[:3000] + " " + prose(4, 60)), (2, prose(3, 50))]
    items = spark.createDataFrame(long, "item_id long, text string")
    parts = decontam._parts(items, 13, 40).collect()
    assert max(len(decontam.words(r.text)) for r in parts) <= 40
    for item, text in long:
        ws = decontam.words(text)
        got = [w for r in parts if r.item_id == item for w in [decontam.words(r.text)]]
        assert sorted(tuple(w[i:i + 13]) for w in got for i in range(len(w) - 12)) == sorted(
            tuple(ws[i:i + 13]) for i in range(len(ws) - 12))
    same(decontam.digest(decontam.find_benchmark(df, items, block_words=400)), expected(rows, long))


def test_extra_columns_of_the_benchmark(spark, frame):
    items = spark.createDataFrame([(1, prose(1, 20), "x", "y")], "item_id long, text string, doc_id string, spans string")
    rows = [row(1, prose(1, 20)), row(2, prose(2, 20))]
    same(decontam.digest(decontam.find_benchmark(frame(rows), items)), expected(rows, [(1, prose(1, 20))]))


def test_empty_tables(spark, frame, edge):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_benchmark(frame([]), none).collect() == []
    same(decontam.digest(decontam.find_benchmark(edge[0], none)), expected(edge[1], []))


def test_a_window_stands_under_its_rarest_shingle():
    b = decontam.Block([(1, "a b c d e f g h i j k l m")])
    places = {tuple(sorted(b.number)[x] for x in range(i, i + 3)): i for i in range(11)}
    counts = {(3, i): 50 for i in range(11)}
    at = b.seen(b.ids([b"d", b"e", b"f"]), 3)[0]
    counts[3, int(at)] = 2
    b.index(counts)
    (entry,) = [e for e in b.entries[3] if e]
    assert entry == [(0, 3)] and len(places) == 11
