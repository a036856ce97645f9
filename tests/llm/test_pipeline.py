"""Each stage of the pipeline against a version without Spark, on what the
stage before it kept."""

import hashlib

import public_tokenizers
import pytest
import test_decontam
import test_minhash
import tiktoken
from corpus_rows import edge, edge_rows, frame, prose, row  # noqa: F401

import corpus_pipeline
from qualmark.llm import bpe, cotrain, pii
from qualmark.llm.queries import TOKENIZER

ITEMS = [(1, prose(501, 40)), (2, prose(502, 25)), (3, "le le le")]


def corpus():
    rows = [r for r in edge_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    for i in range(100, 260):
        text = prose(i, 60)
        if i % 4 == 0:
            text = " ".join(w + "%%" for w in text.split())
        if i % 10 == 1:
            text += f" mail a{i}@mail.example.com or +1 (743) 555-0{i}"
        if i % 25 == 2:
            text += " " + ITEMS[i % 2][1]
        rows.append(row(i, text))
    return rows


def labels():
    return [(i, int(i % 4 > 0), 0) for i in range(100, 220)]


@pytest.fixture(scope="module")
def sf_dir(spark, frame, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("corpus"))
    frame(corpus()).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels(), "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = [[tuple(r) for r in docs.collect()]]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        seen.append([tuple(r) for r in docs.collect()])
    start, good, single, clean, masked, tokens = seen

    model = cotrain.train(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                          spark.read.parquet(f"{sf_dir}/labels.parquet"))
    views = cotrain.Views()
    kept = [r for r in start if model(views.text(r[1]), views.meta(r[3], r[2], r[4]))[2] < model.cutoff]
    assert sorted(map(str, good)) == sorted(map(str, kept))
    ids = {r[0] for r in good}
    assert sum(i in ids for i in range(220, 260) if i % 4 == 0) <= 1
    assert sum(i in ids for i in range(220, 260) if i % 4) >= 28

    near = {r[0]: r[3] for r in test_minhash.expected(good, 5, 80)}
    assert sorted(map(str, single)) == sorted(str(r) for r in good if near[r[0]])
    dirty = {r[0]: r[5] for r in test_decontam.expected(single, ITEMS)}
    assert any(dirty.values())
    assert sorted(map(str, clean)) == sorted(str(r) for r in single if not dirty[r[0]])

    by_id = {r[0]: r for r in clean}
    assert by_id.keys() == {r[0] for r in masked}
    for doc_id, text, lang, source, n_chars in masked:
        before = by_id[doc_id][1]
        assert (lang, source) == by_id[doc_id][2:4]
        if before is None:
            assert text is None and n_chars is None
            continue
        assert n_chars == len(text) and not pii.base_spans(text)
        if not any(c.isdigit() for c in before):
            assert text == before

    codec = bpe.Codec(bpe.load_ranks(public_tokenizers.path(TOKENIZER)), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks,
                                special_tokens={})
    want = [(i, library.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest())
            for i, t, *_ in masked]
    assert sorted(str((i, list(x), sha)) for i, x, _, sha in tokens) == sorted(map(str, want))


def test_decisions_row_by_row(spark, frame, sf_dir):
    """Rows without doc_id and rows that share one are judged by their own text."""
    a, b, c = (prose(900 + i, 60) for i in range(3))
    dirty = a + " " + ITEMS[0][1]
    rows = [row(None, dirty), row(7, dirty), row(7, b), row(8, c), row(None, c)]
    clean = corpus_pipeline.decontaminate(spark, frame(rows), sf_dir).collect()
    assert sorted(map(str, map(tuple, clean))) == sorted(map(str, rows[2:]))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    many = corpus_pipeline.decontam.keep_clean(frame(rows), items, block_words=20).collect()
    assert sorted(map(str, map(tuple, many))) == sorted(map(str, rows[2:]))

    rows = [row(1, a), row(1, a), row(2, a + " end"), row(2, b), row(None, c), row(None, c), row(3, None), row(None, None)]
    single = corpus_pipeline.near_dedup(spark, frame(rows), sf_dir).collect()
    want = [rows[i] for i in (0, 3, 4, 6, 7)]
    assert sorted(map(str, map(tuple, single))) == sorted(map(str, want))


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"]
    assert 0 < out.count() < len(corpus())


def test_empty_documents(spark, sf_dir, tmp_path):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
