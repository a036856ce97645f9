import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from corpus_rows import edge, frame  # noqa: F401

from qualmark.llm import bpe
from qualmark.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(public_tokenizers.path(TOKENIZER)), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_same_ids_as_the_library(codec, library):
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0x3000), *range(0x1F300, 0x1F700)]]
    for i in range(3000):
        letters = rng.choice([pool[:128], pool[:600], pool, list("abt e\n"), list("aeio'stre ")])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(80)))
        ids = codec.encode(text).tolist()
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", " " * 3000, "a" * 9000, "the" * 3000, "\n \n" * 900, "é" * 2000, "1234567" * 400])
def test_long_pieces(codec, library, text):
    assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_pieces_in_parts_and_memo_limits(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "PIECE_MEMO", 3)
    monkeypatch.setattr(bpe, "PAIR_MEMO", 3)
    small = bpe.Codec(codec.ranks, public_tokenizers.PATTERN)
    text = "Somewhere thention onatingly is thereforeish " * 3
    assert small.encode(text).tolist() == library.encode_ordinary(text)


def test_search_is_linear_in_the_piece(codec, monkeypatch):
    calls = []
    fits = codec.fits
    monkeypatch.setattr(codec, "fits", lambda a, b: calls.append(1) or fits(a, b))
    codec.encode_piece(b"thentiononatingly" * 50)
    few = len(calls)
    codec.encode_piece(b"thentiononatingly" * 500)
    assert len(calls) - few < 12 * few


def test_documents(edge, library):
    df, rows = edge
    got = bpe.digest(bpe.encode(df, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)).collect()
    want = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_table(frame):
    out = bpe.digest(bpe.encode(frame([]), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN))
    assert out.collect() == []
