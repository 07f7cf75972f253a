import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TOKENS = byte_bpe.read_ranks(PATH)
CODEC = byte_bpe.Codec(TOKENS, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})


def ids(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in CODEC.encode_all(texts)]


def test_every_token_is_its_own_code():
    assert CODEC.replay(TOKENS) == [i.to_bytes(4, "little") for i in range(len(TOKENS))]


@pytest.mark.parametrize("text", ["", " ", "  ", "   a", "a  b   c", "a \n b\n\n c\t d ", "I'll don't 's", "aaaa" * 500, "<|endoftext|>", "日本語　😀😀 é́", "a b   c"])
def test_texts(text):
    assert ids([text]) == [LIBRARY.encode_ordinary(text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abest TH'l.,\n\t\r 1½é日😀 ")), max_size=60), max_size=8))
def test_like_the_library(texts):
    assert ids(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize(
    "text", ["a \u00a0 \u00a0 b", "a \u00a0 \u00a0 \u00a0 \u00a0 b", "\u00a0 \u00a0 \u00a0 \u00a0 x", "a\n \nb", "a\t \tb c", "\n \n", " \u3000 a", "a \u00a0", "b  c d \u2009 e"]
)
def test_runs_of_mixed_white_space(text):
    for whole in (text, f"x y {text} z", f"{text} {text}"):
        assert ids([whole]) == [LIBRARY.encode_ordinary(whole)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab.1 \u00a0\u2009\u3000\n\t\x85\x1c")), max_size=40))
def test_white_space_like_the_library(text):
    assert ids([text]) == [LIBRARY.encode_ordinary(text)]


def test_any_characters_and_round_trip():
    rng = random.Random(5)
    texts = ["".join(chr(rng.choice([rng.randrange(1, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(80)) for _ in range(300)]
    assert ids(texts) == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [CODEC.decode(x) for x in CODEC.encode_all(texts)] == [t.encode() for t in texts]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 30)
    texts = [f"word{i} other word{i} {'x' * i}" for i in range(90)]
    assert ids(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


def test_frames(documents):
    texts = ["A text and another one.", None, "", "é😀 x" * 300]
    docs = documents(*[(i, t, "en") for i, t in enumerate(texts)])
    rows = {r.doc_id: r for r in byte_bpe.digests(docs, PATH, PATTERN).collect()}
    encoded = byte_bpe.encode(docs, PATH, PATTERN)
    lists = {r.doc_id: r for r in encoded.collect()}
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(encoded, PATH).collect()}
    for i, text in enumerate(texts):
        want = LIBRARY.encode_ordinary(text or "")
        raw = np.array(want, dtype="<u4").tobytes()
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(want), hashlib.sha256(raw).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert (lists[i].ids, lists[i].n_tokens, back[i]) == (want, len(want), (text or "").encode())


def test_odd_rows(odd, empty, clashing):
    assert byte_bpe.digests(odd, PATH, PATTERN).count() == 10
    assert byte_bpe.digests(empty, PATH, PATTERN).count() == 0 and byte_bpe.encode(empty, PATH, PATTERN).count() == 0
    assert byte_bpe.encode(clashing, PATH, PATTERN).columns == ["doc_id", "n_tokens", "ids"]
    assert byte_bpe.encode(clashing, PATH, PATTERN).count() == 10


def test_a_batch_is_encoded_in_parts(spark):
    import pyarrow as pa

    from recordloom.llm.blocks import parts

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array(["aaaa", None, "öö", "", "a" * 20])], names=["doc_id", "text"])
    cut = list(parts(batch, 1, 4))
    assert [p.column(0).to_pylist() for p in cut] == [[1], [2, 3], [4, 5]]
    assert [p.num_rows for p in parts(batch.slice(0, 0), 1, 4)] == [0]
