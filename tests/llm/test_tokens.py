"""Token counts, BPE encoding and decoding against the tokenizers library."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftlane.llm import bpe
from siftlane.llm.tokens import token_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBPE(BYTES)


def test_counts(odd, nothing):
    library = Tokenizer.from_file(WORDS)
    rows = token_counts(odd.withColumn("n_tokens", F.lit("clash")), WORDS, limit=500).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(rows) == odd.count() and token_counts(nothing, WORDS).count() == 0
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 500)


def test_counts_refuse_tokenizers_that_keep_blanks(odd):
    with pytest.raises(ValueError):
        token_counts(odd, BYTES)


def test_encode_and_decode(odd, nothing, byte_library):
    docs = odd.withColumn("ids", F.lit("clash"))
    rows = bpe.decode(bpe.encode(docs, BYTES), BYTES).collect()
    assert sorted(map(str, bpe.round_trip(docs, BYTES).collect())) == sorted(map(str, rows)) and bpe.round_trip(nothing, BYTES).count() == 0
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(rows) == odd.count() and bpe.decode(bpe.encode(nothing, BYTES), BYTES).count() == 0
    for r in rows:
        assert r.ids == byte_library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded == byte_library.decode(r.ids, skip_special_tokens=False) == texts[r.doc_id]


def test_decode_of_broken_and_null_ids(spark):
    rows = spark.createDataFrame([(1, [220, 999999]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(rows, BYTES).collect()} == {1: " ", 2: "", 3: ""}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  \n\t'stré1½— 日😀x")), max_size=60))
def test_any_text(own, byte_library, text):
    ids = [int(x) for x in memoryview(own.encode([text])[0]).cast("i")] if text else []
    assert ids == byte_library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("word", ["a" * 47, "a" * 48, "a" * 49, "ab" * 500, "thethethe" * 40, "é" * 100])
def test_long_words(own, byte_library, word):
    ids = list(memoryview(own.encode([word])[0]).cast("i"))
    assert ids == byte_library.encode(word, add_special_tokens=False).ids


def test_common_pieces_stay_remembered(own, byte_library, monkeypatch):
    """A worker that remembers too many pieces forgets those that the next texts do not have; ids stay as they are."""
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own.after_blank.clear()
    own.encode(["x common often " + " ".join(f"rare{i}" for i in range(20))])
    learnt = []
    monkeypatch.setattr(own, "encode_pieces", lambda pieces, f=own.encode_pieces: learnt.extend(pieces) or f(pieces))
    text = "x common often fresh"
    ids = own.encode([text])[0]
    assert learnt == [" fresh", "x"] and set(own.after_blank) == {"common", "often", "fresh"}
    assert ids == b"".join(i.to_bytes(4, "little") for i in byte_library.encode(text, add_special_tokens=False).ids)
