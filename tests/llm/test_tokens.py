"""op2 round trip and the encoder against the tokenizers library itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfcast.llm import tokens as T
from shelfcast.session import scratch_path

from .conftest import rows_of

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
OURS = T.ChunkEncoder(open(PATH, encoding="utf-8").read())


def ids(t):
    return PLAIN.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aA.,!'s \n<|>éÉİ½"))))
def test_encoder_equals_library(text):
    assert np.frombuffer(OURS.encode([text.encode()])[0], "<u4").tolist() == ids(text)


@pytest.mark.parametrize("text", ["<|endoftext|> a", "x<|startoftext|>.", "it's IT'S don't. 't!", "Straße ẞ ΑΣ. Σ", "éa. ́", "bİ!", "ŉ! ǰ."])
def test_encoder_hard_cases(text):
    assert np.frombuffer(OURS.encode([text.encode()])[0], "<u4").tolist() == ids(text)


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 3)
    enc = T.ChunkEncoder(open(PATH, encoding="utf-8").read())
    for text in ["One two, three.", "two four five six", "One two, three. seven"]:
        assert np.frombuffer(enc.encode([text.encode()])[0], "<u4").tolist() == ids(text)


def check(spark, df, **kw):
    path = scratch_path(spark, "test-tokens")
    T.write_tokens(df, path, PATH, end_id=2, **kw)
    got = sorted(T.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    want = sorted(((i is not None, i or 0, tuple([*ids(t), 2])) for i, t in rows_of(df)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(r.ids)) for r in got) == want
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]  # ascending
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    return path


def test_round_trip_edges(spark, edge_docs):
    check(spark, edge_docs)


def test_round_trip_small_shards_and_random_access(spark, edge_docs):
    path = check(spark, edge_docs.where("doc_id between 0 and 16"), shard_bytes=200)
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    blob = bytes(spark.read.format("binaryFile").load(f"{path}/shards").orderBy("path").first().content)
    index = T.read_index(blob)
    want = {i: [*ids(t), 2] for i, t in rows_of(edge_docs)}
    for k, i in enumerate(index["doc_id"].tolist()):
        assert T.read_document(blob, k, dictionary).tolist() == want[i]
    with pytest.raises(ValueError):
        T.read_document(blob, 0, dictionary + b"x")


def test_dictionary_sample_is_bounded_in_rows(spark, monkeypatch):
    """One doc_id holds all rows: only so many reach the driver."""
    seen, train = [], T.zstandard.train_dictionary
    monkeypatch.setattr(T.zstandard, "train_dictionary", lambda n, samples: seen.append(len(samples)) or train(n, samples))
    df = spark.range(5000).selectExpr("7L as doc_id", "concat('word number ', id) as text")
    T.train_dictionary(df, T.Holder(spark, PATH), 2, sample_docs=64)
    assert seen == [64]


def test_empty(spark, no_docs):
    path = scratch_path(spark, "test-tokens")
    T.write_tokens(no_docs, path, PATH, end_id=2)
    assert T.read_tokens(spark, path).count() == 0
