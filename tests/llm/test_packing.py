"""op5: every piece placed once, gapless, within capacity, near the bound."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfcast.llm import packing as P

from .conftest import rows_of

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(got, capacity):
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= capacity
    return len(bins)


def test_documents(edge_docs):
    got = P.pack_documents(edge_docs, PATH).collect()
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows_of(edge_docs):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i or -1, p, lo, len(ids[lo:lo + 4096]), zlib.crc32(ids[lo:lo + 4096].tobytes())) for p, lo in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    check(got, 4096)


def test_empty(no_docs):
    assert P.pack_documents(no_docs, PATH).count() == 0


@pytest.mark.parametrize("leaf", [100000, 400, 37, 5])
def test_tree(spark, leaf):
    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(1, 400, 1500), rng.integers(400, 4097, 300), np.full(40, 2100), np.full(20, 4096)])
    df = spark.createDataFrame([(int(i), 0, 0, int(n), int(i)) for i, n in enumerate(sizes)], P.PIECES)
    got = P.pack(df, 4096, leaf_items=leaf).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(sizes)))
    n = check(got, 4096)
    bound = -(-int(sizes.sum()) // 4096)
    assert n <= bound * (1.02 if leaf > 1000 else 1.1 if leaf > 100 else 1.35)


def test_equal_rows(spark):
    df = spark.createDataFrame([(1, 0, 0, 1500, 9)] * 10, P.PIECES)
    got = P.pack(df, 4096, leaf_items=3).collect()
    assert len(got) == 10 and check(got, 4096) == 5


def test_best_fit_takes_the_fullest_bin():
    assert P.best_fit(np.array([60, 50, 40, 45]), 100).tolist() == [0, 1, 0, 1]
