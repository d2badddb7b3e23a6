"""op11, op12, op13 against brute force and on edge cases."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from shelfcast.llm import binary_packing as B
from shelfcast.llm import merkle as M
from shelfcast.llm import spelling as S
from shelfcast.llm.common import documents

from .conftest import SF001, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------ op11
def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_hash(r, text):
    return sha256("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))).encode()).hexdigest()


def grow(nodes):
    """Levels of a tree of fan 16, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha256("".join(x[i:i + 16]).encode()).hexdigest() for i in range(0, len(x), 16)])
    return levels


def way(levels, i):
    """Per level the place in the run and the other digests of it."""
    out = []
    for x in levels[:-1]:
        run = x[i - i % 16:i - i % 16 + 16]
        out.append((i % 16, run[:i % 16] + run[i % 16 + 1:]))
        i //= 16
    return out


def brute_manifest(rows, tamper):
    trees = defaultdict(list)
    for r in rows:
        trees[r.source].append((r.doc_id is not None, r.doc_id or 0, bytes.fromhex(leaf_hash(r, r.text)), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {}
    for s in names:
        trees[s].sort(key=lambda x: x[:3])
        grown[s] = grow([x[2].hex() for x in trees[s]])
    top = grow([grown[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (*_, leaf, r) in enumerate(trees[s]):
            steps = way(grown[s], i) + way(top, k)
            node = leaf_hash(r, tamper(r))
            for at, sib in steps:
                node = sha256("".join([*sib[:at], node, *sib[at:]]).encode()).hexdigest()
            out.append((r.doc_id, leaf.hex(), grown[s][-1][0], top[-1][0], sha256("".join(x for _, sib in steps for x in sib).encode()).hexdigest(), node, node == top[-1][0]))
    return sorted(out, key=str)


def lower_some(r):
    hit = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
    return re.sub("[A-Z]+", lambda m: m[0].lower(), r.text) if hit else r.text


def manifest_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_manifest_query(spark):
    got = manifest_of(E.queries()["op11_merkle_manifest"](spark, SF001))
    assert got == brute_manifest(documents(spark, SF001).collect(), lower_some)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_edges(edge_docs, no_docs, levels):
    """Nulls everywhere, repeated rows and ids; several rounds of builders."""
    many = edge_docs.unionByName(edge_docs.sparkSession.range(700).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(None).cast("string").alias("lang"),
        F.when(F.col("id") < 600, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 90)).alias("source"), F.col("id").alias("n_chars"),
        F.lit("w").alias("words"), F.lit(1).alias("bucket"), F.lit(2).cast("long").alias("hash")))
    trees, top = M.build(many, levels=levels)
    assert len(trees) > 1 or levels == 2
    want = brute_manifest(many.collect(), lambda r: r.text)
    got = M.proofs(trees, top, levels=levels, with_path=True).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == want
    assert all(r.verified for r in got)
    for r in got:
        assert sha256("".join(p.siblings for p in r.path).encode()).hexdigest() == r.proof_sha256
    assert M.proofs(*M.build(no_docs)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 900), st.sampled_from([2, 3, 16]))
def test_postorder_places(n, fan):
    log = M.PostorderLog(fan)
    leaves = [sha256(str(i).encode()).digest() for i in range(n)]
    for x in leaves:
        log.add(x)
    h = M.height_of(n, fan)
    root = log.finish(h)
    assert M.node_at(h, 0, n, fan) == len(log.log) // 32 - 1 and root == bytes(log.log[-32:])
    level = [x.hex() for x in leaves]
    for k in range(h + 1):
        for j, d in enumerate(level):
            p = M.node_at(k, j, n, fan)
            assert log.log[32 * p:32 * p + 32].hex() == d
        level = [sha256("".join(level[i:i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]


# ------------------------------------------------------------------ op12
def check_sequences(got, capacity=1024):
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    last = capacity
    for r in sorted(got, key=lambda r: r.sequence_id):
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= last
        last = r.length


def want_pieces(rows):
    tok, out = Tokenizer.from_file(PATH), []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        n, at = len(ids), 0
        while at < n:
            m = min(1024, 1 << ((n - at).bit_length() - 1))
            out.append((-1 if i is None else i, at, m, zlib.crc32(ids[at:at + m].tobytes()), n))
            at += m
    return sorted(out)


def test_binary_query(spark):
    got = E.queries()["op12_binary_packing"](spark, SF001).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want_pieces([(r.doc_id, r.text) for r in documents(spark, SF001).collect()])
    check_sequences(got)


def test_binary_edges(edge_docs, no_docs):
    got = B.pack_binary(edge_docs.repartition(3), PATH, batch_tokens=2048, with_ids=True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want_pieces([(r.doc_id, r.text) for r in edge_docs.collect()])
    check_sequences(got)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)
    assert max(Counter((r.length, r.batch) for r in got if r.length == 1024).values()) == 2
    assert B.pack_binary(no_docs, PATH).count() == 0
    with pytest.raises(ValueError):
        B.pack_binary(no_docs, PATH, capacity=1000)


@pytest.fixture(scope="module")
def spaced():
    with open(PATH, encoding="utf-8") as f:
        return B.SpacedEncoder(f.read())


TEXTS = st.lists(st.sampled_from([" ", "  ", "\n", "\n\n", "\t", " ", " ", "\x1c", "word", "it's", "Über", "漢字", "12", "3.5", "<|endoftext|>", "!", "...", "é", "\r\n", "a", "🙂"]), max_size=14)


@settings(max_examples=400, deadline=None)
@given(TEXTS | st.lists(st.characters(exclude_categories=["Cs"]), max_size=12))
def test_spaced_encoding(spaced, parts):
    text = "".join(parts)
    assert np.frombuffer(spaced.encode(text), "<u4").tolist() == spaced.tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5000))
def test_binary_cuts(n):
    cuts = B.binary_cuts(n, 1024)
    assert [lo for lo, _ in cuts] == np.cumsum([0, *(m for _, m in cuts)])[:-1].tolist() and sum(m for _, m in cuts) == n
    small = [m for _, m in cuts if m < 1024]
    assert small == sorted(set(small), reverse=True)


# ------------------------------------------------------------------ op13
def brute_words(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_forms(words):
    by = defaultdict(set)  # words that agree but for one place
    for w in words:
        for i in range(len(w)):
            by[w[:i] + "*" + w[i + 1:]].add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= by[w[:i] + "*" + w[i + 1:]]
            if w[:i] + w[i + 1:] in near:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    form = {}
    for w, x in near.items():
        x.discard(w)
        best = min(x, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def forms_of(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def test_spelling_query(spark):
    got = forms_of(E.queries()["op13_spelling_variants"](spark, SF001))
    assert got == brute_forms(brute_words([(r.doc_id, r.text) for r in documents(spark, SF001).collect()]))
    assert any(r[1] for r in got)


def test_spelling_edges(edge_docs, no_docs):
    assert forms_of(S.spelling_forms(S.word_counts(edge_docs))) == brute_forms(brute_words([(r.doc_id, r.text) for r in edge_docs.collect()]))
    assert S.spelling_forms(S.word_counts(no_docs)).count() == 0


@pytest.mark.parametrize("group", [2, 5, 64])
def test_spelling_crowded_groups(spark, group):
    """Words that share almost everything, also doubled letters, whose one
    edit can be told in several places, and one very long word."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), rng.integers(5, 9))): int(rng.integers(3, 60)) for _ in range(900)}
    words |= {f"interna{x}{y}l": i + 3 for i, (x, y) in enumerate((a, b) for a in "abcdefgh" for b in "stuvwxy")}
    words |= {"aaaaa": 3, "aaaaaa": 9, "aaaaaaa": 40, "x" * 3000: 5, "x" * 3001: 11}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert forms_of(S.spelling_forms(df, group=group)) == brute_forms(words)
    pairs = [tuple(r) for r in S.near_pairs(df, group).select("a", "b").collect()]
    assert len(pairs) == len(set(pairs)) == sum(one_edit(a, b) for a in words for b in words if a < b)


def test_forms_chain(spark):
    words = {"colour": 100, "colou": 40, "colo": 9, "cölou": 12, "cölo": 3, "cölöu": 3, "prose": 7}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r[0]: r for r in forms_of(S.spelling_forms(df))}
    assert got["cölo"][2] == "colour" and got["colour"][1] is None and got["prose"][4] == 0
    assert forms_of(S.spelling_forms(df)) == brute_forms(words)


def test_prose_is_counted(spark):
    text = prose(400, 77)
    got = {r.word: r.n for r in S.word_counts(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()}
    assert got == brute_words([(1, text)] * 2)
