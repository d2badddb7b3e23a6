"""op1 against brute force over all pairs."""

import __spark_entry__ as E
from shelfcast.llm import minhash as M
from shelfcast.llm.common import documents, shingle_set

from .conftest import SF001, prose, rows_of


def brute(rows):
    sets = {}
    up = {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    items = []
    for i, t in rows:
        if i is None:
            continue
        up.setdefault(i, i)
        items.append((i, set(shingle_set((t or "").encode()).tolist())))
    for a, (i, s) in enumerate(items):
        for j, u in items[:a]:
            if s and u and 100 * len(s & u) >= 75 * len(s | u):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: find(i) for i in up}


def check(df):
    want = brute(rows_of(df))
    got = M.near_duplicates(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id]), r
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    return got


def test_edges(edge_docs):
    got = {r.doc_id: r for r in check(edge_docs)}
    assert got[11].component_id == 0  # A-Z is lower-cased
    assert got[6].component_id == got[7].component_id == 6 and got[6].n_shingles == 1
    assert got[3].n_shingles == got[5].n_shingles == 0 and got[4].kept


def test_empty(no_docs):
    assert M.near_duplicates(no_docs).count() == 0
    assert M.keep_one(no_docs).columns == no_docs.columns


def test_query_equals_brute_force(spark):
    want = brute(rows_of(documents(spark, SF001)))
    got = E.queries()["op1_minhash_near_dedup"](spark, SF001).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_chain_and_split_centres(spark, monkeypatch):
    """A chain of near copies, whose ends are unlike, in blocks of three."""
    monkeypatch.setattr(M, "BLOCK_DOCS", 3)
    words = prose(300, 7).split()
    rows = []
    for k in range(40):
        words[(k * 7) % 300] = f"edit{k}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = check(df)
    assert {r.component_id for r in got} == {0}


def test_groups_of_a_split_centre_are_bounded(spark, monkeypatch):
    """Documents of one template, alike by 0.6 or so and few of them by 0.75:
    none of the groups compared holds more than a block and a part."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(M, "BLOCK_DOCS", 8)
    sizes, mapped = [], type(spark.range(0)).mapInArrow

    def watched(df, how, schema, *a, **k):
        if {"centre", "block"} < set(df.columns):
            keys = [c for c in df.columns if c in ("centre", "block", "part")]
            sizes.append((keys, df.groupBy(*keys).count().agg(F.max("count")).first()[0]))
        return mapped(df, how, schema, *a, **k)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", watched)
    template = prose(225, 11).split()
    rows = [(k, " ".join(template + [f"own{k}-{i}" for i in range(75)])) for k in range(120)]
    rows += [(1000 + k, t.replace(f"own{k}-9 ", "other ")) for k, t in rows[5:90:17]]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(not r.kept for r in got) == 5
    assert len(sizes) > 1 and max(n for _, n in sizes) <= 4 * M.BLOCK_DOCS, sizes


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 64)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in M.components(edges).collect()}
    assert {got[k] for k in range(1, 65)} == {0} and got[101] == 100


def test_keep_one(edge_docs):
    kept = M.keep_one(edge_docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == edge_docs.columns
    assert ids.count(None) == 2 and ids.count(0) == 1 and 2 not in ids and 16 not in ids and 6 in ids and 7 not in ids
