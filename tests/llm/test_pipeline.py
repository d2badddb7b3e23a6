"""The stages on edge cases and on planted documents, against plain versions."""

import corpus_pipeline as P
from shelfcast.llm.common import stash

from .conftest import SF001, prose


def test_stages_keep_columns_and_empty_tables(spark, no_docs):
    docs = no_docs
    for name, stage in P.STAGES:
        out = stash(stage(spark, docs, SF001), f"test-{name}")
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
            docs = out


def test_stages_with_clashing_names(spark):
    """Extra columns with the names that stages use inside."""
    names = ["_id", "_gone", "_r", "_words", "_0", "_l", "_s", "d", "g", "bin", "leaf", "n_words", "hash", "rows"]
    base = [(k, prose(120, 300 + k), "en", "s", 9) for k in range(40)] + [(100, prose(120, 300), "en", "s", 9)]
    docs = spark.createDataFrame([(*r, *([7] * len(names))) for r in base], ["doc_id", "text", "lang", "source", "n_chars", *names])
    columns = docs.columns
    for name, stage in P.STAGES:
        docs = stash(stage(spark, docs, SF001), f"test-{name}")
        assert docs.count() == (41 if name == "quality" else 40)
        if name != "packing":
            assert docs.columns == columns


def test_planted(spark):
    item = spark.read.parquet(f"{SF001}/benchmark.parquet").first().text
    clean = [(k, prose(200, 100 + k)) for k in range(300)]
    rows = [*clean, (1000, clean[0][1]), (1001, clean[1][1] + " one more"), (1002, prose(300, 900) + " " + item + " " + prose(200, 901)),
            (1003, "word " * 300), (1004, " ".join(f"{w}###" for w in prose(200, 902).split())), (1005, None), (1006, prose(200, 903) + " a.b@c.org")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {}
    for name, stage in P.STAGES:
        docs = stash(stage(spark, docs, SF001), f"test-{name}")
        left[name] = {r.doc_id for r in docs.collect()}
    clean_ids = {i for i, _ in clean}
    assert left["quality"] == clean_ids | {1000, 1001, 1002, 1006}
    assert left["near_dedup"] == clean_ids | {1002, 1006}
    assert left["decontamination"] == left["personal_data"] == left["packing"] == clean_ids | {1006}


def test_run(spark):
    got = P.run(spark, SF001).collect()
    assert got and {"doc_id", "sequence_id", "offset", "length"} <= set(got[0].asDict())
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 4096
