"""op8: repeated passages by seed and extend.

Seeds are winnowed anchors: of every run of SPAN - SEED + 1 seed hashes the
smallest, so each window of SPAN words holds the anchor that it chooses, and
equal windows choose the same one. Documents are joined on anchors; where an
anchor occurs in several, its occurrence is extended both ways to all windows
that choose it, and their hashes are joined in turn: a window is a repeat if
the same one starts in a document with a smaller doc_id. Repeats inside one
document are found on the spot. Runs of repeated windows are the maximal
repeats. Nothing is paired within a group: for each hash only the smallest
doc_id counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, grams, mix, small_batches, stash, utf8, word_hashes

SPAN, SEED = 20, 6


def windows(text: bytes, span: int = SPAN, seed: int = SEED) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, the hash of each window of ``span`` words, and the hash of the
    anchor that each window chooses (the smallest seed hash inside it)."""
    words = text.split()
    if len(words) < span:
        return words, np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = mix(word_hashes(words))
    seeds = grams(h, seed)
    # sliding minimum by doubling: minima of runs of 1, 2, 4, ... then two that overlap
    run, width = seeds, span - seed + 1
    size = 1
    while size * 2 <= width:
        run = np.minimum(run[:-size], run[size:])
        size *= 2
    if size < width:
        run = np.minimum(run[:len(run) - (width - size)], run[width - size:])
    return words, grams(h, span), run


def repeats_inside(w: np.ndarray) -> np.ndarray:
    """True for each window that also starts earlier in the same document."""
    order = np.argsort(w, kind="stable")
    again = np.zeros(len(w), bool)
    s = w[order]
    again[order[1:][s[1:] == s[:-1]]] = True
    return again


def covered(starts: np.ndarray, n_words: int, span: int = SPAN) -> np.ndarray:
    """True for each word inside a window that begins at one of ``starts``."""
    d = np.zeros(n_words + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + span, -1)
    return np.cumsum(d[:-1]) > 0


def _longs(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int64), *[v.view(np.int64) for v in values]])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, hashes): digest of the words and the distinct anchors
    of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                got = [(_digest(x[0]), np.unique(x[2])) for x in map(windows, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.binary()), _longs([g[1] for g in got])], schema=schema)

    return docs.mapInArrow(run, "doc_id long, digest binary, hashes array<long>")


def extended(seeded: DataFrame) -> DataFrame:
    """Rows (doc_id, text, seeds): the distinct windows that choose one of the
    seeds (anchors shared with other documents), as (doc_id, w)."""
    schema = pa.schema([("doc_id", pa.int64()), ("w", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                got = []
                for t, s in zip(part.column(1).to_pylist(), part.column(2)):
                    _, w, a = windows(t)
                    got.append(np.unique(w[np.isin(a.view(np.int64), s.values.to_numpy())]))
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(g) for g in got])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(got).view(np.int64))], schema=schema)

    return seeded.mapInArrow(run, "doc_id long, w long")


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: int, length: int>>, kept_text string"


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, repeated, copied): words outside every repeated
    window; in a copy of an earlier document every window is one."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), ("kept_text", pa.string())])
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part, out = b.slice(lo, 512), {n: [] for n in schema.names}
            for d, t, r, copied in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist()):
                words, w, _ = windows(t)
                gone, spans, kept = np.zeros(len(words), bool), [], words
                if len(w):
                    again = repeats_inside(w)
                    if copied and _digest(words) in copied:
                        again[:] = True
                    elif r.is_valid:
                        again |= np.isin(w.view(np.int64), r.values.to_numpy())
                    if again.any():
                        gone = covered(np.flatnonzero(again), len(words))
                        edge = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
                        spans = [{"start": int(a), "length": int(z - a)} for a, z in zip(edge[::2], edge[1::2])]
                        kept = [x for x, g in zip(words, gone.tolist()) if not g]
                text = b" ".join(kept)
                for k, v in zip(schema.names, (d, len(words), int(gone.sum()), hashlib.sha256(text).hexdigest(), spans, text.decode() if with_text else None)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: words, words removed, digest of the
    kept words, the maximal repeats (word start and length) and, on request,
    the kept text. Null text has no words; texts under SPAN words lose none.
    Rows that share a doc_id do not count as earlier than one another; a null
    doc_id is neither earlier nor later than any, so only its own repeats go."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8())
    known = d.where("doc_id is not null")
    all_anchors = stash(anchors(known), "anchors")
    # a copy of an earlier document holds no window that starts there first
    # and none that the earlier one lacks: only the earliest goes on
    classes = stash(all_anchors.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "copy-classes")
    copies = stash(all_anchors.select("digest", "doc_id").join(classes, "digest").where("doc_id > first").select("doc_id", "digest").distinct(), "copies")
    found = all_anchors.join(copies, ["doc_id", "digest"], "left_anti").select("doc_id", F.explode("hashes").alias("hash"))
    shared = stash(found.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("hash"), "anchors-shared")
    seeds = found.join(shared, "hash").groupBy("doc_id").agg(F.collect_set("hash").alias("seeds"))  # bounded by the document's length
    wide = stash(extended(known.join(seeds, "doc_id").select("doc_id", "text", "seeds")), "windows")
    first = stash(wide.groupBy("w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "windows-first")
    later = wide.join(first, "w").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("w").alias("repeated"))
    copied = copies.groupBy("doc_id").agg(F.collect_set("digest").alias("copied"))
    out = (d.join(later, "doc_id", "left").join(copied, "doc_id", "left").select("doc_id", "text", "repeated", "copied")
           .mapInArrow(lambda b: _cut(b, with_text), _RESULT))
    return out if with_text else out.drop("kept_text")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all ``documents``."""
    return remove_repeats(documents(spark, sf_dir)).drop("spans")


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS nth
      FROM (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS gram
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20))),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM g WHERE nth > 1),
k AS (SELECT p.doc_id, count(c.i) AS n_removed, string_agg(p.word, ' ' ORDER BY p.i) FILTER (WHERE c.i IS NULL) AS kept
      FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
