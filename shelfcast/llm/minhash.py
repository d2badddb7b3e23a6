"""op1: MinHash near-duplicates.

Universal hash minima of every document's set of 5-word shingles, banded; a
band key shared by several documents makes its smallest doc_id their centre.
All documents that meet at a centre are compared there on full sets: first with
the centre, then those that it did not take with every other (signatures
first, sets to confirm). So every pair that shares a band key is examined, and
no pair is ever emitted but the links of a spanning forest. Centres with many
members are split into blocks; what such a centre did not take is dealt into
parts, and each part meets each block in a group of its own: on wide signatures
first, then, where these leave a chance, on full sets. Components: alternating
large-star, small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix, shingle_set, small_batches, stash, utf8

BANDS, ROWS = 32, 4          # a pair at 0.75 shares no key with chance 5e-6
PERCENT = 75
#: members of a block at most: documents, and shingles in all of them
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 4 << 20
_K = BANDS * ROWS
_RNG = np.random.Generator(np.random.PCG64(20240607))
_A = _RNG.integers(0, 2**64, _K, dtype=np.uint64, endpoint=False) | np.uint64(1)
_B = _RNG.integers(0, 2**64, _K, dtype=np.uint64, endpoint=False)
_C = _RNG.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64, endpoint=False) | np.uint64(1)
#: equal minima (of 128) from which sets are compared: 4 deviations below 0.75
_LEAST = int(_K * 0.75 - 4 * (_K * 0.75 * 0.25) ** 0.5)
#: minima of a wide signature, one byte each, and equal ones from which sets are compared: 6 deviations below 0.75
WIDE = 512
_WIDE = (_RNG.integers(0, 2**64, WIDE, dtype=np.uint64, endpoint=False) | np.uint64(1), _RNG.integers(0, 2**64, WIDE, dtype=np.uint64, endpoint=False))
_WIDE_LEAST = int(WIDE * 0.75 - 6 * (WIDE * 0.75 * 0.25) ** 0.5)


def minima(s: np.ndarray, by: tuple[np.ndarray, np.ndarray] = (_A, _B)) -> np.ndarray:
    """Minimum over the set of each of the multiply-add-shift hashes."""
    x = s >> np.uint64(32)
    out = np.full(len(by[0]), 2**32, np.uint64)
    for lo in range(0, len(x), 1024):
        h = by[0][:, None] * x[None, lo:lo + 1024]
        h += by[1][:, None]
        h >>= np.uint64(32)
        np.minimum(out, h.min(1), out=out)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, 128-bit fingerprint of the set, band keys (none for an empty set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f0", pa.int64()), ("f1", pa.int64()),
                        ("keys", pa.list_(pa.int64()))])
    numbers = np.arange(BANDS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part, n, f, keys = b.slice(lo, 512), [], [], []
                for t in part.column(1).to_pylist():
                    s = shingle_set(t)
                    n.append(len(s))
                    f.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8"))
                    keys.append(mix((minima(s).reshape(BANDS, ROWS) * _C).sum(1, dtype=np.uint64) + numbers).view(np.int64) if len(s) else np.empty(0, np.int64))
                f = np.array(f, np.int64).reshape(-1, 2)
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()),
                                                  pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f0 long, f1 long, keys array<long>")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, on sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    x = np.concatenate([a, b])
    x.sort(kind="stable")
    both = int((x[1:] == x[:-1]).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.find(b)] = self.find(a)


def link_group(sets: list[np.ndarray]) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that join every two similar sets of a group, directly or through
    others, and the members without a way to the first one."""
    f, links = Forest(len(sets)), []
    for i in range(1, len(sets)):
        if similar(sets[0], sets[i]):
            f.join(0, i)
            links.append((0, i))
    probes = [i for i in range(1, len(sets)) if f.find(i) != f.find(0)]
    if len(sets) > 2 and probes:
        sig = np.array([minima(s) for s in sets]).astype(np.uint32)
        for i in probes:
            equal = (sig == sig[i]).sum(1)
            for j in sorted(np.flatnonzero(equal >= _LEAST).tolist(), key=lambda j: -equal[j]):
                if f.find(i) != f.find(j) and similar(sets[i], sets[j]):
                    f.join(i, j)
                    links.append((i, j))
    return links, [i for i in range(len(sets)) if f.find(i) != f.find(0)]


def meets(role: np.ndarray, ids: np.ndarray, i: int) -> np.ndarray:
    """Members that the probe i is compared with: those that the centre has
    (role 0), and of those it has not (1) the ones with a smaller doc_id, as
    the larger of two is the probe (2)."""
    return (role == 0) | (role == 1) & (ids < ids[i])


def link_probes(sets: list[np.ndarray], role: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Links of the probes with the members they meet. Each probe is counted
    against all sets at once."""
    n = np.array([len(s) for s in sets])
    ends = np.cumsum(n)
    grams, at = np.unique(np.concatenate(sets), return_inverse=True)
    mark, at = np.zeros(len(grams), np.uint8), at.astype(np.int32)
    f, links = Forest(len(sets)), []
    linked = np.flatnonzero(role == 0).tolist()
    for i in linked:
        f.join(linked[0], i)
    for i in np.flatnonzero(role == 2).tolist():
        own = at[ends[i] - n[i]:ends[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[at], ends - n, dtype=np.int64)
        mark[own] = 0
        for j in np.flatnonzero((100 * both >= PERCENT * (n + n[i] - both)) & meets(role, ids, i)).tolist():
            if f.find(i) != f.find(j):
                f.join(i, j)
                links.append((i, j))
    return links


def _groups(batches: Iterator[pa.RecordBatch], keys: int, made=shingle_set) -> Iterator[list[tuple]]:
    """Runs of rows with equal first ``keys`` columns, from sorted batches."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() if i < b.num_columns - 1 else b.column(i) for i in range(b.num_columns))):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            # the text becomes its set at once: eight bytes a shingle
            held.append((*row[:-1], made(row[-1].as_py())))
    if held:
        yield held


_LINKS = "kind int, centre long, block int, u long, v long"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    names = ("kind", "centre", "block", "u", "v")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], list(names))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (centre, block, rest, doc_id, text), the centre first: links (kind
    0) and, of split centres, members without a way to the centre (kind 1)."""
    out: list[tuple] = []
    for g in _groups(batches, 2):
        centre, block, *_ = g[0]
        links, left = link_group([r[-1] for r in g])
        out += [(0, None, None, g[i][3], g[j][3]) for i, j in links]
        if block >= 0:
            out += [(1, centre, block, g[i][3], None) for i in left]
        if len(out) >= 10000:
            yield _emit(out)
            out = []
    yield _emit(out)


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) -> (doc_id, wide signature), none for an empty set."""
    for b in batches:
        sets = [(d, s) for d, t in zip(b.column(0).to_pylist(), b.column(1)) if len(s := shingle_set(t.as_py()))]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in sets], pa.int64()), pa.array([minima(s, _WIDE).astype(np.uint8).tobytes() for _, s in sets], pa.binary())], ["doc_id", "sig"])


_DEALT = "centre long, block int, part int, role int, doc_id long"


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (centre, block, part, role, doc_id, wide signature): those without
    the signature that have any chance of a link in their group."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    for g in _groups(batches, 3, lambda x: np.frombuffer(x, np.uint8)):
        role, ids, sig = np.array([r[3] for r in g]), np.array([r[4] for r in g]), np.array([r[-1] for r in g])
        some = np.zeros(len(g), bool)
        for i in np.flatnonzero(role == 2).tolist():
            near = ((sig == sig[i]).sum(1) >= _WIDE_LEAST) & meets(role, ids, i)
            some |= near
            some[i] = near.any()
        rows = [g[i][:-1] for i in np.flatnonzero(some).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["centre", "block", "part", "role", "doc_id"])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (centre, block, part, role, doc_id, text): links of the probes."""
    for g in _groups(batches, 3):
        g = [r for r in g if len(r[-1])]
        links = link_probes([r[-1] for r in g], np.array([r[3] for r in g]), np.array([r[4] for r in g])) if g else []
        yield _emit([(0, None, None, g[i][4], g[j][4]) for i, j in links])


def candidate_links(docs: DataFrame, sig: DataFrame) -> DataFrame:
    """Verified links (u, v) between documents with different sets that share a band key."""
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("f0", "f1").agg(F.min("doc_id").alias("doc_id"))
    keys = sig.join(classes, ["f0", "f1", "doc_id"], "left_semi").select(F.explode("keys").alias("key"), "doc_id", F.col("n_shingles").cast("int").alias("n"))
    centres = stash(keys.groupBy("key").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last"))
                    .where("centre < last").drop("last"), "minhash-centres")
    members = stash(keys.join(centres, "key").where("doc_id <> centre").groupBy("centre", "doc_id").agg(F.max("n").alias("n")), "minhash-members")
    split = F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    large = stash(members.groupBy("centre").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
                  .select("centre", split.alias("blocks")).where("blocks > 1"), "minhash-large")
    # block -1: the centre has one block
    block = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.lit(-1))
    dealt = members.join(large, "centre", "left").select("centre", block.alias("block"), F.lit(1).alias("rest"), "doc_id")
    heads = (members.select("centre").distinct().join(large, "centre", "left")
             .select("centre", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.expr("sequence(0, blocks - 1)"))).alias("block"),
                     F.lit(0).alias("rest"), F.col("centre").alias("doc_id")))
    texts = docs.where("doc_id is not null").select("doc_id", "text")

    def compared(rows: DataFrame, keys: list[str], of: DataFrame, how, schema: str) -> DataFrame:
        return (rows.join(of, "doc_id").select(*rows.columns, of.columns[-1]).repartition(*keys)
                .sortWithinPartitions(*rows.columns).mapInArrow(how, schema))

    found = stash(compared(dealt.unionByName(heads), ["centre", "block"], texts, _compare, _LINKS), "minhash-links")
    links = found.where("kind = 0").select("u", "v")
    left = found.where("kind = 1").select("centre", "block", F.col("u").alias("doc_id")).distinct()
    if left.take(1):
        # what a split centre has not, in parts no larger than a block, each
        # with every block but a probe's own: (centre, block, part) is bounded
        parts = stash(left.join(members, ["centre", "doc_id"]).groupBy("centre").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
                      .select("centre", split.alias("parts")), "minhash-parts")
        probes = (left.join(large, "centre").join(parts, "centre")
                  .select("centre", F.col("block").alias("own"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"),
                          F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts")).cast("int").alias("part"), F.lit(2).alias("role"), "doc_id")
                  .where("own <> block").drop("own"))
        there = (dealt.where("block >= 0").join(parts, "centre").join(left.withColumn("l", F.lit(1)), ["centre", "block", "doc_id"], "left")
                 .select("centre", "block", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.coalesce("l", F.lit(0)).alias("role"), "doc_id"))
        across, group = there.unionByName(probes), ["centre", "block", "part"]
        wide = stash(texts.join(members.join(parts, "centre", "left_semi").select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_wide, "doc_id long, sig binary"), "minhash-wide")
        near = stash(compared(across, group, wide, _screen, _DEALT), "minhash-near").distinct()
        links = links.unionByName(stash(compared(near, group, texts, _probe, _LINKS), "minhash-across").select("u", "v"))
    return links


def components(edges: DataFrame, limit: int = 100) -> DataFrame:
    """(node, component): component is the smallest node reachable, for every
    node of an edge. Alternating large-star and small-star until nothing
    changes; each round is written, so lineage stays short."""
    def tidy(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = stash(tidy(edges), "components")
    before = state(e)
    for _ in range(limit):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the join are exchanged and Spark can
        # split the neighbours of a node that very many others link to
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least")
        large = stash(tidy(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "components-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = stash(tidy(large.join(low, "u").select("v", "m").toDF("u", "v").unionByName(low.toDF("u", "v"))), "components")
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    return e.toDF("node", "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs(doc_id,
    text)``. Empty sets (null or blank text) link with nothing. Rows that
    share a doc_id are one node. A null doc_id links with nothing: its
    component is null and it is kept."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8())
    sig = stash(signatures(docs), "minhash-signatures")
    known = sig.where("n_shingles > 0 and doc_id is not null")
    classes = stash(known.groupBy("f0", "f1").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "minhash-classes")
    # copies stand for their class and are no edges, but for doc_ids that have
    # rows in several classes and so tie these together
    tied = known.groupBy("doc_id").agg(F.min(F.struct("f0", "f1")).alias("a"), F.max(F.struct("f0", "f1")).alias("z")).where("a <> z").select("doc_id")
    ties = known.join(stash(tied, "minhash-tied"), "doc_id").join(classes, ["f0", "f1"]).where("doc_id <> first").select(F.col("first").alias("u"), F.col("doc_id").alias("v"))
    found = components(candidate_links(docs, sig).unionByName(ties))
    rep = (sig.join(classes, ["f0", "f1"], "left")
           .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))).otherwise(F.col("doc_id")).alias("rep")))
    own = found.select(F.col("node").alias("rep"), "component")
    # a tied doc_id has the component of any of its classes
    by_id = rep.join(own, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return (by_id
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one
    with the smallest doc_id (of rows that share it, the one with the smallest
    hash). All columns stay. Texts are shuffled only where the lists of ids to
    drop are too large for Spark to broadcast."""
    found = stash(near_duplicates(docs), "minhash-found")
    gone = stash(found.where("not kept").select("doc_id").distinct(), "minhash-gone")
    twice = stash(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "minhash-twice")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    cols = [F.col(c) for c in docs.columns]
    one = F.min_by(F.struct(*cols), F.xxhash64(*cols))
    once, more = (left.join(twice, "doc_id", how).select(*docs.columns) for how in ("left_anti", "left_semi"))
    return once.unionByName(more.groupBy("doc_id").agg(one.alias("_r")).select("_r.*"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all ``documents``."""
    return near_duplicates(documents(spark, sf_dir))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i + 4], ' ') ELSE array_to_string(ws, ' ') END AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s AS a JOIN s AS b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT u, v FROM l JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT u, v FROM k UNION ALL SELECT v, u FROM k),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents AS d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
