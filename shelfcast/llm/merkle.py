"""op11: Merkle manifest of a dataset as postorder append logs.

Leaves of a tree are dealt to aligned builders of ``fan ** levels``
consecutive places. A builder appends each digest to its log when the node is
complete: a leaf as it comes, a parent right after its last child. Places in
such a log follow from subtree sizes alone, so siblings are read by address.
The builders' own roots are the leaves of the next round's builders, and the
trees' roots those of the tree on top: no task holds more than one builder.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_SQL, documents, ranked, small_batches, stash

FAN, LEVELS = 16, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: the tree over the sources' roots; a source's own key is "" (null) or starts with "+"
TOP = "*"
LOG = ("tree string, round int, block long, total long, n int, height int, root binary, log binary, "
       "ids array<bigint>, names array<string>, shown binary")
PATH = "tree string, block long, at array<int>, siblings array<binary>, subroot binary, root binary"
PROOF = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
         "verified boolean, path array<struct<at: int, siblings: string>>")


# ---------------------------------------------------------------- closed forms
def leaf_at(i: int, fan: int = FAN) -> int:
    """Place of leaf ``i`` in a postorder log: the leaves before it and the
    nodes complete by then."""
    at = 0
    while i:
        at += i
        i //= fan
    return at


def node_at(h: int, j: int, n: int, fan: int = FAN) -> int:
    """Place of node ``j`` of height ``h`` in the log over ``n`` leaves: ``h``
    steps behind its last leaf."""
    return leaf_at(min((j + 1) * fan ** h, n) - 1, fan) + h


def height_of(n: int, fan: int = FAN) -> int:
    """Rounds of hashing until one node is left."""
    h = 0
    while n > 1:
        n, h = -(-n // fan), h + 1
    return h


class PostorderLog:
    """Appends digests in completion order; open runs are all it keeps besides."""

    def __init__(self, fan: int = FAN):
        self.fan, self.n, self.log, self.open = fan, 0, bytearray(), [[]]

    def add(self, digest: bytes) -> None:
        self.n += 1
        self._put(0, digest)

    def _put(self, h: int, digest: bytes) -> None:
        self.log += digest
        if h == len(self.open):
            self.open.append([])
        self.open[h].append(digest.hex())
        if len(self.open[h]) == self.fan:
            self._close(h)

    def _close(self, h: int) -> None:
        digest = sha256("".join(self.open[h]).encode()).digest()
        self.open[h] = []
        self._put(h + 1, digest)

    def finish(self, height: int) -> bytes:
        """Close what is open below ``height``; the root."""
        for h in range(height):
            if self.open[h]:
                self._close(h)
        return bytes(self.log[-32:])


def runs(log: bytes, n: int, height: int, fan: int = FAN) -> list[list[str]]:
    """Hex digests of each run of siblings, by height, read by address."""
    out = []
    for h in range(height):
        nodes = -(-n // fan ** h)
        out.append(["".join(log[32 * p:32 * p + 32].hex() for p in (node_at(h, j, n, fan) for j in range(lo, min(lo + fan, nodes))))
                    for lo in range(0, nodes, fan)])
    return out


# ---------------------------------------------------------------- build
def digest_of(columns: dict[str, Column]) -> Column:
    """Leaf digest: of each column ``-`` if null, else byte count, ``:``, value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns.values()]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _builders(level: DataFrame, round_: int, fan: int, levels: int) -> DataFrame:
    """One row per builder from (tree, idx, n, digest, doc_id, name, shown)."""
    span = fan ** levels
    small_batches(level.sparkSession)

    def run(batches):
        out: dict[str, list] = {}
        key = book = None

        def flush():
            tree, block, total = key
            height = levels if total > span else height_of(total, fan)
            root = book[0].finish(height)
            row = (tree, round_, block, total, book[0].n, height, root, bytes(book[0].log), book[1], book[2], b"".join(x or b"" for x in book[3]))
            for f, v in zip(schema, row):
                out.setdefault(f.name, []).append(v)

        def batch():
            b = pa.RecordBatch.from_arrays([pa.array(out.get(f.name, []), f.type) for f in schema], schema=schema)
            out.clear()
            return b

        for b in batches:
            for tree, block, total, digest, i, name, shown in zip(*(c.to_pylist() for c in b.columns)):
                if key != (tree, block, total):
                    if book:
                        flush()
                        if len(out["tree"]) >= 128:
                            yield batch()
                    key, book = (tree, block, total), (PostorderLog(fan), [], [], [])
                book[0].add(digest)
                if round_ == 0:
                    for to, v in zip(book[1:], (i, name, shown)):
                        to.append(v)
        if book:
            flush()
            yield batch()

    schema = _arrow(LOG)
    block = F.floor(F.col("idx") / span)
    dealt = level.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
    return dealt.select("tree", "block", F.col("n").alias("total"), "digest", "doc_id", "name", "shown").mapInArrow(run, LOG)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _grow(leaves: DataFrame, name: str, fan: int, levels: int) -> list[DataFrame]:
    """Logs of all rounds; a tree whose leaves fill more than one builder has
    its builders' roots as leaves of the next round."""
    rounds, level, span = [], leaves, fan ** levels
    while True:
        rounds.append(stash(_builders(level, len(rounds), fan, levels), f"{name}-log"))
        most = rounds[-1].agg(F.max("total")).first()[0]
        if most is None or most <= span:
            return rounds
        level = rounds[-1].where(F.col("total") > span).select(
            "tree", F.col("block").alias("idx"), F.ceil(F.col("total") / span).alias("n"), F.col("root").alias("digest"),
            F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("binary").alias("shown"))


def build(df: DataFrame, fan: int = FAN, levels: int = LEVELS, shown: dict[str, Column] | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Logs of the trees of all sources and of the tree on top, by round.
    Leaves ascend by doc_id (nulls first, equal ids by digest). ``shown`` names
    columns as a reader presents them, whose digests are kept beside the leaves
    to be checked; by default the rows themselves. An empty table has no log."""
    own = {c: F.col(c) for c in FIELDS}
    leaf = digest_of(own)
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))
    rows = stash(df.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"),
                           (digest_of({**own, **shown}) if shown else F.lit(None).cast("binary")).alias("shown")), "leaves")
    placed = ranked(rows, "tree", ["doc_id", "digest"], "leaves-in-order")
    trees = _grow(placed.select("tree", "idx", "n", "digest", "doc_id", F.lit(None).cast("string").alias("name"),
                                F.coalesce("shown", "digest").alias("shown")), "source", fan, levels)
    done = trees[0].where(F.col("total") <= fan ** levels).select("tree", "root")
    for t in trees[1:]:
        done = done.unionByName(t.where(F.col("total") <= fan ** levels).select("tree", "root"))
    subroots = stash(done.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), "subroots")
    top = ranked(subroots, "tree", ["name"], "subroots-in-order")
    return trees, _grow(top.select("tree", "idx", "n", "digest", F.lit(None).cast("long").alias("doc_id"), "name",
                                   F.lit(None).cast("binary").alias("shown")), "top", fan, levels)


# ---------------------------------------------------------------- proofs
def _expand(rows: DataFrame, top: bool, fan: int, levels: int) -> DataFrame:
    """Paths of a builder's leaves: its own siblings by address, then the
    builder's path. The leaves of a round above the first are builders."""
    span = fan ** levels
    schema = _arrow(PATH)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                book = runs(r["log"], r["n"], r["height"], fan)
                for lo in range(0, r["n"], 128):
                    out = []
                    for i in range(lo, min(lo + 128, r["n"])):
                        at, sib, j = [], [], i
                        for level in book:
                            k = j % fan
                            run_ = level[j // fan]
                            at.append(k)
                            sib.append(bytes.fromhex(run_[:64 * k] + run_[64 * k + 64:]))
                            j //= fan
                        first = r["round"] == 0 and top
                        leaf = r["log"][32 * leaf_at(i, fan):][:32]
                        out.append((r["names"][i] if first else r["tree"], 0 if first else r["block"] * span + i, at + r["at"], sib + r["siblings"],
                                    leaf if first else r["subroot"], r["above"] or r["root"]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(run, PATH)


def _prove(rows: DataFrame, fan: int, with_path: bool) -> DataFrame:
    schema = _arrow(PROOF)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                book = runs(r["log"], r["n"], r["height"], fan)
                up = [(k, s.hex()) for k, s in zip(r["at"], r["siblings"])]
                tail = "".join(s for _, s in up).encode()
                log, shown, subroot, root = r["log"].hex(), r["shown"].hex(), r["subroot"].hex(), r["above"].hex()
                out = []
                for i, doc in enumerate(r["ids"]):
                    proof, node, path, j = sha256(), shown[64 * i:64 * i + 64], [], i
                    for level in book:
                        k, s = 64 * (j % fan), level[j // fan]
                        proof.update((s[:k] + s[k + 64:]).encode())
                        node = sha256((s[:k] + node + s[k + 64:]).encode()).hexdigest()
                        if with_path:
                            path.append({"at": j % fan, "siblings": s[:k] + s[k + 64:]})
                        j //= fan
                    proof.update(tail)
                    for k, s in up:
                        node = sha256((s[:64 * k] + node + s[64 * k:]).encode()).hexdigest()
                    p = 64 * leaf_at(i, fan)
                    out.append((doc, log[p:p + 64], subroot, root, proof.hexdigest(), node, node == root,
                                [*path, *({"at": k, "siblings": s} for k, s in up)] if with_path else None))
                for lo in range(0, len(out), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[lo:lo + 1024]), schema)], schema=schema)

    return rows.mapInArrow(run, PROOF)


def proofs(trees: list[DataFrame], top: list[DataFrame], fan: int = FAN, levels: int = LEVELS, with_path: bool = False) -> DataFrame:
    """Per leaf its digest, subroot, root, the digest of its proof (siblings
    from the leaf to the root, left to right) and the root folded from the
    digest that was shown, with the proof itself (place in the run and hex of
    the siblings, by level) on request."""
    span = fan ** levels
    own = ["tree", "round", "block", "n", "height", "log", "ids", "names", "shown", "root"]
    empty = [F.array().cast("array<int>").alias("at"), F.array().cast("array<binary>").alias("siblings"), F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("above")]
    up = None
    for r, t in reversed(list(enumerate(top))):
        ends = t.where(F.col("total") <= span).select(*own, *empty)
        if up is not None:
            ends = ends.unionByName(t.where(F.col("total") > span).select(*own).join(up, ["tree", "block"]))
        up = _expand(ends, True, fan, levels).withColumnRenamed("root", "above")
    names = stash(up.drop("block"), "source-paths")
    up = None
    for r, t in reversed(list(enumerate(trees))):
        ends = t.where(F.col("total") <= span).select(*own).join(names, "tree")
        if up is not None:
            ends = ends.unionByName(t.where(F.col("total") > span).select(*own).join(up, ["tree", "block"]))
        if r:
            up = stash(_expand(ends, False, fan, levels).withColumnRenamed("root", "above"), "builder-paths")
    got = _prove(ends, fan, with_path)
    return got if with_path else got.drop("path")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: manifest of all ``documents``; rows whose doc_id has a
    crc32 divisible by 5 are shown with the text in lower case."""
    abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(hit, F.translate("text", abc, abc.lower())).otherwise(F.col("text"))
    trees, top = build(documents(spark, sf_dir), shown={"text": text})
    return proofs(trees, top)


OP11_SQL = r"""
WITH RECURSIVE""" + CRC_SQL + r""",
ids AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
hit AS (SELECT doc_id, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS BIGINT)),
                                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS tampered FROM ids, crc_table),
f AS (SELECT d.doc_id, d.source, d.text, coalesce(tampered, FALSE) AS tampered,
             coalesce(octet_length(encode(CAST(d.doc_id AS VARCHAR))) || ':' || d.doc_id, '-') || coalesce(octet_length(encode(d.source)) || ':' || d.source, '-')
             || coalesce(octet_length(encode(d.lang)) || ':' || d.lang, '-') || coalesce(octet_length(encode(CAST(d.n_chars AS VARCHAR))) || ':' || d.n_chars, '-') AS head,
             coalesce(octet_length(encode(d.text)) || ':', '') AS size
      FROM documents AS d LEFT JOIN hit ON hit.doc_id = d.doc_id),
l AS (SELECT doc_id, source, sha256(head || coalesce(size || text, '-')) AS leaf,
             CASE WHEN tampered THEN sha256(head || coalesce(size || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))
                  ELSE sha256(head || coalesce(size || text, '-')) END AS shown FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l),
tree AS (
  SELECT 0 AS h, source, CAST(i AS BIGINT) AS i, CAST(n AS BIGINT) AS n, leaf AS d FROM p
  UNION ALL
  SELECT h + 1, source, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY h, source, i // 16, n),
sub AS (SELECT source, d, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS h, CAST(i AS BIGINT) AS i, CAST(n AS BIGINT) AS n, d FROM sub
  UNION ALL
  SELECT h + 1, i // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY h, i // 16, n),
run AS (SELECT h, source, i // 16 AS r, string_agg(d, '' ORDER BY i) AS ds FROM tree WHERE n > 1 GROUP BY ALL),
toprun AS (SELECT h, i // 16 AS r, string_agg(d, '' ORDER BY i) AS ds FROM top WHERE n > 1 GROUP BY ALL),
walk AS (
  SELECT 0 AS step, 0 AS h, FALSE AS up, doc_id, source, leaf, CAST(i AS BIGINT) AS i, CAST(n AS BIGINT) AS n, shown AS node, '' AS proof, row_number() OVER () AS k FROM p
  UNION ALL
  SELECT step + 1, CASE WHEN NOT w.up AND w.n = 1 THEN 0 ELSE w.h + 1 END, w.up OR w.n = 1, doc_id, w.source, leaf,
         CASE WHEN NOT w.up AND w.n = 1 THEN sub.i ELSE w.i // 16 END, CASE WHEN NOT w.up AND w.n = 1 THEN sub.n ELSE (w.n + 15) // 16 END,
         CASE WHEN NOT w.up AND w.n = 1 THEN node ELSE sha256(substr(coalesce(run.ds, toprun.ds), 1, 64 * (w.i % 16)) || node || substr(coalesce(run.ds, toprun.ds), 64 * (w.i % 16) + 65)) END,
         CASE WHEN NOT w.up AND w.n = 1 THEN proof ELSE proof || substr(coalesce(run.ds, toprun.ds), 1, 64 * (w.i % 16)) || substr(coalesce(run.ds, toprun.ds), 64 * (w.i % 16) + 65) END, k
  FROM walk AS w LEFT JOIN run ON NOT w.up AND w.n > 1 AND run.h = w.h AND run.source IS NOT DISTINCT FROM w.source AND run.r = w.i // 16
       LEFT JOIN toprun ON w.up AND toprun.h = w.h AND toprun.r = w.i // 16
       LEFT JOIN sub ON NOT w.up AND w.n = 1 AND sub.source IS NOT DISTINCT FROM w.source
  WHERE NOT (w.up AND w.n = 1))
SELECT w.doc_id, w.leaf, sub.d AS subroot, top.d AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = top.d AS verified
FROM walk AS w JOIN top ON top.n = 1 JOIN sub ON sub.source IS NOT DISTINCT FROM w.source WHERE w.up AND w.n = 1
"""
