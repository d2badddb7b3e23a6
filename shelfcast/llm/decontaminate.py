"""op6: benchmark items inside documents by MinHash containment.

DataFrame functions only. Items are partitioned by size (powers of two of
their shingle count); an item's sketch holds its smallest shingle hashes, so
many that a document with at least THRESHOLD of its shingles must have one of
them: floor((1 - t) * n) + 1 minima leave too few others. Documents look
their shingle hashes up among the minima of the size partitions that they can
hold, which gives candidate pairs and misses none; each is then verified by
its exact shingles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, SHINGLE, SPACE, documents, stash

THRESHOLD = 75  # percent of an item's shingles


def _with_words(df: DataFrame) -> DataFrame:
    """``df`` with _words: lower-case words of text (null text: none)."""
    t = F.btrim(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(BLANKS))
    return df.withColumn("_words", F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE)))


def _hashes():
    """Hash of each shingle, in text order; fewer words are one shingle."""
    five = ", ".join(f"_words[i + {k}]" for k in range(SHINGLE))
    return F.expr(f"""case when size(_words) >= {SHINGLE} then transform(sequence(0, size(_words) - {SHINGLE}), i -> xxhash64({five}))
                      when size(_words) > 0 then array(xxhash64(_words)) else cast(array() as array<bigint>) end""")


def _shingles():
    """The distinct shingles themselves."""
    return F.expr(f"""array_distinct(case when size(_words) >= {SHINGLE}
                      then transform(sequence(1, size(_words) - {SHINGLE - 1}), i -> array_join(slice(_words, i, {SHINGLE}), ' '))
                      when size(_words) > 0 then array(array_join(_words, ' ')) else cast(array() as array<string>) end)""")


def short_lengths(items: DataFrame) -> list[int]:
    """Numbers of words under SHINGLE that items have (four at most)."""
    n = F.size("_words")
    return sorted(r.n for r in _with_words(items).select(n.alias("n")).where((F.col("n") > 0) & (F.col("n") < SHINGLE)).distinct().collect())


def _short(lengths: list[int], one: str) -> list:
    """Runs of so many words of texts that have more, each as ``one``."""
    return [F.expr(f"case when size(_words) > {k} then transform(sequence(1, size(_words) - {k - 1}), i -> {one.format(run=f'slice(_words, i, {k})')}) end") for k in lengths]


def _all_of(first, more: list):
    """``first`` and what there is of the others, as one array."""
    return F.concat(first, *[F.coalesce(c, F.filter(first, lambda x: F.lit(False))) for c in more]) if more else first


def sketches(items: DataFrame) -> DataFrame:
    """(size_class, item_id, n_item, hash): the minima of each item."""
    # explode_outer: for explode Catalyst infers a filter on the array's size
    # and would make the array twice, element by element
    h = _with_words(items).select("item_id", F.array_sort(F.array_distinct(_hashes())).alias("h"))
    n = F.size("h")
    return h.select(F.floor(F.log2(n.cast("double"))).cast("int").alias("size_class"), "item_id", n.alias("n_item"),
                    F.explode_outer(F.slice("h", F.lit(1), F.floor((100 - THRESHOLD) * n / 100).cast("int") + 1)).alias("hash")).where("hash is not null")


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id) of documents that have a minimum of an item
    and are large enough for THRESHOLD of the items of its size partition."""
    # a written table, so that Spark broadcasts it only if its size allows
    sk = stash(sketches(items), "item-sketches")
    more = _short(short_lengths(items), "xxhash64({run})")
    h = _with_words(docs.select("doc_id", "text")).select("doc_id", _all_of(_hashes(), more).alias("h"))
    seen = h.select("doc_id", F.size("h").alias("n_doc"), F.explode_outer("h").alias("hash"))
    least = F.expr("shiftleft(1, size_class)")  # the smallest size of the partition
    return (seen.join(sk, "hash").where(100 * F.col("n_doc") >= THRESHOLD * least)
            .where(100 * F.col("n_doc") >= THRESHOLD * F.col("n_item")).select("doc_id", "item_id").distinct())


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): documents with at least THRESHOLD
    percent of the shingles of an item. Texts without words never match; an
    item of fewer than five words is one shingle, its whole sequence, which is
    looked for among the runs of as many words of a document. Rows that
    share a doc_id (null included) are reported together, with the largest
    n_shared; so are items that share an item_id and are equally long."""
    pairs = stash(candidates(docs, items), "contamination-pairs")
    # one row per document, so that its shingles are made once
    of_doc = pairs.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_list("item_id").alias("_items"))
    texts = docs.select("doc_id", "text").join(of_doc, F.col("doc_id").eqNullSafe(F.col("_d")))
    more = _short(short_lengths(items), "array_join({run}, ' ')")
    sets = _with_words(texts).select("doc_id", "_items", _all_of(_shingles(), more).alias("_in_doc"))
    exact = stash(_with_words(items.select("item_id", "text")).select(F.col("item_id").alias("_i"), _shingles().alias("_in_item")), "item-shingles")
    pair = sets.select("doc_id", "_in_doc", F.explode("_items").alias("item_id")).join(exact, F.col("item_id") == F.col("_i"))
    return (pair.select("doc_id", "item_id", F.size("_in_item").cast("long").alias("n_item"),
                        F.size(F.array_intersect("_in_item", "_in_doc")).cast("long").alias("n_shared"))
            .where("n_item > 0").where(100 * F.col("n_shared") >= THRESHOLD * F.col("n_item"))
            .groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared")))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    gone = stash(contaminated(docs, items).select("doc_id").distinct(), "contaminated")
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left_anti")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all benchmark items."""
    return contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir))


OP6_SQL = r"""
WITH w AS (
  SELECT 0 AS k, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (SELECT DISTINCT k, id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i + 4], ' ') ELSE array_to_string(ws, ' ') END AS gram
      FROM (SELECT k, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
      UNION SELECT 0, id, array_to_string(ws[i:i + n - 1], ' ')
      FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
            FROM w JOIN (SELECT DISTINCT len(ws) AS n FROM w WHERE k = 1 AND len(ws) BETWEEN 1 AND 4) AS short ON len(ws) > n WHERE k = 0)),
n AS (SELECT id, count(*) AS n_item FROM s WHERE k = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n.n_item, count(*) AS n_shared
FROM s AS d JOIN s AS b ON d.gram = b.gram AND d.k = 0 AND b.k = 1 JOIN n ON n.id = b.id
GROUP BY d.id, b.id, n.n_item HAVING 100 * count(*) >= 75 * n.n_item
"""
