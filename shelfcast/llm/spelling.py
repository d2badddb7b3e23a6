"""op13: spelling variants by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. The shorter word is cut into two disjoint chunks; one edit
leaves one of them as it is, at its place in the longer word or shifted by the
one code point. So the words meet on that chunk: the shorter one offers its
chunks, the longer one its positional grams. Where too many words meet, the
part that is still open is cut again, which makes the shared text longer;
verification then sees bounded groups only.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_SQL, documents, small_batches, stash, utf8

RUN = re.compile("[a-zÀ-ÿ]+")
#: words that meet in one group before it is cut further
GROUP = 64


def word_counts(df: DataFrame, min_length: int = 5, min_count: int = 3, noise: int = 97) -> DataFrame:
    """Words (word, n) of the whole texts: maximal runs of letters, lower-cased
    in A-Z only, one code point deleted where ``noise`` divides the crc32 of
    ``<doc_id>:<run>`` (a null doc_id counts as an empty number; null texts
    have no words). Counted per task before the shuffle."""
    small_batches(df.sparkSession)

    def run(batches):
        counts: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pre = zlib.crc32(b"" if doc is None else b"%d" % doc)
                pre = zlib.crc32(b":", pre)
                for w, n in Counter(RUN.findall(raw.lower().decode("utf-8", "replace"))).items():
                    if len(w) >= min_length:
                        h = zlib.crc32(w.encode(), pre)
                        if h % noise:
                            counts[w] += n
                        elif len(w) > min_length:
                            at = h % len(w)
                            counts[w[:at] + w[at + 1:]] += n
                if len(counts) > 200_000:
                    yield flush()
                    counts.clear()
        if counts:
            yield flush()

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------- meeting on chunks
def _meet(rows: DataFrame, regions: Column) -> DataFrame:
    """One row per open region [lo, hi) of the shorter word, of ``p`` code
    points: the group of the words that share all before and behind it."""
    r = rows.withColumn("_r", F.explode(regions)).select("word", "n", "p", "_r.lo", "_r.hi")
    size = F.char_length("word").cast("int")
    shared = F.xxhash64("p", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")),
                        F.substring("word", size - F.col("p") + F.col("hi") + 1, F.col("p") - F.col("hi")))
    return r.withColumn("meet", shared)


def _region(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def near_pairs(words: DataFrame, group: int = GROUP, name: str = "spelling") -> DataFrame:
    """Pairs (a, n_a, b, n_b) of near words, each once, from distinct words.

    A word of p code points offers its two chunks (what lies before and behind
    the cut in the middle); words of p and p + 1 offer the grams that a chunk of
    p can meet, at its own place or one further. A group of more than ``group``
    words is replaced by the two groups that a cut in the middle of its open
    region gives, until the region has one code point: then a group has at most
    one word per letter and length."""
    size = F.char_length("word").cast("int")
    roles = words.withColumn("p", F.explode(F.array(size, size - 1))).where("p > 0")
    cut = F.floor(F.col("p") / 2)
    level = _meet(roles, F.array(_region(F.lit(0), cut), _region(cut, F.col("p"))))
    cold = None
    while True:
        level = stash(level, f"{name}-groups")
        # of one open code point, only insertions beside it can be told apart further
        openly = (F.col("hi") - F.col("lo") > 1) | ((F.col("hi") - F.col("lo") == 1) & (size > F.col("p")))
        crowded = stash(level.groupBy("meet").agg(F.count("*").alias("c"), F.max(openly).alias("o"))
                        .where((F.col("c") > group) & F.col("o")).select("meet"), f"{name}-crowded")
        some = not crowded.isEmpty()
        rest = level.join(crowded, "meet", "left_anti") if some else level
        cold = rest if cold is None else cold.unionByName(rest)
        if not some:
            break
        lo, hi = F.col("lo"), F.col("hi")
        mid = F.floor((lo + hi) / 2)
        # one open code point: an inserted one lies before it, or at the very
        # end behind it; a replaced one stays open, among words of one length
        beside = F.concat(F.array(_region(lo, lo)), F.when(hi == F.col("p"), F.array(_region(hi, hi))).otherwise(F.array().cast("array<struct<lo: int, hi: int>>")))
        beside = F.when(size == F.col("p"), F.concat(F.array(_region(lo, hi)), beside)).otherwise(beside)
        kept = F.when(hi - lo == 1, beside).otherwise(F.array(_region(lo, mid), _region(mid, hi)))
        level = _meet(level.join(crowded, "meet", "left_semi").drop("meet"), kept)
    return _verify(cold)


def _verify(cold: DataFrame) -> DataFrame:
    size = F.char_length("word").cast("int")
    s = cold.where(size == F.col("p")).select("meet", "p", "lo", "hi", F.col("word").alias("a"), F.col("n").alias("n_a"))
    t = cold.select("meet", F.col("p").alias("_p"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    pair = s.join(t, "meet").where("p = _p and lo = _lo and hi = _hi and (char_length(b) > p or a < b)")
    # the edit is where the words first differ; only the region that holds that place reports the pair
    upto = F.greatest(F.col("hi"), F.col("lo") + 1)
    here = (F.col("hi") == F.col("p")) | (F.substring("a", F.lit(1), upto) != F.substring("b", F.lit(1), upto))
    return pair.where(here & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


# ---------------------------------------------------------------- forms and roots
def spelling_forms(words: DataFrame, ratio: int = 2, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n). Forms
    at least double the count at each step, so chains are short; roots come by
    pointer jumping, a join of the words that have a form per doubling."""
    words = stash(words, "words")
    pairs = near_pairs(words, group)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    is_form = -F.col("best.m") >= ratio * F.col("n")
    got = stash(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")), "forms")
    roots = got.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:
        to = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stash(roots.join(to, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
    return (got.join(roots.drop("moved"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: words of all ``documents`` with form and root."""
    return spelling_forms(word_counts(documents(spark, sf_dir)))


OP13_SQL = r"""
WITH RECURSIVE""" + CRC_SQL + r""",
runs AS (SELECT doc_id, run, count(*) AS c FROM (
           SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs WHERE length(run) >= 5),
h AS (SELECT run, c, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
                                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h)
      WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (SELECT a.word AS a, b.word AS b FROM cut AS a JOIN cut AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT cut.word, w.word FROM cut JOIN w ON w.word = cut.rest UNION SELECT w.word, cut.word FROM cut JOIN w ON w.word = cut.rest),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS near, max(n) AS m FROM pairs JOIN w ON w.word = b GROUP BY a),
g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN near END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN best ON best.word = w.word),
chain AS (SELECT word, word AS root FROM g UNION ALL SELECT chain.word, g.form FROM chain JOIN g ON g.word = chain.root WHERE g.form IS NOT NULL)
SELECT g.word, g.form, chain.root, g.n, CAST(g.n_near AS BIGINT) AS n_near, g.form_n
FROM g JOIN chain ON chain.word = g.word JOIN g AS e ON e.word = chain.root AND e.form IS NULL
"""
