"""op4: quality rules with thresholds learned per language and source.

DataFrame functions only. Each document gets a few integer measures; their
distribution per (lang, source) is kept as a mergeable quantile sketch: counts
per log-linear bucket (exact below 64, six significant bits above, so a
quantile is within 1/32). Counts of buckets add, so the sketches of a language
or of the whole corpus are sums, to which the limits of small groups are drawn.
Limits from each group's own percentiles replace fixed cutoffs and are joined
back to the measures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, SPACE, documents, stash

#: limits by measure: two percentiles of the group's sketch and how many times
#: the way between them a limit lies beyond, at least by the last number (small
#: against the measure: it only counts where all documents are alike). Junk is a
#: share of any source, so symbols, which junk alone is full of, are measured
#: below that share; repeated lines and words have long tails among clean texts.
#: Measures: mean word length (tenths of a character), symbols per 1000 word
#: characters, repeated lines and repeated words per 1000.
RULES = {"mean10": (25, 75, 5, 3), "symbols": (50, 75, 3, 10), "dup_lines": (50, 99, 1, 50), "repeats": (50, 99, 1, 50)}
#: documents by which a group's limits are drawn to those of its language, and these to all
SHRINK = 100


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words (long). Null text has none of them. Windows of three words
    are compared by a 64-bit hash within one document."""
    t = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(t, F.lit(BLANKS))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    d = docs.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    d = d.withColumn("_lines", lines)
    # sequence() may not count down, hence the when
    grams = F.when(F.size("_words") >= 3, F.expr(
        "transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2]))")).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("_g", grams)
    # only documents with an equal pair of windows are sorted
    d = d.withColumn("_s", F.when(F.size("_g") > F.size(F.array_distinct("_g")), F.expr(
        "sort_array(transform(_g, (h, i) -> struct(h as h, i as i)))")))
    twice = ("filter(sequence(0, size(_s) - 1), k -> (k > 0 and _s[greatest(k - 1, 0)].h = _s[k].h)"
             " or (k < size(_s) - 1 and _s[least(k + 1, size(_s) - 1)].h = _s[k].h))")
    d = d.withColumn("_r", F.expr(f"transform({twice}, k -> _s[k].i)"))
    return d.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(F.array_distinct(F.flatten(F.expr("transform(_r, i -> array(i, i + 1, i + 2))")))).cast("long"), F.lit(0)).alias("n_repeat_words"))


def _base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _shares() -> dict:
    """Integer measures whose distribution is sketched."""
    def per(a, b, k):
        return F.when(F.col(b) > 0, F.expr(f"({k} * {a}) div {b}")).otherwise(F.lit(0).cast("long"))

    return {"mean10": per("word_chars", "n_words", 10), "symbols": per("n_symbols", "word_chars", 1000),
            "dup_lines": per("n_dup_lines", "n_lines", 1000), "repeats": per("n_repeat_words", "n_words", 1000)}


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) over documents that pass the base
    rules. Sketches of parts merge by adding n."""
    long = measured.where(~_base_failed()).select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(k).alias("measure"), v.cast("long").alias("value")) for k, v in _shares().items()])).alias("m")).select("lang", "source", "m.*")
    bucket = F.expr("case when value < 64 then value else shiftleft(shiftright(value, length(bin(value)) - 6), length(bin(value)) - 6) end")
    return long.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(sk: DataFrame) -> DataFrame:
    """(lang, source, lo_mean10, hi_mean10, hi_symbols, hi_dup_lines,
    hi_repeats) by RULES. The limits of a language are averaged with those of
    all documents, a group's with its language's, by their documents against
    SHRINK: no size is a switch. A null lang or source is a group."""
    levels = sk.select(F.lit(0).alias("level"), "lang", "source", "measure", "bucket", "n").unionByName(
        sk.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "measure", "bucket", "n")).unionByName(
        sk.groupBy("measure", "bucket").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "measure", "bucket", "n"))
    group = ["level", "lang", "source", "measure"]

    def rule(i):
        return F.create_map(*[F.lit(x) for k, v in RULES.items() for x in (k, v[i])])[F.col("measure")]

    # a group has a row per bucket: at most 64 + 32 for each power of two
    total = F.sum("n").over(Window.partitionBy(*group))
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("bucket"))
    q = (levels.withColumn("total", total).withColumn("upto", upto).groupBy(*group)
         .agg(F.max("total").alias("total"), F.min(F.when(100 * F.col("upto") >= rule(0) * F.col("total"), F.col("bucket"))).alias("a"),
              F.min(F.when(100 * F.col("upto") >= rule(1) * F.col("total"), F.col("bucket"))).alias("z")))
    width = F.greatest(rule(2) * (F.col("z") - F.col("a")), rule(3))
    q = q.withColumn("lo", F.greatest(F.lit(0), F.col("a") - width)).withColumn("hi", F.col("z") + width)

    def pick(side, m):
        return F.max(F.when(F.col("measure") == m, F.col(side))).cast("long").alias(f"{side}_{m}")

    cols = ["lo_mean10", *[f"hi_{m}" for m in RULES]]
    wide = q.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), pick("lo", "mean10"), *[pick("hi", m) for m in RULES])
    every = wide.where("level = 2").select(F.struct(*cols).alias("t")).scalar()  # one row

    def drawn(n, own, to, names):
        return F.struct(*[F.expr(f"({n} * {own}.{c} + {SHRINK} * {to}.{c}) div ({n} + {SHRINK})").alias(c) for c in names])

    lang = (wide.where("level = 1").select(F.col("lang").alias("l1"), F.col("total").alias("n1"), F.struct(*cols).alias("t1"))
            .withColumn("t2", every).select("l1", drawn("n1", "t1", "t2", cols).alias("t1")))
    own = wide.where("level = 0").select("lang", "source", F.col("total").alias("n0"), F.struct(*cols).alias("t0"))
    j = own.join(lang, F.col("lang").eqNullSafe(F.col("l1")))
    return j.select("lang", "source", drawn("n0", "t0", "t1", cols).alias("t")).select("lang", "source", "t.*")


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept. Documents of a group without
    any that passes the base rules all fail those."""
    x = _shares()
    limits = limits.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *limits.columns[2:])
    within = ((x["mean10"] >= F.col("lo_mean10")) & (x["mean10"] <= F.col("hi_mean10")) & (x["symbols"] <= F.col("hi_symbols"))
              & (x["dup_lines"] <= F.col("hi_dup_lines")) & (x["repeats"] <= F.col("hi_repeats")))
    return (measured.withColumn("base_failed", _base_failed())
            .join(limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))))


def assess(docs: DataFrame) -> DataFrame:
    """Measures and verdict for every row of ``docs(doc_id, text, lang, source)``.
    Null and empty texts have no words and fail the base rules; rows that share
    a doc_id, or have none, are judged singly; an empty table gives no rows."""
    measured = stash(measures(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality-measures")
    limits = stash(thresholds(sketch(measured)), "quality-limits")
    return judge(measured, limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject; all columns and
    rows of the others stay. Measures are written beside the rows, so texts
    are read once for both and rows that share a doc_id are judged singly."""
    cols = docs.columns
    named = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(cols)], "lang", "source", "text")
    measured = stash(measures(named).drop("text"), "quality-measures")
    limits = stash(thresholds(sketch(measured)), "quality-limits")
    return judge(measured, limits).where("kept").select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(cols)])


def op4_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all ``documents``."""
    return assess(documents(spark, sf_dir))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM r GROUP BY 1),
m AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rw ON rw.doc_id = w.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CASE WHEN n_words > 0 THEN 10 * word_chars // n_words ELSE 0 END AS mean10,
             CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols,
             CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
             CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats
      FROM m),
x AS (SELECT lang, source, u.measure, u.value,
             CASE WHEN u.value < 64 THEN u.value ELSE (u.value >> (length(bin(u.value)) - 6)) << (length(bin(u.value)) - 6) END AS bucket
      FROM (SELECT lang, source, unnest([{'measure': 'mean10', 'value': mean10}, {'measure': 'symbols', 'value': symbols},
                                         {'measure': 'dup_lines', 'value': dup_lines}, {'measure': 'repeats', 'value': repeats}]) AS u
            FROM v WHERE NOT base_failed)),
lv AS (SELECT 0 AS level, lang, source, measure, bucket, count(*) AS n FROM x GROUP BY ALL
       UNION ALL SELECT 1, lang, NULL, measure, bucket, count(*) FROM x GROUP BY ALL
       UNION ALL SELECT 2, NULL, NULL, measure, bucket, count(*) FROM x GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total,
             sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto FROM lv),
q AS (SELECT level, lang, source, measure, max(total) AS total,
             min(bucket) FILTER (WHERE 100 * upto >= CASE measure WHEN 'mean10' THEN 25 ELSE 50 END * total) AS a,
             min(bucket) FILTER (WHERE 100 * upto >= CASE measure WHEN 'mean10' THEN 75 WHEN 'symbols' THEN 75 ELSE 99 END * total) AS z
      FROM c GROUP BY ALL),
f AS (SELECT level, lang, source, measure, total, z, a,
             greatest(CASE measure WHEN 'mean10' THEN 5 WHEN 'symbols' THEN 3 ELSE 1 END * (z - a),
                      CASE measure WHEN 'mean10' THEN 3 WHEN 'symbols' THEN 10 ELSE 50 END) AS width FROM q),
b AS (SELECT level, lang, source, measure, CAST(total AS BIGINT) AS n, CAST(greatest(0, a - width) AS BIGINT) AS lo, CAST(z + width AS BIGINT) AS hi FROM f),
l AS (SELECT b.lang, b.measure, (b.n * b.lo + 100 * e.lo) // (b.n + 100) AS lo, (b.n * b.hi + 100 * e.hi) // (b.n + 100) AS hi
      FROM b JOIN b AS e ON e.level = 2 AND e.measure = b.measure WHERE b.level = 1),
o AS (SELECT b.lang, b.source, b.measure, (b.n * b.lo + 100 * l.lo) // (b.n + 100) AS lo, (b.n * b.hi + 100 * l.hi) // (b.n + 100) AS hi
      FROM b JOIN l ON b.lang IS NOT DISTINCT FROM l.lang AND b.measure = l.measure WHERE b.level = 0),
t AS (SELECT lang, source, max(lo) FILTER (WHERE measure = 'mean10') AS lo_mean10, max(hi) FILTER (WHERE measure = 'mean10') AS hi_mean10,
             max(hi) FILTER (WHERE measure = 'symbols') AS hi_symbols, max(hi) FILTER (WHERE measure = 'dup_lines') AS hi_dup_lines,
             max(hi) FILTER (WHERE measure = 'repeats') AS hi_repeats
      FROM o GROUP BY lang, source)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(mean10 BETWEEN lo_mean10 AND hi_mean10 AND symbols <= hi_symbols
                                    AND dup_lines <= hi_dup_lines AND repeats <= hi_repeats, FALSE) AS kept
FROM v LEFT JOIN t ON v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source
"""
