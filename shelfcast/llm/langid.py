"""op7: language by compression. Every language has a raw-content zstandard
dictionary of its own training text; a document belongs to the language whose
dictionary makes it smallest, and is not accepted when the margin is narrow."""

from __future__ import annotations

import math
import re

import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_rows, utf8

#: bounds of the learned model: documents per language, characters of a piece
#: of each (a dictionary is all pieces: about 128 KB), and languages
DOCS_PER_LANG, PIECE, MAX_LANGS = 400, 320, 256
CHUNK, LEVEL = 4096, 6
MIN_MARGIN = 0.01
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


_TO_SPACE = bytes(b if b >= 128 or bytes([b]).isalpha() else 32 for b in range(256))


def letters(t: str) -> bytes:
    """Lower-case text with ASCII marks, digits and white space as one blank."""
    return b" ".join(t.lower().encode().translate(_TO_SPACE).split())


def train(df: DataFrame) -> dict[str, bytes]:
    """Dictionary content (lower case) per language, frequent languages first, from
    ``df(doc_id, text, lang)``: of the DOCS_PER_LANG rows with the smallest hash of
    doc_id a piece of PIECE characters each, from a place anywhere in the text that
    the hash chooses. A bounded sample: rows above a hash limit that lets about four
    times as many through never leave their task. More than MAX_LANGS values of lang
    are an error, as each has a dictionary in every worker."""
    df = df.where("lang is not null and doc_id is not null and length(text) > 0")
    often = df.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS + 1).collect()  # a row per language
    if not often:
        return {}
    if len(often) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    top = 1 << 31
    limit = F.create_map(*[x for r in often for x in (F.lit(r.lang), F.lit(min(top, 4 * DOCS_PER_LANG * top // r["count"] + 1)).cast("long"))])
    h = F.pmod(F.xxhash64("doc_id"), F.lit(top))
    w = Window.partitionBy("lang").orderBy("h", "doc_id", "s")
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.char_length("text") - PIECE + 1)).cast("int") + 1
    rows = (df.where(h < limit[F.col("lang")]).select("lang", "doc_id", h.alias("h"), F.substring("text", place, F.lit(PIECE)).alias("s"))
            .withColumn("r", F.row_number().over(w)).where(F.col("r") <= DOCS_PER_LANG).orderBy("lang", "r").collect())
    out: dict[str, list[bytes]] = {}
    for r in rows:
        out.setdefault(r.lang, []).append(letters(r.s))
    return {r.lang: b"\n".join(out[r.lang]) for r in often if r.lang in out}


class Classifier:
    def __init__(self, model: dict[str, bytes]):
        self.langs, self.by = list(model), []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(model[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        """Bytes of the whole text under every dictionary, chunk by chunk, so
        that a long text cannot become a dictionary of its own."""
        chunks = [text[lo:lo + CHUNK] for lo in range(0, len(text), CHUNK)]
        return [sum(len(c.compress(x)) for x in chunks) for c in self.by]

    def __call__(self, text: bytes) -> tuple[str, float, bool]:
        """Language, score (share of the weight 2^-bytes over the smallest) and
        whether the margin to the next language is wide enough."""
        t = text.decode()
        if not self.langs or not (_ASCII_LETTER.search(text) or any(map(str.isalpha, t))):
            return "und", 0.0, False
        n = self.sizes(letters(t))
        best = min(n)
        second = min((x for i, x in enumerate(n) if i != n.index(best)), default=2 * best)
        p = 1 / sum(math.exp2(best - x) for x in n)
        return self.langs[n.index(best)], p, second - best >= MIN_MARGIN * second


def classify(df: DataFrame, model: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, accepted for every row of ``df(doc_id, text)``.
    Null text or text without a letter: ``und``, score 0. Ties: the more
    frequent language of the training rows."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages * DICT_BYTES

    def make():
        model = Classifier(shared.value)

        def f(c):
            got = [model(t) for t in c["text"]]
            return {"doc_id": c["doc_id"], "lang_pred": [x[0] for x in got], "score": [x[1] for x in got], "accepted": [x[2] for x in got]}
        return f

    return map_rows(df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8()), make,
                    "doc_id long, lang_pred string, score double, accepted boolean")


def held_out():
    """True for documents that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all ``documents``."""
    docs = documents(spark, sf_dir)
    return classify(docs, train(docs.where(~held_out()))).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "accepted")
