"""op12: power-of-two decomposition of documents into sequences.

A document of n ids is cut into pieces of ``capacity`` ids and then into one
piece for each binary digit of the rest, longest first. A piece is a sequence
of its own, so none crosses documents and none is padded; sequences of equal
length are consecutive, in batches of equal shape.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import documents, map_rows, stash
from .tokens import Holder, _Chars

#: pieces that a worker keeps, of each generation (about 200 bytes a piece)
CACHE = 250_000

#: marks that are no part of a contraction
_MARKS = "!#$%&()*+,-./:;<=>?@[\\]^_`{|}~\""

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, at long, ids array<bigint>"


def _letters(p: str) -> bool:
    """Whether the tokenizer takes ``p`` as one run of letters (of alphabets
    that every Unicode version knows)."""
    return p.isalpha() and (p.isascii() or max(p) < "\u0250")


class _Pieces(dict):
    """Text between two blanks -> ids (little-endian uint32) of it behind
    ``before``; None where white space touches its ends, as the tokenizer then
    need not break there. Two generations: past CACHE entries the young one
    becomes the old one, and what is still in use moves back."""

    def __init__(self, tok: Tokenizer, before: str, plain: _Pieces | None = None):
        super().__init__()
        self.tok, self.model, self.before, self.plain = tok, tok.model, before, self if plain is None else plain
        self.chars, self.old = _Chars(tok), {}
        self.first = before.translate(self.chars)

    def age(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()

    def ids(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, w: str) -> bytes:
        """Ids of a run of letters: the model alone, on the characters that the
        tokenizer's own pre-tokenizer makes of them."""
        v = self.old.get(w)
        if v is None:
            v = array("I", [x.id for x in self.model.tokenize(self.first + (w if w.isascii() else w.translate(self.chars)))]).tobytes()
        if len(w) < 64:
            self[w] = v
        return v

    def __missing__(self, p: str) -> bytes | None:
        if p.isalpha() and _letters(p):
            return self.word(p)
        head = p.rstrip(_MARKS)
        if len(head) < len(p) and _letters(head):  # marks behind letters are a run of their own
            v = self.old.get(p) or (self.get(head) or self.word(head)) + self.plain[p[len(head):]]
            if len(p) < 64:
                self[p] = v
            return v
        if not p or p[0].isspace() or p[-1].isspace():
            return None
        lines = p.split("\n")
        if len(lines) > 1 and not any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            # a line end between two words is a token of its own
            end = self.plain.newline
            return self[lines[0]] + b"".join(end + self.plain[x] for x in lines[1:])
        v = self.old.get(p) or self.ids(self.before + p)
        if len(p) < 64:
            self[p] = v
        return v


class SpacedEncoder:
    """Whole texts through a byte-level tokenizer that breaks before a single
    blank between two words, by cached pieces; where the white space is of
    another kind, the pieces around it are encoded as one."""

    def __init__(self, json: str):
        self.tok = Tokenizer.from_str(json)
        self.plain = _Pieces(self.tok, "")
        self.plain.newline = self.plain.ids("\n")
        self.spaced = _Pieces(self.tok, " ", self.plain)

    def encode(self, text: str) -> bytes:
        self.plain.age()
        self.spaced.age()
        p = text.split(" ")
        got = [self.plain[p[0]], *map(self.spaced.__getitem__, p[1:])]
        if None not in got:
            return b"".join(got)
        out, lo = [], 0
        for i in range(1, len(p) + 1):
            if i == len(p) or p[i - 1] and p[i] and not p[i - 1][-1].isspace() and not p[i][0].isspace():
                out.append(got[lo] if i == lo + 1 and got[lo] is not None else self.plain.ids((" " if lo else "") + " ".join(p[lo:i])))
                lo = i
        return b"".join(out)


@lru_cache(maxsize=2)
def _encoder(holder: Holder) -> SpacedEncoder:
    return SpacedEncoder(holder.value)


def binary_cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    out = [(lo, capacity) for lo in range(0, n - capacity + 1, capacity)]
    at, bit = len(out) * capacity, capacity >> 1
    while bit:
        if (n - at) & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def pack_binary(df: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 1024, batch_tokens: int = 1 << 20,
                with_ids: bool = False) -> DataFrame:
    """Pieces of ``df(doc_id, text)`` as sequences: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id (0 to their number less one, the longest
    first), offset (0), batch (of at most ``batch_tokens`` ids, numbered within
    its length) and the ids on request. ``capacity`` is a power of two. A null
    or empty text is the end id alone; equal rows are packed each; an empty
    table gives no rows."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spark = df.sparkSession
    holder = Holder(spark, tokenizer_path)
    end = struct.pack("<I", end_id)

    def make():
        enc, seen = _encoder(holder), dict.fromkeys((1 << k for k in range(capacity.bit_length())), 0)

        def f(c):
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at", "ids")}
            for d, text in zip(c["doc_id"], c["text"]):
                raw = enc.encode(text) + end
                n = len(raw) // 4
                for lo, m in binary_cuts(n, capacity):
                    cut = raw[4 * lo:4 * (lo + m)]
                    for k, v in zip(out, (d, lo, m, zlib.crc32(cut), n, seen[m], array("I", cut).tolist() if with_ids else None)):
                        out[k].append(v)
                    seen[m] += 1
            return out
        return f

    rows = map_rows(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), make, PIECES, rows=128)
    rows = stash(rows.withColumn("part", F.spark_partition_id()), "binary-pieces")
    # sequences of a length follow each other: a task's first number is what
    # longer ones and earlier tasks have (a row per task and length)
    inside = Window.partitionBy("length").orderBy("part")
    heads = (rows.groupBy("length", "part").agg(F.count("*").alias("c"))
             .select("length", "part", (F.sum("c").over(inside) - F.col("c")).alias("before")))
    lengths = rows.groupBy("length").agg(F.count("*").alias("c"))  # one row a power of two
    longer = lengths.select("length", (F.sum("c").over(Window.orderBy(F.desc("length"))) - F.col("c")).alias("first"))
    placed = rows.join(heads.join(F.broadcast(longer), "length"), ["length", "part"])
    index = F.col("before") + F.col("at")
    out = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + index).alias("sequence_id"),
                        F.lit(0).cast("long").alias("offset"),
                        F.floor(index / F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("length")))).alias("batch"), "ids")
    return out if with_ids else out.drop("ids")


def op12_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all ``documents`` in sequences of at most 1024 ids."""
    import public_tokenizers

    return pack_binary(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
