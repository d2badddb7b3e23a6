"""Token ids of whole texts through the ``tokenizers`` library, and op2: a
binary token store.

Encoding goes chunk by chunk (a chunk is a run without ASCII white space,
where this tokenizer always breaks) through a bounded cache, so frequent
chunks are encoded once per worker.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfcast.session import scratch_path

from .common import documents, map_rows, stash, utf8

CACHE = 300_000
#: Fixed values of the file format: zstd skippable-frame magic, format tag.
SKIP, TAG = 0x184D2A50, b"SCT2"


#: marks that split off the end of a chunk: never part of a word, a contraction or a special token
_MARKS = b"!#$%&()*+,-./:;=?@[]^_`{}~\"\\"


class _Chars(dict):
    """Code point -> what byte-level pre-tokenization makes of it."""

    def __init__(self, tok: Tokenizer):
        super().__init__()
        self.pre = tok.pre_tokenizer

    def __missing__(self, c: int) -> str:
        v = self[c] = self.pre.pre_tokenize_str(chr(c))[0][0]
        return v


class ChunkEncoder(dict):
    """UTF-8 chunk -> little-endian uint32 ids as bytes, in two generations:
    past CACHE chunks the young one becomes the old one, and what is still in
    use moves back."""

    def __init__(self, json: str):
        super().__init__()
        self.tok = Tokenizer.from_str(json)
        self.model = self.tok.model
        self.old: dict[bytes, bytes] = {}
        self.chars = _Chars(self.tok)

    def _word(self, w: str) -> bytes:
        """Ids of one run of lower-case letters: the model alone, on the
        characters that the tokenizer's own pre-tokenizer makes of them."""
        return array("I", [x.id for x in self.model.tokenize(w.translate(self.chars))]).tobytes()

    def __missing__(self, w: bytes) -> bytes:
        v = self.old.get(w)
        if v is None:
            head = w.rstrip(_MARKS)
            if head.isalpha():  # ASCII letters and a run of marks: most chunks
                if head.islower():
                    v = self.old.get(head) or self.get(head)
                    if v is None:
                        v = self._word(head.decode())
                        if len(head) < len(w):
                            self[head] = v
                else:
                    v = self[head.lower()]
                if len(head) < len(w):
                    v += self[w[len(head):]]
            else:
                v = self._other(w, head)
        self[w] = v
        return v

    def _other(self, w: bytes, head: bytes) -> bytes:
        letters = head.decode()
        low = letters.lower()
        # letters below U+0250 fold and compose one by one; a run of marks
        # after letters is a token run of its own
        if letters.isalpha() and low.isalpha() and max(letters) < "\u0250":
            if len(head) < len(w):
                return self[head] + self[w[len(head):]]
            return self[low.encode()] if low != letters else self._word(letters)
        return array("I", self.tok.encode(w.decode(), add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()
        return [b"".join(map(self.__getitem__, t.split())) for t in texts]


@lru_cache(maxsize=2)
def _encoder(key: str, holder) -> ChunkEncoder:
    return ChunkEncoder(holder.value)


class Holder:
    """Tokenizer file read on the driver (about 2 MB, fixed) and broadcast."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            json = f.read()
        self.key = hashlib.sha256(json.encode()).hexdigest()
        self.b = spark.sparkContext.broadcast(json)

    @property
    def value(self) -> str:
        return self.b.value

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key

    def encoder(self) -> ChunkEncoder:
        return _encoder(self.key, self)


# ---------------------------------------------------------------- op2
def train_dictionary(df: DataFrame, holder: Holder, end_id: int, sample_docs: int = 1024,
                     sample_bytes: int = 16384, dict_bytes: int = 65536) -> bytes:
    """Raw bytes of a zstd dictionary trained on serialized id arrays of the
    ``sample_docs`` rows with the smallest hash of doc_id (a bounded sample: at
    most sample_docs * sample_bytes bytes reach the driver, however often an id
    repeats). Empty when the sample is too small to train on."""
    df = df.where("doc_id is not null")
    h = F.xxhash64("doc_id")
    least = df.select(h.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    if least is None:
        return b""
    rows = df.where(h <= least).orderBy(h, "doc_id", F.xxhash64("text")).limit(sample_docs).repartition(16)

    def make():
        enc = holder.encoder()

        def f(c):
            raw = enc.encode([t[:sample_bytes * 2].rpartition(b" ")[0] or t[:1024].decode("utf-8", "ignore").encode() for t in c["text"]])
            return {"s": [np.frombuffer(r + struct.pack("<I", end_id), "<u4").astype("<u2").tobytes()[:sample_bytes] for r in raw],
                    "doc_id": c["doc_id"]}
        return f

    got = map_rows(rows.select("doc_id", utf8()), make, "doc_id long, s binary").collect()
    samples = [bytes(r.s) for r in sorted(got, key=lambda r: (r.doc_id, bytes(r.s)))]
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _shard(rows: list[tuple], dict_hash: bytes, part: int, chunk: int) -> bytes:
    """One shard: a skippable frame with header and offset index, the documents'
    frames, and a skippable frame of one byte, which the writer's line end fills."""
    ids = np.array([0 if r[0] is None else r[0] for r in rows], "<i8")
    null = np.array([r[0] is None for r in rows], "u1")
    size = np.array([len(r[1]) for r in rows], "<u8")
    off = np.concatenate([[0], np.cumsum(size)[:-1]]).astype("<u8")
    n = np.array([r[2] for r in rows], "<u8")
    body = (TAG + dict_hash + struct.pack("<IIIQ", part, chunk, len(rows), int(n.sum()))
            + ids.tobytes() + null.tobytes() + off.tobytes() + size.tobytes() + n.tobytes())
    return b"".join([struct.pack("<II", SKIP, len(body)), body, *(r[1] for r in rows), struct.pack("<II", SKIP, 1)])


def read_index(blob: bytes) -> dict:
    """Header and offset index of a shard (needs only its first frame)."""
    magic, size = struct.unpack_from("<II", blob)
    if magic != SKIP or blob[8:12] != TAG:
        raise ValueError("not a token shard")
    part, chunk, n, total = struct.unpack_from("<IIIQ", blob, 28)
    at, out = 48, {"dict_hash": blob[12:28], "part": part, "chunk": chunk, "total": total, "base": 8 + size}
    for name, kind in (("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u8"), ("n_tokens", "<u8")):
        out[name] = np.frombuffer(blob, kind, n, at)
        at += out[name].nbytes
    return out


def read_document(blob: bytes, i: int, dictionary: bytes) -> np.ndarray:
    """Ids of the i-th document of a shard: one frame, found by the index."""
    x = read_index(blob)
    if x["dict_hash"] != hashlib.md5(dictionary).digest():
        raise ValueError("the shard was written with another dictionary")
    lo = x["base"] + int(x["offset"][i])
    return _ids(_decompressor(dictionary), blob[lo:lo + int(x["size"][i])])


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


def _ids(d: zstandard.ZstdDecompressor, frame: bytes) -> np.ndarray:
    raw = d.decompress(frame)  # the first byte is the width of an id
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=raw[0]).astype("<u4")


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, end_id: int, shard_bytes: int = 8 << 20,
                 level: int = 3) -> None:
    """Encode ``df(doc_id, text)`` and write shards under ``path/shards`` in
    ascending doc_id order (nulls first; rows of one doc_id by a hash of the
    text), the dictionary under ``path/dictionary``. Null text: empty."""
    spark = df.sparkSession
    holder = Holder(spark, tokenizer_path)
    df = df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8())
    dictionary = train_dictionary(df, holder, end_id)
    digest = hashlib.md5(dictionary).digest()
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    end = struct.pack("<I", end_id)

    def run(batches):
        from pyspark import TaskContext
        enc, part, chunk = holder.encoder(), TaskContext.get().partitionId(), 0
        z = zstandard.ZstdCompressor(level=level, write_content_size=True, **({"dict_data": zstandard.ZstdCompressionDict(shared.value)} if shared.value else {}))
        rows, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([_shard(rows, digest, part, chunk)], pa.binary())], ["blob"])

        for b in batches:
            for lo in range(0, b.num_rows, 128):
                s = b.slice(lo, 128)
                for d, raw in zip(s.column(0).to_pylist(), enc.encode(s.column(1).to_pylist())):
                    ids = np.frombuffer(raw + end, "<u4")
                    two = ids.max() < 65536
                    frame = z.compress((b"\2\0" + ids.astype("<u2").tobytes()) if two else b"\4\0\0\0" + ids.tobytes())
                    rows.append((d, frame, len(ids)))
                    held += len(frame)
                    if held >= shard_bytes or len(rows) >= 65536:
                        yield flush()
                        rows, held, chunk = [], 0, chunk + 1
        if rows:
            yield flush()

    # range partitions by doc_id, so that files in order hold documents in order
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.withColumn("_h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    (ordered.select("doc_id", "text").mapInArrow(run, "blob binary")
     .select(F.col("blob").cast("string")).write.option("maxRecordsPerFile", 1).text(f"{path}/shards"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a token store: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    rows = spark.read.parquet(f"{path}/dictionary").take(1)
    shared = spark.sparkContext.broadcast(bytes(rows[0].dictionary))
    files = spark.read.format("binaryFile").load(f"{path}/shards").select("content")

    def heads():
        def f(c):
            x = [read_index(b) for b in c["head"]]
            return {k: [int(i[k]) for i in x] for k in ("part", "chunk", "total")}
        return f

    head = map_rows(files.select(F.col("content").alias("head")), heads, "part int, chunk int, total long", rows=1)
    shards = stash(head, "token-heads")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("total").alias("t")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("p0"))
    starts = (shards.join(parts, "part").select("part", "chunk", (F.col("p0") + F.coalesce(F.sum("total").over(inside), F.lit(0))).alias("s0")))

    def make():
        d, digest = _decompressor(shared.value), hashlib.md5(shared.value).digest()

        def f(c):
            out = {k: [] for k in ("part", "chunk", "doc_id", "at", "n_tokens", "ids_crc32", "ids")}
            for blob in c["content"]:
                x = read_index(blob)
                if x["dict_hash"] != digest:
                    raise ValueError("the shard was written with another dictionary")
                at = 0
                for i in range(len(x["doc_id"])):
                    lo = x["base"] + int(x["offset"][i])
                    ids = _ids(d, blob[lo:lo + int(x["size"][i])])
                    for k, v in (("part", x["part"]), ("chunk", x["chunk"]), ("doc_id", None if x["null"][i] else int(x["doc_id"][i])),
                                 ("at", at), ("n_tokens", len(ids)), ("ids_crc32", zlib.crc32(ids.tobytes())), ("ids", ids.tolist() if with_ids else None)):
                        out[k].append(v)
                    at += len(ids)
            return out
        return f

    docs = map_rows(files, make, "part int, chunk int, doc_id long, at long, n_tokens long, ids_crc32 long, ids array<long>", rows=1)
    out = docs.join(starts, ["part", "chunk"]).select("doc_id", (F.col("s0") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: whole ``documents`` written as a token store and read back."""
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, path)
