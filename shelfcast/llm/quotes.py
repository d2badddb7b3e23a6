"""op3: quotation linking.

Messages are split into own text and quoted passages by nesting level; the
normalised passages, paragraphs and lines are hashed and joined to the earliest message of
the conversation whose own text has them. A message replies to the message
that its first-level quotes come from; reply-ordered conversations follow,
without quotes. Lookup is by (conversation, hash) against one earliest turn
each, so common lines make no pairs.
"""

from __future__ import annotations

import re
from itertools import groupby

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, stash

_QUOTE = re.compile(r"(?:[ \t]{0,3}>)+")
#: fixed phrases that end a line which introduces a quotation
_INTRO = re.compile(r"^\s*\S.{0,200}\s(?:wrote|writes|schrieb|schreibt|escribió|a écrit)\s?:\s*$")
MIN_WORDS = 3  # shorter lines and paragraphs are looked up only as part of their passage


def normalise(lines: list[str]) -> str:
    return " ".join(" ".join(lines).casefold().split())


def _key(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode())


def parse(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """Own text without quotes and their introductions, and the passages
    (level, lines): runs of quoted lines of one nesting level."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    level = 0
    for line in (text or "").split("\n"):
        m = _QUOTE.match(line)
        now = m[0].count(">") if m else 0
        if not now:
            own.append(line)
        else:
            if not level:
                for i in range(len(own) - 1, -1, -1):  # an introduction may stand above blank lines
                    if own[i].strip():
                        if _INTRO.match(own[i]):
                            del own[i:]
                        break
            if now != level:
                passages.append((now, []))
            passages[-1][1].append(line[m.end():].strip())
        level = now
    return "\n".join(own).strip(), [(k, x) for k, x in passages if any(x)]


def own_units(body: str) -> set[str]:
    """What others may quote: the whole, paragraphs and lines."""
    paragraphs = [p.split("\n") for p in re.split(r"\n\s*\n", body)]
    units = {normalise([body]), *map(normalise, paragraphs)}
    units |= {u for p in paragraphs for x in p if (u := normalise([x])).count(" ") >= MIN_WORDS - 1}
    return units - {""}


def quote_units(lines: list[str]) -> dict[str, int]:
    """Lookup units of a passage and their words; the whole outweighs its
    paragraphs and lines."""
    whole = normalise(lines)
    paragraphs = [list(p) for some, p in groupby(lines, key=bool) if some]
    units = {u: len(u.split()) for x in [*paragraphs, *([x] for x in lines)] if (u := normalise(x)).count(" ") >= MIN_WORDS - 1}
    units[whole] = 3 * len(whole.split())
    return units


def parsed(messages: DataFrame) -> DataFrame:
    def make():
        def f(c):
            out = {k: [] for k in ("conv_id", "turn", "role", "body", "n_passages", "max_level", "own", "quoted")}
            for conv, turn, role, text in zip(c["conv_id"], c["turn"], c["role"], c["text"]):
                body, passages = parse(text)
                quoted = [{"passage": i, "level": k, "words": n, "hash": _key(u)} for i, (k, x) in enumerate(passages) for u, n in quote_units(x).items()]
                for k, v in zip(out, (conv, turn, role, body, len(passages), max((k for k, _ in passages), default=0), sorted(map(_key, own_units(body))), quoted)):
                    out[k].append(v)
            return out
        return f

    cols = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return map_rows(cols, make, "conv_id long, turn long, role string, body string, n_passages int, max_level int, own array<binary>, "
                                "quoted array<struct<passage: int, level: int, words: int, hash: binary>>")


def link_quotes(p: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, level, source): the earlier message of each
    passage; of several the one with most matched words, then the latest."""
    p = p.where("conv_id is not null and turn is not null")
    quoted = p.where("n_passages > 0").select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*")
    own = stash(p.select("conv_id", "turn", F.explode("own").alias("hash")).groupBy("conv_id", "hash").agg(F.min("turn").alias("source")), "passages")
    hits = quoted.join(own, ["conv_id", "hash"]).where("source < turn")
    return (hits.groupBy("conv_id", "turn", "passage", "level", "source").agg(F.sum("words").alias("words"))
            .groupBy("conv_id", "turn", "passage", "level").agg(F.max(F.struct("words", "source")).alias("m"))
            .select("conv_id", "turn", "passage", "level", "m.words", "m.source"))


def threads(up: DataFrame) -> DataFrame:
    """(conv_id, turn, up) with up <= turn -> (conv_id, turn, thread): the first
    message of its reply tree, by pointer jumping (rounds: log of the depth).
    Messages that have found theirs are only looked up, not joined again."""
    now = stash(up.withColumn("done", F.col("up") == F.col("turn")), "threads")
    while now.where("not done").take(1):
        there = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("far"), F.col("done").alias("found"))
        moved = now.where("not done").drop("done").join(there, ["conv_id", "up"]).select("conv_id", "turn", F.col("far").alias("up"), F.col("found").alias("done"))
        now = stash(now.where("done").unionByName(moved), "threads")
    return now.select("conv_id", "turn", F.col("up").alias("thread"))


def conversations(messages: DataFrame) -> DataFrame:
    """Every row of ``messages(conv_id, turn, role, text)`` as conv_id, thread,
    turn, role, body (own text), reply_to (turn, null for a first message),
    by_quote, n_passages, n_linked, max_level. Order by (conv_id, thread,
    turn): a reply follows what it replies to. A message without a linked
    first-level quote replies to the turn before it, where there is one. Rows
    that share (conv_id, turn) share links; rows with a null in either are
    threads of their own. Null text has an empty body."""
    p = stash(parsed(messages), "messages")
    links = stash(link_quotes(p), "quote-links")
    best = links.where("level = 1").groupBy("conv_id", "turn").agg(F.max(F.struct("words", "source")).alias("m")).select("conv_id", "turn", F.col("m.source").alias("quoted"))
    linked = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"))
    nodes = p.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    before = nodes.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("before"))
    up = stash(nodes.join(best, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left").join(linked, ["conv_id", "turn"], "left")
               .select("conv_id", "turn", F.coalesce("quoted", "before").alias("reply_to"), F.col("quoted").isNotNull().alias("by_quote"),
                       F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "replies")
    tree = threads(up.select("conv_id", "turn", F.coalesce("reply_to", "turn").alias("up")))
    info = up.join(tree, ["conv_id", "turn"])
    return (p.select("conv_id", "turn", "role", "body", "n_passages", "max_level").join(info, ["conv_id", "turn"], "left")
            .select("conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", "role", "body", "reply_to",
                    F.coalesce("by_quote", F.lit(False)).alias("by_quote"), F.col("n_passages").cast("long").alias("n_passages"),
                    F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("max_level").cast("long").alias("max_level")))


def write_chats(df: DataFrame, path: str) -> None:
    """Rows of ``conversations`` as JSON lines in reply order across the files
    (the body may not be empty)."""
    order = ["conv_id", "thread", "turn"]
    (df.where("body <> ''").select(*order, F.struct(F.coalesce("role", F.lit("user")).alias("role"), F.col("body").alias("content")).alias("message"))
     .repartitionByRange(*order).sortWithinPartitions(*order).write.json(path))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of the ``conversations`` table in reply order."""
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
