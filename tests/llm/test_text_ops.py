"""op3, op4, op6, op7, op8, op9, op10 against brute force and on edge cases."""

import base64
import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from shelfcast.llm import decontaminate as D
from shelfcast.llm import langid as L
from shelfcast.llm import pii as PI
from shelfcast.llm import quality as Q
from shelfcast.llm import quotes as QU
from shelfcast.llm import substring as S
from shelfcast.llm import warc as W
from shelfcast.llm.common import documents, stash
from shelfcast.session import scratch_path

from .conftest import SF001, prose, rows_of

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ op8
def brute_repeats(rows):
    first, out = {}, {}
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in docs:
        for k in range(len(w) - 19):
            key = tuple(w[k:k + 20])
            if i is not None and (key not in first or first[key] > i):
                first[key] = i
    for n, (i, w) in enumerate(docs):
        gone, here = [False] * len(w), set()
        for k in range(len(w) - 19):
            key = tuple(w[k:k + 20])
            if key in here or (i is not None and first[key] < i):
                gone[k:k + 20] = [True] * 20
            here.add(key)
        out[n] = (i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return sorted(out.values(), key=str)


def test_substring_edges(edge_docs, no_docs):
    got = S.remove_repeats(edge_docs, with_text=True)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str) == brute_repeats(rows_of(edge_docs))
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and sum(s.length for s in r.spans) == r.n_removed for r in got.collect())
    assert S.remove_repeats(no_docs).count() == 0


def test_substring_query(spark):
    got = E.queries()["op8_substring_dedup"](spark, SF001)
    want = brute_repeats(rows_of(documents(spark, SF001)))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str) == want


def test_substring_anchor_shared_with_a_shorter_match(spark):
    """The first document with the anchor shares less than a window."""
    p = prose(40, 9).split()
    rows = [(1, " ".join(p[10:22])), (2, prose(30, 10) + " " + " ".join(p)), (3, " ".join(p[3:30]) + " " + prose(30, 11))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in S.remove_repeats(df).collect()}
    assert got == {1: 0, 2: 0, 3: 27}


# ------------------------------------------------------------------ op10
def brute_base(t):
    def luhn(x):
        d = [int(c) for c in x[::-1]]
        return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        x = re.sub("[ -]", "", m[0])
        if 13 <= len(x) <= 19 and luhn(x):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a@.-+_%0123456789 ()é\n", max_size=60))
def test_base_spans_equal_plain_patterns(t):
    got = PI.base_spans(t)
    assert [(k, *s) for k in PI.BASE for s in got[k]] == brute_base(t)


def test_pii_query(spark):
    got = {r.doc_id: r for r in E.queries()["op10_pii"](spark, SF001).collect()}
    for i, t in rows_of(documents(spark, SF001)):
        base = brute_base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in base).encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(b[0] == k for b in base) for k in PI.BASE)


def test_pii_spans_end_where_the_validator_says():
    kept = lambda t: [(k, t[lo:hi]) for k, lo, hi, _ in PI.find_spans(t)]
    for tail in (" BIC COBADEFFXXX", " 50 EUR", " 2024 paid", ""):
        assert kept("iban DE89370400440532013000" + tail) == [("iban", "DE89370400440532013000")]
        assert kept("iban DE89 3704 0044 0532 0130 00" + tail) == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kept("no AB12 3456 7890 1234 DE89 3704 0044 0532 0130 00 50") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kept("card 4111 1111 1111 1111 12/26") == [("card_in_run", "4111 1111 1111 1111")]
    assert kept("12 4111-1111-1111-1111 123") == [("card_in_run", "4111-1111-1111-1111")]
    assert kept("years 2001 2002 2003 2004 2005 2006 2007 2008 2009 2010 2011 2012") == []
    token = "aB3dE5fG" * 40
    assert kept("token " + token) == [("secret", token)]
    assert PI.mask("iban DE89370400440532013000 BIC X, card 4111 1111 1111 1111 12/26") == "iban <IBAN> BIC X, card <CARD_IN_RUN> 12/26"


def test_pii_validators_context_and_mask(edge_docs, no_docs):
    assert PI.mod97("GB82 WEST 1234 5698 7654 32") and not PI.mod97("GB82 WEST 1234 5698 7654 33")
    kinds = [s[0] for s in PI.find_spans("iban GB82 WEST 1234 5698 7654 32")]
    assert "iban" in kinds
    secret = "04dbebab91ab85687d33eea9f2b4"
    assert [s[0] for s in PI.find_spans(f'token = "{secret}"')] == ["secret"]
    assert PI.find_spans(f'word = "{secret}"') == [] and PI.find_spans(f"commit {secret}") == []
    assert PI.mask("call +1 (555) 555-0199 or a.b@c.org") == "call <PHONE> or <EMAIL>"
    assert PI.mask(None) is None and PI.mask("") == ""
    assert PI.find_pii(edge_docs).count() == edge_docs.count() and PI.find_pii(no_docs).count() == 0
    masked = PI.mask_pii(edge_docs)
    assert masked.columns == edge_docs.columns and sorted(map(str, rows_of(masked))) == sorted(map(str, rows_of(edge_docs)))
    assert PI.mask_pii(no_docs).count() == 0
    # time stays linear on runs that match nothing
    for t in ("a" * 300000, "1" * 300000, "1." * 100000, "+1" * 100000, "@" * 100000, "1 " * 100000):
        PI.find_spans(t)


# ------------------------------------------------------------------ op4
def brute_measures(t):
    t = t or ""
    w = SPLIT.findall(t)
    lines = [x for x in t.split("\n") if SPLIT.search(x)]
    seen = {}
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k:k + 3]), []).append(k)
    rep = {k + d for v in seen.values() if len(v) > 1 for k in v for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_measures(edge_docs, no_docs):
    got = Q.assess(edge_docs).collect()
    want = sorted((str(i), *brute_measures(t)) for i, t in rows_of(edge_docs))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert Q.assess(no_docs).count() == 0
    kept = Q.keep_good(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r.kept for r in got)
    assert Q.keep_good(no_docs).count() == 0


def test_sketches_merge(spark):
    """Thresholds from merged sketches of two halves are those of the whole."""
    m = Q.measures(documents(spark, SF001).select("doc_id", "lang", "source", "text")).drop("text").cache()
    whole = Q.thresholds(Q.sketch(m)).collect()
    halves = Q.sketch(m.where("doc_id % 2 = 0")).unionByName(Q.sketch(m.where("doc_id % 2 = 1")))
    merged = halves.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, Q.thresholds(merged).collect()), key=str)


def test_limits_are_learned(spark):
    """What is junk in one source is usual in another: 300 documents each, of
    which 5 % carry far more symbols, repeated lines, repeated words or longer
    words than the rest of their source."""
    def text(k, kind, much):
        w = prose(120, k).split()
        if kind == "symbols":
            w = [x + "#" * much for x in w]
        elif kind == "dup_lines":  # lines of single marks, so that only lines repeat
            return " ".join(w) + "\n" + "\n".join(["-"] * 1 if much == 0 else [x for i in range(12) for x in (f"l{k}n{i}", "=" * (1 + i % (13 - much)))])
        elif kind == "repeats":
            w = w + w[:10 * much] if much else w
        elif kind == "mean10":
            w = [x + "qrst"[:much] * 2 for x in w]
        return " ".join(w)

    rows = []
    for s, (kind, usual, junk) in enumerate([("symbols", 0, 2), ("symbols", 2, 4), ("repeats", 0, 5), ("mean10", 0, 4), ("mean10", 4, 0)]):
        for i in range(300):
            much = junk if i % 20 == 0 else usual
            if kind == "symbols" and usual and i % 20:  # two symbols a word on average, with a spread
                much = 1 + i % 3
            rows.append((1000 * s + i, text(1000 * s + i, kind, much), "en", f"{s}-{kind}", i % 20 == 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    got = {r.doc_id: r.kept for r in Q.assess(df).collect()}
    share = {}
    for i, _, _, s, junk in rows:
        share.setdefault((s, junk), []).append(got[i])
    share = {k: sum(v) / len(v) for k, v in share.items()}
    assert share["0-symbols", True] == 0 and share["0-symbols", False] > 0.95
    assert share["1-symbols", False] > 0.95  # up to three symbols a word are usual there
    assert share["2-repeats", False] > 0.95
    assert share["3-mean10", True] == 0 and share["3-mean10", False] > 0.95
    assert share["4-mean10", False] > 0.95
    limits = {r.source: r for r in Q.thresholds(Q.sketch(stash(Q.measures(df).drop("text"), "test-measures"))).collect()}
    assert limits["1-symbols"].hi_symbols > 5 * limits["0-symbols"].hi_symbols
    assert limits["4-mean10"].lo_mean10 > 2 * limits["3-mean10"].lo_mean10


def test_small_groups_are_drawn_to_their_language(spark):
    """Limits change smoothly with the number of documents of a group."""
    rows = [(i, prose(100, i), "en", "big") for i in range(400)] + [(1000 + i, " ".join(x + "#" for x in prose(100, i).split()), "en", "small") for i in range(30)]
    for n in (1, 10, 30):
        df = spark.createDataFrame([r for r in rows if r[3] == "big" or r[0] < 1000 + n], "doc_id long, text string, lang string, source string")
        x = {r.source: r.hi_symbols for r in Q.thresholds(Q.sketch(stash(Q.measures(df).drop("text"), "test-measures"))).collect()}
        assert x["big"] <= x["small"]
        if n > 1:
            assert x["small"] > last
        last = x["small"]


# ------------------------------------------------------------------ op6
def grams(t):
    w = SPLIT.findall((t or "").lower())
    return {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def test_decontamination(spark, edge_docs, no_docs):
    words = prose(60000, 2).split()
    items = [(1, " ".join(words[30000:30040]).upper()), (2, " ".join(words[100:130] + ["no"] * 30)), (3, None), (4, ""), (5, "one two"),
             (6, " ".join(["swap", *words[500:560]])), (None, prose(80, 3)), (7, prose(50, 77)), (1, "another text under the same id"),
             (8, "FIVE words"), (9, "words in here\tonly"), (10, "nowhere")]
    items = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in D.contaminated(edge_docs, items).collect())))
    want = set()
    for i, t in rows_of(edge_docs):
        for r in items.collect():
            a, b = grams(r.text), grams(t)
            if a and (k := len(min(a))) < 5:  # a short item is looked for among the runs of as many words
                w = SPLIT.findall((t or "").lower())
                b = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}
            if r.item_id is not None and a and 100 * len(a & b) >= 75 * len(a):
                want.add(str((i, r.item_id, len(a), len(a & b))))
    assert got == sorted(want) and any("(8, 1," in x for x in got)
    assert {"(-5, 8, 1, 1)", "(-5, 9, 1, 1)", "(6, 5, 1, 1)"} <= set(got)
    kept = D.drop_contaminated(edge_docs, items)
    assert kept.columns == edge_docs.columns and 8 not in [r.doc_id for r in kept.collect()]
    assert D.contaminated(no_docs, items).count() == 0 and D.drop_contaminated(edge_docs, items.limit(0)).count() == edge_docs.count()


# ------------------------------------------------------------------ op7
def test_language_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = E.queries()["op7_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got)


def test_language_edges(edge_docs, no_docs):
    model = L.train(edge_docs)
    got = {r.doc_id: r for r in L.classify(edge_docs, model).collect()}
    assert len(model) == 1 and got[3].lang_pred == got[4].lang_pred == "und" and got[0].lang_pred == "en"
    assert {r.lang_pred for r in L.classify(edge_docs, L.train(no_docs)).collect()} == {"und"}
    assert L.classify(no_docs, model).count() == 0


def test_language_equals_a_plain_version(spark):
    """The sample by sorting all rows, and every whole text against every dictionary."""
    import math

    import zstandard
    docs = documents(spark, SF001).limit(120)
    h, place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)), F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.char_length("text") - 319))
    rows = docs.where("lang is not null and text <> ''").select("lang", "doc_id", "text", h.alias("h"), place.alias("at")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.h, r.doc_id)):
        by.setdefault(r.lang, []).append(r)
    dicts = {k: b"\n".join(b" ".join(re.sub("[^a-z\u0080-\U0010ffff]", " ", r.text[r.at:r.at + 320].lower()).encode().split()) for r in v[:400]) for k, v in by.items()}
    model = L.train(docs)
    assert model == dicts and list(model) == sorted(by, key=lambda k: (-len(by[k]), k))
    got = {r.doc_id: r for r in L.classify(docs, model).collect()}
    for r in rows[:40]:
        text = b" ".join(re.sub("[^a-z\u0080-\U0010ffff]", " ", r.text.lower()).encode().split())
        n = []
        for k in model:
            d = zstandard.ZstdCompressionDict(dicts[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=6)
            c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            n.append(sum(len(c.compress(text[i:i + 4096])) for i in range(0, len(text), 4096)))
        assert got[r.doc_id].lang_pred == list(model)[n.index(min(n))]
        assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp2(min(n) - x) for x in n))


def test_too_many_languages(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    with pytest.raises(ValueError, match="256 languages"):
        L.train(df)


# ------------------------------------------------------------------ op9
def test_revisits_name_their_response(spark):
    """In the archive itself: ids are unique, and what a revisit names is a
    response with its payload."""
    rows = [(i, f"http://h/{i % 7}", f"payload {i % 5}") for i in range(40)] + [(50, None, "payload 1"), (0, "http://h/0", "payload 0"), (51, "http://x", "twice"), (51, "http://x", "twice"), (52, "http://y", "twice")]
    path = scratch_path(spark, "test-warc")
    W.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    got = W.read_warc(spark, path).collect()
    assert len(got) == len(rows) == len({r.record_id for r in got})
    by_id = {r.record_id: r for r in got}
    named = 0
    for r in got:
        if r.record_type == "revisit":
            same = [x for x in got if x.record_type == "response" and x.payload_digest == r.payload_digest]
            assert (r.refers_to_uri, r.refers_to_date) in {(x.target_uri, x.record_date) for x in same} and r.refers_to in {x.page_id for x in same}
            if r.refers_to_record:
                named += 1
                x = by_id[r.refers_to_record]
                assert x in same and x.page_id == r.refers_to and x.target_uri == r.refers_to_uri
    assert named >= 25 and any(r.record_type == "revisit" and r.refers_to == 51 and not r.refers_to_record for r in got)


def test_arc_versions_and_damage():
    date = "20240102030405"
    for v in (1, 2):
        block = b"HTTP/1.1 200 OK\r\n\r\n<html>\nbody"
        blob = W.arc_version_block(v, "a.arc", date) + W.arc_record(v, "http://x/a b", "1.2.3.4", date, "text/html", block) + b"\n" + W.arc_record(v, "dns:x", "-", "202401020304", "text/dns", b"")
        (h1, b1), (h2, b2) = W.iter_arc(blob)
        assert h1["URL"] == "http://x/a%20b" and b1 == block and b2 == b"" and h2["Archive-date"] == "202401020304"
        with pytest.raises(ValueError):
            list(W.iter_arc(blob[:-5] if v == 1 else blob.replace(str(len(block)).encode() + b"\n", b"999\n")))
        w1, w2 = (W.convert(h, b) for h, b in ((h1, b1), (h2, b2)))
        (head, got), (head2, _) = W.iter_warc([w1[:50], w1[50:] + w2])
        assert head["warc-type"] == "response" and head["warc-date"] == "2024-01-02T03:04:05Z" and got == block
        assert head["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"<html>\nbody").digest()).decode()
        assert head2["warc-type"] == "resource" and head2["warc-date"] == "2024-01-02T03:04:00Z"
    assert W.warc_date("19970101") == "1997-01-01T00:00:00Z"


def test_archive_files_round_trip(spark, tmp_path):
    blob = W.arc_version_block(1, "a.arc", "19990101000000") + b"".join(
        W.arc_record(1, f"http://x/{i}", "1.2.3.4", "19990101000000", "text/html", b"HTTP/1.1 200 OK\r\n\r\n" + b"p%d" % i) for i in range(5))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(blob)
    W.convert_archives(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = W.read_warc(spark, str(tmp_path / "out")).collect()
    assert sorted(r.target_uri for r in got) == [f"http://x/{i}" for i in range(5)] and {r.payload_bytes for r in got} == {2}


def test_pages_edges(spark):
    rows = [(1, "http://a", "same"), (2, "http://b c\nd", "same"), (3, None, None), (4, "http://e", ""), (None, "http://f", "same"), (5, "http://g", "x" * 400000),
            (6, "http://h", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\r\n\r\n"), (7, "", "é漢"), (0, "http://i", "same"), (7, "http://j", "é漢")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_path(spark, "test-warc")
    W.archive_pages(pages, path)
    got = W.read_warc(spark, path).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, o in rows if j is not None and (o or "").encode() == b]
        to = min(same) if same and min(same) != i else None
        want.append((str(i), len(b), W.base32_sha1(b), "response" if to is None else "revisit", to))
    assert sorted(map(str, ((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    small = scratch_path(spark, "test-warc")
    W.archive_pages(pages, small, min_bytes=5, arc_version=1)
    assert {r.record_type for r in W.read_warc(spark, small).collect()} == {"response"}
    empty = scratch_path(spark, "test-warc")
    W.archive_pages(pages.limit(0), empty)
    assert W.read_warc(spark, empty).count() == 0


def test_warc_query(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet").collect()
    got = {r.page_id: r for r in E.queries()["op9_arc_to_warc"](spark, SF001).collect()}
    assert len(got) == len(pages)
    for p in pages:
        b = (p.html or "").encode()
        assert (got[p.page_id].payload_bytes, got[p.page_id].payload_digest) == (len(b), W.base32_sha1(b))


# ------------------------------------------------------------------ op3
MAIL = "conv_id long, turn long, role string, text string, thread int, body string"


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there my friend\nHow are you doing today?", 0, ""),
        (1, 1, "assistant", "I am fine thanks a lot", 0, ""),
        (1, 2, "user", "On Monday X wrote:\n\n> hello  there my FRIEND\n> How are you doing today?\n\nReply to first", 0, ""),
        (1, 3, "user", "On Tue Y wrote:\n> > hello there my friend\n> Reply to first\nok then good", 0, ""),
        (1, 4, "user", "> words that nobody ever wrote\nstill just talk", 0, ""), (1, 4, "user", "repeated row", 0, ""),
        (2, 5, "user", "> Hello there my friend\nother conversation", 0, ""), (2, 7, None, None, 0, ""), (None, 1, "user", "x", 0, ""), (3, None, "user", ">", 0, ""),
    ]
    got = {(r.conv_id, r.turn, r.body): r for r in QU.conversations(spark.createDataFrame(rows, MAIL)).collect()}
    assert len(got) == len(rows)
    a = got[(1, 2, "Reply to first")]
    assert (a.reply_to, a.by_quote, a.n_linked, a.max_level, a.thread) == (0, True, 1, 1, 0)
    b = got[(1, 3, "ok then good")]
    assert (b.reply_to, b.n_passages, b.n_linked, b.max_level) == (2, 2, 2, 2)
    assert got[(1, 4, "still just talk")].reply_to == 3 and got[(1, 4, "repeated row")].reply_to == 3
    assert got[(2, 5, "other conversation")].reply_to is None and got[(2, 7, "")].thread == 7 and got[(None, 1, "x")].thread == 1
    assert QU.conversations(spark.createDataFrame([], MAIL)).count() == 0


def test_quotes_of_some_paragraphs_wrapped_anew(spark):
    a, b, c = (prose(24, k).split() for k in (81, 82, 83))
    cut = lambda ws, n, by="": "\n".join(by + " ".join(ws[i:i + n]) for i in range(0, len(ws), n))
    rows = [(1, 0, "user", "\n\n".join(cut(x, 8) for x in (a, b, c)), 0, ""), (1, 1, "assistant", "something else", 0, ""),
            (1, 2, "user", cut(a, 7, "> ") + "\n>\n" + cut(c, 7, "> ") + "\nagreed", 0, "")]
    got = {r.turn: r for r in QU.conversations(spark.createDataFrame(rows, MAIL)).collect()}
    assert got[2].by_quote and got[2].reply_to == 0 and got[2].n_linked == 1


def test_quotes_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF001}/conversations.parquet").collect()
    got = {(r.conv_id, r.turn): r for r in E.queries()["op3_quotation_linking"](spark, SF001).collect()}
    assert len(got) == len(rows)
    turns = {(r.conv_id, r.turn) for r in rows}
    for r in rows:
        x = got[(r.conv_id, r.turn)]
        body, passages = QU.parse(r.text)
        assert x.body == body and x.n_passages == len(passages)
        if not passages:
            assert x.reply_to == (r.turn - 1 if (r.conv_id, r.turn - 1) in turns else None)


def test_planted_quotations_are_linked(spark):
    """Whole, partial, re-wrapped, nested and repeated quotations of messages
    of unique sentences: each finds the message it was taken from."""
    import random
    rng, rows, want = random.Random(3), [], {}
    for conv in range(60):
        paragraphs = {}
        for turn in range(8):
            own = [prose(rng.randint(14, 30), conv * 100000 + turn * 1000 + k).split() for k in range(rng.randint(1, 3))]
            paragraphs[turn] = own
            lines = []
            if turn and rng.random() < 0.8:
                to = rng.randrange(turn)
                kind = rng.choice(["whole", "part", "wrapped", "nested", "lines"])
                src = paragraphs[to] if kind != "part" else [rng.choice(paragraphs[to])]
                width = 9 if kind == "wrapped" else 6
                mark = "> "
                if kind == "nested":  # a quotation inside the quotation comes first, one level down
                    deep = rng.randrange(turn)
                    lines += [f"> > {' '.join(paragraphs[deep][0][i:i + 6])}" for i in range(0, len(paragraphs[deep][0]), 6)] + [">"]
                for p in src:
                    if kind == "lines":
                        lines.append(mark + " ".join(p[:6]).upper())
                    else:
                        lines += [mark + " ".join(p[i:i + width]) for i in range(0, len(p), width)] + [">"]
                lines += ["", "my answer follows", ""]
                want[conv, turn] = to
            body = "\n\n".join("\n".join(" ".join(p[i:i + 6]) for i in range(0, len(p), 6)) for p in own)
            rows.append((conv, turn, "user", "\n".join([*lines, body])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in QU.conversations(df).collect()}
    assert len(want) > 250
    for key, to in want.items():
        assert got[key].by_quote and got[key].reply_to == to, key
    for key, r in got.items():
        if key not in want:
            assert not r.by_quote and r.reply_to == (key[1] - 1 if key[1] else None)
        assert ">" not in r.body


def test_long_message(spark):
    long = prose(60000, 5)
    got = {r.turn: r for r in QU.conversations(spark.createDataFrame([(1, 0, "user", long), (1, 1, "user", "> " + long + "\nyes")], "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].by_quote and got[1].reply_to == 0 and got[0].body == long


def test_deep_thread(spark):
    rows = [(1, k, "user", f"message number {k} of many words") for k in range(130)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.thread for r in QU.conversations(df).collect()} == {0}
