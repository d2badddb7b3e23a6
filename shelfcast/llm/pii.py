"""op10: personal data by regular expressions, checksum validators and context.

Regular expressions propose spans, validators (Luhn, mod-97, ranges) confirm
them, and words near a span raise or lower its score. Spans of the four base
kinds always stay; the added kinds stay from ``MIN_SCORE`` on.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows, small_batches

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "card_in_run", "secret")
MIN_SCORE = 0.6

# Patterns that fix the base kinds. Equivalent to the plain forms, but a digit
# run is tried from its start only and never given back, so that time stays
# linear on any text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Added kinds.
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
_SECRET = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_/+-]{20,}+")
_GROUP = re.compile(r"[0-9]++")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
#: characters of an IBAN by country
IBAN_LENGTH = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC"}.items() for c in cs.split()}
#: digits of a card, the usual number first, and how cards are printed
_CARD_LENGTHS = (16, 15, 14, 13, 19, 18, 17)
_PRINTED = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 3, 3, 3)}
_ISSUER = re.compile("[3-6]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)")
_DIGIT = re.compile("[0-9]")

#: start score of a confirmed span by kind, and words whose nearness adds or takes WEIGHT
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "card_in_run": 0.7, "secret": 0.4}
FOR = {
    "email": {"email", "mail", "e-mail", "contact", "correo", "courriel", "kontakt"},
    "ip": {"ip", "address", "host", "server", "adresse", "login"},
    "card": {"card", "visa", "credit", "mastercard", "karte", "carte", "tarjeta", "payment"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "appel"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "card_in_run": {"card", "visa", "credit", "mastercard", "karte", "carte", "tarjeta"},
    "secret": {"token", "secret", "password", "passwd", "apikey", "api_key", "key", "bearer"},
}
AGAINST = {"version", "release", "section", "isbn", "serial", "checksum", "sha1", "sha256", "md5", "commit"}
WEIGHT, NEAR = 0.25, 32
_WORD = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(t: str) -> list[tuple[int, int]]:
    out, at, last = [], 0, 0
    while (p := t.find("@", at)) >= 0:
        at = p + 1
        if m := _DOMAIN.match(t, at):
            s = p
            while s > last and t[s - 1] in _LOCAL:
                s -= 1
            if s < p:
                out.append((s, m.end()))
                at = last = m.end()
    return out


def base_spans(t: str) -> dict[str, list[tuple[int, int]]]:
    out = {k: [] for k in BASE}
    if "@" in t:
        out["email"] = emails(t)
    if not _DIGIT.search(t):
        return out
    for m in _IP.finditer(t):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(t):
        d = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 40 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out["phone"].append(m.span())
    return out


def score(t: str, kind: str, lo: int, hi: int) -> float:
    """Start score of the kind, moved by context words up to NEAR characters away."""
    near = {w.lower() for w in _WORD.findall(t[max(0, lo - NEAR):lo] + " " + t[hi:hi + NEAR])}
    return round(min(1.0, max(0.0, SCORE[kind] + WEIGHT * bool(near & FOR[kind]) - WEIGHT * bool(near & AGAINST))), 3)


def ibans(t: str) -> list[tuple[int, int]]:
    """Of each start the country's length, else the longest that ends a group."""
    out, last = [], 0
    for m in _IBAN.finditer(t):
        lo, x = m.start(), m[1]
        if lo < last:
            continue
        ends = [k for k in range(len(x), 14, -1) if x[k - 1] != " " and t[lo + k:lo + k + 1] not in _ALNUM]
        ends.sort(key=lambda k: k - x.count(" ", 0, k) != IBAN_LENGTH.get(x[:2]))
        if hi := next((lo + k for k in ends if mod97(x[:k])), 0):
            out.append((lo, hi))
            last = hi
    return out


def cards_in_runs(t: str) -> list[tuple[int, int]]:
    """Runs of whole digit groups inside longer sequences. Luhn holds for a
    tenth of all numbers, so several groups count only if they are printed as a
    card is and an issuer has the number, or beside a word for a card."""
    out = []
    for m in _CARD.finditer(t):
        groups = [g.span() for g in _GROUP.finditer(t, *m.span())]
        i = 0
        while i < len(groups):
            sizes, windows = [], {}
            for lo, hi in groups[i:i + 19]:
                sizes.append(hi - lo)
                if (n := sum(sizes)) > 19:
                    break
                if n >= 13:
                    windows[n] = (len(sizes), hi)
            lo = groups[i][0]
            for n in _CARD_LENGTHS:
                if n in windows:
                    k, hi = windows[n]
                    number = t[lo:hi].replace(" ", "").replace("-", "")
                    if luhn(number) and (k == 1 or tuple(sizes[:k]) in _PRINTED and _ISSUER.match(number) or score(t, "card_in_run", lo, hi) > SCORE["card_in_run"]):
                        out.append((lo, hi))
                        i += k - 1
                        break
            i += 1
    return out


def secrets(t: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SECRET.finditer(t) if any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0]))]


def find_spans(t: str) -> list[tuple[str, int, int, float]]:
    """All kept spans, by kind as listed and then by start."""
    base = base_spans(t)
    out = [(k, lo, hi, score(t, k, lo, hi)) for k in BASE for lo, hi in base[k]]
    if not _DIGIT.search(t):
        return out
    for kind, found in (("iban", ibans), ("card_in_run", cards_in_runs), ("secret", secrets)):
        taken = sorted((lo, hi) for _, lo, hi, _ in out)
        starts, ends = [x[0] for x in taken], list(accumulate((x[1] for x in taken), max))
        for lo, hi in found(t):
            if (x := score(t, kind, lo, hi)) >= MIN_SCORE:
                i = bisect_left(starts, hi)  # of the spans that start before its end, does one reach into it?
                if not i or ends[i - 1] <= lo:
                    out.append((kind, lo, hi, x))
    return out


def join_spans(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{lo}:{hi}" for k, lo, hi, _ in spans)


def find_pii(df: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, digest of the base spans, all spans and
    their scores. Null or empty text: no spans. Offsets are code points."""
    def make():
        def f(c):
            out = {k: [] for k in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores")}
            for d, t in zip(c["doc_id"], c["text"]):
                s = find_spans(t or "")
                base = [x for x in s if x[0] in BASE]
                out["doc_id"].append(d)
                for k in BASE:
                    out[f"n_{k}"].append(sum(x[0] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                out["spans"].append(join_spans(s))
                out["scores"].append(",".join(str(x[3]) for x in s))
            return out
        return f

    return map_rows(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make,
                    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")


def mask(t: str | None) -> str | None:
    """Text with every span replaced by its kind in angle brackets; of
    overlapping spans the parts join into one replacement."""
    if not t:
        return t
    out, at = [], 0
    for lo, hi, k in sorted((lo, hi, k) for k, lo, hi, _ in find_spans(t)):
        if lo >= at:
            out += [t[at:lo], f"<{k.upper()}>"]
        at = max(at, hi)
    return "".join([*out, t[at:]]) if out else t


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with masked text (and ``n_chars``, where present, counted anew);
    every other column and every row stays."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def masked(s):
        return s.map(mask, na_action="ignore")

    small_batches(docs.sparkSession)
    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all ``documents``."""
    return find_pii(documents(spark, sf_dir))
