import pytest

SF001 = "/root/testdata/sf0.001"
WORDS = [f"{a}{b}" for a in ("an", "be", "co", "du", "el", "fo", "ga", "hi") for b in ("ro", "sta", "lin", "mer", "tos", "vik", "nu")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, bucket int, hash long"


def prose(n: int, seed: int) -> str:
    """n words, the same for the same seed."""
    x, out = seed * 2654435761 + 1, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(WORDS[(x >> 33) % len(WORDS)])
    return " ".join(out)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and blank and very long texts, ties,
    repeated rows, and extra columns whose names operators might use."""
    base = prose(120, 1)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [
        (0, base), (1, near), (2, base), (2, base), (3, None), (4, ""), (5, " \t\n\x0b\x0c\r "), (6, "one two"), (7, "one two"),
        (8, prose(60000, 2)), (9, "word " * 500), (10, prose(80, 3)), (11, base.upper()), (12, prose(30, 4) + "\n" + " ".join(words[:40])),
        (None, base), (None, None), (13, "x" * 50000), (14, "Ünï çödé ﬁ ½ 漢字 " * 9), (15, " nbsp word wide"), (16, near),
        (2**62, prose(80, 3) + " tail"), (-5, "minus five words in here only"),
    ]
    return spark.createDataFrame([(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 2}", None, "w", 1, 2)
                                  for k, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
