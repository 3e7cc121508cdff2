"""Small tables that hold the awkward cases: nulls, empty and long texts, ties, repeats, clashing column names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "river stone light paper under cloud morning silver quiet garden window letter winter candle bridge harbor".split()


def prose(seed, n):
    state, out = seed * 2654435761 % 2**32 or 1, []
    for i in range(n):
        state = (state * 1664525 + 1013904223) % 2**32
        out.append(WORDS[state >> 28] + (chr(97 + (state >> 20) % 26) * 2) + ("." if i % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def awkward(spark):
    long_text = " ".join(prose(7, 400) for _ in range(60)) + "\n" + "x" * 50_000 + "\n" + " " * 3000 + "\n" + prose(8, 3000)
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t\n", None, "a", 4), (4, "one", "de", None, 3), (None, prose(1, 60), "en", "a", 1),
            (5, prose(2, 80), "en", "a", 1), (5, prose(2, 80), "en", "a", 1), (6, prose(2, 80), None, "b", 1), (7, long_text, "en", "a", 1),
            (8, "\x00 weird   \U0001f600 text <|endoftext|> été ÀÉ", "fr", "c", 1), (5, prose(3, 70), "en", "b", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(awkward):
    from pyspark.sql import functions as F
    names = "id key fp h n line version first size shard slot votes quality kept n_words n_lines n_dropped score rank length w win digest lo hi near root unit".split()
    return awkward.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
