import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n int, id string, h long, t string, piece int, score double, fp string, node int, raw string, n_tokens int, key string"


def texts(seed: int, n: int = 60) -> list:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéß ") for _ in range(rnd.randrange(1, 9))).strip() or "a" for _ in range(80)]
    long = " ".join(rnd.choice(words) for _ in range(9000))
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(30, 120))) for _ in range(6)]
    out = [None, "", " ", "x", "日本語のテキスト " * 30, "a" * 3000, "<|endoftext|> and </s> <s>", long, long, "ab\n\tcd  ef\r\n" * 40]
    for _ in range(n):
        b = rnd.choice(base).split()
        for _ in range(rnd.randrange(3)):
            b[rnd.randrange(len(b))] = rnd.choice(words)
        out.append(" ".join(b))
    return out


@pytest.fixture(scope="session")
def rows():
    """Texts with nulls in every column, empty and long ones, copies, near copies and rows that are repeated whole."""
    some = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "src0", None if t is None else len(t)) for i, t in enumerate(texts(3))]
    return some + some[8:14] + [(None, "no id", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with further columns whose names clash with names used inside."""
    return spark.createDataFrame([(*r, 1, "q", 2, "w", 3, 0.5, "z", 4, "r", 5, "k") for r in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def unordered():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
