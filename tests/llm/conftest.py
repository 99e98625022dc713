import pytest

LONG = "lorem ipsum dolor sit amet 12, " * 4000

#: Awkward texts: null, empty, blank, other scripts, special strings, no spaces, very long.
TEXTS = [None, "", " ", "   ", "a  b", " a", "\n\n", "▁ ▁▁x", "<s> </s> <|endoftext|> <0x0A>", "é漢字😀\u0000x", "I'll don't we're 'tis", "a\tb\r\n c", "x" * 3000, LONG, "The same text twice.", "The same text twice.", "﻿  a　b"]


@pytest.fixture(scope="session")
def awkward(spark):
    """doc_id, text and columns whose names the operators use themselves; an id is null, one stands twice."""
    ids = [*range(len(TEXTS) - 2), None, 3]
    rows = [(i, t, 7, "z", 1, 2, 3.5) for i, t in zip(ids, TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, __k1 string, k1 int, fp int, score double").repartition(3)


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.filter("false")
