import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

WORDS = ["re", "thon", "eada", "Über", "ñas", "the", "of", "ing", "blea", "ever", "Nd", "x1", "émou", "wh", "ti", "st", "or", "an"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", rng.choice(WORDS), "."]) for _ in range(n))


EDGE_ROWS = [
    (1, prose(1, 60), "a", "x", 1.0, None),
    (2, prose(1, 60), "a", "x", 1.0, None),  # a copy
    (2, prose(1, 60), "a", "x", 1.0, None),  # the row once more
    (3, prose(1, 59) + " other", None, "y", 2.0, None),  # a near copy, no source
    (4, None, "b", "y", 2.0, "q"),
    (5, "", "b", "", 2.0, "q"),
    (6, " \t\n\r\x0b\x0c ", "b", None, None, "q"),
    (7, "Two words", "a", "x", 1.0, None),
    (8, "two  WORDS", "a", "x", 1.0, None),
    (None, prose(5, 30), "c", "x", 1.0, None),
    (9, prose(6, 20_000), "c", "x", 1.0, None),
    (10, "　   日本語 <s> </s> <|endoftext|> \x00 á", "c", "x", 1.0, None),
]
# columns whose names an operator might use inside
EDGE_SCHEMA = "doc_id long, text string, source string, id string, size double, node string"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
