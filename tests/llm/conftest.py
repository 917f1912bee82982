import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import random

import pytest

#: A table with what tables may hold: no id, no text, empty and blank texts, repeated rows and ids, equal texts, a long
#: text, odd white space, extra columns named like the operators' own.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, ids string, score double, row long, component string, n int, spans string"


def odd_rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, text = prose(70), prose(120)
    rows = [(None, prose(30)), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, text), (4, text), (5, text), (6, text + " more"), (7, "x" * 5000)]
    rows += [(8, prose(20000)), (9, f"{prose(40)} {passage} {prose(20)}"), (10, f"{passage}\n{prose(10)}"), (11, "Ünï cödé ß 漢字 😀 x　 y\r\n" * 20)]
    rows += [(12, "one two"), (13, "one two"), (14, prose(200).upper() + "!!"), (4, "another text with id four")]
    rows += [(100 + i, prose(rng.randint(1, 400))) for i in range(80)]
    rows += [(i, rows[40][1].replace("a", "b", 1)) for i in range(300, 306)]
    return [(i, t, "en", "s", len(t or ""), 1, "x", 0.5, 7, "c", 3, "s") for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
