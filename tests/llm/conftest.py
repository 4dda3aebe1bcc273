import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns that operators use inside."""
    texts = [
        (1, "The cat sat on the mat and it was good for all of them."), (2, "the CAT sat on the mat and it was good for all of them."), (3, None), (4, ""), (5, " \n\t "),
        (6, "word " * 20000), (7, "é ß 🙂 \x01 \x02 a@b.co 1.2.3.4"), (7, "é ß 🙂 \x01 \x02 a@b.co 1.2.3.4"), (None, "no id here"), (None, None), (8, "x" * 30000), (9, "one two"),
    ]
    clash = "mark string, key string, fp long, digest binary, meeting long, block long, role int, score double, value string, base string, pair long, held_out boolean, keep_id long, least long, hits string"
    names = [c.split()[0] for c in clash.split(", ")]
    return spark.createDataFrame([(*t, *[None] * len(names)) for t in texts], "doc_id long, text string, " + clash).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
