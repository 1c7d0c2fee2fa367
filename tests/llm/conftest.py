"""Documents with every odd case, and plain words to make others of."""

import random

import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in ("ba", "con", "del", "fir", "gu", "hel", "in", "jo", "kra", "lum") for b in ("ta", "ven", "dor", "lis", "ne", "pu", "ram", "so")]
EXTRA = ("fp", "doc", "chunk", "curve", "score", "component", "print", "low", "row", "ids", "bucket", "name")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Null id and text, empty and blank texts, a very long one, copies, near copies, repeated rows, clashing columns."""
    base = prose(1, 120)
    lines = "\n".join(prose(50 + k, 12) for k in range(4))
    rows = [
        (1, base),
        (2, base),
        (3, base + " end"),
        (4, prose(2, 60)),
        (5, None),
        (6, ""),
        (7, " \n\t "),
        (8, prose(3, 60_000)),
        (9, lines),
        (10, prose(4, 20) + "\n" + lines + "\n\n" + prose(5, 20)),
        (11, "Éa ß ﬁ 你好 " + "a" * 4000 + " \x1c x"),
        (12, "one"),
        (12, "one"),
        (13, "ONE"),
        (None, base),
        (None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumns({c: F.lit(c) for c in EXTRA} | {"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
