import random

import pytest
from pyspark.sql import functions as F

from kartograf.llm.base import prepared

CLASHES = ["id", "key", "n", "block", "_id", "h", "kind", "place", "label", "uid", "rank", "keep_id", "row_id", "_row", "word", "part", "recipe", "bin_id"]


@pytest.fixture(scope="session")
def ready(spark):
    return prepared(spark)


def odd_rows():
    """Texts with ties, repeats, near copies, personal data, gaps, and one very long one."""
    rng = random.Random(11)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta,", "eta.", "日本", "theta"]
    core = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(3)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a B c"), (5, "A b C"), (5, "A b C"), (7, core[0]), (8, core[0].upper()), (9, core[0] + " x"),
            (10, core[1]), (11, core[1] + " tail"), (12, core[1]), (13, core[2] + core[0]), (14, "é" * 120), (15, "é" * 80), (None, core[2]), (None, None),
            (16, core[2]), (1 << 60, "mail bob.b@mail.example.com or +1 (234) 555-6789 at 10.0.0.255, card 4111 1111 1111 1111; password=Zx91kk"),
            ((1 << 60) + 1, "no 1.2.3.256 here, 4111111111111112 neither, +12 no, a@b no, x@y.z yes"), (17, "🙂 smile 🙂"),
            (18, " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(30_000)))]
    return rows + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(20)]


@pytest.fixture(scope="session")
def odd(ready):
    """The same as a table with the columns of documents and many more, some named as operators name theirs."""
    rows = [(d, t, "en" if i % 3 else None, "s", i) for i, (d, t) in enumerate(odd_rows())]
    df = ready.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    return df.withColumns({c: F.lit(-1) for c in CLASHES}).cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("false")


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) if not isinstance(v, (list, tuple)) else (True, str(v)) for v in r))
