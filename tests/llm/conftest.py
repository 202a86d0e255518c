import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, bits string, size string, n_removed string, mark int, words int"


def passage(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, shared passages and near copies."""
    shared, other = passage(1, 60), passage(2, 80)
    near = other.split()
    near[40] = "changed"
    long = "\n".join(passage(100 + i, 25) for i in range(400))
    texts = [
        (1, f"{passage(3, 30)}\n{shared}\n{passage(4, 20)}"),
        (2, f"{passage(5, 10)} {shared} {passage(6, 10)}"),
        (3, other),
        (4, other),
        (5, " ".join(near)),
        (6, None),
        (7, ""),
        (8, " \n\t \n"),
        (9, long),
        (9, long),
        (10, f"{shared}\n{shared}"),
        (11, "one"),
        (12, "one two"),
        (13, "été Straße ÀÉ été Straße ÀÉ été straße " + passage(7, 60)),
        (14, "spam " * 400),
        (None, shared),
        (None, passage(8, 70)),
        (15, f"Licensed under CC-BY 4.0.\nAll  rights\treserved. {passage(9, 60)}"),
        (16, "\n".join(["same line here again"] * 5 + [passage(10, 55)])),
        (17, f"{passage(3, 30)}\n\n{shared} tail"),
    ]
    return [(i, t, None if n % 7 == 6 else "en", None if n % 5 == 4 else f"s{n % 3}", len(t or ""), "x", "y", "z", "w", 7, n) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
