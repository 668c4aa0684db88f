import random

import pytest
from hypothesis import settings

settings.register_profile("loaded", deadline=None)  # a busy machine is no failure
settings.load_profile("loaded")

#: Columns whose names the operators use inside.
CLASH = "th string, h long, fp long, n int, kept boolean, spans string, t string, ws string, keys string"


def corpus():
    """Invented texts: plain ones, exact and near copies, shared passages and lines, odd ones."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(30, 120))) for i in range(24)]
    rows += [(30, rows[3][1]), (31, rows[3][1]), (32, rows[3][1].replace("w1 ", "w2 ", 1)), (33, rows[4][1] + " tail")]
    passage = text(90)
    rows += [(40 + i, text(25) + " " + passage + " " + text(25)) for i in range(4)]
    lines = "\n".join(text(6) for _ in range(5))
    rows += [(50, lines + "\n" + text(5)), (51, text(5) + "\n" + lines), (52, "a\nb\nc\na\nb\nc\na\nb\nc")]
    rows += [(60, None), (61, ""), (62, " \n\t \n "), (63, "one"), (64, "One two"), (65, "é ñ 𝒳 ü"), (66, "x" * 3000), (67, text(4000))]
    rows += [(70, rows[5][1]), (70, rows[5][1]), (None, rows[6][1]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    wide = [(i, t, "en", "s", 1, *["x", 1, 2, 3, True, "y", "z", "w", "k"]) for i, t in rows]
    return spark.createDataFrame(wide, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
