import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, key string, node bigint, row string, size string"


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, near copies."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("aeioubdfgklmnrst") for _ in range(draw.randint(2, 7)))
    words = [word() for _ in range(400)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    texts = [text(draw.randint(1, 120)) for _ in range(60)]
    base = text(90).split(" ")
    for i in range(8):
        copy = list(base)
        copy[10 * i] = f"other{i}"
        texts.append(" ".join(copy))
    texts += [texts[3].upper(), texts[3], None, "", " \n\t ", "?!", "ünïcode Ärger Σ ΑΣ", "x\x1cy  z", texts[5], text(30000), "tick tock " * 60]
    out = [(i, t, draw.choice(["en", "de", None]), draw.choice(["a", "a", "a", "b", "ü", None]), len(t or ""), "k", "k", 1, "r", "s") for i, t in enumerate(texts)]
    out.append(out[4])  # a row twice
    out.append((None, texts[6], None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
