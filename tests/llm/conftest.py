"""Small tables with the awkward rows that every operator must take."""

import pytest


def awkward(rng_texts):
    """Rows (doc_id, text, source, lang, n_chars): nulls in every column, empty and long texts, repeated rows, white space, other scripts."""
    rows = [
        (0, None, "s", "en", None),
        (1, "", "s", None, 0),
        (2, " \t\n ", None, "de", 4),
        (3, "short", "s", "en", 5),
        (4, "日本語 текст ñandú 😀", "t", "xx", 17),
        (None, "a row without an id", "t", "en", 19),
    ]
    rows += [(10 + i, t, "hot" if i % 3 else "t", "en", len(t)) for i, t in enumerate(rng_texts)]
    rows += [rows[7], rows[7]]
    return rows


SCHEMA = "doc_id bigint, text string, source string, lang string, n_chars bigint"


@pytest.fixture(scope="session")
def texts():
    """Invented prose with copies, near copies, shared passages, repeated lines and one very long text."""
    import random

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice(["an", "be", "ko", "ti", "lu", "sche", "ña"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(90), prose(12)
    out = [prose(rng.randint(5, 200)) for _ in range(25)]
    out += [out[0], out[0], out[1]]
    for k in range(12):  # near copies of one text
        words = out[2].split() + prose(80).split() if k == 0 else base.split()
        if k == 0:
            base = " ".join(words)
        words[rng.randrange(len(words))] = "changed" + str(k)
        out.append(" ".join(words))
    out += [prose(30) + " " + passage + " " + prose(20) for _ in range(6)]
    out += ["\n".join([line] * 40 + [prose(8)]) for _ in range(2)]
    out.append("x" * 1500)
    out.append(prose(6000))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(awkward(texts), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
