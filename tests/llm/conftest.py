import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and to in a that it for on was with as be at by this are from".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "x", "yz", "er", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    r = random.Random(11)
    base = [prose(r, r.randrange(20, 90)) for _ in range(25)]
    passage = prose(r, 30)
    texts = [*base, base[0], base[0].upper(), base[3], base[3] + ".", None, "", "   ", "word", "Word", "!!! ###", "ÀÉ àé", passage]
    for t in base[5:15]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            for _ in range(r.randrange(1, 4)):
                v[r.randrange(len(v))] = prose(r, 1)
            texts.append(" ".join(v))
    texts += [prose(r, 10) + " " + passage + " " + prose(r, 5) for _ in range(6)]
    texts.append(prose(r, 20_000))
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    rows.append(rows[4])  # a repeated row
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
