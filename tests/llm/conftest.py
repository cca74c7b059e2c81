from __future__ import annotations

import random

import pytest

WORDS = "the of and to in a is that it was for on are with as his they be at one have this from".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice("abcdefgéß") for _ in range(rng.randint(3, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): exact and near copies, shared passages, periodic, very long, empty and null texts."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(5, 160)) for _ in range(40)]
    passage = prose(rng, 90)
    texts = list(base)
    texts += [base[i] for i in (0, 0, 0, 3, 5)]
    for i in range(30):
        words = base[i % 6].split(" ")
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 12)} {passage}\n{prose(rng, 9)}" for _ in range(8)]
    texts += ["ab " * 120, "ab " * 90, "x" * 400, "x" * 250, "", "", None, None, " \t\n ", "one", "one", "One two", "one TWO"]
    texts.append(prose(rng, 3000) + " " + passage + " " + base[1])
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus as a table with further columns whose names clash with those of the operators."""
    rows = [(i, t, "src%d" % (i % 3) if i % 7 else None, "fp", 1, None) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kind string, n long, rep string").repartition(5)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
