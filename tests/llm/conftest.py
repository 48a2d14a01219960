import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        w = "".join(r.choice("abcdefghiklmnoprstuvwyz") for _ in range(r.randint(2, 8)))
        out.append(r.choice([w, w, w, w + ",", w + ".", w.title(), w + ".\n"]))
    return " ".join(out)


@pytest.fixture(scope="session")
def rand():
    return lambda seed=0: random.Random(seed)


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, shared lines, nulls, empty and long texts, repeated rows."""
    r = random.Random(5)
    texts = [prose(r, r.randint(1, 120)) for _ in range(60)]
    for t in texts[:12]:
        texts += [t, t.replace(" ", "  "), f" {t}\t"]
    for t in texts[20:26]:
        words = t.split(" ")
        for _ in range(6):
            near = list(words)
            for _ in range(1 + len(near) // 60):
                near[r.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    passage = prose(r, 70).replace("\n", " ")
    texts += [f"{prose(r, 30)}\n{passage}\n{prose(r, 30)}" for _ in range(5)]
    texts += [None, None, "", "", " \t\n", "one", "One", "two words", "a b c d", "a b c d e", prose(r, 9000), "x" * 20000]
    rows = [(k, t, "en", "s0", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[3], (None, "no id here", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
