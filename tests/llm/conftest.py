import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "tu", "re", "sa", "no", "vi"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=0, n=60):
    """Texts with copies, near copies, repeated lines and shared passages."""
    rng = random.Random(seed)
    boiler, passage = sentence(rng, 9), sentence(rng, 45)
    texts = []
    for i in range(n):
        lines = [sentence(rng, rng.randint(2, 30)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), boiler)
        if i % 5 == 0:
            lines.insert(rng.randrange(len(lines) + 1), passage)
        if i % 4 == 1:
            lines.append(f"Page {i} of {n} printed {rng.randint(1, 999)} times on this site")
        t = "\n".join(lines)
        if i > 10 and i % 6 == 2:
            w = texts[rng.randrange(5)].split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if i > 10 and i % 7 == 3:
            t = texts[rng.randrange(10)]
        texts.append(t)
    return texts


@pytest.fixture(scope="session")
def docs(spark):
    texts = corpus()
    rows = [(7 * i + 3, t, ["en", "de", None][i % 3], ["a", "b", "c", "é", None][i % 5], len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, and columns called like those of the operators."""
    long = "\n".join(f"word{i % 997} and more{i % 89} of it" for i in range(30_000))
    base = [
        (1, "a b c d e f g", "en", "s"), (1, "a b c d e f g", "en", "s"), (2, None, None, None), (None, None, None, None), (None, "a b c d e f g", "en", "s"), (3, "", "de", "s"), (4, "", "de", None),
        (5, " \t\n ", "de", "s"), (6, long, "en", "t"), (7, long + " x", "en", "t"), (8, "12 34 !!", "en", "t"), (9, "é ü \U0001f642 <|endoftext|> x", "fr", "t"), (1, "other text under the same id here", "en", "s"), (-5, "x" * 50_000, "en", "t"),
    ]
    more = ["size", "h", "id", "row", "key", "keep", "block", "lines", "digest", "letters", "noise", "class_id", "root", "c0", "document", "s", "t", "n", "copies", "kept", "vector"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{m}` string" for m in more)
    return spark.createDataFrame([(*b, *(["x"] * len(more))) for b in base], schema)
