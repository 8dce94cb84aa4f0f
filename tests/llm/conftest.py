import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __g string, kept string, bucket string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sà", "ti", "日本") for b in ("n", "ra", "sto", "vé", "", "lix", "pp")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def sample():
    """Documents with copies, near copies, shared passages and every odd case."""
    rng = random.Random(11)
    passage, line = prose(rng, 40), prose(rng, 9)
    texts = [prose(rng, rng.choice([3, 12, 40, 90])) for _ in range(60)]
    texts += [texts[i] for i in (3, 3, 3, 7, 20)]  # copies
    for i in range(20):  # near copies of one text
        w = prose(random.Random(5), 120).split(" ")
        w[(7 * i) % len(w)] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [f"{prose(rng, 20)}\n{passage}\n{prose(rng, 15)}" for _ in range(12)]
    texts += [f"{line}\n{prose(rng, 30)}" for _ in range(12)]
    texts += [None, None, "", " \n\t ", "one", "a b c d", "ab" * 400, "x " * 300, "=" * 2000, prose(rng, 6000), passage, "wörd " * 13]
    rows = [(2 * i + 1, t, "en", "hot" if i % 3 else f"s{i}", len(t or ""), "g", "k", "b") for i, t in enumerate(texts)]
    rows += [(5, rows[2][1], "en", None, None, None, None, None)] * 2  # repeated rows under one id
    rows += [(7, "another text under an id that is taken " * 4, None, "hot", 1, "g", "k", "b"), (None, texts[0], "fr", "hot", 1, "g", "k", "b"), (None, prose(rng, 30), "fr", "hot", 1, "g", "k", "b")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return sample()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def small_groups(monkeypatch):
    """Many groups and partitions although the texts are few."""
    from basalt.llm import groups

    monkeypatch.setattr(groups, "GROUP_BYTES", 9_000)
    monkeypatch.setattr(groups, "LEAST_GROUP_BYTES", 4_000)
