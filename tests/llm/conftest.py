import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row int, fp int, key int, words int, hits int, place int, rank int, line int"


def make(spark, rows):
    """documents with further columns whose names operators use inside; rows: (doc_id, text, source)."""
    return spark.createDataFrame([(d, t, "en", s, 0, *(0,) * 9) for d, t, s in rows], SCHEMA)


def prose(rng, n):
    parts = "the of ing tion ed ha er re sh at th on es an in ou le".split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with exact and near copies, repeated rows, nulls, blanks and a long text."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(3, 60)) + "\n" + prose(rng, 20), f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "s0") for i in range(12)]
    for i in range(12):
        words = rows[i + 20][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((200 + i, " ".join(words), None))
    rows += [(300, None, "s1"), (301, "", "s1"), (302, " \t\n", None), (None, rows[3][1], ""), (None, None, None)]
    rows += [rows[5], rows[5], (400, rows[7][1], "s2"), (400, "another text", "s2")]
    rows.append((500, prose(rng, 20_000), "s3"))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return make(spark, corpus).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])
