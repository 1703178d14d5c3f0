import random

import pytest

WORDS = [f"w{i}" for i in range(400)] + ["Straße", "été", "niño", "El", "THE", "the", "x.", "don't"]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def fixture_rows():
    """Documents with nulls, empty and long texts, ties, copies, near copies, shared lines and a hot source."""
    rng = random.Random(11)
    rows = []
    base = text(rng, 150).split()
    shared = [" ".join(text(rng, 9).split()) + f" line {k} that many share" for k in range(4)]
    for i in range(160):
        t = text(rng, rng.choice([1, 3, 4, 5, 30, 120]))
        if i % 8 == 0:
            own = list(base)
            for _ in range(i // 8 % 4):
                own[rng.randrange(len(own))] = f"edit{i}"
            t = " ".join(own)
        if i % 5 == 0:
            t += "\n" + (shared[i % 4] if i % 2 else f"  {shared[i % 4].upper()}\t") + "\nend"
        rows.append((i, t, "en" if i % 3 else None, "hot" if i % 3 else f"s{i % 7}", len(t)))
    rows += [
        (200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \t\n ", "en", "s1", 4),
        (203, rows[8][1], "fr", "s2", 1), (204, rows[8][1], "en", "hot", 1), (205, text(rng, 9000), "de", "s3", 2),
        (206, "\n\n", None, None, 2), (207, "12 34 !!", "en", "s4", 8), (208, "あ \U0001f600 ä", "xx", "\U0001f600", 5),
        (209, "a" * 30000, "en", "s5", 30000),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, fixture_rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(fixture_rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def texts(fixture_rows):
    return {r[0]: r[1] for r in fixture_rows}


@pytest.fixture
def empty(docs):
    return docs.limit(0)


@pytest.fixture
def sf(docs, tmp_path):
    """The fixture as a folder of tables, for the registered queries."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)
