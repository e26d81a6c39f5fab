import random

import pytest

WORDS = "the and of idea river stone data plain Green blue Über año señor 12 345 x,".split()


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): prose, near copies, copies, nulls, empty, white space, one very long, repeated rows, no id."""
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", "\n"]) for _ in range(n))
    rows = [(i, prose(rng.randrange(1, 120))) for i in range(40)]
    for i in range(6):
        base = prose(90).split(" ")
        rows.append((100 + 10 * i, " ".join(base)))
        for j in range(1, 5):
            copy = list(base)
            for _ in range(j):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(99)}"
            rows.append((100 + 10 * i + j, " ".join(copy)))
    rows += [(200, rows[0][1]), (201, rows[41][1]), (202, ""), (203, None), (204, " \n "), (205, "a"), (206, "a b c d"), (207, "A b c d"), (208, prose(6000)), (209, "x" * 5000)]
    rows += [(0, rows[0][1]), (205, "a"), (None, "a"), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows with extra columns whose names clash with those used inside."""
    rows = [(i, t, f"src{(i or 0) % 3}", ["en", "de", None][(i or 0) % 3], 1, 2, "s", 3, 4) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, n int, key string, frag int, row_key long")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
