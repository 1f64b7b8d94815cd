import random

import pytest

ENGLISH = "the of and to in is that it was for be by with on are this stone river green quiet market window garden letter morning winter summer silver copper travel answer number people little better never always under above between around during before after while because though".split()


@pytest.fixture(scope="session")
def prose():
    def make(n, seed):
        rnd = random.Random(seed)
        return " ".join(rnd.choice(ENGLISH) + (rnd.choice(["", "", "", "ly", "ed", "ing", str(rnd.randrange(999))]) if rnd.random() < 0.5 else "") for _ in range(n))

    return make


SCHEMA = "doc_id bigint, text string, lang string, id bigint, key string, place int, n bigint, part int, bucket int, _row int, h bigint, kept boolean, score double, one int"


@pytest.fixture(scope="session")
def hard_docs(spark, prose):
    """Nulls everywhere, empty and long texts, repeated rows, ties, and columns with clashing names."""
    base, other = prose(120, 1), prose(150, 2)
    near = base.split()
    near[60] = "changed"
    long = "\n".join(prose(40, 100 + k) for k in range(600))
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, other), (5, None), (6, ""), (7, " \n\t "), (8, long),
        (9, other + "\n" + prose(60, 5)), (10, "one"), (11, "one"), (12, base.upper()), (None, base), (None, None),
        (13, "\n".join(["a line that repeats itself in full here"] * 5)), (4, other), (14, "İ ß 日本 é\u0301 <|endoftext|>x ½ 🙂"), (15, "x" * 5000),
    ]
    rows = [(i, t, None, k, "key" if k % 2 else None, 0, None, 1, 2, 3, 4, True, 0.5, 7) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


SF = "/root/testdata/sf0.001"
