import pytest

#: Null and empty texts, a very long one, ties, repeated rows and ids, exact and near copies.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, seed):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


PASSAGE = prose(60, 99)
ROWS = [
    (1, prose(40, 1) + "\n" + PASSAGE),
    (2, PASSAGE + " " + prose(30, 2)),
    (3, None),
    (4, ""),
    (5, prose(40, 1) + "\n" + PASSAGE),
    (6, " \t\n "),
    (7, "short one"),
    (8, "word " * 300),
    (9, "Ünïcödé ÆØÅ 😀 " * 20 + prose(20, 9)),
    (10, prose(20_000, 10)),
    (11, prose(30, 3) + " " + " ".join(PASSAGE.split()[5:40]) + " " + prose(30, 4)),
    (11, prose(30, 3) + " " + " ".join(PASSAGE.split()[5:40]) + " " + prose(30, 4)),
    (12, "word " * 300),
    (None, PASSAGE),
    (None, None),
    (13, prose(200, 13)),
    (14, prose(200, 13).replace("alpha", "ALPHA", 1)),
    (15, "x" * 5000),
    (16, "x" * 5000 + " end"),
    (17, "ends with   odd   spaces\v and\fbreaks"),
]
CLASHING = "batch long, order string, score double, dest int, fp string, node int, keep0 string, held_out string, component_id string, n_words string, size string, shard string, curve string"


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    """The rows with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    for c in CLASHING.split(", "):
        df = df.withColumn(c.split()[0], F.lit(None).cast(c.split()[1]))
    return df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


def shuffled(rows):
    return sorted(rows, key=repr)
