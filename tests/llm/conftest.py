import random

import pytest

WORDS = [a + b for a in "the of and ba ke lo mi ra tu zo".split() for b in ["", "n", "ster", "ing", "la", "qua"]]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def tricky():
    """Nulls, empty and odd white space, repeats, copies, a long text; some ids null or twice."""
    rng = random.Random(1)
    passage = prose(rng, 70)
    rows = [(k, prose(rng, rng.randint(20, 160)), "en", f"s{k % 4}" if k % 7 else None) for k in range(40)]
    rows += [(40, None, "en", "s1"), (41, "", "en", "s0"), (42, " \t\n\x0b ", None, "s0"), (None, prose(rng, 60), "en", "s2"), (None, passage, "en", "s2"), (None, None, None, None)]
    rows += [(50, rows[3][1], "en", "s3"), (51, rows[3][1], "en", "s0"), (52, rows[3][1] + " tail", "en", "s0"), (53, "é ß " + passage + " — 日本語 <|endoftext|> it's 12", "de", "s9")]
    rows += [(54, prose(rng, 10) + "\n" + passage + "  " + prose(rng, 30), "en", "s1"), (55, passage, "en", "s1"), (3, rows[3][1], "en", "s3"), (3, "another text under an id in use " + prose(rng, 30), "en", "s3")]
    rows += [(56, "a " * 300, "en", "s1"), (57, "x" * 5000, "en", "s1"), (58, prose(rng, 9000), "en", "s2"), (59, "THE!! END!! " * 40, "en", "s2")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return tricky()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, 0 if k in (56, 59) else 1, 0) for k in [*range(0, 40, 2), 56, 59]] + [(None, 1, 0), (5, None, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents under extra columns with the names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["_doc", "_digest", "_spans", "_whole", "spans", "key", "range", "size", "taken", "row", "fp", "slot", "shard", "_slot", "_text_digest", "_kept_id", "_copy", "_got", "_take", "_size", "_nth", "label", "score", "length"]
    return docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
