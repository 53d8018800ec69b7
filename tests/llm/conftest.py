import random

import pytest

WORDS = "the of and to in anor thion esting ouble wher reand onst tha ering lyou heat inter ndes asho blet".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "er", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Prose, exact and near copies, shared passages, junk, nulls, empty and long texts."""
    rng = random.Random(3)
    passage = "shared passage that stands in many of the documents and is well over fifty bytes long"
    rows = []
    for i in range(120):
        text = sentence(rng, rng.choice([3, 20, 60, 200, 700]))
        if i % 5 == 0:
            text += "\n" + passage + " " + sentence(rng, 5)
        if i % 17 == 0:
            text = "Ünïcode ñ     x\x1f " + text + "\r\n\t end"
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    base = sentence(rng, 300)
    for i in range(120, 150):  # near copies, each with one word of its own
        words = base.split()
        words[(i * 7) % 300] = f"word{i}"
        rows.append((i, " ".join(words), "en", "s0", 0))
    rows += [(150 + i, rows[10][1], "en", "s1", 0) for i in range(6)]
    rows += [(160, None, None, None, None), (161, "", "en", None, 0), (162, " \n\t ", "en", "s1", 4), (163, "one two three", "en", "s2", 13)]
    rows += [(164, "a b c d e " * 4000, "en", "s2", 40000), (165, "ONE Two three", "en", "s2", 13), (None, rows[10][1], "en", "s3", 5), (163, "one two three", "en", "s2", 13)]
    rows.append((166, "<|endoftext|> special  <|startoftext|>\n\n x<|endoftext|>y  ", "en", "s3", 1))
    return rows


SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns named as those that operators make."""
    from pyspark.sql import functions as F

    names = ("n", "digest", "size", "label", "node", "words", "content", "key", "batch", "target", "spans", "ids", "score", "row_no", "copies")
    return docs.withColumns({n: F.lit(1) for n in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
