import random

import pytest

WORDS = "the of and to in that it was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS)
        out.append(w + (".\n" if r.random() < 0.04 else "," if r.random() < 0.05 else ""))
    return " ".join(out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use themselves.
CLASH = ["n_words", "kept", "bin", "k", "tie", "fp", "spans", "sort_key", "epoch", "tokens", "weight", "row", "ids", "n_tokens", "parts", "rank", "d2", "component_id", "__p", "value", "key"]


def rows_of_edges():
    """Nulls, empty and white texts, repeated rows and ids, a very long text, odd characters."""
    base = [(i, prose(i, 60 + 7 * i), ["en", "de"][i % 2], f"src{i % 3}") for i in range(12)]
    rows = [*base, base[0], (20, base[1][1], "en", "src0"), (21, base[1][1].replace("the", "xx", 1), "en", "src0")]
    rows += [(30, None, "en", "src1"), (31, "", None, None), (32, " \n\t ", "en", None), (None, "no id here at all", "fr", "src9"), (None, None, None, None)]
    rows += [(33, "one", "en", "src1"), (34, "é漢😀▁ \x00x", "en", "src1"), (3, "a second text of the same id " * 9, "en", "src0"), (35, "ab" * 400, "en", "src2"), (36, prose(99, 15_000), "en", "src2")]
    return [(d, t, l, s, None if t is None else len(t)) for d, t, l, s in rows]


@pytest.fixture(scope="session")
def edges(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows_of_edges(), SCHEMA)
    for i, c in enumerate(CLASH):
        df = df.withColumn(c, F.lit(f"clash {i}"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
