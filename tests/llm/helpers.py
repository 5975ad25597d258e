"""Small tables with the awkward cases that every operator and stage must stand."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng: random.Random, n: int) -> str:
    syllables = "the an er on in th re he ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, near and exact copies."""
    rng = random.Random(11)
    base = prose(rng, 80)
    near = base.split()
    near[40] = "changed"
    rows = [
        (1, base, "en", "a", len(base)), (2, base.replace(" ", "  \t"), "en", "b", 9), (3, " ".join(near), "en", "a", 9), (3, " ".join(near), "en", "a", 9),
        (4, None, "en", "a", None), (5, "", "en", "a", 0), (6, " \n\t ", None, "a", 4), (None, base, "en", None, 9), (None, prose(rng, 30), None, None, None),
        (None, None, None, None, None), (7, "one", "en", "a", 3), (8, "one two three", "en", "c", 13), (9, "One Two  three", "en", "c", 14),
        (10, prose(rng, 30_000), "en", "a", 1), (11, "x" * 200_000, "en", "b", 200_000), (12, "é" * 50 + " 　 漢字 🙂", "fr", "d", 60),
    ]
    return rows + [(100 + i, prose(rng, rng.randint(0, 120)), "en", "abcde"[i % 3], 1) for i in range(60)]


def frame(spark, rows, extra: dict | None = None):
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name, value in extra.items():
            df = df.withColumn(name, F.lit(value))
    return df
