"""Rows that every operator has to take: nulls, empty and long texts, ties,
repeated rows, and extra columns named like the operators' own."""

import random

from pyspark.sql import functions as F

CLASHES = ("score", "n_words", "spans", "digest", "check", "run", "keep", "best", "n", "bucket", "chunk", "place", "node", "set_key", "rep", "weight", "length", "text_hash", "fp", "key", "kept", "predicted")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def texts():
    rng = random.Random(5)
    base = [words(rng, 60) for _ in range(6)]
    near = base[0].replace(" ", "  ", 2).rsplit(" ", 1)[0] + " changed"
    out = [(i, t) for i, t in enumerate(base)]
    out += [(10, base[1]), (11, base[1].replace(" ", "\n", 3)), (12, near), (13, ""), (14, None), (15, " \t\n"), (16, "one two"), (16, "one two")]
    out += [(None, base[2]), (None, None), (17, words(rng, 30000)), (18, "Ünï " * 40), (19, base[3][:200] + " tail " + base[4][:180]), (20, "a" * 300)]
    return out


def frame(spark, rows, names="doc_id long, text string"):
    df = spark.createDataFrame(rows, names)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def messy(spark):
    return frame(spark, texts()).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string")})


def empty(spark):
    return messy(spark).limit(0)


def strip(df, *names):
    return sorted(map(str, df.select(*names).collect()))
