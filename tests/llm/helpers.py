"""Rows that every operator has to stand: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_texts():
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "Öl", "delta", "of", "the"]
    prose = " ".join(rnd.choice(words) + str(rnd.randrange(300)) for _ in range(400))
    return [
        None, "", " \t\n", "one", "two words", "a b c", prose, prose, prose + " tail", prose.upper(),
        "same line here\n" * 40, "x" * 5000, "tab\tand\x0bmore\x1cwords　here " * 30, "😀 smile " * 60, "\n\n\na\n\nb\n",
        " ".join(rnd.choice(words) for _ in range(30000)), "he said <|endoftext|> twice  over", prose + "\n" + prose,
    ]


def odd_docs(spark, extra=False):
    rows = [(i, t, None if i % 5 == 0 else ["en", "de"][i % 2], None if i % 7 == 0 else f"src{i % 3}", len(t) if t else None) for i, t in enumerate(odd_texts())]
    rows += [rows[6], rows[6], (2**60 + 1, "an id that no double holds", "en", "src1", 26), (None, "no id at all", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for c in ("fp", "key", "n", "component", "id", "rank", "part", "length", "base", "score", "low", "at", "tokens", "leaf"):
            df = df.withColumn(c, F.lit("x"))
    return df


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
