"""Tables with everything an operator has to bear."""

from pyspark.sql import functions as F

BASE = "The quick brown fox jumps over the lazy dog while the old man of the house is in the garden and it was late for tea"


def hard_documents(spark):
    """NULLs in every column, empty and long texts, repeated rows, and columns whose names operators use."""
    rows = [
        (1, BASE, "en", "a"), (2, BASE, "en", "a"), (2, BASE, "en", "a"), (3, None, None, None), (4, "", "", ""),
        (None, "no id here but words enough", "en", "b"), (None, None, None, None), (5, " \t\n ", "en", "b"),
        (6, "word", "en", "c"), (7, "two words", "en", "c"), (8, (BASE + ". ") * 400, "en", "c"), (9, "x" * 60_000, "xx", "c"),
        (10, "Grüße aus Köln ▁ marke  zwei   drei vier\n\nfünf 你好世界。\U0001f600", "de", "d"),
        (11, BASE.upper() + "!!", "en", "d"), (12, "under the MIT License. CC-BY-NC 4.0, Apache License, Version 2.0", "en", "d"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ("key", "row", "row_number", "fingerprint", "component_id", "score", "predicted", "kept", "n_words", "entities",
             "ids", "shard", "slot", "h", "t", "size", "labels", "matches", "_fp", "_words", "_found", "_h", "k", "y", "w", "o")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])


def no_documents(spark):
    return hard_documents(spark).where("1 = 0")


def plain(df, *columns):
    """Rows as sorted tuples, NULLs first."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: tuple((x is not None, x) for x in t))
