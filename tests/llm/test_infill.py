"""Fill-in-the-middle: against a version with strings and regular expressions, round trips, hard tables."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradewright.llm import infill
from tests.llm.cases import hard_documents, no_documents

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def naive(key, text):
    """n, form, prefix_chars, middle_chars and the output."""
    text = text or ""
    tokens = TOKEN.findall(text)
    h = sha(f"42:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(h[i: i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    return n, "psm", len(prefix), len(middle), "<P>" + prefix + "<S>" + suffix + "<M>" + middle


def checked(made):
    for r in made.collect():
        want = naive(r["doc_id"], r["text"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["output_sha256"] == sha(want[4]) and r["restored_sha256"] == sha(r["text"] or "")
        assert r["restored"] == (r["text"] or "")


def test_hard_tables(spark):
    docs = hard_documents(spark).withColumn("n", F.lit("theirs")).withColumn("Output", F.lit("theirs"))
    made = infill.restore(infill.transform(docs))
    assert made.count() == docs.count() and {"lang", "source", "key"} <= set(made.columns)
    checked(made)
    assert infill.transform(no_documents(spark)).collect() == []


def test_marks_and_very_long_texts(spark):
    texts = ["a <P> b", "<M>", "< P>a", "<P", "x <S", "<", "M> <", "a" * 3_000_000, "ab é \U0001f600 " * 300_000, " \t" * 500_000, None, ""]
    rows = [(i * 100 + j, t) for j, t in enumerate(texts) for i in range(3)]
    checked(infill.restore(infill.transform(spark.createDataFrame(rows, "doc_id long, text string").repartition(16))))


def test_forms_and_descriptors(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("one two  three\n"), 5).alias("text"))
    made = infill.transform(docs)
    shares = {r["form"]: r["count"] / 2_000 for r in made.groupBy("form").count().collect()}
    assert abs(shares["plain"] - 0.5) < 0.05 and abs(shares["spm"] - 0.4) < 0.05 and abs(shares["psm"] - 0.1) < 0.03
    marks = "".join(infill.MARKS).encode()
    for r in made.limit(50).collect():
        buffers = (r["text"].encode(), marks)
        assert b"".join(infill.stream(buffers, [infill.Piece(*p) for p in r["pieces"]])).decode() == r["output"]
        assert len(r["pieces"]) == (1 if r["form"] == "plain" else 6)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab <>PSM\t\n\x0b\x1cé你\U0001f600 "), max_size=60), st.integers(0, 10_000))
def test_random_texts(text, key):
    body = text.encode()
    form, n, pieces = infill.plan(body, str(key))
    written = b"".join(infill.stream((body, "".join(infill.MARKS).encode()), pieces))
    want = naive(key, text)
    assert (n, form, written.decode()) == (want[0], want[1], want[4])
    assert b"".join(infill.stream((written,), infill.read_back(written, form))) == body


def test_splits():
    whole = [infill.Piece(0, 10, 5)]
    assert infill.split(whole, 0) == [infill.Piece(0, 10, 0), infill.Piece(0, 10, 5)]
    assert infill.split(infill.split(whole, 5), 2) == [infill.Piece(0, 10, 2), infill.Piece(0, 12, 3), infill.Piece(0, 15, 0)]
    with pytest.raises(ValueError):
        infill.split(whole, 6)
