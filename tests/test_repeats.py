import random
import re

import pytest

from gradewright.functions.repeats import has_cube, has_cubes, repeated_block, repeated_blocks

ANY = re.compile(r"(.{10,}?)\1{2,}", re.DOTALL)
LINE = re.compile(r"(.{10,})\1{2,}")


@pytest.mark.parametrize("text, anywhere, in_line", [
    ("0123456789" * 3, True, True),
    ("0123456789" * 2, False, False),
    ("01234\n6789" * 3, True, False),
    ("a" * 30, True, True),
    ("a" * 29, False, False),
    ("", False, False),
    ("漢字仮名交文字列と😀" * 4, True, True),
])
def test_cases(text, anywhere, in_line):
    assert has_cube(text) is anywhere
    assert has_cube(text, across_lines=False) is in_line


def test_random_texts_against_the_pattern():
    rng = random.Random(5)
    hits = 0
    for i in range(4000):
        block = "".join(rng.choice("ab\n") for _ in range(rng.randint(5, 15)))
        noise = ["".join(rng.choice("ab\n") for _ in range(rng.randint(0, 25))) for _ in range(2)]
        text = noise[0] + block * rng.randint(1, 4) + noise[1]
        assert has_cube(text) == bool(ANY.search(text)), text
        assert has_cube(text, across_lines=False) == bool(LINE.search(text)), text
        assert has_cubes(text) == (bool(ANY.search(text)), bool(LINE.search(text))), text
        hits += bool(ANY.search(text))
    assert 500 < hits < 3900


def test_long_text_stays_fast():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    assert not has_cube(text)
    middle = text[:60_000]
    assert has_cube(text + middle * 3)


def test_column_keeps_nulls(spark):
    df = spark.createDataFrame([(0, "0123456789" * 3), (1, None), (2, "x")], "i int, t string")
    rows = df.orderBy("i").select(repeated_block("t").alias("r")).collect()
    assert [r.r for r in rows] == [True, None, False]


def test_both_forms_in_one_column(spark):
    df = spark.createDataFrame([(0, "0123456789" * 3), (1, None), (2, "01234\n6789" * 3)], "i int, t string")
    rows = df.orderBy("i").select(repeated_blocks("t").alias("r")).collect()
    assert [tuple(r.r) for r in rows] == [(True, True), (None, None), (True, False)]


def test_memory_of_a_long_text():
    import tracemalloc

    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh ") for _ in range(500_000))
    tracemalloc.start()
    assert has_cubes(text) == (False, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(text)
