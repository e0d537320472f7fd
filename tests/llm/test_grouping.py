"""Packing by linear grouping: ids against the library, the plan by its laws and against all packings of small inputs."""

import collections
import functools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradewright.llm import grouping
from tests.llm.cases import BASE, hard_documents, no_documents

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(VOCABULARY)


def wanted_ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, grouping.END_ID]


def sound(plan, counts, length):
    """Every piece in one sequence, offsets without gaps, no sequence too long, every sequence used."""
    lengths = np.repeat(np.arange(length + 1), counts)
    numbers = np.concatenate([np.arange(n) for n in counts]) if lengths.size else np.empty(0, np.int64)
    sequence, offset = plan.find(lengths, numbers)
    order = np.lexsort((offset, sequence))
    sequence, offset, lengths = sequence[order], offset[order], lengths[order]
    begins = np.diff(sequence, prepend=-1) > 0
    assert (offset[begins] == 0).all() and (offset[1:] == (offset + lengths)[:-1])[~begins[1:]].all()
    assert (offset + lengths <= length).all()
    assert np.unique(sequence).tolist() == list(range(plan.sequences))
    return plan.sequences


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300), st.sampled_from([(2, 4), (4, 1), (4, 8), (8, 16), (16, 64)]))
def test_plans(lengths, choice):
    counts = np.bincount(lengths, minlength=65)
    made = sound(grouping.grouped_plan(counts, 64, *choice), counts, 64)
    assert made >= -(-sum(lengths) // 64)
    best = sound(grouping.make_plan(counts, 64, (choice, (4, 16))), counts, 64)
    assert best <= made


def fewest(lengths, room):
    """The fewest sequences, by trying all packings."""
    lengths = tuple(sorted(lengths, reverse=True))

    @functools.cache
    def more(i, rooms):
        if i == len(lengths):
            return 0
        found = [1 + more(i + 1, tuple(sorted((*rooms, room - lengths[i]))))]
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                found.append(more(i + 1, tuple(sorted((*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1:])))))
        return min(found)

    return more(0, ())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_close_to_the_fewest(lengths):
    counts = np.bincount(lengths, minlength=21)
    assert grouping.make_plan(counts, 20).sequences <= fewest(lengths, 20) + 1


@pytest.mark.parametrize("low, high, waste", [(1, 4096, 0.01), (520, 1500, 0.01), (1000, 3000, 0.015), (10, 600, 0.001)])
def test_little_padding(low, high, waste):
    counts = np.bincount(np.random.default_rng(low).integers(low, high, 100_000), minlength=4097)
    least = -(-int(counts @ np.arange(4097)) // 4096)
    assert sound(grouping.make_plan(counts), counts, 4096) <= (1 + waste) * least


def test_any_number_of_pieces():
    counts = np.zeros(4097, dtype=np.int64)
    counts[[7, 300, 1365, 1366, 2048, 4000, 4096]] = [10**11, 10**10, 3 * 10**10, 10**10 + 1, 10**9, 5, 10**10]
    plan = grouping.make_plan(counts)
    assert len(plan.first) < 200 and (np.diff(plan.first) > 0).all()
    total = int(counts @ np.arange(4097))
    assert plan.sequences * 4096 >= total and plan.sequences * 4096 < 1.2 * total
    assert grouping.make_plan(np.zeros(4097, dtype=np.int64)).sequences == 0


def test_configurations_are_optimal():
    # Three sizes of which the best mix fills every sequence.
    sizes, needed = np.array([50, 30, 20]), np.array([100, 100, 100])
    made = grouping.configurations(sizes, needed, 100)
    assert all(c @ sizes <= 100 for c, _ in made) and sum(t for _, t in made) == 100
    assert (sum(c * t for c, t in made) == needed).all()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aAbΣsé'’́̀\x01\x1c\xa0 \t\n\x0b0½你。<|startoftext|>\U0001f600İ"), max_size=80)
       | st.text(st.characters(max_codepoint=0x250), max_size=60) | st.text("a'sREve7²ßÄñǅ.,!", max_size=60))
def test_ids_are_those_of_the_library(text):
    made = grouping.tokenizer_of(VOCABULARY).encode(text.encode())
    assert np.frombuffer(made, "<u4").tolist() == wanted_ids(text)[:-1]


def test_words_come_back_after_the_table_turned(monkeypatch):
    monkeypatch.setattr(grouping, "CACHE", 5)
    monkeypatch.setattr(grouping, "SLICE", 64)
    own = grouping.WordTokenizer(VOCABULARY)
    every = "".join(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]))
    assert np.frombuffer(own.encode(every.encode()), "<u4").tolist() == wanted_ids(every)[:-1]
    text = " ".join(f"word{i % 23} other{i % 7}!" for i in range(300)) + "x" * 500 + " end"
    for _ in range(2):
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == wanted_ids(text)[:-1]


def checked(made, docs, length):
    rows = made.collect()
    texts = collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r[0]].append(wanted_ids(r[1]))
    left = collections.Counter()
    for key, all_ids in texts.items():
        for ids in all_ids:
            for p, start in enumerate(range(0, len(ids), length)):
                own = np.array(ids[start: start + length], dtype="<u4").tobytes()
                left[key, p, start, len(own) // 4, len(ids), zlib.crc32(own), own] += 1
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["doc_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in rows)
    assert got == left
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    assert sorted(by) == list(range(len(by)))
    return len(by), sum(r["length"] for r in rows)


def test_pack(spark):
    docs = hard_documents(spark)
    checked(grouping.pack(docs, VOCABULARY, length=64), docs, 64)
    # One length in most rows, over several partitions.
    rows = [(i, BASE) for i in range(600)] + [(1_000 + i, "a b c " * (i % 50)) for i in range(300)] + [(5_000, BASE * 300)]
    many = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("theirs")).repartition(7)
    n, tokens = checked(grouping.pack(many, VOCABULARY, length=128), many, 128)
    assert n <= 1.06 * tokens / 128
    none = grouping.pack(no_documents(spark), VOCABULARY)
    assert none.collect() == [] and "ids" not in grouping.pack(docs, VOCABULARY, with_ids=False).columns
