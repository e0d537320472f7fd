"""Packing into few sequences by linear grouping.

What has to be known of a corpus to pack it is how many pieces there are of each
length, and no length is above a sequence's. From those counts alone a plan is made:

1. Large lengths, in descending order, are cut into groups of equal cardinality and
   rounded up to the largest of their group. That leaves a few sizes.
2. Configurations of these sizes that fill a sequence are optimised as a linear
   program; new ones come from a knapsack over its prices. Whole multiples are taken.
3. The actual lengths take the places of their groups in order, so that a
   configuration falls into runs of sequences with equal contents.
4. What is left of the large ones and then the small ones, by descending length, go
   where they fit best, a run of equal sequences at a time.

The plan says for every place in the descending order of all pieces which sequence it
belongs to. Its size depends on the number of lengths, not of documents. A piece's
place is its number among the pieces of its length: counted in its own partition
while that is written, plus the pieces of partitions before. So nothing is sorted,
no task gathers a length, and documents are tokenised once.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gradewright.llm.common import col
from gradewright.session import cut_lineage

LENGTH = 4096
END_ID = 1
#: Pieces above the length divided by the first number are grouped, into as many groups as
#: the second says. The plan of fewest sequences is taken, the first of equal ones. Many groups
#: waste least by rounding, few leave more room that small pieces can fill.
CHOICES = ((4, 8), (4, 16), (4, 64), (8, 16), (8, 64), (2, 16))
TURNS = 2_000  # exchanges of the linear program; stopping early costs sequences, nothing else
CACHE = 1 << 19  # words, twice, and parts of words whose ids a worker keeps
LONG_WORD = 64  # bytes; longer words are not kept
SLICE = 1 << 20  # bytes of a text that are split into words at once
TOKENS = 1 << 20  # tokens handed on at once, about

SPACE = b" \t\n\x0b\x0c\r"
MARK = b"\x01"  # a word that is one id of no other word

# Fixed values of the vocabulary's file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

# Its split for words without white space: of printable ASCII, and of Latin letters and signs whose
# lower case and composition are those of single characters.
ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
LATIN_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
LATIN = regex.compile(r"[\x21-\x7E\u00A1-\u012F\u0131-\u024F]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for a byte: its own if that is printed, else the next of those from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


BYTE_LETTERS = _byte_letters()


# --- the plan ------------------------------------------------------------------


class Plan(NamedTuple):
    """Sequences by place. Segments of places hold equal lengths and follow each
    other without gaps: `first` (place), `sequence` of the first piece, `each` (pieces
    in a sequence) and `base` (offset of the first of them)."""

    starts: np.ndarray  # of each length, the place of its first piece
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    base: np.ndarray
    sequences: int

    def find(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, from their lengths and their numbers among those of the length."""
        place = self.starts[lengths] + numbers
        i = np.searchsorted(self.first, place, side="right") - 1
        k = place - self.first[i]
        return self.sequence[i] + k // self.each[i], self.base[i] + k % self.each[i] * lengths


def groups_of(counts: np.ndarray, least: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, descending, and cardinalities of the groups of all lengths from `least` on.

    Groups have equal cardinality but for the last; those of equal size are one.
    """
    lengths = np.flatnonzero(counts[least:])[::-1] + least
    total = int(counts[lengths].sum())
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begins = np.arange(0, total, -(-total // groups))
    sizes = lengths[np.searchsorted(np.cumsum(counts[lengths]), begins, side="right")]
    fresh = np.flatnonzero(np.diff(sizes, prepend=-1))
    return sizes[fresh], np.diff(begins[fresh], append=total)


def knapsack(sizes: np.ndarray, prices: np.ndarray, length: int) -> np.ndarray:
    """How often to take each size so that the prices add up to most."""
    value = np.zeros(length + 1)
    taken = []
    for size, price in zip(sizes.tolist(), prices.tolist()):
        best, times = value, np.zeros(length + 1, dtype=np.int16)
        if price > 0:
            best = value.copy()
            for t in range(1, length // size + 1):
                more = value[: length + 1 - t * size] + t * price
                gain = more > best[t * size:]
                best[t * size:][gain] = more[gain]
                times[t * size:][gain] = t
        value = best
        taken.append(times)
    made, room = np.zeros(len(sizes), dtype=np.int64), length
    for i in range(len(sizes) - 1, -1, -1):
        made[i] = taken[i][room]
        room -= int(made[i]) * int(sizes[i])
    return made


def configurations(sizes: np.ndarray, needed: np.ndarray, length: int, turns: int = TURNS) -> list[tuple[np.ndarray, int]]:
    """Configurations (how many of each size) and how many sequences of each; they never take more than needed.

    The simplex method over columns made on demand; what remains after taking whole
    multiples are fewer pieces than there are sizes times pieces in a sequence.
    """
    m = len(sizes)
    if not m:
        return []
    basis = np.diag((length // sizes).astype(float))
    for _ in range(turns):
        fresh = knapsack(sizes, np.linalg.solve(basis.T, np.ones(m)), length)
        if np.linalg.solve(basis.T, np.ones(m)) @ fresh <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, fresh)
        amounts = np.maximum(np.linalg.solve(basis, needed.astype(float)), 0)
        ratios = np.divide(amounts, step, out=np.full(m, np.inf), where=step > 1e-9)
        leaving = int(ratios.argmin())
        if not np.isfinite(ratios[leaving]):
            break
        basis[:, leaving] = fresh
    amounts = np.linalg.solve(basis, needed.astype(float))
    left, out = needed.copy(), []
    for p in np.argsort(-amounts, kind="stable"):
        config = np.rint(basis[:, p]).astype(np.int64)
        some = config > 0
        times = min(int(np.floor(max(amounts[p], 0) + 1e-6)), int((left[some] // config[some]).min()))
        if times > 0:
            left -= config * times
            out.append((config, times))
    return out


class _Sequences:
    """Runs of sequences with equal contents, and the segments placed in them."""

    def __init__(self, length: int):
        self.length, self.next = length, 0
        self.segments: list[tuple[int, int, int, int]] = []  # first place, sequence, each, base
        self.free: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, number)
        self.rooms: list[int] = []

    def open(self, n: int) -> int:
        self.next += n
        return self.next - n

    def leave(self, room: int, first: int, n: int) -> None:
        if not n or not room:
            return
        if room not in self.free:
            self.free[room] = []
            bisect.insort(self.rooms, room)
        self.free[room].append((first, n))

    def put(self, size: int, place: int, n: int) -> None:
        """n pieces of a size, from a place on, where they fit best."""
        while n:
            i = bisect.bisect_left(self.rooms, size)
            if i == len(self.rooms):
                room, first, count = self.length, None, -(-n // (self.length // size))
                first = self.open(count)
            else:
                room = self.rooms[i]
                first, count = self.free[room].pop()
                if not self.free[room]:
                    del self.free[room], self.rooms[i]
            each = room // size
            whole = min(count, n // each)
            if whole:
                self.segments.append((place, first, each, self.length - room))
                self.leave(room - each * size, first, whole)
                place, n = place + whole * each, n - whole * each
                first, count = first + whole, count - whole
            if n and count:  # fewer than a sequence takes
                self.segments.append((place, first, n, self.length - room))
                self.leave(room - n * size, first, 1)
                place, n, first, count = place + n, 0, first + 1, count - 1
            self.leave(room, first, count)


def make_plan(counts: np.ndarray, length: int = LENGTH, choices: tuple[tuple[int, int], ...] = CHOICES) -> Plan:
    """The best of the plans for so many pieces of each length (counts[0] is not used)."""
    least = -(-int(np.asarray(counts, dtype=np.int64)[1:] @ np.arange(1, length + 1)) // length)
    best = None
    for large, groups in choices:
        made = grouped_plan(counts, length, large, groups)
        if best is None or made.sequences < best.sequences:
            best = made
        if best.sequences == least:
            break
    return best


def grouped_plan(counts: np.ndarray, length: int, large: int, groups: int) -> Plan:
    """The plan with one choice of what is large and how many groups there are."""
    counts = np.asarray(counts, dtype=np.int64)
    descending = np.flatnonzero(counts[1:])[::-1] + 1
    ends = np.cumsum(counts[descending])
    starts = np.zeros(length + 1, dtype=np.int64)
    starts[descending] = ends - counts[descending]
    made = _Sequences(length)
    sizes, needed = groups_of(counts, length // large + 1, groups)
    taken = np.cumsum(needed) - needed  # the next place of each group
    stops = np.cumsum(needed)

    def size_at(place: int) -> tuple[int, int]:
        """The length at a place and the place where it ends."""
        i = int(np.searchsorted(ends, place, side="right"))
        return int(descending[i]), int(ends[i])

    for config, times in configurations(sizes, needed, length):
        at = []  # the next place of each slot
        for g in np.flatnonzero(config):
            at += [int(taken[g]) + k * times for k in range(config[g])]
            taken[g] += config[g] * times
        left = times
        while left:
            own = [size_at(place) for place in at]
            run = min(left, *[end - place for (_, end), place in zip(own, at)])
            first, base = made.open(run), 0
            for j, (size, _) in enumerate(own):
                made.segments.append((at[j], first, 1, base))
                base += size
                at[j] += run
            made.leave(length - base, first, run)
            left -= run
    rest = []
    for a, b in zip(taken.tolist(), stops.tolist()):
        while a < b:
            size, end = size_at(a)
            rest.append((size, a, min(b, end) - a))
            a = min(b, end)
    grouped = int(stops[-1]) if len(stops) else 0
    for size, end in zip(descending.tolist(), ends.tolist()):
        if end > grouped:
            rest.append((size, int(starts[size]), end - int(starts[size])))
    for size, place, n in rest:
        made.put(size, place, n)
    segments = np.array(sorted(made.segments), dtype=np.int64).reshape(-1, 4)
    return Plan(starts, *segments.T, made.next)


# --- tokens --------------------------------------------------------------------


class WordTokenizer:
    """Ids of a lower-casing byte-level vocabulary with word ends, whose pieces never cross white space.

    The text is split at ASCII white space, and a word's ids are kept for the next
    time it comes. New words in Latin letters are cut into parts as the vocabulary's
    own split does it, parts are kept as well, and only new parts go to the library's
    model, many at once: each part's last id is one that ends a word. All other words go
    through the whole library, many at once with a mark between them. `check` tells
    whether the file is one that this holds for.
    """

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(vocabulary)
        (self.mark,) = self.library.encode(MARK.decode(), add_special_tokens=False).ids
        self.model = tokenizers.Tokenizer(self.library.model)
        self.model.pre_tokenizer = tokenizers.pre_tokenizers.CharDelimiterSplit(" ")
        names = self.library.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, dtype=bool)
        self.last[[i for name, i in names.items() if name.endswith(WORD_END)]] = True
        self.kept: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}  # what was kept before; goes when the next is full
        self.parts: dict[str, bytes] = {}
        self.check(vocabulary)

    def check(self, vocabulary: str) -> None:
        import json

        with open(vocabulary, encoding="utf-8") as file:
            made = json.load(file)
        kinds = [n["type"] for n in made["normalizer"]["normalizers"]], [n["type"] for n in made["pre_tokenizer"]["pretokenizers"]]
        split = made["pre_tokenizer"]["pretokenizers"][0].get("pattern", {}).get("Regex")
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or split != SPLIT or made["model"]["end_of_word_suffix"] != WORD_END:
            raise ValueError(f"{vocabulary} does not normalise or split words as expected")

    def of_parts(self, parts: list[str]) -> Iterator[bytes]:
        text = " ".join([p.encode().decode("latin-1").translate(BYTE_LETTERS) for p in parts])
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        raw = ids.tobytes()
        return (raw[a:b] for _, a, b in zip(parts, [0, *ends], ends, strict=False))

    def of_marked(self, words: list[bytes]) -> Iterator[bytes]:
        text = (b" %s " % MARK).join(words).decode("utf-8", "replace")
        ids = np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        ends = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
        raw = ids.tobytes()
        return (raw[4 * a: 4 * b] for a, b in zip([0, *[e + 1 for e in ends]], ends))

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words."""
        cut, others, made = {}, [], {}
        for word in words:
            text = word.decode("utf-8", "replace")
            if "<|" in text:  # may be an added token
                others.append(word)
            elif text.isascii():
                if text.isprintable():
                    cut[word] = ASCII_PARTS.findall(text.lower())
                else:
                    others.append(word)
            elif LATIN.fullmatch(text):
                cut[word] = LATIN_PARTS.findall(text.lower())
            else:
                others.append(word)
        if len(self.parts) > CACHE:
            self.parts = {}
        fresh = list({p for found in cut.values() for p in found if p not in self.parts})
        new = dict(zip(fresh, self.of_parts(fresh), strict=True)) if fresh else {}
        self.parts.update((p, ids) for p, ids in new.items() if len(p) <= LONG_WORD)
        for word, found in cut.items():
            made[word] = b"".join([new[p] if p in new else self.parts[p] for p in found])
        marked = [w for w in others if MARK not in w]
        if marked:
            made.update(zip(marked, self.of_marked(marked), strict=True))
        for word in others:
            if MARK in word:
                ids = self.library.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
                made[word] = np.array(ids, dtype="<u4").tobytes()
        return made

    def of_words(self, words: list[bytes]) -> bytes:
        found = list(map(self.kept.get, words))
        if None in found:
            fresh = {w for w, ids in zip(words, found) if ids is None}
            made = {w: self.old[w] for w in fresh if w in self.old}
            made |= self.learn([w for w in fresh if w not in made])
            self.kept.update((w, ids) for w, ids in made.items() if len(w) <= LONG_WORD)
            if len(self.kept) > CACHE:
                self.old, self.kept = self.kept, {}
            found = [made[w] if ids is None else ids for w, ids in zip(words, found)]
        return b"".join(found)

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a text in UTF-8."""
        if len(text) <= SLICE:
            return self.of_words(text.split())
        out, a = [], 0
        while a < len(text):
            b = a + SLICE
            while b < len(text) and text[b] not in SPACE:
                b += 1
            out.append(self.of_words(text[a:b].split()))
            a = b
        return b"".join(out)


@functools.lru_cache(maxsize=1)
def tokenizer_of(vocabulary: str) -> WordTokenizer:
    """One for all tasks of a worker, so that words are learned once."""
    return WordTokenizer(vocabulary)


def pieces_of(docs: DataFrame, vocabulary: str, key: str, text: str, length: int, with_ids: bool) -> DataFrame:
    """Pieces with their partition and their number among the partition's pieces of the same length; a written table."""
    longs = ("start", "length", "doc_tokens", "ids_crc32", "part", "number")
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("piece", T.IntegerType()),
                           *[T.StructField(c, T.LongType()) for c in longs], *[T.StructField("ids", T.BinaryType())] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(vocabulary)
        end = np.array([END_ID], dtype="<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(length + 1, dtype=np.int64).tolist()

        def batch(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            at, piece, *rest = zip(*rows)
            types = [pa.int64()] * len(longs) + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(c, t) for c, t in zip(rest, types)]], names=schema.names)

        for b in batches:
            keys, rows, held = b.column(0), [], 0
            for i, body in enumerate(b.column(1)):
                ids = tokenizer.encode(body.as_py()) + end
                n = len(ids) // 4
                for p, start in enumerate(range(0, n, length)):
                    own = ids[4 * start: 4 * (start + length)]
                    size = len(own) // 4
                    rows.append((i, p, start, size, n, zlib.crc32(own), part, seen[size], *[own] * with_ids))
                    seen[size] += 1
                held += n
                if held >= TOKENS:
                    yield batch(keys, rows)
                    rows, held = [], 0
            if rows:
                yield batch(keys, rows)

    body = F.coalesce(col(text), F.lit("")).cast("binary").alias("text")
    return cut_lineage(docs.select(col(key).alias("doc_id"), body).mapInArrow(run, schema))


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = LENGTH,
         choices: tuple[tuple[int, int], ...] = CHOICES, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences of at most `length` tokens.

    Returns doc_id (the key, of any type, repeated or NULL ones too), piece, start,
    length, doc_tokens, ids_crc32, sequence_id (from 0 without gaps), offset and,
    unless switched off, ids (little-endian unsigned 32-bit numbers). Each document's
    ids end with END_ID; a NULL or empty text has that id alone. Only longer documents
    are cut, and only their last piece is shorter than a sequence. Other columns are not
    read.
    """
    pieces = pieces_of(docs, vocabulary, key, text, length, with_ids)
    # At most so many rows as the partition has pieces, and as there are lengths.
    counts = cut_lineage(pieces.groupBy("part", col("length").alias("size")).agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(length + 1, dtype=np.int64)
    for size, n in counts.groupBy("size").agg(F.sum("n")).collect():  # a row per length
        histogram[size] = n
    plan = make_plan(histogram, length, choices)
    through = F.sum("n").over(Window.partitionBy("size").orderBy("part"))
    before = counts.select(col("part").alias("of"), "size", (through - col("n")).alias("before"))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def find(sizes: pa.Array, numbers: pa.Array) -> pa.Array:
        sequence, offset = plan.find(sizes.to_numpy(zero_copy_only=False), numbers.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["sequence_id", "offset"])

    joined = pieces.join(before, (col("part") == col("of")) & (col("length") == col("size")))
    placed = joined.withColumn("found", find("length", col("before") + col("number")))
    return placed.select("doc_id", "piece", "start", "length", "doc_tokens", "ids_crc32",
                         col("found")["sequence_id"].alias("sequence_id"), col("found")["offset"].alias("offset"), *["ids"] * with_ids)
