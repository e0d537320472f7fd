"""Packing by order-preserving dynamic programming.

Sequences are windows over the stream of documents in their stored order. Cuts
may fall at document ends, at sentence ends and, inside sentences longer than a
window, at fixed steps. The cheapest set of cuts by padding plus a penalty for
each cut inside a document is found exactly: the best earlier cut for a window
end is a sliding minimum, kept in a monotone queue, so a block takes linear time.

A partition is packed as it streams by, in blocks; a block's last window stays
open and starts the next block, so only a partition's last sequence is left
short. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewright.llm.common import col

LENGTH = 2048
END_ID = 1
SENTENCE_PENALTY = 24  # a cut at a sentence end costs as much as so much padding
INNER_PENALTY = 96  # a cut inside a sentence
STEP = 128  # where no sentence ends for a window's length, cuts may fall so far apart
BLOCK = 1 << 19  # tokens packed at once
ROWS = 1_000  # pieces handed on at once, about


def best_cuts(at: list[int], penalty: list[int], length: int) -> list[int]:
    """Indices of the cheapest cuts, first and last included.

    `at` ascends from 0 in steps of at most `length`. A window costs its padding,
    a cut its penalty; of equal choices the longer window is taken.
    """
    n = len(at)
    cost, back = [0] * n, [0] * n
    queue, head = [0], 0  # candidates, costs ascending
    key = [0] * n  # cost plus place: what a window start adds to any window end
    for j in range(1, n):
        place = at[j]
        while at[queue[head]] < place - length:
            head += 1
        best = queue[head]
        back[j] = best
        cost[j] = key[best] + length - place + penalty[j]
        own = key[j] = cost[j] + place
        while len(queue) > head and key[queue[-1]] > own:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, closes: np.ndarray, opens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, and what each cut costs.

    ends: the documents' ends. closes, opens: of each id, whether it can close a
    sentence, and whether one can start with it.
    """
    after = np.zeros(len(ids) + 1, dtype=bool)
    after[1:-1] = closes[ids[:-1]] & opens[ids[1:]]
    after[0] = after[-1] = True
    after[ends] = True
    at = np.flatnonzero(after)
    wide = np.flatnonzero(np.diff(at) > length // 2)
    if len(wide):
        step = min(STEP, max(1, length // 4))
        inner = np.concatenate([np.arange(at[w] + step, at[w + 1], step) for w in wide])
        at = np.union1d(at, inner)
    penalty = np.where(after[at], SENTENCE_PENALTY, INNER_PENALTY)
    penalty[np.isin(at, ends)] = 0
    penalty[0] = penalty[-1] = 0
    return at, penalty


class Packer:
    """Packs a stream of token arrays; sequences are numbered from `first` on."""

    def __init__(self, closes: np.ndarray, opens: np.ndarray, first: int, length: int = LENGTH):
        self.closes, self.opens, self.next, self.length = closes, opens, first, length
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # key, tokens, tokens that have been packed
        self.size = 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        self.ids.append(ids)
        self.docs.append((key, len(ids), 0))
        self.size += len(ids)
        if self.size >= BLOCK:
            yield from self.flush(last=False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        """Pieces: key, start, length, doc_tokens, sequence_id, offset, ids."""
        if not self.size:
            return
        ids = np.concatenate(self.ids)
        left = np.array([n - done for _, n, done in self.docs], dtype=np.int64)
        ends = np.cumsum(left)
        at, penalty = candidates(ids, ends, self.closes, self.opens, self.length)
        cuts = at[best_cuts(at.tolist(), penalty.tolist(), self.length)]
        if not last:
            cuts = cuts[:-1]
        stop = int(cuts[-1])
        bounds = np.union1d(cuts, np.concatenate(([0], ends[ends < stop])))
        doc = np.searchsorted(ends, bounds[:-1], side="right")
        window = np.searchsorted(cuts, bounds[:-1], side="right") - 1
        raw = ids.astype("<u4", copy=False)
        for a, b, d, w in zip(bounds[:-1].tolist(), bounds[1:].tolist(), doc.tolist(), window.tolist()):
            key, n, done = self.docs[d]
            start = a - int(ends[d] - left[d]) + done
            yield key, start, b - a, n, self.next + w, a - int(cuts[w]), raw[a:b].tobytes()
        self.next += len(cuts) - 1
        d = int(np.searchsorted(ends, stop, side="right"))
        self.docs = self.docs[d:]
        if self.docs:
            key, n, done = self.docs[0]
            self.docs[0] = (key, n, done + stop - int(ends[d] - left[d]))
        self.ids = [ids[stop:].copy()]
        self.size = len(ids) - stop


class Tokenizer:
    """Ids of a byte-level BPE vocabulary.

    Its ranks are applied by the faster of two libraries; a text that one cannot
    split (its pattern backtracks too far in very long white space) goes to the
    other, and so does one that holds the string of an added token, which is one
    id. Both give the same ids.
    """

    # The vocabulary's split of a text before merging, with possessive repeats.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

    def __init__(self, vocabulary: str, ranks: str):
        import base64
        import json

        import tiktoken

        with open(ranks, "rb") as file:
            self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.vocabulary, self.whole = vocabulary, None
        with open(vocabulary, encoding="utf-8") as file:
            self.added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}

    def encode(self, text: str) -> np.ndarray:
        if any(token in text for token in self.added):
            return self.encode_whole(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            return self.encode_whole(text)

    def encode_whole(self, text: str) -> np.ndarray:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        if self.whole is None:
            self.whole = tokenizers.Tokenizer.from_file(self.vocabulary)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def sentence_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each id, whether it can close a sentence and whether one can start with it."""
        n = max(*self.ranks.values(), *self.added.values(), END_ID) + 1
        closes, opens = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        for piece, i in self.ranks.items():
            text = piece.decode("utf-8", "replace")
            closes[i] = text.rstrip("\"')»”").endswith((".", "!", "?", "。", "！", "？", "\n"))
            opens[i] = text[:1].isspace()
        return closes, opens


def pack(docs: DataFrame, vocabulary: str, ranks: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces of documents in sequences of at most `length` tokens.

    Returns the key (of any type, repeated or NULL keys too), start, length,
    doc_tokens, sequence_id, offset (long) and ids (little-endian unsigned 32-bit
    numbers). Each document's ids end with END_ID; a NULL or empty text has that id
    alone. Each id lies in one piece. Sequence ids are unique, not gapless: the
    partition's number and a count. Other columns are not read.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")],
        T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(vocabulary, ranks)
        packer = Packer(*tokenizer.sentence_ids(), TaskContext.get().partitionId() << 33, length)
        out, key_type = [], None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [key_type, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        for b in batches:
            key_type = b.schema.field(0).type
            for key, text in zip(b.column(0), b.column(1)):
                ids = np.append(tokenizer.encode(text.as_py()), np.uint32(END_ID))
                out += packer.add(key.as_py(), ids)
                if len(out) >= ROWS:
                    yield batch(out)
                    out = []
        out += packer.flush()
        if out:
            yield batch(out)

    return docs.select(col(key).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text")).mapInArrow(run, schema)
