"""SentencePiece encoding and decoding through a table of distinct marked words.

In the vocabularies handled here no piece has a whitespace marker after another
character, so no merge crosses the border before a marker, and a text's ids are
those of its marked words in turn. Each task keeps a table of the marked words
it has met; a new one is segmented once by the library, all others are joined
back by position. The table is emptied when full, so memory is bounded and no
row leaves its partition: joining words back through a shuffle would move every
word of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewright.llm.common import col, without

TABLE_WORDS = 150_000  # entries of a task's table
LONG_WORD = 64  # longer ones are segmented each time, not kept


class Segmenter:
    """Ids and texts by distinct marked words."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any("▁" in p.lstrip("▁") for p in pieces) or self.model.encode("a  b", out_type=str)[0] != "▁a":
            raise ValueError("pieces of this model cross whitespace markers")
        # Alone at the end of a text, a marker has no word to stand before.
        self.table: dict[str, bytes] = {}
        self.bare = self._bytes([self.model.piece_to_id("▁")])

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        import numpy as np

        return np.array(ids, dtype="<i4").tobytes()

    @staticmethod
    def marked_words(text: str) -> list[str]:
        """The text's marked words, each without its first marker."""
        import re

        whole = " " + text.replace("▁", " ")
        if "  " in whole or whole.endswith(" "):
            return [w[1:] for w in re.findall(" +[^ ]*", whole)]
        return whole.split(" ")[1:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.marked_words(t) if t else [] for t in texts]
        table = self.table
        if len(table) > TABLE_WORDS:
            table.clear()
        table[""] = self.bare
        new = {w for words in split for w in words if w not in table}
        long = {w for w in new if len(w) > LONG_WORD}
        new = list(new)
        table.update(zip(new, map(self._bytes, self.model.encode(new, num_threads=1))))
        made = [b"".join([table[w] for w in words]) for words in split]
        for w in long:
            del table[w]
        return made


def encode(docs: DataFrame, model: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """Add `ids` (array of int) and, if asked for, `decoded`, the ids' text.

    NULL and empty texts have no ids and decode to ''. Repeated rows are treated
    alike; input columns called `ids` or `decoded` give way.
    """
    docs = without(docs, "ids", "decoded")
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))

    @F.arrow_udf(T.StructType(fields))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        segmenter = Segmenter(model)
        for texts in batches:
            for group in bounded_groups(texts):
                parts = segmenter.encode(group)
                ends = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int64)
                ids = pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
                arrays, names = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], ["ids"]
                if decoded:
                    back = segmenter.model.decode([np.frombuffer(p, "<i4").tolist() for p in parts], num_threads=1)
                    arrays.append(pa.array(back, pa.string()))
                    names.append("decoded")
                yield pa.StructArray.from_arrays(arrays, names=names)

    made = run(F.coalesce(col(text), F.lit("")))
    return docs.select("*", F.inline(F.array(made)))


def bounded_groups(texts: pa.Array, chars: int = 1_000_000) -> Iterator[list[str]]:
    """Texts of a batch in groups of about so many characters; one text may be longer."""
    group, size = [], 0
    for x in texts:
        t = x.as_py() or ""
        group.append(t)
        size += len(t)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group
