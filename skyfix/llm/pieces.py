"""SentencePiece encoding and decoding through a table of distinct marked words.

In a model whose pieces never hold a white-space marker behind another character, no
merge can cross the place where a marker follows a word. A text then splits there into
chunks (markers, then the word), and the segmentation of a text is the segmentation of
its chunks, one after another. Each task keeps a bounded table of the distinct chunks it
has met, segments each of them once with the library, and joins the ids back by position
with one vectorised gather. The table lives in the task, not in a shuffle: as a global
Spark join every word of the corpus would be shuffled twice, several times the input.

Defined results: a null text is the empty text; the empty text has no ids and decodes to
the empty text; rows with equal or null ids stay separate rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import columns, sliced

#: Entries after which a task starts its chunk table anew: about 40 MB of Python objects.
TABLE_ENTRIES = 150_000
#: Texts encoded at a time, by characters, so that one batch of long texts stays small.
GROUP_CHARS = 400_000
CHUNK = re.compile("▁+[^▁]*")


class _Numbers(dict):
    """Numbers new keys 0, 1, 2, ... as they are looked up."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class ChunkTable:
    """Distinct chunks, each segmented once."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.marker = self.model.piece_to_id("▁")
        # The whole text goes to the library where a piece, or normalisation, could cross chunks.
        self.splits = (
            not any("▁" in p.lstrip("▁") for p in pieces)
            and self.model.encode("a  ﬁ ", out_type=str)[-1] == "▁"
            and self.model.decode(self.model.encode("  ﬁ ")) == "  ﬁ "
        )
        self.clear()

    def clear(self) -> None:
        self.number, self.start, self.count = _Numbers(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _segment_new(self) -> None:
        done = len(self.start)
        new = list(self.number)[done:] if done else list(self.number)
        if not new:
            return
        # The library puts one marker before a text, so the chunk is passed without its first.
        ids = self.model.encode([c[1:] for c in new], num_threads=1)
        ids = [x or [self.marker] for x in ids]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        begin = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int32, int(count.sum()))])
        self.start, self.count = np.concatenate([self.start, begin]), np.concatenate([self.count, count])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in a row, and the number of ids of each text."""
        if not self.splits:
            ids = self.model.encode(texts, num_threads=1)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum())), sizes
        if len(self.number) > TABLE_ENTRIES:
            self.clear()
        find, look = CHUNK.findall, self.number.__getitem__
        chunks = [find("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
        held = np.fromiter(map(len, chunks), np.int64, len(chunks))
        at = np.fromiter((look(c) for x in chunks for c in x), np.int64, int(held.sum()))
        self._segment_new()
        count = self.count[at]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[at] - ends + count, count) + np.arange(total)]
        cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(held)])]
        return ids, np.diff(cut)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` and, if asked for, ``decoded``: the library's decode of the ids."""
    rows = columns(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_file)
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _groups(texts):
                ids, sizes = table.encode(texts[a:b])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                out = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    flat = ids.tolist()
                    out.append(pa.array(table.model.decode([flat[x:y] for x, y in zip(ends[:-1], ends[1:])], num_threads=1), pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "ids", "decoded"][: len(out)])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(df: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` from lists of ids; a null list is the empty one."""
    rows = columns(df, doc_id=id_col, ids=ids_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ChunkTable(model_file).model
        for batch in batches:
            texts = model.decode([x or [] for x in batch.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")
