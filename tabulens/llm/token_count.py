"""Token counts by a Viterbi search that keeps counts only.

An Aho-Corasick automaton enumerates the vocabulary's matches in a unit of text; dynamic
programming carries, for each end, the best score and its number of pieces. No segmentation is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import vocabulary
from .common import small_batches
from .vocabulary import SPACE, Vocabulary

#: Units whose counts a task remembers; it starts anew beyond that.
REMEMBERED = 400_000


class Counter(dict):
    """Unit of text -> number of its pieces, found when it is first asked for."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, (_, score) in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown, self.bytes = vocabulary.unknown_score, bool(vocabulary.byte_ids)
        self.split = regex.compile(vocabulary.units).findall

    def __missing__(self, unit: str) -> int:
        n = self.pieces(unit)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(unit) <= 64:
            self[unit] = n
        return n

    def pieces(self, unit: str) -> int:
        """Matches come by end, longest first, that is by start: of equal scores the earliest start
        stays, as in the tokenizer. A character that is no piece itself is unknown and counts a
        piece for each of its bytes, if there are byte pieces."""
        best, count = [0.0] + [None] * len(unit), [0] * (len(unit) + 1)
        at, single = 0, True

        def close(end: int) -> None:  # all matches that end there have been seen
            if not single and best[end - 1] is not None:
                score = best[end - 1] + self.unknown
                if best[end] is None or score > best[end]:
                    best[end] = score
                    count[end] = count[end - 1] + (len(unit[end - 1].encode()) if self.bytes else 1)

        for last, (length, score) in self.automaton.iter(unit):
            while at <= last:
                if at:
                    close(at)
                at, single = at + 1, False
            start = at - length
            total = best[start] + score
            single |= length == 1
            if best[at] is None or total > best[at]:
                best[at], count[at] = total, count[start] + 1
        while at < len(unit):
            if at:
                close(at)
            at, single = at + 1, False
        close(at)
        return count[-1]

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.split(SPACE + text.replace(" ", SPACE))))


def token_counts(docs: DataFrame, path: str = vocabulary.DEFAULT_PATH) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_chars, n_bytes, n_tokens.

    Whole texts are counted; null and empty texts have no tokens. A text is cut where no piece can
    reach across, and scores are summed within such a unit, so that long texts lose no precision.
    Rows that share a doc_id are counted each by itself. An empty table gives an empty result;
    other columns are ignored.
    """
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary.load(path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(known.value)
        for b in batches:
            texts = [x.as_py() or "" for x in b.column(1)]
            sizes = np.array([(len(t), len(t.encode()), counter.of(t)) for t in texts], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, sizes.T)], ["doc_id", "n_chars", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars long, n_bytes long, n_tokens long")
