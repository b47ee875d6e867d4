"""Alignment of two tokenizers' tokens over a corpus, by id-striped dense count matrices.

Both tokenizers read each text; tokens whose bytes overlap are linked. Links are dealt by the id of
the first side into stripes. A stripe's counts are a dense block, ids of its own by all ids of the
other side, into which the pairs of each part of the corpus are added; the greatest of a row is the
best of an id. Links meet the finished block of their stripe, and their scores go back to their texts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut, discard, gather, read_file

FOLDER = os.environ.get("TABULENS_TOKENIZERS", "/opt/tokenizers")
A_PATH, B_PATH = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Stripes of ids; bytes of text that a batch holds (or one text); distinct units that are encoded as one text.
STRIPES, BYTES, RUN = 128, 2 << 20, 256
#: Pairs that a task adds up before it sends them on; rows that are added into one block, and batches that one block scores, at most or so.
PAIRS, ROWS = 1 << 21, 128
#: A space between two characters that are none: both tokenizers part a text there.
PLACE = re.compile(r"(?<=\S) (?=\S)")


def pack(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the greatest needs, compressed byte by byte, as the high ones repeat."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or x.max() <= np.iinfo(t).max)
    data = np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T)
    return bytes([data.shape[0] if len(x) else 1]) + zstandard.ZstdCompressor(level=1).compress(data.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"u{data[0]}").ravel().astype(np.int64)


def byte_level() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: itself if it is printable in Latin-1, the next from U+0100 on if not."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both sides: ids of texts, and the bytes of each id. A byte-level BPE file and a SentencePiece file."""

    def __init__(self, a: bytes, b: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task a core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        table = byte_level()
        entries = sorted((i, t) for t, i in self.a.get_vocab().items())
        self.a_bytes = [b""] * (entries[-1][0] + 1)
        for i, t in entries:
            self.a_bytes[i] = bytes(table[c] for c in t) if all(c in table for c in t) else t.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        self.whole = any("▁" in t.lstrip("▁") for t in names)  # a piece crosses a space: texts can't be parted
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        # How ids are written in groups: what follows an id is part of its word.
        self.a_words = np.array([f"{i}{end}".encode() for i in range(len(self.a_bytes)) for end in ",|"], object)
        self.b_words = np.array([f"{i}{end}".encode() for i in range(len(names)) for end in (",", ";", "")], object)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of both sides the ids of all texts and their number in each; none if a text is null or empty, or either side's bytes are not a space and the text.

        Texts are cut where both sides part, and each distinct unit of all texts is encoded once.
        """
        parts = [([t] if self.whole else PLACE.split(t)) if t else [] for t in texts]
        coded = pa.array(chain.from_iterable(parts), pa.string()).dictionary_encode()
        sides, good = self.units(coded.dictionary.to_pylist())
        use, text = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.fromiter(map(len, parts), np.int64, len(parts)))
        keep = (np.bincount(text, ~good[use], len(texts)) == 0)[text]
        use, text = use[keep], text[keep]
        return [(ids[gather(start[use], size[use])], np.bincount(text, size[use], len(texts)).astype(np.int64)) for ids, start, size in sides]

    def units(self, units: list[str]) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
        """Of both sides (ids, start, size) by unit, and which units give their own bytes on both.

        Units that white space can't join to their neighbours are encoded many in one text, parted by spaces; those with white space at an end or a
        written mark of space, and all if anything does not fit, one by one.
        """
        odd = np.array([self.whole or u[0].isspace() or u[-1].isspace() or "▁" in u for u in units], bool)
        plain = np.flatnonzero(~odd).tolist()
        runs = [" ".join(units[k] for k in plain[s : s + RUN]) for s in range(0, len(plain), RUN)]
        want = "".join(" " + r for r in runs).encode()
        ends = np.cumsum([len(units[k].encode()) + 1 for k in plain], dtype=np.int64)
        flat = [list(chain.from_iterable(x.ids for x in self.a.encode_batch_fast([" " + r for r in runs], add_special_tokens=False))), list(chain.from_iterable(self.b.encode(runs, num_threads=1) if runs else ()))]
        places = [np.cumsum(sizes[np.array(ids, np.int64)]) for ids, sizes in zip(flat, self.sizes, strict=True)]
        fits = all(b"".join(map(table.__getitem__, ids)) == want and np.isin(ends, p).all() for table, ids, p in zip((self.a_bytes, self.b_bytes), flat, places, strict=True))
        if not fits:
            plain, odd, flat, places, ends = [], np.ones(len(units), bool), [[], []], [np.zeros(0, np.int64)] * 2, ends[:0]
        good, out = ~odd, []
        alone = [(k, self.a.encode(" " + units[k], add_special_tokens=False).ids, self.b.encode(units[k])) for k in np.flatnonzero(odd).tolist()]
        for k, *ids in alone:
            good[k] = all(b"".join(map(table.__getitem__, x)) == f" {units[k]}".encode() for table, x in zip((self.a_bytes, self.b_bytes), ids, strict=True))
        for side in range(2):
            start, size = np.zeros((2, len(units)), np.int64)
            last = np.searchsorted(places[side], ends) + 1
            start[plain], size[plain] = np.r_[0, last[:-1]][: len(last)], np.diff(last, prepend=0)
            single = [x[side + 1] for x in alone]
            size[odd] = list(map(len, single))
            start[odd] = len(flat[side]) + np.cumsum(size[odd]) - size[odd]
            out.append((np.array(flat[side] + list(chain.from_iterable(single)), np.int64), start, size))
        return out, good


@lru_cache(maxsize=1)
def loaded(a: bytes, b: bytes) -> Tokenizers:
    return Tokenizers(a, b)


class Aligned:
    """The links and groups of a batch of texts, whose tokens lie end to end."""

    def __init__(self, known: Tokenizers, sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.known, self.ids, self.n = known, [ids for ids, _ in sides], [n for _, n in sides]
        texts = len(self.n[0])
        self.ends = [np.cumsum(size[ids]) for size, ids in zip(known.sizes, self.ids, strict=True)]
        marks = [np.zeros((e[-1] if len(e) else 0) + 1, bool) for e in self.ends]
        for mark, e in zip(marks, self.ends, strict=True):
            mark[e] = True
        self.common = marks[0] & marks[1]  # where both sides end a token
        at = np.flatnonzero(marks[0] | marks[1])  # each stretch between two ends is one link
        self.links = [ids[np.cumsum(mark)[at] - mark[at]] for ids, mark in zip(self.ids, marks, strict=True)]
        last = np.cumsum(self.n[0])
        bytes_at = np.r_[0, self.ends[0]][last] if len(last) else last
        self.text = np.searchsorted(bytes_at, at)  # that of each link; texts without tokens have none
        self.n_links = np.bincount(self.text, minlength=texts)
        self.n_groups = np.bincount(self.text[self.common[at]], minlength=texts)

    def groups(self) -> list[bytes]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`."""
        group = [np.cumsum(self.common)[e] - self.common[e] for e in self.ends]
        words = np.empty(sum(map(len, self.ids)), object)
        words[np.arange(len(group[0])) + np.searchsorted(group[1], group[0])] = self.known.a_words[self.ids[0] * 2 + self.common[self.ends[0]]]
        closes = self.common[self.ends[1]].astype(np.int64)
        closes[np.cumsum(self.n[1])[self.n[1] > 0] - 1] = 2
        words[np.arange(len(group[1])) + np.searchsorted(group[0], group[1], side="right")] = self.known.b_words[self.ids[1] * 3 + closes]
        cuts = np.r_[0, np.cumsum(self.n[0] + self.n[1])].tolist()
        words = words.tolist()
        return [b"".join(words[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]

    def stripes(self) -> list[tuple[int, bytes, bytes]]:
        """(stripe, cells, texts) with, for each pair of the batch, its cell in the stripe's block and its texts; see cells_of() and texts_of()."""
        wide, texts = len(self.known.b_bytes), max(1, len(self.n[0]))
        a, b = self.links
        cells = block_rows(self.known) * wide
        key, often = np.unique((((a % STRIPES) * cells + a // STRIPES * wide + b) * texts + self.text).astype(np.uint64), return_counts=True)
        pair, text = np.divmod(key.astype(np.int64), texts)
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        cell, sizes = pair[first], np.diff(np.r_[first, len(pair)])
        step = np.diff(text, prepend=0)
        step[first] = text[first]
        stripe, from_ = np.unique(cell // cells, return_index=True)
        out = []
        for s, i, j in zip(stripe.tolist(), from_, np.r_[from_[1:], len(cell)], strict=True):
            p, q = first[i], first[j] if j < len(cell) else len(pair)
            own = np.diff(cell[i:j] - s * cells, prepend=0)
            out.append((s, pack(np.r_[own, sizes[i:j]]), pack(np.r_[step[p:q], often[p:q]])))
        return out


def block_rows(known: Tokenizers) -> int:
    return -(-len(known.a_bytes) // STRIPES)


def cells_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a batch's pairs, in order, and in how many of its texts each is linked."""
    step, sizes = unpack(data).reshape(2, -1)
    return np.cumsum(step), sizes


def texts_of(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of each pair, pair after pair, and how often each links it."""
    step, often = unpack(data).reshape(2, -1)
    run = np.cumsum(step)
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    return run - np.repeat(run[first] - step[first], sizes), often


def encoded(docs: DataFrame, files: tuple[bytes, bytes], digest: bool) -> DataFrame:
    """docs(doc_id, text) as one row a batch of texts: of each text its doc_id, sizes and groups; of each stripe the batch's links."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(files)  # as large as the vocabularies
    names = ["doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups"]
    shape = pa.struct([("stripe", pa.int32()), ("cells", pa.binary()), ("texts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = loaded(*sent.value), TaskContext.get().partitionId() << 40
        for k, b in enumerate(part for whole in batches for part in by_bytes(whole, 1, BYTES)):
            found = Aligned(known, known.encode(b.column(1).to_pylist()))
            spelt = [hashlib.sha256(g).hexdigest() if digest and g else g.decode() for g in found.groups()]
            lists = [b.column(0), *map(pa.array, (*found.n, found.n_groups, found.n_links)), pa.array(spelt, pa.string())]
            links = pa.array([dict(zip(("stripe", "cells", "texts"), s, strict=True)) for s in found.stripes()], shape)
            one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (*lists, links)]
            yield pa.RecordBatch.from_arrays([pa.array([first + k]), *one], ["batch", *names, "links"])

    counts = ", ".join(f"{n} array<long>" for n in names[1:5])
    return docs.select("doc_id", "text").mapInArrow(run, f"batch long, doc_ids array<{kind}>, {counts}, groups array<string>, links array<struct<stripe:int,cells:binary,texts:binary>>")


def added(links: DataFrame, cells: int) -> DataFrame:
    """(stripe, cells) -> (stripe, part, cells, counts): each task's pairs and the number of texts that link them, added up before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        part, size = TaskContext.get().partitionId(), 0

        def merged() -> np.ndarray:
            key, n = np.concatenate(held, axis=1)
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            return np.stack([key[order][first], np.add.reduceat(n[order], first)])

        def out() -> pa.RecordBatch:
            key, n = held.pop()
            stripe, i = np.unique(key // cells, return_index=True)
            cuts = list(zip(i, np.r_[i[1:], len(key)], strict=True))
            lists = [[pack(np.diff(key[s:e] - g * cells, prepend=0)) for g, (s, e) in zip(stripe, cuts, strict=True)], [pack(n[s:e]) for s, e in cuts]]
            return pa.RecordBatch.from_arrays([pa.array(stripe.astype(np.int32)), pa.array(np.full(len(stripe), part)), *(pa.array(x, pa.binary()) for x in lists)], ["stripe", "part", "cells", "counts"])

        for b in batches:
            for stripe, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cell, n = cells_of(data)
                held.append(np.stack([cell + stripe * cells, n]))
                size += len(cell)
                if size > 2 * PAIRS:
                    held[:] = [merged()]
                    size = held[0].shape[1]
                    if size > PAIRS:
                        yield out()
                        size = 0
        if size:
            held[:] = [merged()]
            yield out()

    return links.select("stripe", "cells").mapInArrow(run, "stripe int, part long, cells binary, counts binary")


def blocks(parts: DataFrame, cells: int) -> DataFrame:
    """(stripe, part, cells, counts) -> one row for each (stripe, part): the parts' counts added up in the stripe's dense block."""

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = np.zeros(cells, np.int64)
        for cell, n in zip(table["cells"], table["counts"], strict=True):
            np.add.at(block, np.cumsum(unpack(cell.as_py())), unpack(n.as_py()))
        at = np.flatnonzero(block)
        held = [pa.array([pack(x)], pa.binary()) for x in (np.diff(at, prepend=0), block[at])]
        return pa.Table.from_arrays([pa.array([k.as_py()], k.type) for k in key] + held, ["stripe", "part", "cells", "counts"])

    return parts.groupBy("stripe", "part").applyInArrow(add, "stripe int, part long, cells binary, counts binary")


class Alignment:
    """The written links of a corpus, and the counts of its pairs."""

    def __init__(self, docs: DataFrame, a_path: str, b_path: str, digest: bool) -> None:
        files = tuple(read_file(p) for p in (a_path, b_path))
        known = loaded(*files)
        self.wide, self.rows = len(known.b_bytes), block_rows(known)
        self.cells = self.rows * self.wide
        self.batches = cut(encoded(docs, files, digest))
        links = self.batches.select("batch", F.explode("links").alias("l")).select("batch", "l.*")
        # Dealt by number where a stripe has many parts, whose sums meet in a second step.
        parts = cut(added(links, self.cells))
        n = parts.agg(F.countDistinct("part")).first()[0]
        sums = blocks(parts.withColumn("part", F.pmod("part", F.lit(n // ROWS + 1))), self.cells)
        self.counts = cut(blocks(sums.withColumn("part", F.lit(0).cast("long")), self.cells))
        discard(parts)
        self.links = links

    def scored(self) -> DataFrame:
        """(batch, n_best, sums): of each stripe and batch, by its texts, how many links are the best of their id, and the sum of their counts."""
        cells, wide = self.cells, self.wide
        n = self.batches.count() // ROWS + 1
        links = self.links.withColumn("part", F.pmod(F.xxhash64("batch"), F.lit(n)))
        counts = self.counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

        def score(links: pa.Table, counts: pa.Table) -> pa.Table:
            block, rows = np.zeros(cells, np.int64), []
            for cell, c in zip(counts["cells"], counts["counts"], strict=True):
                block[np.cumsum(unpack(cell.as_py()))] = unpack(c.as_py())
            best = block.reshape(-1, wide).max(axis=1)
            for batch, cell, texts in zip(links["batch"], links["cells"], links["texts"], strict=True):
                at, sizes = cells_of(cell.as_py())
                text, often = texts_of(texts.as_py(), sizes)
                out = np.zeros((2, text.max() + 1), np.int64)
                np.add.at(out[0], text, np.repeat(block[at] == best[at // wide], sizes) * often)
                np.add.at(out[1], text, np.repeat(block[at], sizes) * often)
                rows.append((batch.as_py(), pack(out[0]), pack(out[1])))
            return pa.Table.from_pylist([dict(zip(("batch", "n_best", "sums"), r, strict=True)) for r in rows], pa.schema([("batch", pa.int64()), ("n_best", pa.binary()), ("sums", pa.binary())]))

        met = links.groupBy("stripe", "part").cogroup(counts.groupBy("stripe", "part"))
        return met.applyInArrow(score, "batch long, n_best binary, sums binary")

    def texts(self) -> DataFrame:
        """One row for each text."""
        held = ["doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups"]
        kind = self.batches.schema["doc_ids"].dataType.elementType.simpleString()
        names = ["doc_id", *held[1:5], "n_best", "count_sum", "groups"]

        def put_together(texts: pa.Table, scores: pa.Table) -> pa.Table:
            columns = [texts[c].combine_chunks().flatten() for c in held]
            sums = np.zeros((2, len(columns[0])), np.int64)
            for k, c in enumerate(("n_best", "sums")):
                for data in scores[c]:
                    x = unpack(data.as_py())
                    sums[k, : len(x)] += x
            return pa.Table.from_arrays([*columns[:5], *map(pa.array, sums), columns[5]], names)

        met = self.batches.select("batch", *held).groupBy("batch").cogroup(self.scored().groupBy("batch"))
        return met.applyInArrow(put_together, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:7]) + ", groups string")


def align(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, digest: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    Side A encodes a space and the text with a byte-level BPE file, side B the text with a SentencePiece file that puts a space before it; special tokens'
    strings are plain text. Where tokens of both sides end, groups part; groups: their ids as `a1,a2|b1;a3|b2,b3`, or with `digest` the SHA-256 of that.
    Links: pairs of tokens whose bytes overlap. A pair's count is the number of rows in which it is linked; n_best links have the greatest count of
    their A id, ties included; count_sum adds up the counts of all links. Null and empty texts, and those whose tokens' bytes are not a space
    and the text, have no tokens: zeros and ''. Whole texts are encoded, by units between which both sides part. Rows that share a doc_id, or
    have none, are each by itself, and copies count each. An empty table gives an empty result; other columns are ignored.

    Texts are encoded once. Links are written packed by batch and stripe, shuffled once by (stripe, group of batches) to meet the stripe's block.
    """
    return Alignment(docs, a_path, b_path, digest).texts()


def pair_counts(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """(a_id, b_id, n_docs, best): every pair of ids that some row links, in how many rows, and whether it is the best of a_id, ties included."""
    found = Alignment(docs, a_path, b_path, digest=True)
    cells, wide = found.cells, found.wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stripe, cell, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                at, count = np.cumsum(unpack(cell)), unpack(n)
                best = np.zeros(cells // wide, np.int64)
                np.maximum.at(best, at // wide, count)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (at // wide * STRIPES + stripe, at % wide, count, count == best[at // wide]))), ["a_id", "b_id", "n_docs", "best"])

    return found.counts.select("stripe", "cells", "counts").mapInArrow(run, "a_id long, b_id long, n_docs long, best boolean")
