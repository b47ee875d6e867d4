"""Runs of words that repeat with a period, by the suffix tree of Stoye and Gusfield.

The tree of a batch of texts is held as arrays: its leaves in order, and for each inner node the
interval of its leaves. Of each node all leaves but those of its largest child are visited, and
paired with the leaves that lie the node's depth away: these are the branching tandem repeats. Each
is rotated to the left as far as it goes; repeats of one stretch are merged into one maximal run.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bound, by_bytes, gather

#: Words of the shortest run; it holds two periods at least.
LEAST = 12
#: Bytes of text that share a tree (or one text), and leaf visits that are tested at once.
BYTES, VISITS = 4 << 20, 1 << 21


def leaves(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes of x in order, and their ranks by their first 1, 2, 4, ... symbols until no two tie.

    The last symbol of x occurs once, so that suffixes that tie go on beyond what they have in common.
    """
    order = np.argsort(x, kind="stable")
    new = np.r_[True, x[order][1:] != x[order][:-1]]
    rank = np.empty(len(x), np.int32)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    ranks, tied = [rank], ~(new & np.r_[new[1:], True])
    while len(at := np.flatnonzero(tied)):
        s = order[at]
        key = rank[s].astype(np.int64) * len(x) + rank[s + (1 << len(ranks) - 1)]
        turn = np.argsort(key)
        s, key = s[turn], key[turn]
        new = np.r_[True, key[1:] != key[:-1]]
        order[at], rank = s, rank.copy()
        rank[s] = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        ranks.append(rank)
        tied[at] = ~(new & np.r_[new[1:], True])
    return order, ranks


def depths(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Symbols that each leaf has in common with the next."""
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(len(a), np.int64)
    for k in reversed(range(len(ranks) - 1)):
        step = (ranks[k][a] == ranks[k][b]).astype(np.int64) << k
        a, b, out = a + step, b + step, out + step
    return out


def inner_nodes(common: np.ndarray) -> np.ndarray:
    """A row for each inner node below the root: depth, its leaves [l, r), those of its largest child [a, b)."""
    out, stack = array("q"), [[0, 0, 0, 0]]
    for end, depth in enumerate([*common.tolist(), 0], 1):
        left = end - 1  # the child that ends here: a leaf, then each node that closes
        while stack[-1][0] > depth:
            d, l, a, b = stack.pop()  # noqa: E741
            out.extend((d, l, end, left, end) if end - left > b - a else (d, l, end, a, b))
            left = l
        top = stack[-1]
        if top[0] < depth:
            stack.append([depth, left, left, end])
        elif end - left > top[3] - top[2]:
            top[2:] = left, end
    return np.frombuffer(out, np.int64).reshape(-1, 5) if len(out) else np.zeros((0, 5), np.int64)


def branching(x: np.ndarray, order: np.ndarray, rank: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """(end, period) of the branching tandem repeats, in order: a word string twice, after which something else than its first word comes."""
    depth, l, r, a, b = nodes.T  # noqa: E741
    node, starts, sizes = np.tile(np.arange(len(nodes)), 2), np.r_[l, b], np.r_[a - l, r - b]
    found = [np.zeros((0, 2), np.int64)]
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // VISITS, prepend=-1))
    for s, e in zip(cuts, np.r_[cuts[1:], len(sizes)], strict=True):
        v = np.repeat(node[s:e], sizes[s:e])
        i, q = order[gather(starts[s:e], sizes[s:e])], depth[v]
        for other in (i + q, i - q):
            ok = (other >= 0) & (rank[other] >= l[v]) & (rank[other] < r[v])
            first, period = np.minimum(i, other)[ok], q[ok]
            ends = first + 2 * period
            found.append(np.stack([ends, period], axis=1)[x[first + period] != x[ends]])
    return np.unique(np.concatenate(found), axis=0)


def maximal(x: np.ndarray, repeats: np.ndarray, least: int) -> np.ndarray:
    """(start, end, period) of the runs of at least `least` symbols to which branching repeats rotate.

    Repeats come by end, then period: a later one that the run of an earlier one holds whole is a power of its period and merges into it.
    """
    end, q = repeats.T
    good = np.ones(len(end), bool)
    for d in range(1, least - 1):  # so many rotations at least
        at = end - 2 * q - d
        good &= (2 * q + d > least) | ((at >= 0) & (x[np.maximum(at, 0)] == x[np.maximum(at, 0) + q]))
    out, last, reach = [], -1, 0
    for e, p in repeats[good].tolist():
        if e != last:
            last, reach = e, 0
        if 2 * p <= reach:
            continue
        s, step = e - 2 * p, 64
        while s:
            low = max(0, s - step)
            differ = np.flatnonzero(x[low:s] != x[low + p : s + p])
            if len(differ):
                s = low + int(differ[-1]) + 1
                break
            s, step = low, 2 * step
        reach = max(reach, e - s)
        if e - s >= least:
            out.append((s, e, p))
    return np.array(out, np.int64).reshape(-1, 3)


def repeated(word: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a passage of `size` words that occurs twice in their text (or, by chance of a hash, seems to)."""
    inside = np.zeros(len(word) + 1, np.int32)
    if len(word) >= size:
        with np.errstate(over="ignore"):
            h = np.zeros(len(word) - size + 1, np.uint64)
            for k in range(size):
                h = h * np.uint64(0x9E3779B97F4A7C15) + word[k : k + len(h)].astype(np.uint64) + np.uint64(1)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + text[: len(h)].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        whole = np.flatnonzero(text[: len(h)] == text[size - 1 :])
        turn = whole[np.argsort(h[whole])]
        same = h[turn][1:] == h[turn][:-1]
        at = turn[np.r_[same, False] | np.r_[False, same]]
        inside[at] += 1
        inside[at + size] -= 1
    return np.cumsum(inside[:-1]) > 0


def word_runs(word: np.ndarray, text: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of the runs in several texts, words being numbers and text[i] the text of word i, by start, then period.

    A run of period q and length n has n - q >= least / 2 words in a row that occur again q words on, and those passages cover it. So the
    tree is built over the stretches of words that lie in some repeated passage of so many words: no other word can be in a run.
    """
    at = np.flatnonzero(repeated(word, text, -(-least // 2)))
    if not len(at):
        return np.zeros((0, 3), np.int64)
    last = np.r_[(np.diff(at) > 1) | (np.diff(text[at]) > 0), True]
    # Words are told apart by text, so that texts share no node; each stretch ends in a symbol of its own.
    _, symbol = np.unique(text[at].astype(np.int64) * (int(word.max()) + 1) + word[at], return_inverse=True)
    ends = np.flatnonzero(last) + 1
    x = np.insert(symbol, ends, len(at) + np.arange(len(ends)))
    place = np.insert(at, ends, at[ends - 1] + 1)
    order, ranks = leaves(x)
    found = maximal(x, branching(x, order, ranks[-1], inner_nodes(depths(order, ranks))), least)
    start = place[found[:, 0]]
    runs = np.stack([start, start + found[:, 1] - found[:, 0], found[:, 2]], axis=1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, runs, collapsed.

    runs: array of (start, length, period) by start, then period: each stretch of words with that smallest period and of at least two
    periods and `least` words which no neighbouring word extends. collapsed: the text's words joined by single spaces, without those that
    some run contains after its first period. Words are parted by ASCII white space. Whole texts are read; null and empty texts have no runs and collapse
    to the empty text. Rows that share a doc_id, or have none, are each by itself. An empty table gives an empty result; other columns are
    ignored. Nothing is shuffled. A task holds BYTES of text at once, or one text: besides its words, some 150 bytes for each word in a repeated passage.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in by_bytes(whole, 1, BYTES)):
            lists = pc.ascii_split_whitespace(pc.fill_null(b.column(1), ""))
            words, text = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            filled = pc.greater(pc.binary_length(words), 0)
            words, text = words.filter(filled), text[filled.to_numpy(zero_copy_only=False)]
            first = np.searchsorted(text, np.arange(len(b) + 1))
            runs = word_runs(words.dictionary_encode().indices.to_numpy(), text)
            drop = np.zeros(len(words) + 1, np.int64)
            np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
            np.add.at(drop, runs[:, 1], -1)
            keep = np.cumsum(drop[:-1]) == 0
            kept = np.r_[0, np.cumsum(keep)][first].astype(np.int32)
            left = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept), words.filter(pa.array(keep))), " ")
            of = text[runs[:, 0]]
            items = pa.StructArray.from_arrays([pa.array(runs[:, 0] - first[of]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(shape))
            held = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(b) + 1)).astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays([b.column(0), held, left], ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of the texts whose doc_id has a checksum divisible by ten, the words from some place on repeat with some period; others are as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words):
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return bound(F.struct(words.alias("w"), a.cast("int").alias("a"), p.cast("int").alias("p"), n.alias("n")), lambda x: F.array_join(
            F.concat(F.slice(x["w"], F.lit(1), x["a"]), F.transform(F.sequence(F.lit(0), x["n"] - x["a"] - 1), lambda j: F.get(x["w"], x["a"] + F.pmod(j, x["p"])))), " ",
        ))

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    some = F.coalesce((F.pmod(h, F.lit(10)) == 0) & F.col("text").rlike(WORD), F.lit(False))
    return docs.select("doc_id", F.when(some, bound(words, repeat)).otherwise(F.col("text")).alias("text"))
