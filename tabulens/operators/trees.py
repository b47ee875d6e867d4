"""The first shortest ways from a root to all it leads to, as one tree a root."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Edges that are looked at together, at least: whole roots, a root's edges are never parted.
EDGES = 2**16
#: A tree: level by level, the way to each node has its parent's place in the level before, the label of its last edge and the place of that edge's
#: expression in exprs. The only node of level 0 is the root, which has no entry.
TREE = "root long, nodes array<array<long>>, parents array<array<int>>, labels array<array<string>>, daxes array<array<int>>, exprs array<string>, alike boolean"
SCHEMA = pa.schema([("root", pa.int64()), ("nodes", pa.list_(pa.list_(pa.int64()))), ("parents", pa.list_(pa.list_(pa.int32()))), ("labels", pa.list_(pa.list_(pa.string()))), ("daxes", pa.list_(pa.list_(pa.int32()))), ("exprs", pa.list_(pa.string())), ("alike", pa.bool_())])


def places(group: np.ndarray) -> np.ndarray:
    """The place of each row among those of its group; groups lie together."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    return np.arange(len(group)) - np.repeat(starts, np.diff(starts, append=len(group)))


def dense(*keys: np.ndarray) -> np.ndarray:
    """Numbers in the order of keys (the first counts most), the same for rows alike in all."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def nested(values: pa.Array, sizes: np.ndarray, outer: np.ndarray) -> pa.ListArray:
    """values in lists of sizes, and these in lists of outer."""
    offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    return pa.ListArray.from_arrays(offsets(outer), pa.ListArray.from_arrays(offsets(sizes), values))


def grown(edges: pa.Table) -> pa.RecordBatch:
    """Trees of some roots. edges, sorted by root: all that lead on from a node that the root leads to, or from itself, with the node's level.

    Of the shortest ways to a node the first by edge numbers is kept, as a queue would visit it; of these, if a source's edges share
    a number, the first by labels. A way's first part is itself the first to where it ends, so that each level orders the next.
    """
    root, src, level, n, dst = (edges[c].to_numpy() for c in ("root", "src", "level", "n", "dst"))
    group = np.cumsum(np.diff(root, prepend=root[:1]) != 0)
    names, number = np.unique(np.concatenate([src, dst]), return_inverse=True)
    key = lambda nodes: group * len(names) + nodes
    source, target = key(number[: len(src)]), key(number[len(src) :])
    # An edge on a shortest way: none comes to its target from a lesser level.
    order = np.lexsort((level, target))
    nodes, first = np.unique(target[order], return_index=True)
    least, at = level[order][first], np.searchsorted(nodes, target)
    kept = np.flatnonzero(level == least[at])
    kept = kept[np.argsort(level[kept], kind="stable")]
    by = np.lexsort((n, source))
    tied = bool(((source[by][1:] == source[by][:-1]) & (n[by][1:] == n[by][:-1])).any())
    zero = np.zeros(len(n), np.int64)
    label, dax = (pc.rank(edges[c].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64) if tied else zero for c in ("label", "dax"))
    place, by_n, by_label = (np.zeros(len(nodes) + 1, np.int64) for _ in range(3))  # of nodes; the last is any root's
    came = np.where(src == root, len(nodes), np.searchsorted(nodes, source))
    chosen, ends = [], np.searchsorted(level[kept], np.arange(level.max(initial=-1) + 2))
    for k in range(len(ends) - 1):
        e = kept[ends[k] : ends[k + 1]]
        e = e[np.lexsort((dax[e], label[e], by_label[came[e]], n[e], by_n[came[e]], group[e]))]
        e = e[np.sort(np.unique(at[e], return_index=True)[1])]
        place[at[e]] = places(group[e])
        by_n[at[e]] = dense(group[e], by_n[came[e]], n[e]) if tied else place[at[e]]
        by_label[at[e]] = dense(group[e], by_label[came[e]], label[e]) if tied else 0
        chosen.append(e)
    chosen = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
    e = chosen[np.argsort(group[chosen], kind="stable")]
    block = np.flatnonzero(np.diff(group[e], prepend=-1) | np.diff(level[e], prepend=-1))
    sizes, whose = np.diff(block, append=len(e)), group[e][block]
    head = np.flatnonzero(np.diff(whose, prepend=-1))
    outer = np.diff(head, append=len(whose))
    per_root = np.add.reduceat(sizes, head) if len(head) else sizes
    row = np.repeat(np.arange(len(head)), per_root)
    coded = edges["dax"].combine_chunks().dictionary_encode()
    code = coded.indices.fill_null(len(coded.dictionary)).to_numpy().astype(np.int64)[e]
    wide = len(coded.dictionary) + 1
    exprs, own = np.unique(row * wide + code, return_inverse=True)
    counts = np.bincount(exprs // wide, minlength=len(head)).astype(np.int64)
    texts = coded.dictionary.take(pa.array(exprs % wide, mask=exprs % wide == wide - 1))
    labels = edges["label"].combine_chunks().take(pa.array(e))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(root[e][block][head]), nested(pa.array(dst[e]), sizes, outer), nested(pa.array(place[came[e]].astype(np.int32)), sizes, outer), nested(labels, sizes, outer),
            nested(pa.array((own - (np.cumsum(counts) - counts)[row]).astype(np.int32)), sizes, outer),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), texts),
            pa.array(alike(labels, row, level[e], place[came[e]], len(head))),
        ],
        schema=SCHEMA,
    )


def alike(labels: pa.Array, row: np.ndarray, level: np.ndarray, parent: np.ndarray, rows: int) -> np.ndarray:
    """Of each tree whether two of its ways may read alike: a node has two edges of one label, or a label is null or holds an arrow."""
    odd = pc.fill_null(pc.match_substring(labels, "->"), True).to_numpy(zero_copy_only=False)
    codes = labels.dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
    order = np.lexsort((codes, parent, level, row))
    same = np.ones(max(0, len(order) - 1), bool)
    for k in (codes, parent, level, row):
        same &= k[order][1:] == k[order][:-1]
    out = np.zeros(rows, bool)
    out[row[odd]] = True
    out[row[order[1:][same]]] = True
    return out


def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of a task's roots: (root, src, level, n, dst, label, dax) sorted by root in, TREE out."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if sum(b.num_rows for b in held) >= EDGES:
            last = held[-1]["root"][-1].as_py()
            cut = int(np.searchsorted(batch["root"].to_numpy(), last, side="right"))
            held.append(batch.slice(0, cut))
            if cut == batch.num_rows:
                continue
            yield grown(pa.Table.from_batches(held))
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield grown(pa.Table.from_batches(held))
