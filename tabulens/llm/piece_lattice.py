"""SentencePiece encoding and decoding over a relational lattice.

The corpus's distinct units of text are cut into substrings of bounded length, which an equi-join
with the piece table turns into lattice edges; the edges of a unit are grouped and folded, in order
of their ends, into the best path. Documents then take the pieces of their units: those of the most
common units from a broadcast of bounded size, those of all others by joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import vocabulary
from .common import bound, cut, cut_by, setting, short_plans, small_batches
from .vocabulary import SPACE, UNITS, Vocabulary

#: Bytes of common units and their ids that are broadcast at most, whatever the corpus, and the longest of them in bytes.
COMMON_BYTES, COMMON_UNIT = 16 << 20, 64
#: Texts that are split together at most, within the bytes of a batch.
TEXTS = 2048
#: Units that a task of the aggregate holds before it sorts instead.
GROUPS = 1 << 18
#: Marks that often end a word; none is a letter, a space or a line end.
MARKS = frozenset(".,;:!?")
#: Characters by which the longest piece that can begin at a place is known.
HEAD = 3
#: Places of a unit that are folded as one block; longer units are cut into windows of so many.
BLOCK = 256


class Units:
    """The units of a batch of texts, in order; none for null and empty texts. Each distinct word of the batch is split once.

    A text is cut into words at its spaces, as units begin at one; where several spaces meet, or marks of space are
    written out, the whole text counts as a word.
    """

    def __init__(self, texts: pa.Array, split: Callable[[str], list[str]]) -> None:
        texts = pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), texts)
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)), pc.starts_with(texts, " "))
        words = pc.split_pattern(pc.if_else(odd, pc.replace_substring(texts, " ", SPACE), texts), " ")
        coded = words.flatten().dictionary_encode()
        self.word = coded.indices.to_numpy()
        parts = [split(w) for w in coded.dictionary.to_pylist()]
        self.flat = pa.array([u for part in parts for u in part], pa.string())
        self.sizes = np.fromiter(map(len, parts), np.int32, len(parts))
        words_at = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))]
        self.at = np.r_[0, np.cumsum(self.sizes[self.word])][words_at]

    def coded(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct units, most frequent first, how often each occurs, and the place among them of each unit of the texts."""
        coded = self.flat.dictionary_encode()
        often = np.repeat(np.bincount(self.word, minlength=len(self.sizes)), self.sizes)
        n = np.bincount(coded.indices.to_numpy(), often, len(coded.dictionary)).astype(np.int64)
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(n), np.int32)
        place[order] = np.arange(len(n), dtype=np.int32)
        own = pa.array(place[coded.indices.to_numpy()])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(self.sizes)].astype(np.int32)), own)
        return coded.dictionary.take(pa.array(order)), n[order], lists.take(pa.array(self.word)).flatten().to_numpy()


def word_units(pattern: str) -> Callable[[str], list[str]]:
    """A function that gives the units of a word, a space before it. Where letters and other characters part, words of letters alone, or
    with a mark behind them, are not searched."""
    search, letters = regex.compile(pattern).findall, pattern == UNITS[0]

    def units(word: str) -> list[str]:
        if letters and word.isalpha():
            return [SPACE + word]
        if letters and word[-1:] in MARKS and word[:-1].isalpha():
            return [SPACE + word[:-1], word[-1]]
        return search(SPACE + word)

    return units


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, compressed byte by byte, as the high ones repeat."""
    planes = np.ascontiguousarray(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def split_texts(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """docs(doc_id, text) as one row a batch of texts, of bounded bytes or a single text.

    batch: the number of its partition and its place there, for a table that is written once; units, counts: the batch's distinct units; doc_ids, digests,
    sizes: of each text, its SHA-256 and its number of units; body: packed places in units, text after text.
    """
    pattern = known.units
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["batch", "units", "counts", "doc_ids", "digests", "sizes", "body"]
    shape = f"batch long, units array<string>, counts array<long>, doc_ids array<{kind}>, digests array<binary>, sizes array<int>, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, first = word_units(pattern), TaskContext.get().partitionId() << 40
        for k, b in enumerate(batches):
            if not len(b):
                continue
            found = Units(b.column(2), split)
            units, counts, places = found.coded()
            lists = [units, pa.array(counts), b.column(0), b.column(1), pa.array(np.diff(found.at).astype(np.int32))]
            one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array([first + k]), *one, pa.array([packed(places)], pa.binary())], names)
            pa.default_memory_pool().release_unused()

    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.select("doc_id", digest.alias("digest"), "text").mapInArrow(run, shape)


def unit_counts(split: DataFrame) -> DataFrame:
    """(unit, count): the distinct units of all batches."""
    each = split.select(F.explode(F.arrays_zip("units", "counts")).alias("u")).select(F.col("u.units").alias("unit"), F.col("u.counts").alias("n"))
    return each.groupBy("unit").agg(F.sum("n").alias("count"))


def corpus_units(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """(unit, count): the distinct units of all texts of docs."""
    small_batches(docs.sparkSession)
    return unit_counts(split_texts(docs.withColumn("doc_id", F.lit(0)).select("doc_id", "text"), known))


def piece_table(df: DataFrame, known: Vocabulary) -> DataFrame:
    rows = [(p, i) for p, (i, _) in known.pieces.items()]
    return df.sparkSession.createDataFrame(rows, "piece string, id int")


def lengths(df: DataFrame, known: Vocabulary) -> DataFrame:
    """(head, lengths): the first HEAD characters of pieces, and the lengths that a piece may have that begins so, 1 to HEAD - 1 among them."""
    found: dict[str, set[int]] = {}
    for p in known.pieces:
        if len(p) >= HEAD:
            found.setdefault(p[:HEAD], set(range(1, HEAD))).add(len(p))
    return df.sparkSession.createDataFrame([(h, sorted(x)) for h, x in found.items()], "head string, lengths array<int>")


def edges(windows: DataFrame, keys: list[str], known: Vocabulary) -> DataFrame:
    """windows (keys, text, first, starts) -> (keys, edge): the pieces that begin at the first `starts` characters of a text, whose first is place `first` of its unit; see edge().

    The pieces are broadcast (as many as the vocabulary has), so that rows stay where they are. Substrings at a place have the lengths of pieces
    that begin with the same characters.
    """
    starts = windows.select(*keys, "text", "first", F.explode(F.sequence(F.lit(1), F.col("starts"))).alias("at"))
    starts = starts.withColumn("head", F.substring("text", F.col("at"), F.lit(HEAD))).join(F.broadcast(lengths(windows, known)), "head", "left")
    few = F.array(*[F.lit(n) for n in range(1, HEAD)])
    pieces = starts.select(*keys, "text", "first", "at", F.explode(F.coalesce("lengths", few)).alias("n")).filter(F.col("n") <= F.length("text") - F.col("at") + 1)
    found = pieces.withColumn("piece", F.substring("text", F.col("at"), F.col("n"))).join(F.broadcast(piece_table(windows, known)), "piece", "left")
    unknown = F.col("id").isNull() & (F.col("n") == 1)  # a character that is no piece: an edge of its own
    found = found.filter(F.col("id").isNotNull() | unknown)
    return found.select(*keys, edge(F.col("first") + F.col("at") + F.col("n") - 2, F.col("n"), F.coalesce("id", F.lit(known.unknown_id))).alias("edge"))


def lattice(distinct: DataFrame, known: Vocabulary) -> DataFrame:
    """distinct (unit, count), units of BLOCK characters at most -> with blocks: one array<long> of the edges in order of end, then start.

    Grouping needs no second shuffle, as the rows of a unit stay where the units were dealt.
    """
    whole = distinct.select("unit", "count", F.col("unit").alias("text"), F.lit(1).alias("first"), F.length("unit").alias("starts"))
    return edges(whole, ["unit", "count"], known).groupBy("unit", "count").agg(F.array(F.sort_array(F.collect_list("edge"))).alias("blocks"))


def long_lattice(distinct: DataFrame, known: Vocabulary) -> DataFrame:
    """The same for units of any length, a block of edges for each BLOCK of places.

    Units are numbered and cut into windows, which overlap by the longest piece: what is exploded, joined and grouped has a number and
    a window at most, so that the work grows with a unit's length. Only at the end do a unit's blocks meet.
    """
    numbered = cut(distinct.withColumn("number", F.monotonically_increasing_id()))
    windows = numbered.select("number", "unit", F.explode(F.sequence(F.lit(0), F.floor((F.length("unit") - 1) / BLOCK).cast("int"))).alias("k"))
    first = F.col("k") * BLOCK + 1
    windows = windows.select("number", "k", F.substring("unit", first, F.lit(BLOCK + known.longest - 1)).alias("text"), first.alias("first"), F.least(F.lit(BLOCK), F.length("unit") - first + 1).alias("starts"))
    found = edges(windows.repartition("number", "k"), ["number"], known)
    by_block = found.groupBy("number", F.floor((end_of(F.col("edge")) - 1) / BLOCK).alias("k")).agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    blocks = by_block.groupBy("number").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "edges"))), lambda x: x["edges"]).alias("blocks"))
    return numbered.join(blocks, "number").select("unit", "count", "blocks")


def edge(end: Column, length: Column, id_: Column) -> Column:
    """A lattice edge as one number, which sorts by end, then start: pieces have up to 255 characters and there are up to 2**24."""
    return F.shiftleft(end.cast("long"), 32) + F.shiftleft((255 - length).cast("long"), 24) + id_


def end_of(e: Column) -> Column:
    return F.shiftright(e, 32)


def id_of(e: Column) -> Column:
    return e.bitwiseAND(F.lit((1 << 24) - 1)).cast("int")


def back_of(e: Column) -> Column:
    """255 less the length."""
    return F.shiftright(e, 24).bitwiseAND(F.lit(255))


def best_path(blocks: Column, known: Vocabulary) -> Column:
    """array<long> of the edges on the path with the highest score. blocks: array of the edges into each run of places. Every place has an edge into it.

    A place's edges are taken together: each adds its score to the best of the place where it starts. Of equal
    totals the earliest start stays, which comes first. The fold keeps the best scores of as many places
    as a piece is long, and the edge chosen for each place, a block of places at a time.
    """
    # One foldable literal, by id.
    scores = F.split(F.lit(",".join(map(repr, known.scores))), ",").cast("array<double>")
    before = lambda at, i: F.coalesce(F.get(at, i - 1), F.lit(0))
    longs = F.array().cast("array<bigint>")
    mask = F.lit((1 << 24) - 1).cast("long")

    def choose(s: Column, x: Column) -> Column:
        totals = F.transform(x, lambda e: F.get(s["best"], back_of(e) + s["skip"]) + F.get(scores, e.bitwiseAND(mask)))
        return bound(totals, lambda t: F.struct(
            F.array_append(s["best"], F.array_max(t)).alias("best"), (s["skip"] + 1).alias("skip"), F.array_append(s["picks"], F.get(x, F.array_position(t, F.array_max(t)) - 1)).alias("picks"),
        ))

    def places(block: Column) -> Column:
        return bound(place_ends(block), lambda at: F.transform(at, lambda a, i: F.slice(block, before(at, i) + 1, a - before(at, i))))

    def forward(s: Column, block: Column) -> Column:
        # The place where an edge begins lies its length before the end of the best scores.
        start = F.struct(s["best"].alias("best"), (F.size(s["best"]) - 255).cast("long").alias("skip"), longs.alias("picks"))
        kept = lambda t: F.slice(t["best"], F.greatest(F.size(t["best"]) - known.longest, F.lit(0)) + 1, F.lit(known.longest))
        return bound(F.aggregate(places(block), start, choose), lambda t: F.struct(kept(t).alias("best"), F.array_append(s["picks"], t["picks"]).alias("picks")))

    first = F.struct(F.array(F.lit(0.0)).alias("best"), F.array().cast("array<array<bigint>>").alias("picks"))
    picks = F.aggregate(blocks, first, forward, lambda s: s["picks"])

    def hop(s: Column, e: Column) -> Column:  # e is the choice of one place, from the last to the first; the path skips some
        return F.when(end_of(e) == s["at"], F.struct((end_of(e) - 255 + back_of(e)).alias("at"), F.array_append(s["path"], e).alias("path"))).otherwise(s)

    def back(s: Column, block: Column) -> Column:
        inner = F.aggregate(F.reverse(block), F.struct(s["at"].alias("at"), longs.alias("path")), hop)
        return bound(inner, lambda t: F.struct(t["at"].alias("at"), F.array_append(s["path"], t["path"]).alias("path")))

    last = F.struct(end_of(F.element_at(F.element_at(blocks, -1), -1)).alias("at"), F.array().cast("array<array<bigint>>").alias("path"))
    return F.reverse(F.flatten(F.aggregate(F.reverse(picks), last, back, lambda s: s["path"])))


def whole_scores(known: Vocabulary) -> bool:
    """Whether totals of a block are whole numbers of 31 bits, as for files of the BPE kind, whose scores are ranks."""
    return all(float(x).is_integer() for x in known.scores) and max(map(abs, known.scores)) * BLOCK < 1 << 31


def best_short_path(block: Column, known: Vocabulary) -> Column:
    """best_path() of one block, for whole_scores(): the same fold over one number a place, which has the least cost in its high half
    and the low half of the edge chosen in its low one, so that of equal costs the earliest start is least. Nothing but these numbers is made or copied."""
    costs = F.split(F.lit(",".join(str(-int(x) << 32) for x in known.scores)), ",").cast("array<bigint>")
    mask, low, high = (F.lit(x).cast("long") for x in ((1 << 24) - 1, (1 << 32) - 1, -1 << 32))

    def cost(s: Column, e: Column) -> Column:
        return F.get(s, back_of(e) + F.size(s) - 255).bitwiseAND(high) + F.get(costs, e.bitwiseAND(mask)) + e.bitwiseAND(low)

    def back(s: Column) -> Column:
        last = F.size(s) - 1
        picked = lambda p: F.shiftleft(p.cast("long"), 32) + F.get(s, p).bitwiseAND(low)
        hop = lambda t, p: F.when(t["at"] == p, F.struct((p - 255 + back_of(F.get(s, p)).cast("int")).alias("at"), F.array_append(t["path"], picked(p)).alias("path"))).otherwise(t)
        none = F.struct(last.alias("at"), F.array().cast("array<bigint>").alias("path"))
        return F.aggregate(F.sequence(last, F.lit(1), F.lit(-1)), none, hop, lambda t: F.reverse(t["path"]))

    def forward(ends: Column) -> Column:
        done = lambda s: F.coalesce(F.get(ends, F.size(s) - 2), F.lit(0))
        choose = lambda s, end: F.array_append(s, F.array_min(F.transform(F.slice(block, done(s) + 1, end - done(s)), lambda e: cost(s, e))))
        return F.aggregate(ends, F.array(F.lit(0).cast("long")), choose, back)

    # Named by an aggregate of nothing, which makes no copy of it.
    return F.aggregate(F.array().cast("array<int>"), place_ends(block), lambda ends, _: ends, forward)


def place_ends(block: Column) -> Column:
    """How many of a block's edges there are up to each place; a place's last edge is that of a single character, which every place has."""
    return F.filter(F.sequence(F.lit(1), F.size(block)), lambda i: F.get(block, i - 1).bitwiseAND(F.lit(255 << 24)) == 254 << 24)


def unit_ids(distinct: DataFrame, known: Vocabulary) -> DataFrame:
    """(unit, count) -> (unit, count, ids): the unit's piece ids; unknown characters give the ids of their bytes.

    Units of more than BLOCK characters take the way of long_lattice(), all others that of lattice(); both give the same.
    """
    short, long = F.length("unit") <= BLOCK, F.length("unit") > BLOCK
    at = lambda e: F.substring(F.col("unit"), end_of(e).cast("int"), F.lit(1))
    fold = best_short_path(F.element_at("blocks", 1), known) if whole_scores(known) else best_path(F.col("blocks"), known)
    few = with_ids(lattice(distinct.filter(short), known), fold, known, lambda ids: ids(at))
    many = with_ids(long_lattice(distinct.filter(long), known), best_path(F.col("blocks"), known), known, lambda ids: bound(F.split("unit", ""), lambda chars: ids(lambda e: F.get(chars, (end_of(e) - 1).cast("int")))))
    return few.unionByName(many)


def with_ids(found: DataFrame, path: Column, known: Vocabulary, reading: Callable[[Callable[[Callable[[Column], Column]], Column]], Column]) -> DataFrame:
    """A lattice's units with the ids of their best paths (path). reading: applies a function to one that gives the character where an edge ends."""
    # Kept apart, so that the fold's result is made once though it is used more than once.
    paths = found.select("unit", "count", path.alias("path"))
    if not known.byte_ids:
        return paths.select("unit", "count", F.transform("path", id_of).alias("ids"))
    table = F.array(*[F.lit(i) for i in known.byte_ids])
    as_bytes = lambda char: F.transform(F.regexp_extract_all(F.hex(F.encode(char, "UTF-8")), F.lit(".."), F.lit(0)), lambda h: F.get(table, F.conv(h, 16, 10).cast("int")))
    each = lambda char: F.transform("path", lambda e: F.when(id_of(e) == known.unknown_id, as_bytes(char(e))).otherwise(F.array(id_of(e))))
    return paths.select("unit", "count", F.flatten(reading(each)).alias("ids"))


def common_units(pieces: DataFrame) -> tuple[pa.Table, int]:
    """The most common units and their ids, in order of count: as many as COMMON_BYTES hold, of COMMON_UNIT bytes at most each.

    Also the least count of those chosen; all units of that count are among them, but for the long ones. Sums are
    taken a class of counts at a time, of which there are a few hundred.
    """
    fits = F.octet_length("unit") <= COMMON_UNIT
    held = F.octet_length("unit") + 4 * F.size("ids") + 16
    level = F.floor(F.log2("count") * 8)
    classes = pieces.filter(fits).groupBy(level.alias("level")).agg(F.sum(held).alias("bytes"), F.min("count").alias("least"))
    sums, least = 0, 1 << 62
    for r in classes.orderBy(F.desc("level")).collect():
        sums += r["bytes"]
        if sums > COMMON_BYTES:
            break
        least = r["least"]
    return pieces.filter(fits & (F.col("count") >= least)).orderBy(F.desc("count"), "unit").select("unit", "ids").toArrow(), least


class Places:
    """The common units in the tasks: each has its place in the broadcast."""

    def __init__(self, spark: SparkSession, table: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.data = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def table(self) -> tuple[pa.Array, pa.Array]:
        t = pa.ipc.open_stream(pa.py_buffer(self.data.value)).read_all()
        return tuple(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in t.columns)


def list_ends(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins among the values of all, and where the last ends."""
    return np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]


def encode(docs: DataFrame, path: str = vocabulary.DEFAULT_PATH) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, text_sha256, ids array<int>.

    Whole texts are encoded; null and empty texts have no ids. A text is cut where no piece can
    reach across, and scores are summed within such a unit, so that long texts lose no precision.
    Rows that share a doc_id are encoded each by itself. An empty table gives an empty result; other
    columns are ignored.

    Texts are split once: each batch of texts is written with its distinct units and, compressed, the places of
    its texts' units among them. The units that a batch has besides the common ones come to it by joins, once a
    batch; the number of a batch is written with it, so that scans may be cut anew.
    """
    known = vocabulary.load(path)
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    small_batches(spark)
    short_plans(spark)
    # Shuffles of a table are not needed once it is written.
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS)):
            split = cut_by(split_texts(docs, known), "batch")
        with setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPS)):
            # Read by size, not by bucket, so that a task combines the units of many batches; written by unit for the join below.
            batches = spark.read.schema(split.schema).parquet(split._cut_path)
            pieces = cut_by(unit_ids(unit_counts(batches), known), "unit")
    table, least = common_units(pieces)
    places = Places(spark, table)

    @arrow_udf("array<string>")
    def others(units: pa.Array) -> pa.Array:
        """The units of a batch that are not broadcast, in order."""
        flat = units.flatten()
        mask = pc.invert(pc.is_in(flat, value_set=places.table()[0]))
        sofar = np.r_[0, np.cumsum(mask.to_numpy(zero_copy_only=False))]
        return pa.ListArray.from_arrays(pa.array(sofar[list_ends(units)].astype(np.int32)), flat.filter(mask))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each unit of a batch takes its ids from the broadcast, or else the next of the batch's own."""
        common, ids = places.table()
        for b in batches:
            # Looked up together, as a look-up makes an index of all common units first.
            every, ends = pc.fill_null(pc.index_in(b.column(4).flatten(), value_set=common), -1).to_numpy(), list_ends(b.column(4))
            for row, (doc_ids, digests, sizes, body, _, own) in enumerate(zip(*b.columns, strict=True)):
                place = every[ends[row] : ends[row + 1]].copy()
                rare = np.flatnonzero(place < 0)
                place[rare] = len(ids) + np.arange(len(rare))
                lists = pa.concat_arrays([ids, own.values]).take(pa.array(place))
                at = unpacked(body.as_py())
                own_ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy()[at])]
                offsets = own_ends[np.r_[0, np.cumsum(sizes.values.to_numpy())]].astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(offsets), lists.take(pa.array(at)).flatten())
                yield pa.RecordBatch.from_arrays([doc_ids.values, digests.values, found], ["doc_id", "digest", "ids"])
            pa.default_memory_pool().release_unused()

    rare = split.select("batch", F.posexplode(others("units")).alias("k", "unit"))
    beyond = pieces.filter((F.col("count") < least) | (F.octet_length("unit") > COMMON_UNIT)).select("unit", "ids")
    # Dealt by batch before they are put together: there is nothing to combine before that.
    dealt = rare.join(beyond, "unit").select("batch", "k", "ids").repartition("batch")
    fills = dealt.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("own"))
    whole = split.select("batch", "doc_ids", "digests", "sizes", "body", "units").join(fills, "batch", "left")
    own = F.coalesce(F.transform("own", lambda x: x["ids"]), F.array().cast("array<array<int>>"))
    out = whole.select("doc_ids", "digests", "sizes", "body", "units", own.alias("own")).mapInArrow(put_together, f"doc_id {kind}, digest binary, ids array<int>")
    return out.select("doc_id", F.lower(F.hex("digest")).alias("text_sha256"), "ids")


def decode(ids: Column, path: str = vocabulary.DEFAULT_PATH) -> Column:
    """The text of an array of ids: pieces with spaces for their marks, bytes put together, without
    the leading space. No ids give the empty text; null gives null."""
    known = vocabulary.load(path)
    place = {i: b for b, i in enumerate(known.byte_ids)}
    table = [f"{place[i]:02X}" if i in place else name.replace(SPACE, " ").encode().hex().upper() for i, name in enumerate(known.names)]
    # One foldable literal, split once, whose elements are reached by place.
    names = F.split(F.lit(",".join(table)), ",")
    joined = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(names, i)), "")), "UTF-8")
    return F.substr(joined, F.lit(2))


def encoded_corpus(docs: DataFrame, path: str = vocabulary.DEFAULT_PATH) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip): round_trip says that decoding gives the text again."""
    out = encode(docs, path)
    again = F.sha2(F.when(F.size("ids") > 0, decode(F.col("ids"), path)).otherwise(""), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", (again == F.col("text_sha256")).alias("round_trip"))
