"""Secret scan with corpus-wide ownership frequency.

Candidates are found by pattern in every whole text. Their hashes are then counted over distinct
repositories and owners: a value that many copy is an example, one that stays with its owner and
looks random is held to be live. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The kinds in order, with pattern, group of the value and least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: Runs too short to count, of the kinds whose matches are whole runs, are not worth a match.
QUICK = {"access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
VERDICTS = ("live", "example")
ORDER = [*KINDS, *VERDICTS]


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<start, end, value>>: the matches of a kind, leftmost and not overlapping, that
    are long enough; start and end count code points, value is the secret itself, at the match's end."""
    pattern, group, least = KINDS[kind]
    pattern = QUICK.get(kind, pattern)
    full, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(full)).alias("gap"), full.alias("full"), value.alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + F.length(x["full"])
        return F.struct(end.alias("at"), F.array_append(s["out"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

    found = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), F.filter(found, lambda x: F.length(x["value"]) >= least)).otherwise(none)


def looks_random(value: Column) -> Column:
    """Letters and digits, 16 characters or more, and at least 8 different ones."""
    return (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def scan(docs: DataFrame, repository: Column, owner: Column, copied: int = 3) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, base, verdicts.

    base is array<struct<start, kind, end>> by start and kind, kind being a place in ORDER; null text
    counts as empty. verdicts, alike, are the method's own: each value of a base span is `example` if
    it occurs in at least `copied` distinct repositories or under as many owners, and else `live` if
    it looks random. Null is a repository and an owner of its own. Rows that share a doc_id
    are scanned each by itself; a row repeated whole gives its result as often. An empty table gives
    an empty result; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", repository.alias("repository"), owner.alias("owner"),
        *[spans_of(text, kind).alias(kind) for kind in KINDS],
    )
    spans = lambda kind: F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(ORDER.index(kind)).alias("kind"), x["end"].alias("end")))
    base = F.flatten(F.array(*[spans(kind) for kind in KINDS]))
    value = lambda x: F.struct((x["end"] - F.length(x["value"])).alias("start"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("hash"), looks_random(x["value"]).alias("random"))
    values = F.array_distinct(F.flatten(F.array(*[F.transform(kind, value) for kind in KINDS])))
    found = cut(found.select("rid", "doc_id", "repository", "owner", F.array_sort(base).alias("base"), values.alias("values")))

    each = found.filter(F.size("values") > 0).select("rid", "repository", "owner", F.inline("values"))
    # Two steps, so that a value in a third of all rows is combined before it meets in one task.
    places = each.groupBy("hash", "repository", "owner").agg(F.max("random").alias("random"))
    counts = places.groupBy("hash").agg(
        F.max("random").alias("random"), F.count_distinct(F.struct("repository")).alias("repositories"), F.count_distinct(F.struct("owner")).alias("owners")
    )
    common = F.greatest("repositories", "owners") >= copied
    verdict = counts.select("hash", F.when(common, ORDER.index("example")).when(F.col("random"), ORDER.index("live")).alias("kind")).filter("kind IS NOT NULL")
    added = each.join(verdict, "hash").groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("verdicts"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return found.join(added, "rid", "left").select("doc_id", "base", F.coalesce("verdicts", none).alias("verdicts"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(x) for x in ORDER])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
