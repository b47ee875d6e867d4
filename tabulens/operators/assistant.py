"""Questions about a model: the names in them, what they ask for, and what they refer back to.

Names are matched against questions of their own project, by an inverted index of the names' grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import written

#: Characters of a gram, by which names are looked up.
GRAM = 3
#: Names whose index is sent to every task, a few MB; more are joined.
SENT = 20_000
#: Words that ask for a part of the context, and phrases that refer back.
INTENTS = {
    "unused_objects_summary": ("unused", "orphan", "clean up", "redundant", "dead"),
    "relationships_summary": ("relationship", "relation", "filter direction", "bidirectional", "cardinality", "parent-child", "inactive", "parent child"),
    "data_sources": ("source", "sql", "excel", "power query", "m expression", "sharepoint", "database", "connection"),
    "model_health": ("health", "score", "deduction", "grade", "why is my score", "factor"),
    "report": ("visual", "page", "report", "display", "card", "chart", "tableex"),
    "executive_overview": ("summary", "executive", "overview", "top issue", "fix first", "recommendation"),
}
PRONOUNS = (" it ", " it?", " it.", "its ", "this measure", "that measure", "this table", "that table")


def asked(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def intents(text: Column) -> Column:
    """array of the intents whose words occur in a question."""
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(asked(text), w))
    return F.filter(F.array(*[F.when(has(words), name) for name, words in INTENTS.items()]), lambda x: x.isNotNull())


def refers_back(text: Column) -> Column:
    q = asked(text)
    return F.startswith(q, F.lit("it ")) | F.exists(F.array(*[F.lit(p) for p in PRONOUNS]), lambda p: F.contains(q, p))


def grams(text: Column, size: int) -> Column:
    """The distinct substrings of so many characters, found in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def index(names: DataFrame) -> DataFrame:
    """(project_id, gram, ord, name): an inverted index of names, in any case.

    Each name stands once, under the gram of its own that the fewest names of its project have; one shorter than a gram under itself.
    """
    once = names.filter("name <> ''").select("project_id", "ord", "name").distinct()
    low = F.lower("name")
    each = once.withColumn("gram", F.explode(F.when(F.length(low) < GRAM, F.array(low)).otherwise(grams(low, GRAM))))
    often = each.groupBy("project_id", "gram").agg(F.count("*").alias("often"))
    rarest = F.min_by("gram", F.struct("often", "gram")).alias("gram")
    return each.hint("merge").join(often, ["project_id", "gram"]).groupBy("project_id", "ord", "name").agg(rarest)


def contained(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Questions with each name that their text contains, in any case.

    A text that contains a name has the name's rarest gram: names meet questions by an equi-join on it, and what meets is verified. An index of
    SENT names at most is sent to the questions; a larger one meets their grams in a merge join, and texts are not sent with their grams. Questions
    are never sent: the optimizer takes exploded grams for no larger than their texts, and would gather them on the driver.
    """
    taken = {c.lower() for c in [*questions.columns, *names.columns]}
    row, gram = (next(c for c in (f"{x}_", f"{x}__", f"{x}___") if c not in taken) for x in ("row", "gram"))
    low = F.lower(F.coalesce("text", F.lit("")))
    sizes = F.explode_outer(F.flatten(F.array(*[grams(low, q) for q in range(1, GRAM + 1)]))).alias(gram)
    found = written(index(names)).withColumnRenamed("gram", gram)
    if found.limit(SENT + 1).count() <= SENT:
        met = questions.select("*", sizes).join(F.broadcast(found), ["project_id", gram])
    else:
        asked = written(questions.withColumn(row, F.monotonically_increasing_id()))
        ids = asked.select("project_id", row, sizes).join(found.hint("merge"), ["project_id", gram]).select(row, "ord", "name")
        met = asked.join(ids.hint("merge"), row)
    return met.filter(F.contains(low, F.lower("name"))).select(*questions.columns, "ord", "name")


def whole_words(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Questions with each name that stands in their text as a whole word, in any case."""
    pattern = F.concat(F.lit("(?U)\\b\\Q"), F.lower("name"), F.lit("\\E\\b"))
    return contained(questions, names).filter(F.regexp(F.lower("text"), pattern))


def recent_entity(messages: DataFrame, measures: DataFrame, tables: DataFrame, back: int = 4) -> DataFrame:
    """What a conversation's last messages speak of: (project_id, conv_id, kind, name), at most one.

    Of the last few messages the newest that names anything counts: a bracketed measure first, then
    a measure that its text contains, then a table; of several, the first of the model.
    """
    newest = F.row_number().over(W.partitionBy("project_id", "conv_id").orderBy(F.desc("turn")))
    recent = messages.withColumn("back", newest).filter(F.col("back") <= back)
    bracketed = F.contains(F.lower("text"), F.concat(F.lit("["), F.lower("name"), F.lit("]")))

    def best(names: DataFrame, kind: str, rank: Column) -> DataFrame:
        hits = contained(recent, names).withColumn("rank", rank)
        first = F.min_by(F.struct("back", "rank", F.lit(kind).alias("kind"), "name"), F.struct("back", "rank", "ord", "name"))
        return hits.groupBy("project_id", "conv_id").agg(first.alias("x")).select("project_id", "conv_id", "x")

    every = best(measures, "measure", F.when(bracketed, 0).otherwise(1)).unionByName(best(tables, "table", F.lit(2)))
    return every.groupBy("project_id", "conv_id").agg(F.min_by("x", F.struct("x.back", "x.rank")).alias("x")).select("project_id", "conv_id", "x.kind", "x.name")


def first_rows(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each key, in order."""
    return df.withColumn("k_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("k_") <= k).drop("k_")
