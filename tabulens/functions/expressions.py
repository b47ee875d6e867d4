"""References and measures of complexity of model expressions, as Column expressions.

An expression's references are best put into a column once and used from there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import strip

# Patterns and word lists.
BLOCK_COMMENT, LINE_COMMENT = r"(?s)/\*.*?\*/", r"(?://|--)[^\r\n]*"
STRING = r'"[^"]*+(?:""[^"]*+)*"'
QUALIFIED = r"(?:'([^']+)'|([a-zA-Z0-9_#@]+))\s*\[([^\]]+)\]"
BRACKETED = r"\[([^\]]+)\]"
TABLE_FUNCTIONS = (
    "ALL", "ALLEXCEPT", "FILTER", "COUNTROWS", "DISTINCT", "VALUES", "CALCULATETABLE", "RELATEDTABLE", "SUMMARIZE", "ADDCOLUMNS",
    "SELECTCOLUMNS", "CROSSJOIN", "UNION", "EXCEPT", "INTERSECT", "TREATAS", "SUMX", "AVERAGEX", "MINX", "MAXX", "COUNTX",
    "COUNTAX", "MEDIANX", "CONCATENATEX", "RANKX",
)
NOT_TABLES = ("VAR", "RETURN", "TRUE", "FALSE", "BLANK")
FUNCTION = r"\b([a-zA-Z0-9_.]+)\s*\("
CALCULATES = ("CALCULATE", "CALCULATETABLE")
ITERATORS = (
    "SUMX", "AVERAGEX", "MINX", "MAXX", "COUNTX", "COUNTAX", "MEDIANX", "CONCATENATEX", "RANKX", "GEOMEANX", "PRODUCTX",
    "FILTER", "ADDCOLUMNS", "SELECTCOLUMNS", "GENERATE", "GENERATEX",
)
#: Hundredths of a point for each function, CALCULATE, iterator, level and repeat; a character is one.
WEIGHTS = {"function_count": 150, "calculate_count": 200, "iterator_count": 250, "nesting_depth": 150, "repeated_count": 100}

REF = "struct<kind:string,table:string,name:string,raw:string>"


def table_reference(strict: bool = False) -> str:
    """A table function and the name after it, unless a bracket follows. Backing off within the name
    can leave its head as a table; strict does not back off."""
    more = "++" if strict else "+"
    return rf"(?i)\b(?:{'|'.join(TABLE_FUNCTIONS)})\s*\(\s*(?:'([^']+)'|([a-zA-Z0-9_#@]{more}))(?!\s*\[)"


def masked(text: Column) -> Column:
    """Text with comments made a space and string literals blanked, their quotes and length kept.
    Comments are taken out first, so that a comment mark in a string takes the rest of the line."""
    bare = F.regexp_replace(F.regexp_replace(text, BLOCK_COMMENT, " "), LINE_COMMENT, " ")
    gaps = F.split(bare, STRING, -1)
    blanks = F.transform(F.regexp_extract_all(bare, F.lit(STRING), F.lit(0)), lambda s: F.concat(F.lit('"'), F.repeat(F.lit(" "), F.length(s) - 2), F.lit('"')))
    joined = F.array_join(F.zip_with(gaps, blanks, lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), "")
    return F.when(F.contains(bare, F.lit('"')), joined).otherwise(bare)


def references(text: Column, strict: bool = False) -> Column:
    """array<struct<kind, table, name, raw>> of a masked text, in order: qualified, bracketed, table."""
    all_of = lambda t, p, g: F.regexp_extract_all(t, F.lit(p), F.lit(g))
    made = lambda kind, table, name, raw: F.struct(F.lit(kind).alias("kind"), table.alias("table"), name.alias("name"), raw.alias("raw"))
    either = lambda a, b: strip(F.when(a != "", a).otherwise(b))

    groups = [all_of(text, QUALIFIED, g) for g in range(4)]
    qualified = F.transform(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)]), lambda x: made("column", either(x["g1"], x["g2"]), strip(x["g3"]), x["g0"]))
    rest = F.regexp_replace(text, QUALIFIED, " ")
    bracketed = F.transform(all_of(rest, BRACKETED, 1), lambda x: made("bracket", F.lit(None).cast("string"), strip(x), F.concat(F.lit("["), x, F.lit("]"))))
    pattern = table_reference(strict)
    named = F.arrays_zip(*[all_of(text, pattern, g).alias(f"g{g}") for g in range(3)])
    tables = F.transform(named, lambda x: made("table", either(x["g1"], x["g2"]), either(x["g1"], x["g2"]), x["g0"]))
    tables = F.filter(tables, lambda x: ~F.upper(x["name"]).isin(*NOT_TABLES))
    return F.concat(qualified, bracketed, tables).cast(f"array<{REF}>")


def nesting_depth(text: Column) -> Column:
    """Most parentheses open at once; one that closes nothing does not count."""
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(s: Column, mark: Column) -> Column:
        now = F.when(mark == "(", s["open"] + 1).otherwise(F.greatest(s["open"] - 1, F.lit(0)))
        return F.struct(now.alias("open"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(F.regexp_extract_all(text, F.lit("[()]"), F.lit(0)), start, step)["most"]


def repeated(refs: Column) -> Column:
    """Raw texts that occur twice or more among references, in order of first occurrence."""
    raw = F.transform(refs, lambda r: r["raw"])
    return F.filter(F.array_distinct(raw), lambda x: F.size(F.filter(raw, lambda y: y == x)) >= 2)


def line_count(text: Column) -> Column:
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: strip(x) != "")
    return F.greatest(F.size(lines), F.lit(1))


def complexity(text: Column, mask: Column, refs: Column) -> dict[str, Column]:
    """Counts of a stripped text, by name; complexity_score is last and rounds halves up."""
    functions = F.transform(F.regexp_extract_all(mask, F.lit(FUNCTION), F.lit(1)), F.upper)
    among = lambda names: F.size(F.filter(functions, lambda x: x.isin(*names)))
    kind = lambda k: F.size(F.filter(refs, lambda r: r["kind"] == k))
    out = {
        "character_count": F.length(text),
        "line_count": line_count(text),
        "function_count": F.size(functions),
        "referenced_measures": kind("bracket"),
        "referenced_columns": kind("column"),
        "referenced_tables": kind("table"),
        "calculate_count": among(CALCULATES),
        "filter_count": among(["FILTER"]),
        "iterator_count": among(ITERATORS),
        "var_count": F.size(F.regexp_extract_all(mask, F.lit(r"(?i)\bVAR\b"), F.lit(0))),
        "nesting_depth": nesting_depth(mask),
        "repeated_count": F.size(repeated(refs)),
    }
    return out


def score(counts: dict[str, Column]) -> Column:
    """The score in tenths, from whole hundredths, so that it is exact; halves round up."""
    hundredths = counts["character_count"] + sum((counts[n] * w for n, w in WEIGHTS.items()), F.lit(0))
    return F.floor((hundredths + 5) / 10).cast("double") / 10
