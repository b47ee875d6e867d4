"""Names, flags and enumerations of a model, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\f\x0b"

#: Names and annotations that mark a system table, and beginnings of a date variation.
SYSTEM_PREFIXES = ("localdatetable_", "datetabletemplate_")
SYSTEM_ANNOTATIONS = ("__PBI_LocalDateTable", "__PBI_TemplateDateTable")
VARIATION_PREFIXES = ("variation", "datetime variation", "isdefault", "relationship:", "defaulthierarchy:")
HELPER_NAMES = ("_measures", "measures", "keymeasures", "_keymeasures")

#: Spellings of cardinalities, directions and states.
CARDINALITY = {
    "M:1": ("manytoone", "m:1", "*:1", "many_to_one", "many-to-one", "many", "*"),
    "1:M": ("onetomany", "1:m", "1:*", "one_to_many", "one-to-many"),
    "1:1": ("onetoone", "1:1", "one_to_one", "one-to-one", "one", "1"),
    "M:M": ("manytomany", "m:m", "*:*", "many_to_many", "many-to-many"),
}
DIRECTION = {
    "Single": ("onedirection", "single", "singledirection", "1", "one", "automatic", "default"),
    "Both": ("bothdirections", "both", "2", "bidirectional"),
}
INACTIVE = ("false", "0", "inactive", "no")
ONE, MANY = ("one", "1"), ("many", "none", "*")


def strip(text: Column) -> Column:
    """Text without ASCII white space at its ends."""
    return F.btrim(text, F.lit(WHITE))


def key(name: Column) -> Column:
    """What names are compared by: case and white space at the ends do not count."""
    return F.lower(strip(name))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").when(~flag, "No").otherwise("Unknown")


def or_none(text: Column) -> Column:
    return F.coalesce(F.when(text != "", text), F.lit("None"))


def is_system_table(name: Column, annotations: Column | None = None) -> Column:
    by_name = F.lit(False)
    for prefix in SYSTEM_PREFIXES:
        by_name |= F.startswith(key(name), F.lit(prefix))
    if annotations is not None:
        marked = F.exists(annotations, lambda a: a["name"].isin(*SYSTEM_ANNOTATIONS))
        by_name |= (name != "") & F.coalesce(marked, F.lit(False))
    return F.coalesce(by_name, F.lit(False))


def is_date_variation(expression: Column) -> Column:
    text = key(F.coalesce(expression, F.lit("")))
    found = F.contains(text, F.lit("defaulthierarchy:"))
    for prefix in VARIATION_PREFIXES:
        found |= F.startswith(text, F.lit(prefix))
    return found


def table_type(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("_")) | F.lower(name).isin(*HELPER_NAMES), "Helper").otherwise("Data")


def _spelled(text: Column, table: dict[str, tuple[str, ...]], otherwise: str) -> Column:
    out = F
    for name, spellings in table.items():
        out = out.when(text.isin(*spellings), name)
    return out.otherwise(otherwise)


def cardinality(raw: Column, from_end: Column, to_end: Column) -> Column:
    """1:1, 1:M, M:1, M:M or Unknown. Without raw it follows from the ends, if one is given and both
    are known (an end not given counts as many at the start and as one at the target), or is M:1."""
    given = lambda c: F.when(c != "", c)
    a, b = (F.coalesce(key(given(c)), F.lit(d)) for c, d in ((from_end, "many"), (to_end, "one")))
    ends = (
        F.when(a.isin(*ONE) & b.isin(*ONE), "1:1").when(a.isin(*ONE) & b.isin(*MANY), "1:M")
        .when(a.isin(*MANY) & b.isin(*ONE), "M:1").when(a.isin(*MANY) & b.isin(*MANY), "M:M").otherwise("M:1")
    )
    return F.when(given(raw).isNull(), ends).otherwise(_spelled(key(raw), CARDINALITY, "Unknown"))


def filter_direction(raw: Column) -> Column:
    return F.when(F.coalesce(raw, F.lit("")) == "", "Single").otherwise(_spelled(key(raw), DIRECTION, "Unknown"))


def status(raw: Column) -> Column:
    return F.when(key(raw.cast("string")).isin(*INACTIVE), "Inactive").otherwise("Active")


def canonical(kind: Column, table: Column, name: Column) -> Column:
    """KIND:table[name], without brackets where there is no name."""
    return F.concat(F.upper(kind), F.lit(":"), table, F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("["), name, F.lit("]"))).otherwise(""))


def unquoted(name: Column) -> Column:
    """An identifier without the quotes or brackets around it; doubled single quotes become one."""
    text = strip(name)
    inner = F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))
    around = lambda a, b: F.startswith(text, F.lit(a)) & F.endswith(text, F.lit(b))
    return strip(F.when(around("'", "'") | around('"', '"'), F.replace(inner, F.lit("''"), F.lit("'"))).when(around("[", "]"), inner).otherwise(text))


#: Whole references, with the groups of table and column.
COLUMN_REFERENCES = (
    (r"^'([^']+)'\.'([^']+)'$", 2),
    (r"^'([^']+)'\.\[([^\]]+)\]$", 2),
    (r"^'([^']+)'\.([^\s.]+)$", 2),
    (r"^'([^']+)'\[([^\]]+)\]$", 2),
    (r"^([^'\[.\s]+)\[([^\]]+)\]$", 2),
)


def column_reference(text: Column) -> Column:
    """struct<table, column> of 'T'.'C', 'T'.[C], 'T'[C], T[C] and T.C; else no table and the name.
    What matches no whole form is split at its first dot, if it has one."""
    whole = strip(text)
    pair = lambda t, c: F.struct(t.alias("table"), c.alias("column"))
    dot = F.instr(whole, ".")
    out = F
    for pattern, group in COLUMN_REFERENCES:
        out = out.when(whole.rlike(pattern), pair(F.regexp_extract(whole, pattern, 1), F.regexp_extract(whole, pattern, group)))
    split = pair(unquoted(F.substring(whole, F.lit(1), dot - 1)), unquoted(F.substring(whole, dot + 1, F.length(whole))))
    return out.when(dot > 0, split).otherwise(pair(F.lit(""), unquoted(whole)))
