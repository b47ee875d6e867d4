"""Types, titles and field references of report visuals, out of their JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import strip

#: Display names of visual types.
TYPE_NAMES = {
    "card": "Card", "cardvisual": "Card", "columnchart": "Column Chart", "clusteredcolumnchart": "Clustered Column Chart",
    "barchart": "Bar Chart", "clusteredbarchart": "Clustered Bar Chart", "linechart": "Line Chart",
    "linestackedcolumncombochart": "Line and Stacked Column Chart", "lineclusteredcolumncombochart": "Line and Clustered Column Chart",
    "areachart": "Area Chart", "stackedareachart": "Stacked Area Chart", "piechart": "Pie Chart", "donutchart": "Donut Chart",
    "tableex": "Table", "table": "Table", "pivottable": "Matrix", "matrix": "Matrix", "slicer": "Slicer", "textbox": "Text Box",
    "image": "Image", "shape": "Shape", "basicshape": "Shape", "actionbutton": "Button", "button": "Button", "map": "Map",
    "filledmap": "Filled Map", "scatterchart": "Scatter Chart", "treemap": "Treemap", "funnel": "Funnel", "gauge": "Gauge",
    "waterfallchart": "Waterfall Chart", "decompositiontree": "Decomposition Tree", "pythonvisual": "Python Visual",
    "rvisual": "R Visual", "keyinfluencers": "Key Influencers",
}

def title_case(text: Column) -> Column:
    """Each run of letters with its first letter in upper case and the rest in lower case."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    # initcap looks for words by rules of all scripts, which costs much more than all else; ASCII's letters need none.
    first = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2**31 - 1))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.array_join(F.when(ascii_only, F.transform(runs, first)).otherwise(F.transform(runs, F.initcap)), "")


def visual_type(raw: Column) -> Column:
    text = strip(raw)
    table = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    other = title_case(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"))
    unknown = (F.coalesce(raw, F.lit("")) == "") | (raw == "Unknown")
    return F.when(unknown, "Unknown").otherwise(F.coalesce(F.try_element_at(table, F.lower(text)), other))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value made once and named, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def clean_title(text: Column) -> Column:
    """Text without white space and up to two pairs of quotes around it; empty for null and for none."""
    quoted = lambda x: (F.length(x) > 1) & x.rlike(r"""(?s)^(?:'.*'|".*")$""")
    bare = lambda x: F.when(quoted(x), strip(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x)
    once = bound(strip(F.coalesce(text, F.lit(""))), bare)
    return bound(bound(once, bare), lambda x: F.when(F.lower(x) == "none", "").otherwise(x))


def at(doc: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(doc, path, kind)


def text_of(value: Column) -> Column:
    """The string that a variant is; null for what is not a string."""
    return bound(value, lambda x: F.when(F.schema_of_variant(x) == "STRING", at(x, "$")))


def filled(value: Column) -> Column:
    """A variant, unless it is empty."""
    return bound(value, lambda x: F.when(~at(x, "$").isin("{}", "[]", "null", ""), x))


#: What is read of a visual's configuration, at once: each path that is looked up by itself and is not there costs more than one that is.
CONFIG = """struct<title:variant,displayName:variant,customName:variant,vcObjects:variant,visualContainerObjects:variant,objects:variant,
    paragraphs:array<struct<textRuns:array<struct<value:string>>>>,prototypeQuery:variant,visual:variant,
    singleVisual:struct<vcObjects:variant,visualContainerObjects:variant,objects:variant,prototypeQuery:variant>>"""


def config(doc: Column) -> Column:
    """CONFIG of a visual's document (variant), null in all that it lacks."""
    return at(doc, "$", CONFIG)


def config_title(read: Column) -> Column:
    """The title in a visual's configuration (config()): its own, or that of its container's objects, of its
    objects, or the text of its paragraphs; the first that is there, even if it is empty once cleaned."""
    single = read["singleVisual"]
    containers = F.coalesce(*[filled(x) for x in (single["vcObjects"], read["vcObjects"], read["visualContainerObjects"], single["visualContainerObjects"])])
    objects = F.coalesce(filled(single["objects"]), filled(read["objects"]))
    first = lambda x: bound(x, lambda o: F.coalesce(at(o, "$.title[0]", "variant"), at(o, "$.title", "variant")))
    literal, value, text = "$.properties.text.expr.Literal.Value", "$.properties.text.value", "$.properties.text"
    said = F.flatten(F.transform(read["paragraphs"], lambda p: F.coalesce(F.transform(p["textRuns"], lambda r: strip(F.coalesce(r["value"], F.lit("")))), F.array().cast("array<string>"))))
    words = F.nullif(F.array_join(F.filter(said, lambda x: x != ""), " "), F.lit(""))
    boxed = bound(first(containers), lambda box: F.coalesce(at(box, literal), at(box, value), text_of(at(box, text, "variant"))))
    return clean_title(F.coalesce(text_of(read["title"]), boxed, at(first(objects), literal), words))


def explicit_name(read: Column, inner: Column) -> Column:
    """The name a user gave a visual (config() of its document, and of what is its visual), or an empty one."""
    names = (read["displayName"], read["customName"], inner["displayName"], inner["customName"])
    return F.coalesce(*[bound(text_of(x), lambda t: F.when(t != "", t)) for x in names], F.lit(""))


def query_reference(text: Column) -> Column:
    """struct(table, name, kind) of a reference such as Table.Field, Agg(Table.Field) or Table.Field.Variation.Level."""
    bare = lambda x: F.btrim(strip(x), F.lit("'\"[]"))
    inner = F.regexp_extract(strip(text), r"^[a-zA-Z0-9_]+\((.*)\)$", 1)
    wrapped = strip(text).rlike(r"^[a-zA-Z0-9_]+\(.*\)$")

    def parts(x: Column) -> Column:
        dot = F.locate(".", x)
        field = bare(F.substr(x, dot + 1))
        table = F.when(dot > 0, bare(F.substring_index(x, ".", 1)))
        name = F.when(dot > 0, bare(F.substring_index(field, ".", 1))).otherwise(F.btrim(x, F.lit("'\"[]")))
        return F.struct(table.alias("table"), name.alias("name"), F.lit(None).cast("string").alias("kind"))

    return bound(F.when(wrapped, strip(inner)).otherwise(strip(text)), parts)


def aliases(doc: Column) -> Column:
    """map<string,string> of a visual's query (variant): its sources' short names and what they stand for; the last of one name counts."""
    read = at(doc, "$", "struct<prototypeQuery:variant,singleVisual:struct<prototypeQuery:variant>>")
    query = bound(read, lambda x: F.coalesce(filled(x["prototypeQuery"]), x["singleVisual"]["prototypeQuery"]))
    sources = F.coalesce(at(query, "$", "struct<From:array<struct<Name:string,Entity:string>>>")["From"], F.array().cast("array<struct<Name:string,Entity:string>>"))
    filled_in = F.filter(sources, lambda x: (F.coalesce(x["Name"], F.lit("")) != "") & (F.coalesce(x["Entity"], F.lit("")) != ""))

    def mapped(named: Column) -> Column:
        last = lambda x, i: F.array_max(F.transform(F.sequence(F.lit(0), F.size(named) - 1), lambda j: F.when(F.get(named, j)["Name"] == x["Name"], j))) == i
        return F.when(F.size(named) > 0, F.map_from_entries(F.filter(named, last)))

    return bound(filled_in, mapped)


#: Objects that name a field, the property that does, and the kind of field.
NAMED_BY = (("Column", "Property", "Column"), ("Measure", "Property", "Measure"), ("HierarchyLevel", "Level", "Column"))


#: Names of the entries that may name a field.
HOLDERS = (*(holder for holder, _, _ in NAMED_BY), "queryRef")


def entries(value: Column) -> Column:
    """array<struct<key,value>> of what an object or array (variant) holds, with a null key in an array; empty for anything else."""
    of_object = F.map_entries(at(value, "$", "map<string,variant>"))
    of_array = F.transform(at(value, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    return F.coalesce(of_object, of_array, F.array().cast("array<struct<key:string,value:variant>>"))


def held(doc: Column, raw: Column, levels: int) -> Column:
    """array<struct<key,value>> of the entries anywhere in doc (variant, of the text raw) that may name a field.

    The walk goes breadth first, a level of all that is still nested at a time, and looks after each so many levels whether anything is left.
    No text nests deeper than half its length, so that it ends by itself, at any depth.
    """
    state = "struct<ahead:array<variant>,held:array<struct<key:string,value:variant>>>"

    def level(walk: Column, _: Column) -> Column:
        def onward(found: Column) -> Column:
            names = bound(F.filter(found, lambda x: x["key"].isin(*HOLDERS)), lambda x: F.when(F.size(x) > 0, F.concat(walk["held"], x)))
            return F.struct(F.transform(found, lambda x: x["value"]).alias("ahead"), F.coalesce(names, walk["held"]).alias("held"))

        return bound(F.flatten(F.transform(walk["ahead"], entries)), onward)

    steps = F.sequence(F.lit(1), F.lit(levels))
    rounds = F.sequence(F.lit(0), F.floor(F.coalesce(F.length(raw), F.lit(0)) / (2 * levels)).cast("int"))
    start = F.struct(F.array(doc).alias("ahead"), F.array().cast("array<struct<key:string,value:variant>>").alias("held")).cast(state)
    return F.aggregate(rounds, start, lambda walk, _: F.when(F.size(walk["ahead"]) > 0, F.aggregate(steps, walk, level)).otherwise(walk), lambda walk: walk["held"])


def field_at(key: Column, value: Column, known: Column) -> Column:
    """struct(table, name, kind) that an entry of an object names, or null. known: aliases()."""

    def of(read: Column) -> Column:
        name = F.coalesce(*[F.when(key == holder, read[prop]) for holder, prop, _ in NAMED_BY])
        kind = F.coalesce(*[F.when(key == holder, kind) for holder, _, kind in NAMED_BY])
        ref = read["Expression"]["SourceRef"]
        table = F.coalesce(F.when(ref["Entity"] != "", ref["Entity"]), F.when(known.isNotNull(), F.try_element_at(known, ref["Source"])))
        return bound(name, lambda x: F.when(x.isNotNull() & ~x.isin("", "{}", "[]"), F.struct(table.alias("table"), x.alias("name"), kind.alias("kind"))))

    props = ",".join(f"{prop}:string" for prop in dict.fromkeys(prop for _, prop, _ in NAMED_BY))
    named = F.when(key != "queryRef", bound(at(value, "$", f"struct<{props},Expression:struct<SourceRef:struct<Entity:string,Source:string>>>"), of))
    asked = F.when((key == "queryRef") & (F.schema_of_variant(value) == "STRING"), query_reference(at(value, "$")))
    return F.coalesce(named, asked)


def title_field(title: Column) -> Column:
    """struct(table, name, kind) of the first bracketed name in a title, or null."""
    named = F.regexp_extract(F.coalesce(title, F.lit("")), r"\[([^\]]+)\]", 1)
    return F.when(named != "", F.struct(F.lit(None).cast("string").alias("table"), named.alias("name"), F.lit(None).cast("string").alias("kind")))
