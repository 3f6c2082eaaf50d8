"""Structured files as text: JSON as path lines, XML as lines of text, notebooks as Markdown. In generated or built-in functions.

docs: doc_id, text. Null texts are empty ones. What can't be read gives no lines; problem() names why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import text as T

#: Levels of containers that JSON is opened to; items of a list of scalars on one line; characters of a notebook's cell.
DEPTH, INLINE, CELL = 32, 50, 100_000
#: Fixed value: between the parts of a path.
STEP = " › "
#: XML: markup, what may hold a document type or entities, character references.
MARKUP = r"(?s)<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|<(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>"
DECLARES, REFERENCE = r"(?i)<!\s*(?:DOCTYPE|ENTITY)", r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


# --- JSON -----------------------------------------------------------------------------------------------------------


def _kind(v: Column) -> Column:
    """o, a or s: object, array, scalar."""
    told = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    return F.when(told.startswith("OBJECT"), "o").when(told.startswith("ARRAY"), "a").otherwise("s")


def _item(section: Column, path: Column, raw: Column, kind: Column) -> Column:
    return F.struct(section.alias("section"), path.alias("path"), F.coalesce(raw, F.lit("null")).alias("raw"), kind.alias("kind")).cast("struct<section:string,path:string,raw:string,kind:string>")


def _members(raw: Column, make) -> Column:
    """make(key, raw, kind) of an object's members, in the order of the text. Values are read twice: as text and as typed."""
    texts, values = F.map_entries(F.from_json(raw, "map<string,string>")), F.map_values(F.from_json(raw, "map<string,variant>"))
    return F.zip_with(texts, values, lambda e, v: make(e["key"], e["value"], _kind(v)))


def _elements(raw: Column, make) -> Column:
    """make(number from 1, raw, kind) of an array's elements."""
    pairs = F.zip_with(F.from_json(raw, "array<string>"), F.from_json(raw, "array<variant>"), lambda r, v: F.struct(r.alias("raw"), _kind(v).alias("kind")))
    return F.transform(pairs, lambda p, i: make(i + 1, p["raw"], p["kind"]))


def _opened(x: Column) -> Column:
    """An item's children; itself where it is a scalar; short lists of scalars become one."""
    inner = lambda step: lambda k, r, kind: _item(x["section"], F.concat(x["path"], *step(k)), r, kind)
    each = _elements(x["raw"], inner(lambda n: (F.lit(" ["), n.cast("string"), F.lit("]"))))
    plain = (F.size(each) > 0) & (F.size(each) <= INLINE) & ~F.exists(each, lambda y: y["kind"] != "s")
    joined = F.array(_item(x["section"], x["path"], F.array_join(F.transform(each, lambda y: y["raw"]), ", "), F.lit("s")))
    return F.when(x["kind"] == "o", _members(x["raw"], inner(lambda k: (F.lit(STEP), k)))).when(x["kind"] == "a", F.when(plain, joined).otherwise(each)).otherwise(F.array(x))


def nesting(text: Column) -> Column:
    """How deep the containers of a JSON text go."""
    signs = F.regexp_extract_all(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), F.lit(r"[\[\]{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        at = s["at"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(at.alias("at"), F.greatest(s["most"], at).alias("most"))

    return F.aggregate(signs, start, step, lambda s: s["most"])


def json_lines(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, section, line_no, line): each value of a JSON text as "path › to › key: value", in the text's order.

    A section is a top-level key, or "Item n" of a top-level array; a scalar is "Value". Lists of up to INLINE scalars are
    one line; empty containers none; containers below depth levels stand as they are written. White space is
    collapsed. An object that repeats a key is not read. A first look at the brackets tells how many levels the plan needs.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.try_parse_json(F.coalesce("text", F.lit(""))).alias("v")).filter("v IS NOT NULL")
    rows = rows.select("doc_id", "text", _kind(F.col("v")).alias("kind"), F.expr("try_variant_get(v, '$', 'string')").alias("scalar"))
    named = lambda label: lambda k, r, kind: _item(label(k), label(k), r, kind)
    top = (
        F.when(F.col("kind") == "o", _members(F.col("text"), named(lambda k: k)))
        .when(F.col("kind") == "a", _elements(F.col("text"), named(lambda n: F.concat(F.lit("Item "), n.cast("string")))))
        .otherwise(F.array(_item(F.lit("Value"), F.lit("Value"), F.col("scalar"), F.lit("s"))))
    )
    rows = rows.select("doc_id", top.alias("items"))
    deepest = docs.agg(F.max(nesting(F.coalesce("text", F.lit(""))))).first()[0] or 0
    for _ in range(min(depth, deepest - 1)):
        rows = rows.select("doc_id", F.flatten(F.transform("items", _opened)).alias("items"))
    each = rows.select("doc_id", F.posexplode_outer("items").alias("line_no", "x")).filter("x IS NOT NULL")
    return each.select("doc_id", T.label(F.col("x.section")).alias("section"), F.col("line_no").cast("long").alias("line_no"), T.collapse(F.concat("x.path", F.lit(": "), "x.raw")).alias("line"))


# --- XML ------------------------------------------------------------------------------------------------------------


def unescaped(text: Column) -> Column:
    """A text with its character references read; & comes last, so that nothing is read twice."""
    parts = F.split(text, REFERENCE, -1)
    code = lambda r: F.when(F.lower(F.substring(r, 3, 1)) == "x", F.conv(F.regexp_extract(r, "[0-9a-fA-F]+(?=;)", 0), 16, 10)).otherwise(F.regexp_extract(r, "[0-9]+", 0)).cast("long")
    known = lambda n: ((n > 0) & (n < 0xD800)) | ((n >= 0xE000) & (n < 0x110000))
    sign = lambda r: F.when(known(code(r)), F.decode(F.unhex(F.lpad(F.hex(code(r)), 8, "0")), "UTF-32")).otherwise(r)
    signs = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), sign)

    def names(part: Column) -> Column:
        for name, c in NAMED.items():
            part = F.replace(part, F.lit(name), F.lit(c))
        return part

    return F.array_join(F.flatten(F.transform(F.zip_with(parts, signs, lambda p, s: F.struct(p.alias("p"), s.alias("s"))), lambda x: F.array(names(x["p"]), F.coalesce(x["s"], F.lit(""))))), "")


def xml_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): the text of an XML document's elements, a line each, collapsed; attributes and comments go.

    Marked sections are read as they stand. A document type or an entity declaration is refused: it could name other files
    or grow without bound.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(~F.col("text").rlike(DECLARES))
    marked = F.transform(F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(MARKUP), F.lit(0))), lambda m: F.regexp_extract(m, r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1))
    cut = F.zip_with(marked, F.split("text", MARKUP, -1), lambda m, t: F.concat(m, F.lit("\n"), unescaped(t)))
    lines = F.filter(F.transform(F.split(F.array_join(cut, "\n"), "\n"), lambda x: T.collapse(x)), lambda x: x != "")
    each = rows.select("doc_id", F.posexplode_outer(lines).alias("line_no", "line")).filter("line IS NOT NULL")
    return each.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


# --- notebooks ------------------------------------------------------------------------------------------------------

NOTEBOOK = "struct<cells:array<struct<cell_type:string,source:variant>>,metadata:struct<kernelspec:struct<language:string,name:string>,language_info:struct<language:string,name:string>>>"


def notebook_markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a notebook as the Markdown it reads as; code cells are fenced in the kernel's language, outputs left out.

    A fence is longer than any run of backticks in its cell. Cells are cut at CELL characters. Notebooks without text are left out.
    """
    book = docs.select("doc_id", F.from_json(F.coalesce("text", F.lit("")), NOTEBOOK).alias("b"))
    told = [F.coalesce(F.nullif(F.col(f"b.metadata.{x}.language"), F.lit("")), F.col(f"b.metadata.{x}.name")) for x in ("kernelspec", "language_info")]
    language = F.coalesce(*[F.when(x.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), x) for x in told], F.lit(""))

    def block(c: Column) -> Column:
        source = F.coalesce(F.array_join(F.try_variant_get(c["source"], F.lit("$"), "array<string>"), ""), F.when(F.schema_of_variant(c["source"]) == "STRING", F.try_variant_get(c["source"], F.lit("$"), "string")), F.lit(""))
        body = F.substring(source, 1, CELL)
        runs = F.transform(F.regexp_extract_all(body, F.lit("`+"), F.lit(0)), lambda r: F.char_length(r))
        fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
        code = F.concat(fence, F.col("language"), F.lit("\n"), F.regexp_replace(body, r"\s+$", ""), F.lit("\n"), fence)
        return F.when(~body.rlike(r"\S"), None).when(c["cell_type"] == "markdown", F.regexp_replace(body, r"^\s+|\s+$", "")).when(c["cell_type"] == "code", code)

    rows = book.select("doc_id", language.alias("language"), F.filter("b.cells", lambda c: c.isNotNull()).alias("cells"))
    return rows.select("doc_id", F.array_join(F.filter(F.transform("cells", block), lambda x: x.isNotNull()), "\n\n").alias("text")).filter("text <> ''")


def problem(text: Column, suffix: str) -> Column:
    """Why a structured text can't be read; null if it can."""
    found = F.coalesce(text, F.lit(""))
    if suffix == "xml":
        return F.when(found.rlike(DECLARES), "declares a document type or entities").when(~found.rlike(r"<[A-Za-z_]"), "no element")
    if suffix == "ipynb":
        return F.when(F.from_json(found, NOTEBOOK)["cells"].isNull(), "no cells")
    return F.when(F.try_parse_json(found).isNull(), "not valid JSON, or a key is repeated")
