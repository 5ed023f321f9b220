"""Files whose layout drifts, read as one table, with every change of layout by file.

Every line is read once and taken apart in the JVM: delimited text by each separator that it contains
(the file's own is the one of its header, which meets the records in the aggregation and in no join),
JSON objects by their top-level names. Cells combine to (file, place, shape) counts where they are read,
a shape being the text with its digits alike; what texts look like is then asked once per shape. Shapes
fold to (file, name) facts and facts through the type lattice

    integer -> decimal -> string <- boolean

Names are matched to the contract's fields within their feed and by content (``name_fields``). Comparing
a file with the one before is a union of both files' facts and one aggregation. What is kept per feed
is one row per file and field, never per record.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.sources.session import cut

# The contract's fields, each with its class.
CONTRACT = {"order_id": "string", "customer_id": "string", "product_id": "string", "order_status": "string", "quantity": "integer", "unit_price": "decimal", "currency": "string", "order_timestamp": "string"}
# What a field's values look like, as a whole and in any case.
CONTENT = {
    "order_id": r"ORD-?[0-9]+",
    "customer_id": r"CUST-?[0-9]+",
    "product_id": r"PROD-?[0-9]+",
    "order_status": r"pending|confirmed|shipped|delivered|cancelled|returned|refunded",
    "currency": r"USD|EUR|GBP|INR|JPY|CAD|AUD|840|978|826|356|392|124|0?36",
    "order_timestamp": r"[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}([ T][0-9:.]+Z?)?|[0-9]{2}[./][0-9]{2}[./][0-9]{4}([ T][0-9:.]+)?",
    "quantity": r"[0-9]+(\.0+)?|x ?[0-9]+|[0-9]+ ?(pcs|units|pieces|items)\.?|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve",
    "unit_price": r"[0-9]+\.[0-9]+|[0-9]+|[0-9]+([.,][0-9]+)? ?[A-Z]{3}|[A-Z]{3} ?[0-9]+([.,][0-9]+)?|[$€£] ?[0-9]+([.,][0-9]+)?|[0-9]+,[0-9]+",
}
# Parts of names that speak for a field whose values are plain numbers.
HINTS = {"quantity": "qty|quant|unit|item|piece|count|pcs", "unit_price": "price|cost|rate"}
SEPARATORS = [",", ";", "|", "\t"]
#: More than this share of the values under a name must look like a field's.
ALIKE_SHARE = 0.5
#: Share of values that must be numbers to be compared as such.
NUMBER_SHARE = 0.8
#: How far the mean logarithm, and the share of values with a point, of like numbers lie apart at most.
LIKE_MAGNITUDE, LIKE_POINTS = 0.7, 0.5
MAX_FIELDS = 10_000


def normal_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def _separator(header: Column) -> Column:
    """The separator that a header contains most often; the first of SEPARATORS on ties."""
    counts = [F.struct((F.length(header) - F.length(F.replace(header, F.lit(s), F.lit("")))).alias("n"), F.lit(-i).alias("first"), F.lit(s).alias("sep")) for i, s in enumerate(SEPARATORS)]
    return F.greatest(*counts)["sep"]


def _split(line: Column, sep: str) -> Column:
    """The cells of a delimited line; double quotes guard separators and themselves."""
    of = re.escape(sep)
    cells = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{of}("(?:[^"]|"")*"|[^{of}]*)'), F.lit(1))
    guarded = F.transform(cells, lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(F.contains(line, F.lit('"')), guarded).otherwise(F.split(line, of, -1))


def _lines(lines: DataFrame) -> DataFrame:
    """Lines that hold something, of a known file; ``fmt`` in lower case."""
    return lines.select("file_id", F.lower(F.trim("fmt")).alias("fmt"), "line_no", "raw_line").where("file_id is not null and raw_line is not null and trim(raw_line) <> ''")


def _objects(line: Column) -> Column:
    """The top-level (key, value) pairs of a JSON object; null for other lines."""
    return F.map_entries(F.from_json(line, "map<string,variant>"))


def _variant_text(value: Column) -> Column:
    """A JSON value as text: strings without quotes and escapes, objects and arrays as JSON, null as null."""
    return F.call_function("try_variant_get", value, F.lit("$"), F.lit("string"))


def _variant_bit(kind: Column) -> Column:
    """The class of a JSON value by the name of its type."""
    return (
        F.when(kind.isNull() | (kind == "VOID"), F.lit(None).cast("int"))
        .when(kind == "STRING", BITS["string"])
        .when(kind == "BIGINT", BITS["integer"])
        .when(kind == "BOOLEAN", BITS["boolean"])
        .when(F.regexp_like(kind, F.lit(r"\ADECIMAL\((19|[23][0-9]),0\)\z")), BITS["integer"])  # beyond a long
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), BITS["decimal"])
        .otherwise(BITS["string"])
    )


# The bit that stands for a class.
BITS = {"integer": 1, "decimal": 2, "boolean": 4, "string": 8}


def _class_bit(text: Column) -> Column:
    """The class of a delimited value; all digits may be alike."""
    return (
        F.when(text.isNull(), F.lit(None).cast("int"))
        .when(F.regexp_like(text, F.lit(r"\A[+-]?[0-9]+\z")), BITS["integer"])
        .when(F.regexp_like(text, F.lit(r"\A[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")), BITS["decimal"])
        .when(F.lower(text).isin("true", "false"), BITS["boolean"])
        .otherwise(BITS["string"])
    )


def join_class(bits: Column) -> Column:
    """The least upper bound of a set of classes, given as bits; null if it is empty."""
    return F.when(bits == 1, "integer").when(bits.isin(2, 3), "decimal").when(bits == 4, "boolean").when(bits > 0, "string")


def _class_of(bits: Column) -> Column:
    """The bit of the joined class, so that classes join over files as they do over cells."""
    return F.when(bits.isin(1, 2, 4), bits).when(bits == 3, 2).when(bits > 0, BITS["string"])


#: What marks the place of a delimited cell (separator and number) among the names of JSON values.
_PLACE = "\x01"


def _cells(lines: DataFrame) -> DataFrame:
    """(file_id, place, text, bit, header, own): every cell. ``header`` is the name that a header gives to
    the place, ``own`` whether its separator is the file's; ``bit`` is the class of JSON values."""
    line, is_header, csv = F.col("raw_line"), F.col("line_no") == 1, F.col("fmt") == "csv"
    single = ~F.rlike(line, F.lit("[" + "".join(map(re.escape, SEPARATORS)) + "]"))
    no_cells, no_pairs = F.lit(None).cast("array<string>"), F.lit(None).cast("array<struct<key:string,value:variant>>")
    splits = [F.when(csv & (F.contains(line, F.lit(sep)) | single), F.struct(F.lit(i).alias("i"), _split(line, sep).alias("cells"), no_pairs.alias("pairs"))) for i, sep in enumerate(SEPARATORS)]
    objects = F.when(F.col("fmt") == "json", F.struct(F.lit(-1).alias("i"), no_cells.alias("cells"), _objects(line).alias("pairs")))
    # small generators, whose rows are then worked on in compiled code
    taken = (
        _lines(lines)
        .select("file_id", is_header.alias("_header"), F.when(is_header & csv, _separator(line)).alias("_sep"), F.explode(F.array_compact(F.array(*splits, objects))).alias("_g"))
        .select("file_id", "_header", "_sep", "_g.i", "_g.pairs", F.posexplode_outer("_g.cells").alias("_at", "_cell"))
        .select("file_id", "_header", "_sep", "i", "_at", "_cell", F.explode_outer("pairs").alias("_pair"))
        .where("_cell is not null or _pair is not null")
        .select("*", F.trim(F.coalesce("_cell", _variant_text(F.col("_pair.value")))).alias("_text"), F.schema_of_variant("_pair.value").alias("_kind"))
    )
    delimited, title = F.col("i") >= 0, (F.col("i") >= 0) & F.col("_header")
    own = F.lit(None).cast("boolean")
    for i, sep in enumerate(SEPARATORS):
        own = F.when(title & (F.col("i") == i), F.col("_sep") == sep).otherwise(own)
    return taken.select(
        "file_id",
        F.when(delimited, F.concat(F.lit(_PLACE), F.col("i").cast("string"), F.lit(_PLACE), F.col("_at").cast("string"))).otherwise(normal_name(F.col("_pair.key"))).alias("place"),
        F.when(~title & (~delimited | (F.col("_text") != "")), F.col("_text")).alias("text"),
        F.when(~delimited, _variant_bit(F.col("_kind"))).alias("bit"),
        F.when(title, normal_name(F.col("_cell"))).alias("header"),
        own.alias("own"),
    )


def _shape(text: Column) -> Column:
    """The text with its digits alike; short texts, among them number codes, as they are."""
    return F.when(F.length(text) <= 3, text).otherwise(F.translate(text, "0123456789", "9" * 10))


def file_names(lines: DataFrame) -> DataFrame:
    """(file_id, name, class, value_count, like_<field>..., numbers, points, magnitude) per file and name.

    ``lines`` has file_id, fmt, line_no, raw_line; other columns play no part. A delimited file's header is
    its first line (``line_no`` 1); records without the header's separator, and cells beyond the header,
    give nothing. class is a bit, like_<field> counts the values that look like that field's; of the
    values that are numbers, how many there are, how many have a point, and the sum of their logarithms.
    JSON values in objects or arrays are texts of the top-level name. Blank lines, rows with a null file
    or line, and what is no JSON object give nothing.
    """
    # texts that are no numbers are kept from the cast, which fails slowly
    size = F.when(F.rlike(F.col("text"), F.lit(r"\A[+-]?[0-9]{0,15}[.]?[0-9]{1,15}\z")), F.col("text").try_cast("double"))
    shapes = (
        _cells(lines)
        .withColumns({"_shape": _shape(F.col("text")), "_size": F.log1p(F.abs(size))})
        .groupBy("file_id", "place", "bit", "_shape", "header")  # counted by hash: a least header would be by sort
        .agg(F.count("text").alias("n"), F.max("own").alias("own"), F.count("_size").alias("numbers"), F.sum("_size").alias("magnitude"))
    )
    likes = [F.sum(F.when(F.regexp_like("_shape", F.lit(rf"(?i)\A({p})\z")), F.col("n")).otherwise(0)).alias(f"like_{f}") for f, p in CONTENT.items()]
    sums = [f"like_{f}" for f in CONTENT] + ["value_count", "numbers", "points", "magnitude"]
    placed = (
        shapes.withColumns({"_class": F.coalesce("bit", _class_bit(F.col("_shape"))), "_points": F.when(F.contains("_shape", F.lit(".")), F.col("numbers")).otherwise(0)})
        .groupBy("file_id", "place")
        .agg(F.min("header").alias("header"), F.max("own").alias("own"), F.bit_or("_class").alias("_classes"), F.sum("n").alias("value_count"), F.sum("numbers").alias("numbers"), F.sum("_points").alias("points"), F.coalesce(F.sum("magnitude"), F.lit(0.0)).alias("magnitude"), *likes)
    )
    named = placed.where(~F.col("place").startswith(_PLACE) | F.col("own")).withColumn("name", F.when(F.col("place").startswith(_PLACE), F.col("header")).otherwise(F.col("place"))).where("name <> ''")
    return named.groupBy("file_id", "name").agg(F.bit_or("_classes").alias("_classes"), *[F.sum(c).alias(c) for c in sums]).withColumn("class", _class_of(F.col("_classes"))).drop("_classes")


def _told(values: str, prefix: str) -> dict[str, Column]:
    """field -> whether enough of ``values`` look like that field's."""
    return {f: (F.col(values) > 0) & (F.col(f"{prefix}{f}") > F.lit(ALIKE_SHARE) * F.col(values)) for f in CONTRACT}


def _spoken(names: DataFrame) -> DataFrame:
    """(feed, name, field): the names whose content or wording tells the field, feed by feed.

    Keys, statuses, currencies and times are told by their values: those in the feed, or where a feed has
    none under the name, those of all feeds. Plain numbers are told by their name's wording, if most
    values are numbers or look like the field's. No name stands for a field that stands beside it in a file of the feed.
    """
    fields = list(CONTRACT)
    own = names.where(F.col("name").isin(fields)).groupBy("file_id").agg(F.collect_set("name").alias("_own"))
    others = names.where(~F.col("name").isin(fields)).join(own, "file_id", "left")
    sums = [F.sum("value_count").alias("value_count"), F.sum("numbers").alias("numbers"), *[F.sum(f"like_{f}").alias(f"like_{f}") for f in fields]]
    here = others.groupBy("feed", "name").agg(*sums, *[F.max(F.coalesce(F.array_contains("_own", f), F.lit(False))).alias(f"with_{f}") for f in fields])
    everywhere = here.groupBy("name").agg(F.sum("value_count").alias("all_count"), *[F.sum(f"like_{f}").alias(f"all_{f}") for f in fields])
    both = here.join(everywhere, "name")
    feed, anywhere = _told("value_count", "like_"), _told("all_count", "all_")
    field: Column = F.lit(None).cast("string")
    for f in [*HINTS, *(f for f in reversed(fields) if f not in HINTS)]:  # the last that fits counts: content before wording
        if f in HINTS:
            rivals = [F.regexp_like("name", F.lit(h)) for g, h in HINTS.items() if g != f]
            fits = F.regexp_like("name", F.lit(HINTS[f])) & ((F.greatest("numbers", f"like_{f}") > F.lit(ALIKE_SHARE) * F.col("value_count")) | (F.col("value_count") == 0))
            for rival in rivals if f != next(iter(HINTS)) else []:  # a name that speaks for both is the first's
                fits = fits & ~rival
        else:
            fits = feed[f] | ((F.col("value_count") == 0) & anywhere[f])
        field = F.when(fits & ~F.col(f"with_{f}"), F.lit(f)).otherwise(field)
    return both.select("feed", "name", field.alias("field"), *[f"with_{f}" for f in HINTS])


def name_fields(names: DataFrame) -> DataFrame:
    """(feed, name, field): for every name that is no field's own, the field whose content it carries.

    ``names`` has the facts of ``file_names`` with feed and next_file. Where neither content nor wording
    tells (``_spoken``), a name of plain numbers stands for the field that vanishes in the file in which
    it first comes, if its numbers are like those of that field in the file before: of like magnitude
    and as often with a point. Only files of the feed count, whatever their number.
    """
    spoken = _spoken(names)
    resolved = names.join(spoken.select("feed", "name", F.col("field").alias("_spoken")), ["feed", "name"], "left").withColumn("_field", F.when(F.col("name").isin(list(CONTRACT)), F.col("name")).otherwise(F.col("_spoken")))
    held = resolved.groupBy("file_id").agg(F.collect_set("_field").alias("_fields"), F.collect_set("name").alias("_names"))
    measures = [F.col("magnitude") / F.col("numbers"), F.col("points") / F.col("numbers")]
    before = resolved.where(F.col("_field").isin(list(HINTS)) & (F.col("numbers") > 0) & F.col("next_file").isNotNull()).select(F.col("next_file").alias("file_id"), F.col("file_id").alias("_last"), F.col("_field").alias("_gone"), measures[0].alias("_m"), measures[1].alias("_p"))
    new = resolved.where("_field is null and numbers > 0").select("feed", "file_id", "name", "numbers", "magnitude", "points", "value_count")
    turns = new.join(before, "file_id").join(held.select("file_id", F.col("_fields").alias("_now")), "file_id").join(held.select(F.col("file_id").alias("_last"), F.col("_names").alias("_then")), "_last")
    alike = (F.abs(measures[0] - F.col("_m")) <= LIKE_MAGNITUDE) & (F.abs(measures[1] - F.col("_p")) <= LIKE_POINTS) & (F.col("numbers") >= F.lit(NUMBER_SHARE) * F.col("value_count"))
    turned = turns.where(~F.array_contains("_now", F.col("_gone")) & ~F.array_contains("_then", F.col("name")) & alike).groupBy("feed", "name").agg(F.min("_gone").alias("_turned"))
    out = spoken.join(turned, ["feed", "name"], "left")
    beside = F.lit(False)
    for f in HINTS:
        beside = F.when(F.col("_turned") == f, F.col(f"with_{f}")).otherwise(beside)
    return out.select("feed", "name", F.coalesce("field", F.when(~beside, F.col("_turned")), "name").alias("field"))


def file_fields(names: DataFrame) -> DataFrame:
    """(file_id, name, field, class): each file's fields under the names it uses."""
    resolved = names.select("feed", "file_id", "name", "class").join(name_fields(names), ["feed", "name"], "left")
    return resolved.select("file_id", "name", F.coalesce("field", "name").alias("field"), "class")


def file_order(lines: DataFrame) -> DataFrame:
    """(file_id, feed, file_seq, next_file, is_first), a row per file; files without feed are a feed."""
    files = lines.where("file_id is not null").groupBy("file_id").agg(F.coalesce(F.min("feed"), F.lit("")).alias("feed"), F.min("file_seq").alias("file_seq"))
    of_feed = Window.partitionBy("feed").orderBy("file_seq", "file_id")
    return files.withColumn("next_file", F.lead("file_id").over(of_feed)).withColumn("is_first", F.row_number().over(of_feed) == 1)


def file_facts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``file_order``, ``file_names`` with feed and next_file), both cut: the lines are read once each."""
    files = cut(file_order(lines))
    return files, cut(file_names(lines).join(files.select("file_id", "feed", "next_file"), "file_id"))


def layout_changes(lines: DataFrame) -> DataFrame:
    """(feed, file_seq, file_id, field_name, change_kind, before, after), one row per change.

    ``lines`` has feed, file_seq and the columns of ``file_names``. A feed's first file is compared
    with the contract. A field without values keeps the class it had. An empty table gives no rows.
    """
    files, names = file_facts(lines)
    contract = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(c).alias("class")) for f, c in CONTRACT.items()])
    start = files.where("is_first").select("feed", F.lit(None).cast("int").alias("file_seq"), F.lit(None).cast("bigint").alias("file_id"), F.col("file_id").alias("next_file"), F.explode(contract).alias("_c")).select("feed", "file_seq", "file_id", "next_file", F.col("_c.field").alias("name"), F.col("_c.field").alias("field"), F.col("_c.class").alias("class"))
    own = file_fields(names).groupBy("file_id", "field").agg(F.min("name").alias("name"), F.bit_or("class").alias("_classes")).withColumn("class", join_class(F.col("_classes"))).join(files.select("file_id", "feed", "file_seq", "next_file"), "file_id")
    kept = Window.partitionBy("feed", "field").orderBy(F.col("file_seq").asc_nulls_first(), "file_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    facts = start.unionByName(own.select(*start.columns)).withColumn("class", F.last("class", ignorenulls=True).over(kept))
    now = facts.where("file_id is not null").select("file_id", "field", F.struct("name", "class").alias("now"), F.lit(None).cast("struct<name:string,class:string>").alias("was"))
    was = facts.where("next_file is not null").select(F.col("next_file").alias("file_id"), "field", F.lit(None).cast("struct<name:string,class:string>").alias("now"), F.struct("name", "class").alias("was"))
    pair = now.unionByName(was).groupBy("file_id", "field").agg(F.max("now").alias("now"), F.max("was").alias("was"))
    there, before = F.col("now.name").isNotNull(), F.col("was.name").isNotNull()
    kinds = F.array_compact(
        F.array(
            F.when(there & ~before, F.lit("added")),
            F.when(~there & before, F.lit("removed")),
            F.when(there & before & (F.col("now.name") != F.col("was.name")), F.lit("renamed")),
            F.when(there & before & (F.col("now.class") != F.col("was.class")), F.lit("retyped")),
        )
    )
    told = pair.select("file_id", F.col("field").alias("field_name"), F.explode(kinds).alias("change_kind"), F.to_json("was").alias("before"), F.to_json("now").alias("after"))
    return told.join(files.select("file_id", "feed", "file_seq"), "file_id").select("feed", "file_seq", "file_id", "field_name", "change_kind", "before", "after")


def union_schema(lines: DataFrame) -> dict[str, str]:
    """Field -> class over all files, contract first."""
    return folded_schema(file_fields(file_facts(lines)[1]))


def folded_schema(resolved: DataFrame) -> dict[str, str]:
    """The fold of all files' fields. One row per field reaches the driver; more than MAX_FIELDS raise
    an error."""
    fold = resolved.groupBy("field").agg(F.bit_or("class").alias("_c")).select("field", F.coalesce(join_class(F.col("_c")), F.lit("string")).alias("class"))
    found = {r["field"]: r["class"] for r in fold.orderBy("field").limit(MAX_FIELDS + 1).collect()}
    if len(found) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields")
    for field, kind in CONTRACT.items():
        if field not in found:
            found[field] = kind
    return {f: found[f] for f in [*CONTRACT, *sorted(set(found) - set(CONTRACT))]}


# The Spark type that carries a class. Decimals keep their digits.
TYPES = {"integer": "bigint", "decimal": "decimal(38,10)", "boolean": "boolean", "string": "string"}


def read_consistent(lines: DataFrame, schema: dict[str, str] | None = None) -> DataFrame:
    """All records of all files under one schema: file_id, line_no, one column per field, and
    ``unfit_fields``: the fields, comma separated, whose text the schema's type does not hold.

    Files delivered twice count once; of two different records of one line the first in the order of
    their text. A record whose file lacks a field has null there.
    """
    files, names = file_facts(lines)
    resolved = cut(file_fields(names))
    schema = schema or folded_schema(resolved)
    once = _lines(lines).groupBy("file_id", "line_no").agg(F.min("raw_line").alias("raw_line"), F.min("fmt").alias("fmt"))
    # one row per file: its separator, the names of its places, and the fields of its names
    fields = resolved.groupBy("file_id").agg(F.map_from_entries(F.collect_set(F.struct("name", "field"))).alias("_fields"))
    headers = once.where("fmt = 'csv' and line_no = 1").withColumn("_sep", _separator(F.col("raw_line"))).select("file_id", "_sep", F.transform(_by_separator(F.col("raw_line")), normal_name).alias("_names"))
    record = once.where("fmt = 'json' or (fmt = 'csv' and line_no <> 1)").join(fields, "file_id").join(headers, "file_id", "left")
    line, csv = F.col("raw_line"), F.col("fmt") == "csv"
    delimited = F.filter(F.zip_with("_names", _by_separator(line), lambda n, t: F.struct(n.alias("n"), F.when(F.trim(t) != "", t).alias("t"))), lambda e: e["n"].isNotNull())
    objects = F.transform(_objects(line), lambda e: F.struct(normal_name(e["key"]).alias("n"), _variant_text(e["value"]).alias("t")))
    pairs = F.coalesce(F.when(csv, delimited).otherwise(objects), F.array().cast("array<struct<n:string,t:string>>"))
    named = F.filter(F.transform(pairs, lambda e: F.struct(F.element_at("_fields", e["n"]).alias("f"), e["t"].alias("t"))), lambda e: e["f"].isNotNull() & e["t"].isNotNull())
    # of two cells of one field the first in the order of names counts
    held = record.select("file_id", "line_no", F.map_from_entries(F.filter(named, lambda e, i: ~F.exists(F.slice(named, F.lit(1), i), lambda x: x["f"] == e["f"]))).alias("_m"))
    text = {f: F.try_element_at("_m", F.lit(f)) for f in schema}
    typed = {f: (text[f] if c == "string" else F.trim(text[f])).try_cast(TYPES[c]) for f, c in schema.items()}
    unfit = F.array_compact(F.array(*[F.when(text[f].isNotNull() & typed[f].isNull(), F.lit(f)) for f in schema]))
    return held.select("file_id", "line_no", *[v.alias(f) for f, v in typed.items()], F.array_join(unfit, ",").alias("unfit_fields"))


def _by_separator(line: Column) -> Column:
    """The cells of a line by the separator in ``_sep``."""
    out = _split(line, SEPARATORS[0])
    for sep in SEPARATORS[1:]:
        out = F.when(F.col("_sep") == sep, _split(line, sep)).otherwise(out)
    return out
