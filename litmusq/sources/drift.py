"""Rescue-column ingestion of JSON records whose fields drift from file to file.

``ingest`` enforces a target schema: a value that has its column's name and
JSON type becomes a typed value, everything else, nulls too, is kept as JSON
text by dotted path in the rescue column, so a record's fields are its typed
values and what was rescued.  ``changes`` compares each file of a stream with
the one before it by these two.  ``replay`` promotes the rescued fields that the
changes explain (renamed fields by their first name, numbers, flags and texts in
another shape) into the typed columns; what is still unknown stays in the rescue
column.

A field is the dotted path of a value that is no object; an empty object has
none.  Files delivered twice count once (the last delivery wins).  A payload
that is no JSON object has no fields and is rescued whole under ``$``, a null
one has nothing.  Rows with a null stream, file_seq or record_no are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmusq.plans.lineage import materialise

#: The target table: column path and type.
TARGET: dict[str, str] = {
    **dict.fromkeys(("scorer_id", "hypothesis", "lineage", "pareto_ineligible_reason", "validation_reason", "robustness_warning", "survived_because"), "string"),
    **dict.fromkeys(("execution_valid", "pareto_eligible"), "boolean"),
    "generation_round": "bigint",
    **dict.fromkeys(("train_accuracy", "train_margin", "test_accuracy", "test_margin", "adversarial_accuracy", "adversarial_margin", "score_spread", "exec_error_rate"), "double"),
    **{f"pair_type_accuracy.{t}": "double" for t in ("hype_trap", "fake_mechanism", "specificity_trap", "subtle_quality_gap", "source_drift")},
}
_JSON_KIND = {"string": "string", "boolean": "boolean", "bigint": "number", "double": "number"}
RECORD = ("stream", "file_seq", "record_no")
_LEAVES = "leaves array<struct<path:string,kind:string,value:string>>"


#: Levels of objects that are opened at first; deeper ones take as many again.
LEVELS = 3


def _number(value: Column) -> Column:
    """One text for a number however it was written; whole ones without a point."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def _leaf(path: Column, value: Column) -> Column:
    """(path, kind, value) of one JSON value; the value as JSON text."""

    def of(schema: Column) -> Column:
        kind = F.when(schema == "STRING", "string").when(schema == "VOID", "null").when(schema == "BOOLEAN", "boolean").when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").otherwise("number")
        plain = (schema == "STRING") | (schema == "BIGINT") | (schema == "BOOLEAN") | schema.startswith("OBJECT") | schema.startswith("ARRAY")
        text = F.when(schema == "VOID", "null").when(plain, F.to_json(value)).otherwise(F.coalesce(_number(F.try_variant_get(value, "$", "double")), F.to_json(value)))
        return F.struct(path.alias("path"), kind.alias("kind"), text.alias("value"))

    # a one-element transform names an intermediate value, so it is computed once
    return F.get(F.transform(F.array(F.coalesce(F.schema_of_variant(value), F.lit("VOID"))), of), 0)


def _opened(leaves: Column) -> Column:
    """Leaves with every object replaced by its fields, one level."""

    def of(x: Column) -> Column:
        inside = F.map_entries(F.try_parse_json(x["value"]).cast("map<string,variant>"))
        prefix = F.when(x["path"] == "", "").otherwise(F.concat(x["path"], F.lit(".")))
        return F.when(x["kind"] == "object", F.transform(inside, lambda e: _leaf(F.concat(prefix, e["key"]), e["value"]))).otherwise(F.array(x))

    return F.flatten(F.transform(leaves, of))


def opened(records: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(stream, file_seq, record_no, leaves): one row per record, its fields opened ``levels`` deep; deeper objects stay, of kind 'object'."""
    whole = records.where(F.col("stream").isNotNull() & F.col("file_seq").isNotNull() & F.col("record_no").isNotNull())
    one = whole.groupBy(*RECORD).agg(F.max_by("payload", F.struct("received_at", "written_at")).alias("payload"))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False))
    leaf = lambda kind, path, value: F.array(F.struct(F.lit(path).alias("path"), F.lit(kind).alias("kind"), value.alias("value")))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("payload").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    out = one.select(*RECORD, F.when(is_object, leaf("object", "", F.col("payload"))).when(F.col("payload").isNotNull(), leaf("corrupt", "$", quoted)).alias("leaves"))
    for _ in range(levels):
        out = out.withColumn("leaves", _opened(F.col("leaves")))
    return out


def ingested(records: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """The written table of ``ingest``, every object opened: read once more, deeper, where an object was rescued."""
    levels = LEVELS
    while True:
        table = materialise(ingest(opened(records, levels), target), "ingested")
        if table.where(F.exists(F.map_values("rescued"), lambda v: v.startswith("{"))).isEmpty():
            return table
        levels += LEVELS


def _text(value: Column) -> Column:
    """The text of a JSON string."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def _typed(value: Column, kind: Column, target: str, strict: bool) -> Column:
    """A typed value; not strict also reads other shapes: one-element arrays, numbers and flags in texts, lists of texts."""
    exact = F.when(kind == "string", _text(value)).otherwise(value)
    if strict:
        return F.when(kind == _JSON_KIND[target], exact.try_cast(target))
    items = F.from_json(value, "array<string>")
    if target == "string":
        return F.when(kind == "array", F.array_join(items, "; ")).when(kind != "null", exact)
    plain = F.when(kind == "array", F.when(F.size(items) == 1, F.get(items, 0))).otherwise(exact)
    return plain.try_cast(target)


def ingest(leaves: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """The typed columns of ``target`` (dots as two underscores) and ``rescued``, a map of path to JSON text."""
    target = target or TARGET
    by_path = F.map_from_entries(F.transform("leaves", lambda x: F.struct(x["path"], F.struct(x["kind"].alias("kind"), x["value"].alias("value")))))
    known = leaves.select(*RECORD, F.coalesce("leaves", F.array().cast(_LEAVES.split(" ", 1)[1])).alias("leaves")).withColumn("by_path", by_path)
    columns = []
    for path, kind in target.items():
        cell = F.try_element_at("by_path", F.lit(path))
        columns.append(_typed(cell["value"], cell["kind"], kind, True).alias(path.replace(".", "__")))
    fits = []
    for kind in sorted(set(target.values())):
        names = ", ".join(f"'{p}'" for p, k in target.items() if k == kind)
        whole = " AND try_cast(x.value AS bigint) IS NOT NULL" if kind == "bigint" else ""
        fits.append(f"(x.path IN ({names}) AND x.kind = '{_JSON_KIND[kind]}'{whole})")
    rest = F.expr(f"filter(leaves, x -> NOT ({' OR '.join(fits)}))")
    return known.select(*RECORD, *columns, F.map_from_entries(F.transform(rest, lambda x: F.struct(x["path"], x["value"]))).alias("rescued"))


#: Bits of the JSON types of a field's values; null has none.
_BITS = {"string": 1, "number": 2, "boolean": 4, "array": 8}


def _kind(text: Column) -> Column:
    """The JSON type of a rescued text."""
    first = F.substring(text, 1, 1)
    return F.when(first == '"', "string").when(first == "[", "array").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")


def cells(table: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """(stream, file_seq, record_no, scorer, path, kind, value) of every field of an ingested table, typed or rescued; texts plain."""
    typed = []
    for path, kind in (target or TARGET).items():
        c = F.col(path.replace(".", "__"))
        value = c if kind == "string" else _number(c) if kind == "double" else c.cast("string")
        typed.append(F.when(c.isNotNull(), F.struct(F.lit(path).alias("path"), F.lit(_JSON_KIND[kind]).alias("kind"), value.alias("value"))))
    kept = F.transform(F.map_entries(F.map_filter("rescued", lambda k, _: k != "$")), lambda e: F.struct(e["key"].alias("path"), _kind(e["value"]).alias("kind"), F.when(e["value"].startswith('"'), _text(e["value"])).otherwise(e["value"]).alias("value")))
    scorer = F.coalesce(F.col("scorer_id"), F.try_element_at("rescued", F.lit("scorer_id")))
    return table.select(*RECORD, scorer.alias("scorer"), F.explode(F.concat(F.array_compact(F.array(*typed)), kept)).alias("x")).select(*RECORD, "scorer", "x.*")


def _matched(pairs: Column) -> Column:
    """Renames among the fitting (unseen, new_field, field) of one step: most scorers first, then the smallest names; each name once, until no pair is left."""
    start = F.struct(F.array().cast("array<struct<field:string,new_field:string>>").alias("taken"), F.array().cast("array<string>").alias("old"), F.array().cast("array<string>").alias("new"))

    def add(acc: Column, p: Column) -> Column:
        used = F.array_contains(acc["old"], p["field"]) | F.array_contains(acc["new"], p["new_field"])
        more = F.struct(F.array_append(acc["taken"], F.struct(p["field"].alias("field"), p["new_field"].alias("new_field"))).alias("taken"), F.array_append(acc["old"], p["field"]).alias("old"), F.array_append(acc["new"], p["new_field"]).alias("new"))
        return F.when(used, acc).otherwise(more)

    return F.aggregate(F.array_sort(pairs), start, add, lambda acc: acc["taken"])


def changes(table: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """(stream, file_seq, change, field, new_field) of each file of an ingested table against the one before it in its stream.

    A field is renamed if it is gone, another has come, and every scorer with a
    value in both files has the same value under both names.  If several names
    qualify, the one with the most such scorers and then the smallest name is
    taken, and a name is used once; what is left over is matched on.
    """
    rows = cells(table, target)
    bit = F.lit(0)
    for kind, b in _BITS.items():
        bit = F.when(F.col("kind") == kind, b).otherwise(bit)
    has = materialise(rows.groupBy("stream", "file_seq", "path").agg(F.bit_or(bit).alias("kinds")), "fields")
    order = Window.partitionBy("stream").orderBy("file_seq")  # a row per file
    files = table.select("stream", "file_seq").distinct().withColumn("next", F.lead("file_seq").over(order)).withColumn("before", F.lag("file_seq").over(order))
    known = has.join(files, ["stream", "file_seq"])
    side = lambda at, new: F.struct(F.col(at).alias("at"), F.lit(new).alias("new"))
    steps = known.select("stream", "path", "kinds", F.explode(F.array_compact(F.array(F.when(F.col("before").isNotNull(), side("file_seq", True)), F.when(F.col("next").isNotNull(), side("next", False))))).alias("s"))
    kinds = lambda new: F.max(F.when(F.col("s.new") == new, F.col("kinds")))
    compared = steps.groupBy("stream", F.col("s.at").alias("file_seq"), "path").agg(kinds(False).alias("old"), kinds(True).alias("new"))
    differs = materialise(compared.where(F.col("old").isNull() | F.col("new").isNull() | ((F.col("old") != F.col("new")) & (F.col("old") > 0) & (F.col("new") > 0))), "differs")

    # values of the fields that are gone, from the file before, and of those that have come
    asked = differs.where("old IS NULL OR new IS NULL").join(files.select("stream", "file_seq", "before"), ["stream", "file_seq"])
    asked = asked.select("stream", F.col("file_seq").alias("at"), "path", F.col("new").isNotNull().alias("come"), F.when(F.col("new").isNull(), F.col("before")).otherwise(F.col("file_seq")).alias("file_seq"))
    valued = rows.where("kind <> 'null' AND scorer IS NOT NULL").join(asked, ["stream", "file_seq", "path"])
    cell = F.struct("path", "kind", "value")
    per = valued.groupBy("stream", "at", "scorer").agg(*[F.collect_list(F.when(F.col("come") == c, cell)).alias(n) for c, n in ((False, "gone"), (True, "came"))])  # a scorer's own fields of two files
    both = per.select("stream", "at", F.explode("gone").alias("g"), "came").select("stream", "at", "g", F.explode("came").alias("c"))
    fits = both.groupBy("stream", "at", F.col("g.path").alias("field"), F.col("c.path").alias("new_field")).agg(F.count(F.lit(1)).alias("seen"), F.bool_and((F.col("g.kind") == F.col("c.kind")) & (F.col("g.value") == F.col("c.value"))).alias("same")).where("same")
    renamed = fits.groupBy("stream", F.col("at").alias("file_seq")).agg(_matched(F.collect_list(F.struct((-F.col("seen")).alias("unseen"), "new_field", "field"))).alias("taken"))

    # every step's fields meet its renames: the gone one becomes the rename, the come one goes
    none = F.array().cast("array<struct<field:string,new_field:string>>")
    out = differs.join(renamed, ["stream", "file_seq"], "left").withColumn("taken", F.coalesce("taken", none))
    to = F.get(F.filter("taken", lambda r: r["field"] == F.col("path")), 0)["new_field"]
    change = F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), "type_changed").when(F.col("old").isNull(), "added").when(to.isNotNull(), "renamed").otherwise("removed")
    out = out.where(~(F.col("old").isNull() & F.exists("taken", lambda r: r["new_field"] == F.col("path"))))
    return out.select("stream", F.col("file_seq").cast("bigint").alias("file_seq"), change.alias("change"), F.col("path").alias("field"), F.when(change == "renamed", to).otherwise("").alias("new_field"))


def promotions(renames: DataFrame) -> DataFrame:
    """(stream, field, since, until, target): the first name of every renamed field, by file.

    Groups are the renames of one stream: as many as its files have of them.
    """

    import pandas as pd

    def trace(pdf):
        first: dict[str, str] = {}
        open_: dict[str, int] = {}
        rows = []
        for file_seq, old, new in sorted(zip(pdf["file_seq"], pdf["field"], pdf["new_field"])):
            origin = first.pop(old, old)
            if old in open_:
                rows.append((old, open_.pop(old), file_seq - 1, origin))
            first[new], open_[new] = origin, file_seq
        rows += [(name, since, 2**31 - 1, first[name]) for name, since in open_.items()]
        out = pd.DataFrame(rows, columns=["field", "since", "until", "target"])
        out.insert(0, "stream", pdf["stream"].iloc[0])
        return out

    return renames.groupBy("stream").applyInPandas(trace, "stream string, field string, since bigint, until bigint, target string")


def replay(table: DataFrame, found: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """``table`` with promoted rescued values in its typed columns, and the rest still rescued."""
    target = target or TARGET
    names = promotions(found.where("change = 'renamed'")).withColumnRenamed("stream", "p_stream").withColumnRenamed("field", "p_field")
    rescued = table.select(*RECORD, F.explode("rescued").alias("path", "value")).withColumn("kind", _kind(F.col("value")))
    mapped = rescued.join(names, (F.col("stream") == F.col("p_stream")) & (F.col("path") == F.col("p_field")) & F.col("file_seq").between(F.col("since"), F.col("until")), "left")
    mapped = mapped.withColumn("to", F.coalesce("target", "path")).where(F.col("to").isin(*target))
    value = {p: F.max(F.when(F.col("to") == p, _typed(F.col("value"), F.col("kind"), k, False))).alias(f"_{p.replace('.', '__')}") for p, k in target.items()}
    done = F.lit(None).cast("string")
    for p, k in target.items():
        done = F.when((F.col("to") == p) & ((F.col("kind") == "null") | _typed(F.col("value"), F.col("kind"), k, False).isNotNull()), F.col("path")).otherwise(done)
    wide = mapped.groupBy(*RECORD).agg(*value.values(), F.collect_set(done).alias("_done"))
    out = table.join(wide, list(RECORD), "left")
    typed = [F.coalesce(p.replace(".", "__"), f"_{p.replace('.', '__')}").alias(p.replace(".", "__")) for p in target]
    left = F.map_filter("rescued", lambda k, _: ~F.array_contains(F.coalesce("_done", F.array().cast("array<string>")), k))
    return out.select(*RECORD, *typed, left.alias("rescued"))


def consistent_table(records: DataFrame) -> DataFrame:
    """One row per record in the target schema, drift replayed, the rest in ``rescued``."""
    table = ingested(records)
    return replay(table, changes(table))
