"""Models' answers of any shape, read by contract: items, issues with reasons, ids to ask for again.

Answers are parsed as variants, so that no schema is needed; a mode's contract
says under which name its items stand, and of which kind each field is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """``fields`` by kind: text, number or list; ``key`` names the request's item, ``said`` may not be empty; ``cites`` lists request items."""

    envelope: str
    fields: dict[str, str]
    key: str | None = None
    said: tuple[str, ...] = ()
    cites: str | None = None


#: The contracts of the modes; names are fixed values.
MODES = {
    "translation": Contract("translations", {"id": "text", "translation": "text"}, key="id", said=("translation",)),
    "revision": Contract("revisions", {"id": "text", "translation": "text", "reason": "text"}, key="id", said=("translation",)),
    "keyword": Contract("candidates", {"source": "text", "suggested_target": "text", "category": "text", "confidence": "number", "evidence": "text", "source_item_ids": "list"}, said=("source",), cites="source_item_ids"),
}


def kind(v: Column) -> Column:
    """What a variant holds: text, number, flag, list, object or none."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v) | (s == "VOID"), "none").when(s == "STRING", "text").when(s.startswith("ARRAY"), "list").when(s.startswith("OBJECT"), "object").when(s == "BOOLEAN", "flag").otherwise("number")
    )


def _parsed(answers: DataFrame, c: Contract) -> DataFrame:
    """Adds ``v``, the items' variant ``held``, whether the answer is a bare list, and the answer's own ``issue``."""
    rows = answers.withColumn("v", F.try_parse_json("answer"))
    rows = rows.withColumn("bare", F.coalesce(kind(F.col("v")) == "list", F.lit(False)))
    rows = rows.withColumn("held", F.when(F.col("bare"), F.col("v")).when(kind(F.col("v")) == "object", F.try_variant_get("v", f"$.{c.envelope}", "variant")))
    issue = F.when(F.col("v").isNull(), "not_json").when(F.col("held").isNull(), "envelope_missing").when(kind(F.col("held")) != "list", "items_not_array")
    return rows.withColumn("issue", issue)


def read_answers(answers: DataFrame, mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``items``, ``issues`` and ``retry`` of answers ``(request_id, expected, answer)``.

    ``expected`` are the ids that the request asked for. ``items`` are
    ``(request_id, index, fields)``, a map of the contract's fields (lists as
    JSON); of items with one id the first counts. ``issues`` are ``(request_id,
    index, field, code)``: of an answer (``not_json``, ``envelope_missing``,
    ``items_not_array``; index null), of an item (``item_not_object``,
    ``missing_field``, ``wrong_type``, ``empty_field``, ``unknown_id``,
    ``duplicate_id``), the first in that order. ``retry`` are ``(request_id,
    id)`` of expected ids without an item (of modes without key: all, if the
    answer has an issue).
    """
    c = MODES[mode]
    rows = _parsed(answers, c)
    each = rows.filter("issue IS NULL").select("request_id", "expected", F.posexplode(F.try_variant_get("held", "$", "array<variant>")).alias("index", "item"))
    got = {f: F.try_variant_get("item", f"$.{f}", "variant") for f in c.fields}
    each = each.withColumns({"kind": kind(F.col("item"))} | {f"k_{f}": kind(v) for f, v in got.items()} | {f"t_{f}": F.when(kind(v) == "text", v.cast("string")).otherwise(F.to_json(v)) for f, v in got.items()})
    none = F.lit(None).cast("string")
    problem = lambda code, field=None: F.struct(F.lit(code).alias("code"), (F.lit(field) if field else none).alias("field"))
    tests = [F.when(F.col("kind") != "object", problem("item_not_object"))]
    tests += [F.when(F.col(f"k_{f}") == "none", problem("missing_field", f)) for f in c.fields]
    tests += [F.when(F.col(f"k_{f}") != k, problem("wrong_type", f)) for f, k in c.fields.items()]
    tests += [F.when(F.trim(f"t_{f}") == "", problem("empty_field", f)) for f in c.said]
    if c.key:
        tests.append(F.when(~F.array_contains("expected", F.trim(f"t_{c.key}")), problem("unknown_id", c.key)))
    if c.cites:
        cited = F.from_json(f"t_{c.cites}", "array<string>")
        tests += [F.when(F.size(cited) == 0, problem("empty_field", c.cites)), F.when(F.size(F.array_except(cited, "expected")) > 0, problem("unknown_id", c.cites))]
    each = each.withColumn("problem", F.coalesce(*tests))
    if c.key:
        # A window and no join with itself, so that answers are parsed once for it.
        each = each.withColumn("__key", F.trim(f"t_{c.key}"))
        each = each.withColumn("__first", F.min(F.when(F.col("problem").isNull(), F.col("index"))).over(Window.partitionBy("request_id", "__key")))
        again = F.col("problem").isNull() & (F.col("index") != F.col("__first"))
        each = each.withColumn("problem", F.when(again, problem("duplicate_id", c.key)).otherwise(F.col("problem")))
    fields = F.map_from_arrays(F.array(*map(F.lit, c.fields)), F.array(*[F.col(f"t_{f}") for f in c.fields]))
    items = each.filter("problem IS NULL").select("request_id", "index", fields.alias("fields"))
    own = rows.filter("issue IS NOT NULL").select("request_id", F.lit(None).cast("int").alias("index"), none.alias("field"), F.col("issue").alias("code"))
    issues = own.unionByName(each.filter("problem IS NOT NULL").select("request_id", "index", "problem.field", "problem.code"))
    asked = rows.select("request_id", F.explode(F.array_distinct("expected")).alias("id"))
    if c.key:
        retry = asked.join(items.select("request_id", F.trim(F.col("fields")[c.key]).alias("id")), ["request_id", "id"], "left_anti")
    else:
        retry = asked.join(issues.select("request_id").distinct(), "request_id", "left_semi")
    return items, issues, retry


def project(answers: DataFrame, paths: dict[str, str], column: str = "answer") -> DataFrame:
    """The answers with a column for each ``name: path`` (such as ``$.usage.total``), as text; null where the path leads nowhere."""
    v = F.try_parse_json(column)
    return answers.withColumns({n: F.try_variant_get(v, p, "string") for n, p in paths.items()})
