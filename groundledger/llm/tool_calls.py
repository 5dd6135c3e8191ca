"""Linking of tool calls and results in chats, in DataFrame expressions only.

Calls and results meet by a hash join on conversation and call id. Calls name at most one earlier call whose result they
use; the depth of a call in that forest comes from pointer doubling, so a chain of n calls takes log2(n) joins. The order
by (depth, place, id) is topological and numbers the calls of a conversation without one task per conversation. Arguments
are checked against the schema of their tool, and every call becomes one line of canonical JSON: sorted keys, no blanks.

If an id is used by several calls of a conversation the first in place is the call and the others are ``duplicate``; they
have no result and no depth of their own. The first result in place is the call's; other results of the id and results
without a call are kept as ``extra`` and ``orphan`` rows. Exactly repeated rows count once. A named call that doesn't
exist makes a call a root and adds the error ``unknown_parent``; calls on or behind a cycle have the error ``cycle`` and
come last. Null conversation or call ids never link: such calls are ``unlinked``, such results ``orphan``. Null arguments,
text that is not JSON and JSON with repeated keys give ``not_json``. Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import chunk_of, dense_order
from .common import settle

#: JSON schema type -> how the types of variants begin.
TYPES = {"string": ("STRING",), "integer": ("BIGINT", "TINYINT", "SMALLINT", "INT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",),
         "number": ("BIGINT", "TINYINT", "SMALLINT", "INT", "DECIMAL", "DOUBLE", "FLOAT"), "object": ("OBJECT",), "null": ("VOID",)}


def _is(kind: Column, name: str) -> Column:
    out = F.lit(False)
    for t in TYPES[name]:
        out = out | kind.startswith(t)
    return out


def schema_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, dict]]) -> Column:
    """Sorted errors of a call. A schema maps an argument to ``type``, ``required``, ``enum``, ``minimum``, ``maximum``;
    arguments it doesn't name are errors."""
    v = F.try_parse_json(arguments)
    per_tool = F.when(~F.coalesce(name.isin(*schemas), F.lit(False)), F.array(F.lit("unknown_tool")))
    for tool, fields in schemas.items():
        checks = [F.transform(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, fields)).cast("array<string>")),
                              lambda k: F.concat(F.lit("unexpected:"), k))]
        for field, rule in fields.items():
            path = "$['" + field + "']"
            kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
            number = F.try_variant_get(v, path, "double")
            wrong = ~_is(kind, rule["type"])
            some = [F.when(kind.isNull(), F.lit(f"missing:{field}")) if rule.get("required") else F.lit(None).cast("string"),
                    F.when(wrong, F.lit(f"type:{field}"))]
            if "enum" in rule:
                some.append(F.when(~wrong & ~F.try_variant_get(v, path, "string").isin(*rule["enum"]), F.lit(f"enum:{field}")))
            if "minimum" in rule:
                some.append(F.when(~wrong & (number < rule["minimum"]), F.lit(f"minimum:{field}")))
            if "maximum" in rule:
                some.append(F.when(~wrong & (number > rule["maximum"]), F.lit(f"maximum:{field}")))
            checks.append(F.array_compact(F.array(*some)))
        per_tool = per_tool.when(name == tool, F.array_sort(F.concat(*checks)))
    shape = F.when(v.isNull(), F.array(F.lit("not_json"))).when(~F.schema_of_variant(v).startswith("OBJECT"), F.array(F.lit("not_object")))
    return F.coalesce(shape, per_tool)


def depths(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, depth, known_parent``; depth is null on or behind a cycle. Input: ``conv_id, call_id, parent``, one row per id."""
    parent = calls.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"))
    at = calls.join(parent, (calls["conv_id"] == F.col("_c")) & (calls["parent"] == F.col("_p")), "left")
    at = settle(at.select("conv_id", "call_id", F.col("_p").alias("ptr"), F.when(F.col("_p").isNull(), 0).otherwise(1).cast("long").alias("depth"),
                          (F.col("parent").isNull() | F.col("_p").isNotNull()).alias("known_parent")))
    rounds = max(1, math.ceil(math.log2(max(2, at.count()))) + 1)
    for _ in range(rounds):
        if at.where(F.col("ptr").isNotNull()).isEmpty():
            break
        up = at.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_n"), F.col("ptr").alias("_ptr"), F.col("depth").alias("_d"))
        next_ = at.join(up, (at["conv_id"] == F.col("_c")) & (at["ptr"] == F.col("_n")), "left")
        at = settle(next_.select("conv_id", "call_id", F.col("_ptr").alias("ptr"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"),
                                 "known_parent"))
    return at.select("conv_id", "call_id", F.when(F.col("ptr").isNull(), F.col("depth")).alias("depth"), "known_parent")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """``calls``: ``conv_id, place, call_id, name, arguments, parent``; ``results``: ``conv_id, place, call_id, content``.

    Gives ``conv_id, call_id, place, result_place, position, depth, status, errors, json``; ``position`` numbers the
    linked and waiting calls of a conversation from 1 in topological order.
    """
    key = ["conv_id", "call_id"]
    calls = settle(calls.select("conv_id", "place", "call_id", "name", "arguments", "parent").distinct())
    results = results.select("conv_id", "place", "call_id", "content").distinct()

    def firsts(df: DataFrame, rest: list[str]) -> DataFrame:
        best = F.min(F.struct("place", *rest)).alias("_first")
        return df.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy(*key).agg(best).select(*key, "_first.*")

    own = settle(firsts(calls, ["name", "arguments", "parent"]))
    answer = firsts(results, ["content"]).withColumnRenamed("place", "result_place").withColumnRenamed("content", "result")
    placed = own.join(answer, key, "left").join(depths(own), key)
    errors = F.concat(
        schema_errors(F.col("name"), F.col("arguments"), schemas),
        F.array_compact(F.array(F.when(~F.col("known_parent"), F.lit("unknown_parent")), F.when(F.col("depth").isNull(), F.lit("cycle")))),
    )
    placed = placed.withColumn("errors", errors).withColumn("status", F.when(F.col("result_place").isNull(), "waiting").otherwise("linked"))
    # the chunk grows along the order (depth, place), so no window holds a whole conversation
    level = F.struct(F.col("depth").isNull().alias("cycle"), F.coalesce("depth", F.lit(0)).alias("depth"))
    chunk = F.struct(level.alias("level"), F.coalesce(chunk_of("place"), F.lit(-1)).alias("part"))
    numbered = dense_order(settle(placed), ["conv_id"], [level, "place", "call_id"], chunk, "position")
    shown = [*key, "place", "result_place", "position", "depth", "status", "errors", "json"]
    line = F.to_json(F.struct(
        F.try_parse_json("arguments").alias("arguments"), "call_id", "errors", "name", "parent", "result", "status",
    ), {"ignoreNullFields": "false"})
    numbered = numbered.withColumn("json", line).select(*shown)

    def rest(df: DataFrame, kept: DataFrame, fields: list[str], status: Column) -> DataFrame:
        same = [df[c].eqNullSafe(kept[c]) for c in [*key, "place", *fields]]
        cond = same[0]
        for x in same[1:]:
            cond = cond & x
        none = lambda t: F.lit(None).cast(t)
        left = df.join(kept, cond, "left_anti")
        return left.withColumn("_status", status).select(
            *key, "place", none("long").alias("result_place"), none("long").alias("position"), none("long").alias("depth"),
            F.col("_status").alias("status"), F.array().cast("array<string>").alias("errors"), none("string").alias("json"))

    spare = rest(calls, own, ["name", "arguments", "parent"], F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "unlinked").otherwise("duplicate"))
    taken = answer.join(own.select(*key), key, "left_semi").withColumnRenamed("result_place", "place").withColumnRenamed("result", "content")
    known = own.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.lit(True).alias("_known"))
    left = results.join(known, (F.col("conv_id") == F.col("_c")) & (F.col("call_id") == F.col("_i")), "left").drop("_c", "_i")
    lost = rest(left, taken, ["content"], F.when(F.col("_known"), "extra").otherwise("orphan"))
    lost = lost.withColumn("result_place", F.col("place")).withColumn("place", F.lit(None).cast("long"))
    return numbered.unionByName(spare).unionByName(lost)
