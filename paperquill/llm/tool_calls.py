"""Tool-call linking with DataFrame functions only.

Calls are joined with their results by identifier, put in an order in which each comes after the calls it depends on,
their arguments are validated against the schema of their tool, and call and result are serialised as canonical JSON:
members sorted by name, no white space.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch


@dataclass(frozen=True)
class Argument:
    """kind: integer, number, string, boolean, object or array. low, high: bounds of a number, or of a string's length."""

    name: str
    kind: str
    required: bool = True
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()


#: How schema_of_variant names the kinds.
_KINDS = {"integer": r"^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "string": r"^STRING$", "boolean": r"^BOOLEAN$", "object": r"^OBJECT", "array": r"^ARRAY"}


def _path(name: str) -> str:
    return '$["' + name.replace('"', '\\"') + '"]'


def problems(tool: Column, arguments: Column, schemas: dict[str, tuple[Argument, ...]]) -> Column:
    """Array of what is wrong with a call's arguments (a variant, null where they are no JSON); empty if nothing."""
    no_such = F.when(F.coalesce(~tool.isin(*schemas), F.lit(True)), F.lit("unknown tool"))
    found = [no_such, F.when(arguments.isNull(), F.lit("not JSON")).when(~F.schema_of_variant(arguments).startswith("OBJECT"), F.lit("not an object"))]
    for name, args in schemas.items():
        here = (tool == name) & arguments.isNotNull()
        for a in args:
            value = F.try_variant_get(arguments, _path(a.name), "variant")
            kind = F.schema_of_variant(value)
            missing = value.isNull() | (kind == "VOID")
            if a.required:
                found.append(F.when(here & missing, F.lit(f"{a.name}: missing")))
            found.append(F.when(here & ~missing & ~kind.rlike(_KINDS[a.kind]), F.lit(f"{a.name}: not {a.kind}")))
            if a.low is not None or a.high is not None:
                size = F.char_length(F.try_variant_get(arguments, _path(a.name), "string")) if a.kind == "string" else F.try_variant_get(arguments, _path(a.name), "double")
                out = F.lit(False)
                if a.low is not None:
                    out = out | (size < a.low)
                if a.high is not None:
                    out = out | (size > a.high)
                found.append(F.when(here & kind.rlike(_KINDS[a.kind]) & out, F.lit(f"{a.name}: out of range")))
            if a.values:
                found.append(F.when(here & kind.rlike(_KINDS[a.kind]) & ~F.try_variant_get(arguments, _path(a.name), "string").isin(*a.values), F.lit(f"{a.name}: not one of its values")))
    return F.array_compact(F.array(*found))


def _jump(single: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """Chains of calls with one dependency each (scope, node, to) followed to their first call that has none or several.

    Gives scope, node, to, far (the calls in between, and that one) and done; not done is what runs in a circle. Each
    round doubles how far a call looks, so a chain takes the logarithm of its length.
    """
    now = scratch.save(single.withColumns({"far": F.lit(1), "done": F.lit(False)}), "jump")
    for _ in range(max(2, n.bit_length() + 2)):
        ahead = now.select("scope", F.col("node").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"))
        open_ = now.filter("not done").join(ahead, ["scope", "to"], "left")
        moved = open_.select("scope", "node", F.coalesce("to2", "to").alias("to"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("to2").isNull().alias("done"))
        after = scratch.save(now.filter("done").unionByName(moved), "jump")
        scratch.drop(now)
        now = after
        if now.filter("not done").isEmpty():
            break
    return now


def levels(calls: DataFrame, depends: DataFrame, scratch: Scratch, key: list[str], on: str = "after") -> DataFrame:
    """calls (of the key columns only: scope and name) with a level: 0 without dependencies, else one more than the highest of them.

    depends: the key columns and, in `on`, the name of a call of the same scope that has to come before. A dependency on
    what is no call, or on the call itself, is passed over. What is on a cycle or behind one has a null level. Chains of
    single dependencies are followed by doubling; calls with several dependencies take one round for each level that
    such calls have above one another.
    """
    scope, name = key
    ids = scratch.save(calls.select(F.col(scope).alias("scope"), F.col(name).alias("node")).filter("scope is not null and node is not null").distinct(), "calls")
    edge = depends.select(F.col(scope).alias("scope"), F.col(name).alias("node"), F.col(on).alias("to")).filter("node <> to").distinct()
    edge = edge.join(ids, ["scope", "node"], "left_semi").join(ids.withColumnRenamed("node", "to"), ["scope", "to"], "left_semi")
    edge = scratch.save(edge, "depends")
    several = edge.groupBy("scope", "node").agg(F.count("*").alias("n"))
    many = several.filter("n > 1").select("scope", "node")
    chain = _jump(edge.join(many, ["scope", "node"], "left_anti").select("scope", "node", "to"), scratch, ids.count())
    known = scratch.save(ids.join(several, ["scope", "node"], "left_anti").withColumn("level", F.lit(0)), "level")
    found, last = [known], known
    # dependencies of calls that have several, on the first calls of the chains that lead there
    first = chain.filter("done").select("scope", F.col("node").alias("to"), F.col("to").alias("root"), "far")
    hops = edge.join(many, ["scope", "node"], "left_semi").join(first, ["scope", "to"], "left")
    hops = scratch.save(hops.select("scope", "node", F.coalesce("root", "to").alias("to"), F.coalesce("far", F.lit(0)).alias("far"), F.lit(None).cast("int").alias("low")), "hops")
    while not hops.isEmpty():
        seen = hops.join(last.select("scope", F.col("node").alias("to"), "level"), ["scope", "to"], "left")
        seen = seen.select("scope", "node", "to", "far", F.coalesce("low", "level").alias("low"))
        seen = scratch.save(seen, "hops")
        ready = seen.groupBy("scope", "node").agg(F.max(F.col("low") + F.col("far") + 1).alias("level"), F.count("low").alias("have"), F.count("*").alias("n"))
        last = scratch.save(ready.filter("have = n").select("scope", "node", F.col("level").cast("int").alias("level")), "level")
        if last.isEmpty():
            break
        found.append(last)
        left = scratch.save(seen.join(last, ["scope", "node"], "left_anti"), "hops")
        scratch.drop(hops, seen)
        hops = left
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    along = chain.filter("done").join(out.withColumnRenamed("node", "to"), ["scope", "to"]).select("scope", "node", (F.col("level") + F.col("far")).cast("int").alias("level"))
    return out.unionByName(along).select(F.col("scope").alias(scope), F.col("node").alias(name), "level")


def link(calls: DataFrame, results: DataFrame, depends: DataFrame, schemas: dict[str, tuple[Argument, ...]], scratch: Scratch) -> DataFrame:
    """One row per call: conv_id, call_id, name, level, status, problems, n_results, record.

    calls: conv_id, call_id, name, arguments (JSON text); results: conv_id, call_id, content; depends: conv_id, call_id,
    after. Other columns are passed over. The record is canonical JSON of the call's id, name, arguments and result, null
    where the arguments are no JSON. status: the first that holds of duplicate (another row has its identifier), invalid
    (arguments), unordered (on or behind a cycle, or without an identifier), unanswered, ambiguous (several results), ok.
    Of several results the record has the smallest content. Results without a call are not returned here; see orphans.
    """
    # one row for each identifier, whatever its number of results; a hot one is summed before it is shuffled
    answer = results.filter("call_id is not null and conv_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"), F.min("content").alias("result"))
    often = calls.groupBy("conv_id", "call_id").agg(F.count("*").alias("_rows"))
    level = levels(calls, depends, scratch, ["conv_id", "call_id"])
    facts = often.join(answer, ["conv_id", "call_id"], "left").join(level, ["conv_id", "call_id"], "left")
    args = F.try_parse_json("arguments")
    joined = calls.select("conv_id", "call_id", "name", args.alias("args")).join(facts.withColumnsRenamed({"conv_id": "_c", "call_id": "_i"}), F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("call_id").eqNullSafe(F.col("_i")), "left")
    joined = joined.withColumn("problems", problems(F.col("name"), F.col("args"), schemas)).withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    status = (
        F.when((F.col("_rows") > 1) & F.col("call_id").isNotNull(), "duplicate")
        .when(F.size("problems") > 0, "invalid")
        .when(F.col("level").isNull(), "unordered")
        .when(F.col("n_results") == 0, "unanswered")
        .when(F.col("n_results") > 1, "ambiguous")
        .otherwise("ok")
    )
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x")), {"ignoreNullFields": "false"}), r"(?s)^\{\"x\":(.*)\}$", 1)
    record = F.concat(
        F.lit('{"arguments":'), F.to_json("args"), F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit(',"result":'), quoted("result"), F.lit("}")
    )
    return joined.select("conv_id", "call_id", "name", "level", status.alias("status"), "problems", "n_results", record.alias("record"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that no call has asked for."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
