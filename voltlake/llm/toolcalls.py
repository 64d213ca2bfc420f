"""Tool-call linking with DataFrame functions only.

Calls and results are joined by their identifier (an equi-join that Spark may hash or sort, and split
where skewed), ordered topologically within their conversation, validated against argument schemas and
serialised as canonical JSON (object keys sorted, no white space).

Where the dependencies of a conversation all point back, its own order is a topological one, which a
join verifies; conversations with forward references are ordered in rounds, each a stored table. Calls on
or behind a cycle get no order.

Edge cases: a call without a result and a result without a call are kept and say so; of several
results to a call the first by turn counts and ``n_results`` says how many there were; a null id
matches nothing; parents that don't exist are ignored; malformed arguments give the error ``not an
object`` and null JSON; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.llm import scratch

#: Argument schemas by tool: type, required, and bounds of each argument.
SCHEMAS = {
    "reply": {
        "role": {"type": "string", "required": True, "enum": ["user", "system"]},
        "text": {"type": "string", "required": True, "min_length": 1, "max_length": 1_000_000},
        "turn": {"type": "integer", "required": True, "minimum": 0},
    }
}


def errors(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """The sorted array of what is wrong with the arguments of a call."""
    v = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    found = [F.when(~F.coalesce(is_object, F.lit(False)), F.lit("not an object")), F.when(~F.coalesce(name.isin(list(schemas)), F.lit(False)), F.lit("unknown tool"))]
    for tool, args in schemas.items():
        for arg, rule in sorted(args.items()):
            at = f"$.{arg}"
            there = F.try_variant_get(v, at, "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get(v, at, "variant"))
            kind = F.schema_of_variant(F.try_variant_get(v, at, "variant"))
            text = F.try_variant_get(v, at, "string")
            own = lambda bad, said: F.when(is_object & (name == tool) & bad, F.lit(f"{arg}: {said}"))  # noqa: B023, E731
            if rule.get("required"):
                found.append(own(~F.coalesce(there, F.lit(False)), "missing"))
            want = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}[rule["type"]]
            found.append(own(there & (kind != want), f"not {rule['type']}"))
            if "enum" in rule:
                found.append(own(there & ~text.isin(rule["enum"]), "not allowed"))
            if "min_length" in rule:
                found.append(own(there & (F.char_length(text) < rule["min_length"]), "too short"))
            if "max_length" in rule:
                found.append(own(there & (F.char_length(text) > rule["max_length"]), "too long"))
            if "minimum" in rule:
                found.append(own(there & (F.try_variant_get(v, at, "double") < float(rule["minimum"])), "too small"))
    return F.array_sort(F.array_compact(F.array(*found)))


def order(calls: DataFrame) -> DataFrame:
    """(id, topo_order): numbers that grow along every dependency of a scope; ids are unique.

    Transcripts grow at their end, so where all parents of a scope's calls stand before their children the
    transcript's own order is a topological one, which one join shows. Only scopes with a forward
    reference take rounds: a call is placed once no parent waits."""
    at = calls.select(F.col("id").alias("parent"), F.col("ord").alias("_ord"))
    edges = calls.select("id", "scope", "ord", F.explode("parents").alias("parent")).distinct()
    edges = scratch.table(edges.join(at, "parent"), "edges")
    odd = scratch.table(edges.where("_ord >= ord").select("scope").distinct(), "odd-scopes")
    if odd.isEmpty():
        return calls.select("id", F.col("ord").cast("long").alias("topo_order"))
    done = [calls.join(odd, "scope", "left_anti").select("id", F.col("ord").cast("long").alias("topo_order"))]
    left = scratch.table(calls.join(odd, "scope", "left_semi").select("id"), "left")
    waits = scratch.table(edges.join(odd, "scope", "left_semi").select("id", "parent"), "waits")
    while True:
        now = scratch.table(left.join(waits.select("id").distinct(), "id", "left_anti"), "placed")
        if now.isEmpty():
            break  # all are placed, or the rest stands on or behind a cycle
        done.append(now.select("id", F.lit(len(done) - 1).cast("long").alias("topo_order")))
        left = scratch.table(left.join(now, "id", "left_anti"), "left")
        waits = scratch.table(waits.join(now.select(F.col("id").alias("parent")), "parent", "left_anti"), "waits")
    return reduce(DataFrame.union, done)


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """id, status, order, errors, n_results and the canonical JSON of each call or stray result.

    ``calls``: id, scope, ord, name, arguments (JSON text), parents (array of ids). ``results``: id, turn, content.
    """
    placed = order(calls.where("id is not null").groupBy("id").agg(F.min("scope").alias("scope"), F.min("ord").alias("ord"), F.min("parents").alias("parents")))
    first = results.groupBy("id").agg(F.count("*").alias("n_results"), F.min_by("content", F.struct("turn", "content")).alias("content"))
    c = calls.select(F.col("id").alias("call_id"), "name", "arguments")
    both = c.join(first, F.col("call_id") == F.col("id"), "full_outer").withColumn("key", F.coalesce("call_id", "id"))
    both = both.drop("id").join(placed.withColumnRenamed("id", "_id"), F.col("call_id") == F.col("_id"), "left")
    called = F.col("call_id").isNotNull() | F.col("name").isNotNull()
    status = F.when(~called, "stray result").when(F.col("n_results").isNull(), "no result").when(F.col("topo_order").isNull(), "in a cycle").otherwise("linked")
    quoted = lambda col: F.coalesce(F.regexp_extract(F.to_json(F.struct(col.alias("a"))), r'(?s)^\{"a":(.*)\}$', 1), F.lit("null"))
    text = lambda col: F.when(col.isNull(), F.lit("null")).otherwise(quoted(col))
    args = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))
    canonical = F.concat(F.lit('{"arguments":'), args, F.lit(',"id":'), text(F.col("key")), F.lit(',"name":'), text(F.col("name")), F.lit(',"result":'), text(F.col("content")), F.lit("}"))
    return both.select(
        F.col("key").alias("call_id"), status.alias("status"), "topo_order",
        F.when(called, F.concat_ws("; ", errors(F.col("name"), F.col("arguments"), schemas))).alias("argument_errors"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), canonical.alias("canonical_json"),
    )


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a turn of the user or the system calls ``reply``, and the
    assistant's turn right after it is the result. A call depends on the calls one and two turns before."""
    key = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    known = turns.where("conv_id is not null and turn is not null")
    asks = known.where("role in ('user', 'system')")
    arguments = F.to_json(F.struct(F.col("turn"), F.col("text"), F.col("role")))
    calls = asks.select(key(0).alias("id"), F.col("conv_id").alias("scope"), F.col("turn").alias("ord"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.array(key(1), key(2)).alias("parents"))
    calls = calls.groupBy("id").agg(F.min("scope").alias("scope"), F.min("ord").alias("ord"), F.min("name").alias("name"), F.min("arguments").alias("arguments"), F.min("parents").alias("parents"))
    results = known.where("role = 'assistant'").select(key(1).alias("id"), "turn", F.col("text").alias("content"))
    return calls, results


def op2(spark, sf_dir: str) -> DataFrame:
    """The linked calls of every conversation."""
    calls, results = from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return link(scratch.table(calls, "calls"), results)


OP2_SQL = r"""
WITH known AS (
  SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
asks AS (
  SELECT conv_id || ':' || turn AS id, min(conv_id) AS conv_id, min(turn) AS turn,
         min(CASE WHEN text IS NULL THEN '{"role":' || to_json(role) || ',"turn":' || turn || '}'
              ELSE '{"role":' || to_json(role) || ',"text":' || to_json(text) || ',"turn":' || turn || '}' END) AS args,
         min_by(role, text) AS role, min(text) AS text
  FROM known WHERE role IN ('user', 'system') GROUP BY 1),
results AS (
  SELECT conv_id || ':' || (turn - 1) AS id, count(*) AS n, min_by(text, turn) AS content
  FROM known WHERE role = 'assistant' GROUP BY 1)
SELECT coalesce(a.id, r.id) AS call_id,
       CASE WHEN a.id IS NULL THEN 'stray result' WHEN r.id IS NULL THEN 'no result' ELSE 'linked' END AS status,
       CAST(a.turn AS BIGINT) AS topo_order,
       CASE WHEN a.id IS NULL THEN NULL
            ELSE concat_ws('; ', CASE WHEN text IS NULL THEN 'text: missing' WHEN length(text) < 1 THEN 'text: too short' WHEN length(text) > 1000000 THEN 'text: too long' END,
                           CASE WHEN a.turn < 0 THEN 'turn: too small' END) END AS argument_errors,
       coalesce(r.n, 0) AS n_results,
       '{"arguments":' || coalesce(a.args, 'null') || ',"id":' || to_json(coalesce(a.id, r.id)) || ',"name":' || CASE WHEN a.id IS NULL THEN 'null' ELSE '"reply"' END
         || ',"result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}' AS canonical_json
FROM asks a FULL OUTER JOIN results r ON a.id = r.id
"""
