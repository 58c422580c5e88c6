"""Chat formatting: tool calls linked to results, ordered, validated, in canonical JSON.

Calls and results meet in a hash join on the call's identifier.  Levels of the
dependency graph come from pointer doubling along chains and from rounds that release
calls with several dependencies once all of these have a level.  Validation and
serialisation are expressions on Spark's variant type, whose objects have sorted keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderglass.llm.shared import count_of, stash, table

#: Variant type names that a schema type admits.
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}

#: Schemas of the tools that ``conversation_calls`` derives.
SCHEMAS = {
    "search": {"properties": {"query": "string", "size": "integer"}, "required": ["query", "size"]},
    "lookup": {"properties": {"id": "integer", "query": "string"}, "required": ["id", "query"]},
    "note": {"properties": {"query": "string"}, "required": ["query"]},
}


def _errors(name: Column, args: Column, schemas: dict) -> Column:
    """Violations of a call's schema, in order of the schema; null arguments are invalid."""
    cases = F.when(args.isNull() | ~F.coalesce(F.schema_of_variant(args), F.lit("")).startswith("OBJECT"), F.array(F.lit("arguments are not an object")))
    keys = F.coalesce(F.json_object_keys(F.to_json(args)), F.array().cast("array<string>"))
    for tool, schema in schemas.items():
        found = []
        for prop, kind in schema["properties"].items():
            value = F.try_variant_get(args, f"$['{prop}']", "variant")
            there = F.array_contains(keys, prop)
            if prop in schema.get("required", []):
                found.append(F.when(~there, F.lit(f"missing {prop}")))
            found.append(F.when(there & ~F.coalesce(F.schema_of_variant(value), F.lit("VOID")).rlike(f"^(?:{_TYPES[kind]})$"), F.lit(f"{prop} is not {kind}")))
        extra = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, schema["properties"])))), lambda k: F.concat(F.lit("unexpected "), k))
        cases = cases.when(name == tool, F.concat(F.array_compact(F.array(*found)), extra))
    return cases.otherwise(F.array(F.lit("unknown tool")))


def _jumps(chain: DataFrame) -> DataFrame:
    """``call_id, top, steps`` of calls with one dependency: the first call up the chain that has none or several.

    Pointers double, so a chain of n calls takes log2(n) rounds.  A round that ends no
    pointer leaves only calls on cycles and behind them; these have no row.
    """
    own = chain.select(F.col("call_id").alias("top"), F.lit(1).alias("more"))
    first = stash(chain.select("call_id", F.col("need").alias("top"), F.lit(1).alias("steps")).join(own, "top", "left").select("call_id", "top", "steps", F.col("more").isNull().alias("ended")), "jumps")
    ended, going = first.where("ended"), first.where("not ended")
    new = count_of(ended)
    while new and count_of(going):
        ahead = ended.union(going).select(F.col("call_id").alias("top"), F.col("top").alias("next_top"), F.col("steps").alias("next_steps"), "ended")
        jumped = going.drop("ended").join(ahead, "top")
        jumped = stash(jumped.select("call_id", F.col("next_top").alias("top"), (F.col("steps") + F.col("next_steps")).alias("steps"), "ended"), "jumps")
        ended, going = ended.union(jumped.where("ended")), jumped.where("not ended")
        new = count_of(jumped.where("ended"))
    return ended.drop("ended")


def _levels(calls: DataFrame) -> DataFrame:
    """``call_id, level`` of calls: 0 without known dependencies, else above all of them.

    Calls on a cycle or behind one have no row.  Chains of calls with one dependency are
    jumped over; the calls with several then take as many rounds as lie above each other.
    """
    ids = calls.select("call_id").where("call_id is not null").distinct()
    needs = calls.where("call_id is not null").select("call_id", F.explode("depends_on").alias("need")).distinct()
    needs = stash(needs.join(ids.select(F.col("call_id").alias("need")), "need", "left_semi"), "needs")
    degree = needs.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need"))
    jumps = _jumps(degree.where("n = 1"))
    ahead = jumps.select(F.col("call_id").alias("need"), "top", "steps")
    several = needs.join(degree.where("n > 1").select("call_id"), "call_id", "left_semi").join(ahead, "need", "left")
    top, steps = F.coalesce("top", "need").alias("top"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")
    waits = several.select("call_id", top, steps).groupBy("call_id", "top").agg(F.max("steps").alias("steps"))
    waits = stash(waits.withColumn("reach", F.lit(None).cast("int")), "waits")
    last = stash(ids.join(needs, "call_id", "left_anti").withColumn("level", F.lit(0)), "levels")
    done = last
    while count_of(waits):
        met = waits.join(last.select(F.col("call_id").alias("top"), "level"), "top", "left")
        waits = stash(met.select("call_id", "top", "steps", F.coalesce("reach", F.col("level") + F.col("steps")).alias("reach")), "waits")
        reached = waits.groupBy("call_id").agg(F.count_if(F.col("reach").isNull()).alias("open"), F.max("reach").alias("level"))
        last = stash(reached.where("open = 0").select("call_id", "level"), "levels")
        if not count_of(last):
            break
        done = done.union(last)
        waits = waits.join(last, "call_id", "left_anti")
    above = jumps.join(done.select(F.col("call_id").alias("top"), "level"), "top")
    return done.union(above.select("call_id", (F.col("level") + F.col("steps")).alias("level")))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row per call, and per result that no call asked for.

    ``calls(conv_id, turn, call_id, name, arguments, depends_on)``: arguments as JSON
    text.  ``results(call_id, result_turn, content)``; of several results of a call the
    one with the smallest turn (then text) counts.  Returns ``call_id, conv_id, turn,
    level, valid, errors, record``; sort by (level, turn, call_id) for a topological
    order.  Calls on a cycle have a null level and an error.  A call without id meets no
    result.  Repeated call ids each give a row.  Other columns of either table are
    ignored; empty tables give an empty table.
    """
    first = results.groupBy("call_id").agg(F.min(F.struct("result_turn", "content")).alias("first"), F.count(F.lit(1)).alias("n_results"))
    levels = _levels(calls)
    args = F.try_parse_json("arguments")
    own = calls.select("conv_id", "turn", "call_id", "name", args.alias("args"), F.lit(True).alias("called"))
    # neither calls without id nor a full outer join could be split, were there very many of one key
    named = own.where("call_id is not null")
    met = named.join(levels, "call_id", "left").join(first.where("call_id is not null").hint("shuffle_hash"), "call_id", "left")
    alone = first.join(named.select("call_id").distinct(), "call_id", "left_anti")
    linked = met.unionByName(own.where("call_id is null"), allowMissingColumns=True).unionByName(alone, allowMissingColumns=True)
    more = F.array_compact(
        F.array(
            F.when(F.col("called").isNull(), F.lit("result without call")),
            F.when(F.col("called") & F.col("first").isNull(), F.lit("call without result")),
            F.when(F.col("called") & F.col("call_id").isNotNull() & F.col("level").isNull(), F.lit("dependency cycle")),
            F.when(F.col("n_results") > 1, F.lit("several results")),
        )
    )
    schema_errors = F.when(F.col("called"), _errors(F.col("name"), F.col("args"), schemas)).otherwise(F.array().cast("array<string>"))
    out = linked.withColumn("errors", F.concat(schema_errors, more))
    record = F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("call_id"), F.col("errors").alias("errors"), F.col("name").alias("name"), F.col("first.content").alias("result")))
    return out.select("call_id", "conv_id", "turn", "level", (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), record.alias("record"))


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from plain conversations.

    An assistant's turn is a call, the user's turn right after it that call's result.
    The tool follows from the text's length; every fifth ``lookup`` has a text for an
    id.  A call depends on the call two turns before, except at every third call.
    """
    base = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    call_id = lambda shift: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") + shift).cast("string"))
    size = F.length("text")
    name = F.when(size % 3 == 0, "search").when(size % 3 == 1, "lookup").otherwise("note")
    arguments = (
        F.when(name == "search", F.to_json(F.struct(size.alias("size"), F.col("text").alias("query"))))
        .when((name == "lookup") & (size % 5 == 0), F.to_json(F.struct(size.cast("string").alias("id"), F.col("text").alias("query"))))
        .when(name == "lookup", F.to_json(F.struct(size.alias("id"), F.col("text").alias("query"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("query"))))
    )
    depends = F.when(F.col("turn") % 6 != 1, F.array(call_id(-2))).otherwise(F.array().cast("array<string>"))
    calls = base.where("role = 'assistant'").select("conv_id", "turn", call_id(0).alias("call_id"), name.alias("name"), arguments.alias("arguments"), depends.alias("depends_on"))
    results = base.where("role = 'user' and turn > 0").select(call_id(-1).alias("call_id"), F.col("turn").alias("result_turn"), F.col("text").alias("content"))
    return calls, results


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all calls and results of the conversations table."""
    calls, results = conversation_calls(table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, SCHEMAS)


ORACLE = r"""
with recursive base as (select conv_id, turn, role, coalesce(text, '') as text, length(coalesce(text, '')) as n from conversations),
calls as (select *, 'c' || conv_id || '-' || turn as call_id, case n % 3 when 0 then 'search' when 1 then 'lookup' else 'note' end as name,
  case when turn % 6 <> 1 then 'c' || conv_id || '-' || (turn - 2) end as need from base where role = 'assistant'),
lv(call_id, level) as (select call_id, 0 from calls where need is null or need not in (select call_id from calls)
  union all select c.call_id, lv.level + 1 from lv join calls c on c.need = lv.call_id),
res as (select 'c' || conv_id || '-' || (turn - 1) as call_id, arg_min(text, (turn, text)) as content, count(*) as k from base where role = 'user' and turn > 0 group by 1),
j as (select coalesce(c.call_id, r.call_id) as call_id, c.conv_id, c.turn, lv.level, c.name, c.n, c.text, r.content, c.call_id is not null as called, coalesce(k, 0) as k
  from calls c full outer join res r on c.call_id = r.call_id left join lv on lv.call_id = c.call_id),
e as (select *, list_filter([case when called and name = 'lookup' and n % 5 = 0 then 'id is not integer' end, case when not called then 'result without call' end,
  case when called and content is null then 'call without result' end, case when k > 1 then 'several results' end], lambda x: x is not null) as errs,
  case when not called then null when name = 'search' then json_object('query', text, 'size', n) when name = 'lookup' and n % 5 = 0 then json_object('id', n::varchar, 'query', text)
  when name = 'lookup' then json_object('id', n, 'query', text) else json_object('query', text) end as args from j)
select call_id, conv_id, turn, level, len(errs) = 0 as valid, array_to_string(errs, '; ') as errors,
  '{' || case when called then '"arguments":' || args::varchar || ',' else '' end || '"call_id":' || to_json(call_id)::varchar || ',"errors":' || to_json(errs)::varchar
  || case when called then ',"name":' || to_json(name)::varchar else '' end || case when content is not null then ',"result":' || to_json(content)::varchar else '' end || '}' as record
from e
"""
