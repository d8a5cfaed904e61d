"""Chat formatting: tool calls linked to their results, in topological order, as canonical JSON.

A message is a row (conv_id, turn, role, text).  The text of an assistant message may be a JSON object with
`tool_calls`, a list of {"id", "name", "arguments", "depends_on"} (arguments: any JSON value; depends_on: ids of
calls whose results it uses), or of {"id", "function": {"name", "arguments"}}, where arguments is a string of JSON; the text of a `tool` message may be {"tool_call_id", "content"}; that of a
`system` message may be {"tools": [{"name", "parameters"}]}, or the same within `function`, where parameters is a schema with `required` (names) and
`properties` (name -> {"type"}).  Any other text is content, and so is an object that repeats a key.  All else that the
object of a call or a result holds, `content` beside calls included, stays in its JSON.

Calls and results meet in a hash join on (conv_id, id): the first call of an id in turn order owns it, later
ones are `duplicate`, and each result joins that one call, so that no id, however often it is repeated, pairs
more than once per row.  Calls are ordered by rounds over what they depend on: a round resolves the calls
whose calls are all resolved; what no round resolves is a `cycle`.  Every message has a key (anchor, level,
step) that sorts a result after its call and a call after those it depends on, and leaves all else in turn
order; messages stay rows, so a conversation of any length is never gathered in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

TOOLS = "struct<tools:array<struct<name:string,parameters:variant,function:struct<name:string,parameters:variant>>>>"
TYPES = ("string", "integer", "number", "boolean", "object", "array", "null")
#: keywords of a schema that are checked, and those that say nothing about a value
CHECKED = ("type", "enum", "required", "properties", "additionalProperties", "items")
NOTES = ("title", "description", "default", "examples", "$schema", "$id", "$comment", "deprecated", "readOnly", "writeOnly")


def _parsed(role: str, schema: str) -> Column:
    """The text of a role's message as a struct, or null if it isn't a JSON object."""
    return F.when((F.col("role") == role) & F.ltrim("text").startswith("{"), F.from_json("text", schema, {"mode": "PERMISSIVE"}))


def _object() -> Column:
    """The text of an assistant's or tool's message as a variant, or null if it isn't one JSON object and nothing else."""
    # a parser stops after the first value: what follows it can't fit into both of these
    alone = F.expr("try_variant_get(try_parse_json('[' || text || ']'), '$', 'array<variant>')")
    named = F.expr("try_parse_json('{\"a\":' || text || '}')")
    return F.when(F.col("role").isin("assistant", "tool") & F.ltrim("text").startswith("{") & (F.size(alone) == 1) & named.isNotNull(), F.get(alone, F.lit(0)))


def _calls() -> Column:
    """The calls of an object: id, name, arguments, depends_on, malformed (a string of arguments that isn't JSON), as
    `all` the whole call, and its function."""
    get = lambda path, kind: f"try_variant_get(c, '$.{path}', '{kind}')"
    said = get("function.arguments", "string")
    wrapped = f"coalesce(schema_of_variant({get('function', 'variant')}) like 'OBJECT%', false)"
    text = f"{wrapped} and coalesce(schema_of_variant({get('function.arguments', 'variant')}) = 'STRING', false)"
    one = (
        f"named_struct('id', {get('id', 'string')}, 'name', if({wrapped}, {get('function.name', 'string')}, {get('name', 'string')}),"
        f" 'arguments', case when {text} then try_parse_json({said}) when {wrapped} then {get('function.arguments', 'variant')} else {get('arguments', 'variant')} end,"
        f" 'depends_on', {get('depends_on', 'array<string>')}, 'malformed', {text} and try_parse_json({said}) is null, 'all', c,"
        f" 'function', if({wrapped}, {get('function', 'variant')}, null), 'text', if({text}, {said}, null))"
    )
    return F.expr(f"case when role = 'assistant' then transform(try_variant_get(object, '$.tool_calls', 'array<variant>'), c -> {one}) end")


def _fields(value: Column) -> Column:
    """The fields of an object as a map of their JSON; null for other values."""
    return F.transform_values(F.try_variant_get(value, "$", "map<string,variant>"), lambda _, v: F.coalesce(canonical(v), F.lit("null")))


def _written(fields: Column, named: dict[str, Column]) -> Column:
    """An object of JSON fields, where named ones that aren't null come instead, with sorted keys."""
    rest = F.map_filter(fields, lambda k, _: ~reduce(or_, [(k == n) & v.isNotNull() for n, v in named.items()]))
    ours = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in named.items()]
    pairs = F.array_sort(F.concat(F.map_entries(rest), F.array_compact(F.array(*ours))))
    written = F.transform(pairs, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"]))
    return F.when(fields.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", written), F.lit("}")))


def canonical(value: Column) -> Column:
    """A variant as JSON with sorted keys and no white space."""
    return F.to_json(value)


def _fits(kind: Column, type_: Column) -> Column:
    """Whether a value of the kind that schema_of_variant names is of a JSON type."""
    return (
        F.when(type_ == "string", kind == "STRING")
        .when(type_ == "integer", kind == "BIGINT")
        .when(type_ == "number", kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"))
        .when(type_ == "boolean", kind == "BOOLEAN")
        .when(type_ == "object", kind.startswith("OBJECT"))
        .when(type_ == "array", kind.startswith("ARRAY"))
        .when(type_ == "null", kind == "VOID")
        .otherwise(True)
    )


def _judged(ws: Workspace, pairs: DataFrame) -> DataFrame:
    """pairs (mid, pos, v: value, s: schema) -> mid, pos, bad (a value breaks its schema), open (a schema says more than is
    checked).  Each round judges the pairs of one depth and goes on to the values inside of them, until there are none."""
    none = "cast(map() as map<string,variant>)"
    known = ", ".join(f"'{k}'" for k in CHECKED + NOTES)
    found, level = None, ws.keep(pairs)
    while True:
        x = level.selectExpr(
            "mid", "pos", "v", "s", "schema_of_variant(v) as kind", "schema_of_variant(s) as form", "try_variant_get(v, '$', 'map<string,variant>') as fields", f"coalesce(try_variant_get(s, '$.properties', 'map<string,variant>'), {none}) as props",
            "filter(coalesce(try_variant_get(s, '$.type', 'array<string>'), array(try_variant_get(s, '$.type', 'string'))), t -> t is not null) as types", "try_variant_get(s, '$.enum', 'array<variant>') as enum", "try_variant_get(s, '$.required', 'array<string>') as required",
            "case when try_variant_get(s, '$.patternProperties', 'variant') is null then try_variant_get(s, '$.additionalProperties', 'variant') end as more", "try_variant_get(s, '$.items', 'variant') as items",
        )
        no = lambda c: F.coalesce(c, F.lit(False))
        wrong = (F.size("types") > 0) & ~F.exists("types", lambda t: no(_fits(F.col("kind"), t)))
        broken = no(wrong) | F.expr("coalesce(not exists(enum, e -> to_json(e) = to_json(v)), false) or coalesce(exists(required, n -> not map_contains_key(fields, n)), false) or (form = 'BOOLEAN' and not try_variant_get(s, '$', 'boolean'))")
        further = no(F.exists("types", lambda t: ~t.isin(*TYPES))) | F.expr(f"case when form like 'OBJECT%' then size(array_except(map_keys(try_variant_get(s, '$', 'map<string,variant>')), array({known}))) > 0 else form not in ('BOOLEAN', 'VOID') end")
        now = x.select("mid", "pos", broken.alias("bad"), further.alias("open")).where("bad or open")
        found = now if found is None else found.union(now)
        inside = F.expr("""concat(
            coalesce(transform(map_entries(map_filter(fields, (k, w) -> map_contains_key(props, k))), e -> struct(e.value as v, element_at(props, e.key) as s)), array()),
            coalesce(case when more is not null then transform(map_entries(map_filter(fields, (k, w) -> not map_contains_key(props, k))), e -> struct(e.value as v, more as s)) end, array()),
            coalesce(case when items is not null then transform(try_variant_get(v, '$', 'array<variant>'), w -> struct(w as v, items as s)) end, array()))""")
        level = ws.keep(x.select("mid", "pos", F.explode(inside).alias("p")).selectExpr("mid", "pos", "coalesce(p.v, parse_json('null')) as v", "coalesce(p.s, parse_json('null')) as s"))
        if level.isEmpty():
            return found.groupBy("mid", "pos").agg(F.max("bad").alias("bad"), F.max("open").alias("open"))


def format_chats(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text, ...) -> one row per row: conv_id, turn, role, anchor, level, step (the sort
    key within the conversation), n_calls, n_linked, n_invalid, status, json.

    status: null for plain messages; for calls the worst of ok, unanswered, unchecked, invalid, unknown_tool, cycle,
    duplicate; for results ok, orphan, repeated (a later result of an answered call).  A call is invalid if its
    arguments break type, enum, required, properties, additionalProperties or items of the schema at any depth, or
    are a string that isn't JSON (which then stays as it is),
    unchecked if they don't but the schema says more (other keywords or types), and unknown_tool if its
    conversation declares tools but not this one; a conversation without declarations isn't validated.  json
    is the message with sorted keys: content, role, tool_calls, tool_call_id, as far as present, and the other keys of a
    call's or result's object (a role there that differs from the row's is named text.role).  A null role
    or text is left out of the JSON; null conv_id or turn are values like others (null turns come first);
    equal rows that repeat stay, each with the same key; other columns are ignored; an empty table gives none.
    """
    ws = Workspace(messages.sparkSession, "chat")
    rows = messages.select("conv_id", "turn", "role", "text").withColumn("mid", F.monotonically_increasing_id())
    rows = rows.withColumn("object", _object()).select("*", _calls().alias("calls"), F.expr("case when role = 'tool' then try_variant_get(object, '$.tool_call_id', 'string') end").alias("result_of"), _parsed("system", TOOLS)["tools"].alias("tools"))
    rows = ws.keep(rows.withColumn("at", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62)))))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0"))

    calls = rows.where("size(calls) > 0").select(conv.alias("conv"), "mid", "at", F.posexplode("calls").alias("pos", "call"))
    calls = calls.select("conv", "mid", "at", "pos", *[f"call.{c}" for c in ("id", "name", "arguments", "depends_on", "malformed")]).withColumn("order", F.struct("at", "mid", "pos"))
    owners = calls.where("id is not null").groupBy("conv", "id").agg(F.min("order").alias("owner"))
    calls = calls.join(owners, ["conv", "id"], "left").withColumn("duplicate", F.coalesce(F.col("owner") != F.col("order"), F.lit(False)))

    declared = rows.where("size(tools) > 0").select(conv.alias("conv"), F.explode("tools").alias("tool"))
    declared = declared.select("conv", F.coalesce("tool.name", "tool.function.name").alias("name"), F.coalesce("tool.parameters", "tool.function.parameters").alias("parameters")).where("name is not null").groupBy("conv", "name").agg(F.first("parameters", True).alias("parameters"), F.lit(True).alias("declared"))
    with_tools = declared.select("conv").distinct().withColumn("checked", F.lit(True))
    calls = calls.join(declared, ["conv", "name"], "left").join(with_tools, "conv", "left")
    shape = F.coalesce(~F.schema_of_variant("arguments").startswith("OBJECT"), F.lit(False)) & F.col("declared")
    judged = _judged(ws, calls.where("parameters is not null").select("mid", "pos", F.coalesce("arguments", F.expr("parse_json('{}')")).alias("v"), F.col("parameters").alias("s")))
    calls = calls.join(judged, ["mid", "pos"], "left")
    fault = F.when(F.col("checked") & F.col("declared").isNull(), "unknown_tool").when(F.coalesce(F.col("bad"), F.lit(False)) | F.coalesce(shape, F.lit(False)) | F.coalesce("malformed", F.lit(False)), "invalid").when(F.col("open"), "unchecked")
    calls = ws.keep(calls.select("conv", "mid", "pos", "at", "id", "duplicate", "depends_on", fault.alias("fault")))

    results = rows.where("result_of is not null").select(conv.alias("conv"), "mid", "at", F.col("result_of").alias("id"))
    firsts = results.groupBy("conv", "id").agg(F.min(F.struct("at", "mid")).alias("first"))

    # rounds: (conv, id, level, anchor) of the calls whose order is known; a round looks at the calls of the last one
    nodes = calls.where("id is not null and not duplicate")
    needs = nodes.select("conv", "id", F.explode("depends_on").alias("need")).where("need is not null").distinct()
    needs = ws.keep(needs.join(nodes.select("conv", F.col("id").alias("need")), ["conv", "need"], "left_semi"))
    fresh = ws.keep(nodes.join(needs, ["conv", "id"], "left_anti").select("conv", "id", F.lit(0).alias("level"), F.col("at").alias("anchor")))
    answers = firsts.select("conv", "id", F.col("first.at").alias("answered"))
    rounds = [fresh]
    waiting = needs.groupBy("conv", "id").agg(F.count("*").alias("open")).join(nodes.select("conv", "id", F.col("at").alias("anchor")), ["conv", "id"])
    waiting = ws.keep(waiting.select("conv", "id", "open", F.lit(0).alias("level"), "anchor"))
    while not waiting.isEmpty() and not fresh.isEmpty():
        given = fresh.join(answers, ["conv", "id"], "left").select("conv", F.col("id").alias("need"), (F.col("level") + 1).alias("over"), F.greatest("anchor", "answered").alias("after"))
        given = needs.join(given, ["conv", "need"]).groupBy("conv", "id").agg(F.count("*").alias("met"), F.max("over").alias("over"), F.max("after").alias("after"))
        told = waiting.join(given, ["conv", "id"], "left").select("conv", "id", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), F.greatest("level", "over").alias("level"), F.greatest("anchor", "after").alias("anchor"))
        told = ws.keep(told)
        fresh, waiting = told.where("open = 0").drop("open"), told.where("open > 0")
        rounds.append(fresh)
    done = reduce(DataFrame.unionByName, rounds)

    state = calls.join(done, ["conv", "id"], "left").join(answers, ["conv", "id"], "left")
    cyclic = F.col("id").isNotNull() & ~F.col("duplicate") & F.col("level").isNull()
    status = F.when(F.col("duplicate"), 6).when(cyclic, 5).when(F.col("fault") == "unknown_tool", 4).when(F.col("fault") == "invalid", 3).when(F.col("fault") == "unchecked", 2).when(F.col("answered").isNull(), 1).otherwise(0)
    per_call = state.groupBy("mid").agg(
        F.count("*").alias("n_calls"), F.count_if(F.col("answered").isNotNull() & ~F.col("duplicate")).alias("n_linked"), F.count_if(F.col("fault") != "unchecked").alias("n_invalid"),
        F.max(status).alias("worst"), F.max("level").alias("c_level"), F.max("anchor").alias("c_anchor"),
    )
    owner = calls.where("id is not null and not duplicate").join(done, ["conv", "id"], "left").select("conv", "id", F.coalesce("anchor", "at").alias("o_anchor"), F.coalesce("level", F.lit(0)).alias("o_level"), F.lit(True).alias("owned"))
    per_result = results.join(owner, ["conv", "id"], "left").join(firsts, ["conv", "id"], "left")
    repeated = F.col("first") != F.struct("at", "mid")
    per_result = per_result.select("mid", F.when(F.col("owned").isNull(), "orphan").when(repeated, "repeated").otherwise("ok").alias("r_status"), F.greatest("at", "o_anchor").alias("r_anchor"), F.col("o_level").alias("r_level"))

    out = rows.join(per_call, "mid", "left").join(per_result, "mid", "left")
    names_ = F.array(*[F.lit(x) for x in ("ok", "unanswered", "unchecked", "invalid", "unknown_tool", "cycle", "duplicate")])
    text = lambda c: F.when(c.isNotNull(), _quoted(c))
    call_json = F.transform(
        "calls",
        lambda c: F.when(c["function"].isNull(), F.coalesce(_written(_fields(c["all"]), {"id": text(c["id"]), "name": text(c["name"]), "arguments": F.coalesce(canonical(c["arguments"]), F.lit("null"))}), canonical(c["all"]))).otherwise(
            _written(_fields(c["all"]), {"id": text(c["id"]), "function": _written(_fields(c["function"]), {"name": text(c["name"]), "arguments": F.when(c["text"].isNotNull(), text(F.coalesce(canonical(c["arguments"]), c["text"])))})})
        ),
    )
    # what isn't a call or a result is content as it stands
    is_call, is_result = F.coalesce(F.size("calls") > 0, F.lit(False)), F.col("result_of").isNotNull()
    fields, role = _fields(F.col("object")), text(F.col("role"))
    # a role in the object that isn't the row's stays under another name
    fields = F.transform_keys(fields, lambda k, v: F.when((k == "role") & (v != role), "text.role").otherwise(k))
    calls_ = F.when(is_call, F.concat(F.lit("["), F.concat_ws(",", call_json), F.lit("]")))
    json = F.when(is_call, _written(fields, {"role": role, "tool_calls": calls_}))
    json = json.when(is_result, _written(fields, {"role": role, "tool_call_id": text(F.col("result_of")), "content": F.coalesce(F.element_at(fields, "content"), F.lit("null"))}))
    plain = F.concat_ws(",", F.concat(F.lit('"content":'), text(F.col("text"))), F.concat(F.lit('"role":'), role))
    json = json.otherwise(F.concat(F.lit("{"), plain, F.lit("}")))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", "turn", "role",
        F.coalesce("c_anchor", "r_anchor", "at").alias("anchor"), F.coalesce("c_level", "r_level", F.lit(0)).cast("int").alias("level"), F.when(F.col("r_status").isNotNull(), 1).otherwise(0).alias("step"),
        n("n_calls"), n("n_linked"), n("n_invalid"), F.coalesce("r_status", F.get(names_, F.col("worst"))).alias("status"), json.alias("json"),
    )


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("a"))), r'(?s)^\{"a":(.*)\}$', 1)
