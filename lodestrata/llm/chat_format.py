"""Chat formatting with tool-call linking: calls and results are joined by identifier, ordered, validated, serialised.

Calls and results of a conversation are hash-joined by identifier. A result depends on its call, a call on the calls
it names in ``after`` (on their results where there are any). The order is topological: each message stands at its
turn, or where its last prerequisite stands if that is later, behind it. Only from the first message of a conversation
on that does not stand behind all its prerequisites by turn anyway is there something to order: everything before keeps
its turn, and what follows is settled by rounds over all conversations at once. Arguments are validated against a schema
per tool name by native expressions compiled from it, and each conversation is one canonical JSON array: keys sorted, no
white space, one object a message.

Messages are (conv_id, turn, kind, role, text, call_id, name, arguments, after): kind is "message", "call" or
"result", arguments a JSON text, after an array of call ids. conv_id may be of any type that can be grouped.

Defined results: null conv_ids are one conversation, whose messages are gathered in one row as those of any other. A
null turn stands first; ties are ordered by kind, call_id and content. A second call with an identifier counts as
duplicate and takes no results; a result without a call is an orphan and a call without a result unanswered, both stay
at their turn. Members of a dependency cycle, and what depends on them, stay at their turns and count as cyclic.
Arguments that are no JSON or break the schema are invalid and serialised as text if they are no JSON; a tool without a
schema takes any JSON object. Null texts are empty ones; very long texts stay whole. Repeated rows are messages of their
own. An empty table gives no rows. Extra columns do not matter.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise

#: JSON types and how Spark names them in a variant. Whole numbers beyond 64 bits and with a point are decimals or doubles.
_TYPES = {"string": "^STRING$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT<", "array": "^ARRAY<", "null": "^VOID$"}
#: JSON Schema keywords that say nothing about validity, and those that are checked; fixed values.
_NOTES = frozenset("title description default examples $schema $id $comment deprecated readOnly writeOnly".split())
_CHECKED = frozenset(
    "type enum const required properties additionalProperties minProperties maxProperties items minItems maxItems minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum allOf anyOf oneOf not".split()
)


def _get(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _same(value: Column, kind: Column, literal: object) -> Column:
    """Whether a JSON value equals a literal of the schema, as JSON: 1 is 1.0, and no string."""
    if literal is None:
        return kind == "VOID"
    if isinstance(literal, bool):
        return (kind == "BOOLEAN") & (_get(value, "boolean") == literal)
    if isinstance(literal, (int, float)):
        return kind.rlike(_TYPES["number"]) & (_get(value, "double") == float(literal))
    if isinstance(literal, str):
        return (kind == "STRING") & (_get(value, "string") == literal)
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(literal))))


def _rule(schema: dict | bool):
    return lambda value: _meets(value, schema)


def _meets(value: Column, schema: dict | bool) -> Column:
    """Whether a JSON value (a variant that is not null) meets a schema. Names never become part of a path."""
    if isinstance(schema, bool):
        return F.lit(schema)
    strange = set(schema) - _CHECKED - _NOTES
    if strange:
        raise ValueError(f"schema keywords that are not supported: {sorted(strange)}")
    ok = F.lit(True)
    kind = F.schema_of_variant(value)
    if "type" in schema:
        types, any_of = schema["type"] if isinstance(schema["type"], list) else [schema["type"]], F.lit(False)
        for t in types:
            if t == "integer":
                number = _get(value, "double")
                any_of = any_of | (kind.rlike(_TYPES["number"]) & (number == F.rint(number)))
            else:
                any_of = any_of | kind.rlike(_TYPES[t])
        ok = ok & any_of
    if "const" in schema:
        ok = ok & _same(value, kind, schema["const"])
    if "enum" in schema:
        among = F.lit(False)
        for literal in schema["enum"]:
            among = among | F.coalesce(_same(value, kind, literal), F.lit(False))
        ok = ok & among

    def when_type(t: str, *checks: Column) -> None:
        nonlocal ok
        for c in checks:
            ok = ok & (~kind.rlike(_TYPES[t]) | F.coalesce(c, F.lit(False)))

    text, number = _get(value, "string"), _get(value, "double")
    bounds = {"minLength": F.length(text) >= schema.get("minLength"), "maxLength": F.length(text) <= schema.get("maxLength")}
    when_type("string", *[c for k, c in bounds.items() if k in schema])
    if "pattern" in schema:
        when_type("string", text.rlike(schema["pattern"]))
    for k, c in {"minimum": lambda x: number >= float(x), "maximum": lambda x: number <= float(x), "exclusiveMinimum": lambda x: number > float(x), "exclusiveMaximum": lambda x: number < float(x)}.items():
        if k in schema:
            when_type("number", c(schema[k]))
    items = _get(value, "array<variant>")
    for k, c in {"minItems": lambda x: F.size(items) >= x, "maxItems": lambda x: F.size(items) <= x}.items():
        if k in schema:
            when_type("array", c(schema[k]))
    if "items" in schema:
        when_type("array", F.forall(items, lambda x: _meets(x, schema["items"])))
    fields = _get(value, "map<string,variant>")
    for k, c in {"minProperties": lambda x: F.size(fields) >= x, "maxProperties": lambda x: F.size(fields) <= x}.items():
        if k in schema:
            when_type("object", c(schema[k]))
    if schema.get("required"):
        when_type("object", F.size(F.array_except(F.array(*map(F.lit, schema["required"])), F.map_keys(fields))) == 0)
    for name, rule in schema.get("properties", {}).items():
        when_type("object", ~F.map_contains_key(fields, name) | let(F.try_element_at(fields, F.lit(name)), _rule(rule)))
    rest = schema.get("additionalProperties", True)
    if rest is not True:
        named = F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>")
        when_type("object", F.forall(F.map_entries(fields), lambda e: F.array_contains(named, e["key"]) | _meets(e["value"], rest)))
    for part in schema.get("allOf", []):
        ok = ok & _meets(value, part)
    for word in ("anyOf", "oneOf"):
        if word in schema:
            n = sum((_meets(value, part).cast("int") for part in schema[word]), F.lit(0))
            ok = ok & ((n > 0) if word == "anyOf" else (n == 1))
    if "not" in schema:
        ok = ok & ~_meets(value, schema["not"])
    return F.coalesce(ok, F.lit(False))


def valid(arguments: Column, schema: dict) -> Column:
    """Whether a JSON text is an object that meets a JSON schema; keywords that are not supported raise ValueError."""
    whole = F.try_parse_json(arguments)
    return F.coalesce(F.schema_of_variant(whole).rlike(_TYPES["object"]) & _meets(whole, schema), F.lit(False))


def validity(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    out = None
    for tool, schema in schemas.items():
        rule = valid(arguments, schema)
        out = F.when(name == tool, rule) if out is None else out.when(name == tool, rule)
    anything = valid(arguments, {})
    return anything if out is None else out.otherwise(anything)


def _hash_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A shuffled hash join on columns that may be null; ``right`` comes with the columns prefixed by r_."""
    condition = None
    for c in on:
        one = left[c].eqNullSafe(right[f"r_{c}"])
        condition = one if condition is None else condition & one
    return left.join(right.hint("shuffle_hash"), condition, how).drop(*[f"r_{c}" for c in on])


def _positions(edges: DataFrame) -> DataFrame:
    """node, place, depth, cyclic of nodes that prerequisites may move; edges are (conv_id, node, dep, dep_turn, turn)."""
    edges = materialise(edges, "prerequisites")
    late = edges.where("dep_turn >= turn").groupBy("conv_id").agg(F.min("turn").alias("r_from")).withColumnRenamed("conv_id", "r_conv_id")
    late = materialise(late, "late")
    # a node that stands before its conversation's first late one has none among its prerequisites, near or far
    edges = edges.join(late, edges["conv_id"].eqNullSafe(late["r_conv_id"])).where(F.col("turn") >= F.col("r_from")).drop("r_conv_id", "r_from")
    edges = materialise(edges, "open_prerequisites")
    wanted = edges.groupBy("node").agg(F.count("*").alias("n"), F.first("turn").alias("turn"))
    wanted = materialise(wanted, "wanted")
    inner = edges.join(wanted.select(F.col("node").alias("dep")), "dep", "left_semi")
    # prerequisites without prerequisites of their own stand at their turns
    ready = edges.join(wanted.select(F.col("node").alias("dep")), "dep", "left_anti").select("node", "dep", F.col("dep_turn").alias("place"), F.lit(0).alias("depth"))
    done = None
    while True:
        come = ready.groupBy("node").agg(F.count("*").alias("m"), F.max(F.struct("place", "depth")).alias("last"))
        new = come.join(wanted, "node").where(F.col("m") == F.col("n"))
        at = F.greatest("turn", "last.place")
        new = new.select("node", at.alias("place"), F.when(at == F.col("last.place"), F.col("last.depth") + 1).otherwise(0).alias("depth"))
        settled = new if done is None else new.join(done, "node", "left_anti")
        settled = materialise(settled, "settled")
        if settled.isEmpty():
            break
        done = settled if done is None else done.unionByName(settled)
        more = inner.join(settled.select(F.col("node").alias("dep"), "place", "depth"), "dep").select("node", "dep", "place", "depth")
        if more.isEmpty():
            break
        ready = ready.unionByName(more)
    out = wanted.select("node", F.col("turn").alias("place"), F.lit(0).alias("depth"), F.lit(True).alias("cyclic"))
    if done is None:
        return out
    return out.join(done, "node", "left_anti").unionByName(done.withColumn("cyclic", F.lit(False)))


def format_chats(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, counts of links and faults, and the canonical JSON of each conversation."""
    m = messages.select(
        F.col("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("kind"), F.lit("message")).alias("kind"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.col("call_id").cast("string"),
        F.col("name").cast("string"),
        F.coalesce(F.col("arguments"), F.lit("")).alias("arguments"),
        F.coalesce(F.col("after").cast("array<string>"), F.array().cast("array<string>")).alias("after"),
    )
    m = materialise(m.withColumn("node", F.monotonically_increasing_id()), "messages")
    calls = m.where((F.col("kind") == "call") & F.col("call_id").isNotNull())
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "node")).alias("c"))
    first = first.select(F.col("conv_id").alias("r_conv_id"), F.col("call_id").alias("r_call_id"), F.col("c.node").alias("call_node"), F.col("c.turn").alias("call_turn"))
    results = m.where(F.col("kind") == "result").select("conv_id", "call_id", "node", "turn")
    linked = materialise(_hash_join(results.where("call_id is not null"), first, ["conv_id", "call_id"], "inner"), "linked")
    answered = linked.select(F.col("call_node").alias("node")).distinct().withColumn("answered", F.lit(True))

    edges = linked.select("conv_id", "node", F.col("call_node").alias("dep"), F.col("call_turn").alias("dep_turn"), "turn")
    named = calls.select("conv_id", "node", "turn", F.explode(F.array_distinct("after")).alias("call_id"))
    needs = _hash_join(named, first, ["conv_id", "call_id"], "inner").select("conv_id", "node", F.col("call_node").alias("dep"), F.col("call_turn").alias("dep_turn"), "turn")
    outcome = needs.select("conv_id", "node", F.col("dep").alias("call_node"), "turn").join(linked.select("call_node", F.col("node").alias("dep"), F.col("turn").alias("dep_turn")), "call_node")
    places = _positions(edges.unionByName(needs).unionByName(outcome.select("conv_id", "node", "dep", "dep_turn", "turn")))

    firsts = first.select(F.col("call_node").alias("node")).withColumn("is_first", F.lit(True))
    links = linked.select("node").withColumn("linked", F.lit(True))
    full = m.join(places, "node", "left").join(answered, "node", "left").join(firsts, "node", "left").join(links, "node", "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    ok = ~is_call | validity(F.col("name"), F.col("arguments"), schemas)
    quote = lambda c: F.regexp_replace(F.regexp_replace(F.to_json(F.struct(c.alias("a"))), '^\\{"a":', ""), "\\}$", "")
    arguments = F.coalesce(F.to_json(F.try_parse_json(F.col("arguments"))), quote(F.col("arguments")))
    # keys stand in sorted order; arguments come from a variant, whose keys are sorted at every depth
    shown = F.concat(
        F.when(is_call, F.concat(F.lit('{"arguments":'), arguments, F.lit(","))).otherwise(F.lit("{")),
        F.when(~is_call, F.concat(F.lit('"content":'), quote(F.col("text")), F.lit(","))).otherwise(F.lit("")),
        F.when(F.col("call_id").isNotNull() & (is_call | is_result), F.concat(F.lit('"id":'), quote(F.col("call_id")), F.lit(","))).otherwise(F.lit("")),
        F.when(is_call & F.col("name").isNotNull(), F.concat(F.lit('"name":'), quote(F.col("name")), F.lit(","))).otherwise(F.lit("")),
        F.lit('"role":'),
        quote(F.col("role")),
        F.lit(',"turn":'),
        F.col("turn").cast("string"),
        F.lit("}"),
    )
    line = F.struct(F.coalesce("place", "turn").alias("place"), F.coalesce("depth", F.lit(0)).alias("depth"), F.col("turn"), F.col("kind"), F.coalesce("call_id", F.lit("")).alias("id"), shown.alias("json"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    none = F.lit(False)
    return full.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"),
        n(F.coalesce("linked", none)).alias("n_linked"),
        n(is_call & F.coalesce("is_first", none) & ~F.coalesce("answered", none)).alias("n_unanswered"),
        n(is_result & ~F.coalesce("linked", none)).alias("n_orphans"),
        n(is_call & ~F.coalesce("is_first", none)).alias("n_duplicates"),
        n(~ok).alias("n_invalid"),
        n(F.coalesce("cyclic", none)).alias("n_cyclic"),
        F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["json"]), ","), F.lit("]")).alias("chat"),
    )


#: What a user's turn, read as a call of the assistant, must look like.
REPLY_SCHEMA = {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}


def from_turns(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as messages: a user turn calls for a reply, the assistant turn after it is the result.

    A call comes after the call of the user turn two turns before, and thus after its reply.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    call, result = role == "user", role == "assistant"
    turn = F.col("turn").cast("long")
    name = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    return conversations.select(
        F.col("conv_id"),
        turn.alias("turn"),
        F.when(call, "call").when(result, "result").otherwise("message").alias("kind"),
        role.alias("role"),
        F.col("text").cast("string").alias("text"),
        F.when(call, name(turn)).when(result, name(turn - 1)).alias("call_id"),
        F.when(call, "reply").alias("name"),
        F.when(call, F.to_json(F.struct(turn.alias("turn"), F.coalesce(F.col("text"), F.lit("")).alias("text")))).alias("arguments"),
        F.when(call, F.array_compact(F.array(name(turn - 2)))).alias("after"),
    )
