"""Chat formatting: tool calls linked to their results, as canonical JSON. DataFrame functions only."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: What names a call.
KEY = ["conv_id", "call_id"]


def json_string(text: Column) -> Column:
    """The JSON string of a text; null for null."""
    json = F.to_json(F.struct(text.alias("x")))  # {"x":"..."}
    return F.when(text.isNotNull(), F.substring(json, F.lit(6), F.length(json) - 6))


def canonical(pairs: list[tuple[str, Column]]) -> Column:
    """A JSON object with its keys in code-point order, no spaces, and null members left out.

    The values are JSON already.
    """
    members = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(pairs, key=lambda p: p[0])]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def valid_arguments(name: Column, args: Column, schemas: dict[str, dict[str, tuple]]) -> Column:
    """Whether args, a map of JSON texts, fit the schema of the function `name`.

    schemas: {function: {argument: (kind, required)}} with the kinds string (not blank),
    integer, number and boolean; a third member bounds the characters of the JSON text. Unknown
    functions and unknown or null arguments do not fit.
    """
    fits = {
        "string": lambda v: v.rlike(r'^"[\s\S]*\S[\s\S]*"$'),
        "integer": lambda v: v.rlike(r"^-?(0|[1-9][0-9]*)$"),
        "number": lambda v: v.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"),
        "boolean": lambda v: v.isin("true", "false"),
    }
    out = F.lit(False)
    for function, spec in sorted(schemas.items()):
        ok = F.size(F.array_except(F.map_keys(args), F.array(*[F.lit(k) for k in sorted(spec)]).cast("array<string>"))) == 0
        for arg, (kind, required, *most) in sorted(spec.items()):
            here = args[F.lit(arg)]
            fit = fits[kind](here) & (F.length(here) <= most[0] + 2 if most else F.lit(True))
            ok = ok & F.coalesce(fit, F.lit(not required) & ~F.coalesce(F.map_contains_key(args, F.lit(arg)), F.lit(False)))
        out = F.when(name == function, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _named() -> Column:
    """Whether a row names its call in full."""
    return F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """Calls with their results, in topological order, as canonical JSON.

    calls(conv_id, call_id, name, args map<string, JSON text>, after array of call_ids that it
    depends on, place: any order of conversation), results(conv_id, call_id, content).
    Calls and results meet in a hash join on (conv_id, call_id), by which they are shuffled once;
    identifiers that hold over 1/256 of a table are folded before they are shuffled, and of those
    only the first call and result meet. Rows that are alike are one row
    with their number as `copies`. Of different calls or results with one identifier the smallest
    in (place, content) order stands for it; each other keeps a row with an identifier of its own
    (the old one, `~` and a hash of what it says) and the status `repeated`. Nulls among
    identifiers link with nothing.

    Returns one row for each different call, and for each result that is in no call's row: conv_id,
    call_id, level, place, status (linked, no_result, no_call, repeated), valid (arguments fit
    their schema; null for results), copies, json. Sorting by (conv_id, level, place, call_id) is
    a topological order: level is 0 for a call that waits for none, else one more than the highest
    it waits for, and null in or behind a cycle. Dependencies on calls that do not exist count as
    met; of several rows of one identifier all dependencies count. Empty and very long texts are texts
    like others; an empty table gives an empty result; extra columns are ignored.
    """
    said = F.struct("place", "name", F.sort_array(F.map_entries("args")).alias("args"))
    asked, answered = calls.select(*KEY, said.alias("said")), results.select(*KEY, F.col("content").alias("said"))
    # the order follows from identifiers alone, no text goes along
    waits = calls.where(_named()).select(*KEY, F.explode("after").alias("on")).where("on is not null").distinct()
    known = calls.where(_named()).groupBy("conv_id", F.col("call_id").alias("on")).agg(F.min("place").alias("at"))
    levels = _levels(waits.join(known.hint("shuffle_hash"), ["conv_id", "on"]))
    crowded = _crowded(asked, answered)
    # one shuffle by identifier serves to fold copies, to find the first, to add levels and to meet
    even = [t.where(~crowded).repartition(*KEY).groupBy(*KEY, "said").agg(F.count("*").alias("copies")) for t in (asked, answered)]
    even = [t.withColumn("first", F.row_number().over(Window.partitionBy(*KEY).orderBy("said")) == 1) for t in even]
    rows = _meet(*even, levels.where(~crowded).hint("shuffle_hash")).unionByName(
        _meet(*[_folded(t.where(crowded)) for t in (asked, answered)], F.broadcast(levels.where(crowded)))
    )
    c = F.col("said")
    args = F.concat(F.lit("{"), F.array_join(F.transform(c["args"], lambda e: F.concat(json_string(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ","), F.lit("}"))
    body = [("arguments", args), ("name", json_string(c["name"])), ("result", json_string(F.col("content")))]
    own = F.when(F.col("status") == "repeated", F.concat("call_id", F.lit("~"), F.substring(F.md5(canonical(body)), 1, 12))).otherwise(F.col("call_id"))
    level = F.when(F.col("_waits"), F.col("level")).otherwise(F.lit(0))
    valid = F.when(c.isNotNull(), valid_arguments(c["name"], F.map_from_entries(c["args"]), schemas))
    return rows.select("conv_id", own.alias("call_id"), level.alias("level"), c["place"].alias("place"), "status", valid.alias("valid"), "copies", canonical([("id", json_string(own)), *body]).alias("json"))


def _crowded(asked: DataFrame, answered: DataFrame, share: int = 256) -> Column:
    """Whether a row has no full identifier, or one that holds over 1/share of the calls or of the
    results (and over 1000 rows); of those there are under `share` in each table."""
    hot = []
    for t in (asked, answered):
        most = max(t.count() / share, 1000)
        hot += t.where(_named()).groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*KEY).collect()
    same = [F.struct(*[F.lit(r[k]).cast(asked.schema[k].dataType).alias(k) for k in KEY]) for r in hot]
    return ~_named() | (F.struct(*KEY).isin(same) if same else F.lit(False))


def _folded(rows: DataFrame) -> DataFrame:
    """Crowded rows as KEY, said, copies, first: folded by what they say before they are shuffled,
    and by that, too; the first ones are a row for each crowded identifier."""
    each = rows.groupBy(*KEY, "said").agg(F.count("*").alias("copies"))
    least = each.where(_named()).groupBy(*KEY).agg(F.min(F.struct("said")).alias("_least"))
    return each.join(F.broadcast(least), KEY, "left").withColumn("first", F.coalesce(F.col("_least.said").eqNullSafe(F.col("said")), F.lit(True))).drop("_least")


def _meet(asked: DataFrame, answered: DataFrame, levels: DataFrame) -> DataFrame:
    """Rows of KEY, said (the call's), copies, content, level, _waits, status: the first call of an
    identifier with its first result, and all others alone. Both sides are KEY, said, copies, first."""
    first = _named() & F.col("first")
    asked = asked.join(levels, KEY, "left")
    answered = answered.withColumnRenamed("said", "content")
    linked = (
        asked.where(first).select(*KEY, "said", "copies", "level", "_waits")
        .join(answered.where(first).select(*KEY, "content", F.col("copies").alias("_answers")).hint("shuffle_hash"), KEY, "full")
        .withColumn("status", F.when(F.col("copies").isNull(), "no_call").when(F.col("_answers").isNull(), "no_result").otherwise("linked"))
        .withColumn("copies", F.coalesce("copies", "_answers")).drop("_answers")
    )
    again = asked.where(~first).withColumn("status", F.when(_named(), "repeated").otherwise("no_result"))
    unasked = answered.where(~first).join(levels, KEY, "left").withColumn("status", F.when(_named(), "repeated").otherwise("no_call"))
    return linked.unionByName(again.drop("first"), allowMissingColumns=True).unionByName(unasked.drop("first"), allowMissingColumns=True)


def _levels(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, _waits) of the calls that wait: edges(conv_id, call_id, on, at),
    where `at` is the place of the one waited for.

    An edge says that a level is over that of another by a distance at least. In each round an
    edge to a call of known level becomes a known bound, and one to a call that waits for a
    single other goes on to that other, with the distances added; so chains halve, and the rounds
    grow with the logarithm of their length. A distance over the number of calls that wait goes
    round in a cycle, and stays.
    """
    folder, key = shared_dir(edges.sparkSession), KEY
    e = stored(edges.select(*key, "on", "at"), folder, "edges")
    # who waits for another through a later third waits for the third only, so that ladders are
    # chains; the last that a call waits for always stays, also in cycles
    through = e.select("conv_id", F.col("call_id").alias("on"), F.col("on").alias("beyond"), F.col("at").alias("at_beyond")).hint("shuffle_hash")
    implied = e.join(through, ["conv_id", "on"]).where("at > at_beyond").select(*key, F.col("beyond").alias("on"))
    e = stored(e.join(implied.hint("shuffle_hash"), [*key, "on"], "left_anti").select(*key, "on", F.lit(1).cast("long").alias("far")), folder, "round0")
    most = e.groupBy("conv_id").agg(F.count_distinct("call_id").alias("n")).agg(F.max("n")).first()[0] or 0
    known, before = F.col("on").isNull(), None
    for turn in itertools.count(1):
        now = tuple(e.agg(F.count("*"), F.sum("far"), F.count_if(known)).first())
        if now == before or not now[0] or now[0] == now[2]:
            break
        before = now
        # of each waiting call: its level as far as it is known, and the last one it waits for
        at = e.groupBy(*key).agg(F.max(F.when(known, F.col("far"))).alias("_base"), F.count_if(~known).alias("_open"), F.max(F.when(~known, F.struct("on", "far"))).alias("_next"))
        at = at.select("conv_id", F.col("call_id").alias("on"), "_base", "_open", "_next", F.lit(True).alias("_there"))
        open_ = e.where(~known).join(at.hint("shuffle_hash"), ["conv_id", "on"], "left")
        to = lambda on, far: F.struct(on.cast("string").alias("on"), far.alias("far"))
        far, base, nothing = F.col("far"), F.col("_base"), F.lit(None)
        onward = F.array_compact(F.array(to(F.col("_next.on"), far + F.col("_next.far")), F.when(base.isNotNull(), to(nothing, far + base))))
        goes = (
            F.when(F.col("_there").isNull(), F.array(to(nothing, far)))
            .when(F.col("_open") == 0, F.array(to(nothing, far + base)))
            .when((F.col("_open") == 1) & (far <= most), onward)
            .otherwise(F.array(to(F.col("on"), far)))
        )
        moved = open_.select(*key, F.inline(goes))
        e = e.where(known).unionByName(moved.select(e.columns)).groupBy(*key, "on").agg(F.max("far").alias("far"))
        e = stored(e, folder, f"round{turn}")
    level = F.when(F.count_if(~known) == 0, F.max("far")).cast("int")
    return e.groupBy(*key).agg(level.alias("level"), F.lit(True).alias("_waits"))


#: Most characters of a prompt, and the function that a plain chat turn calls, with its arguments.
PROMPT = 8000
CHAT_SCHEMAS = {"reply": {"prompt": ("string", True, PROMPT), "turn": ("integer", True)}}


def format_conversations(messages: DataFrame) -> DataFrame:
    """Chats as linked calls: each user turn calls `reply`, the assistant turn after it answers.

    messages(conv_id, turn, role, text). The call of user turn t has the identifier `t`; it waits
    for the calls of the two turns before, as far as these are a user's, so that its level is its
    place in the talk. The assistant turn t answers the call
    t - 1. Turns of other roles call nothing; each is a row with the status `message`, the role
    and text in its JSON, level 0 and null call_id and valid. Null text is an empty text (an empty
    prompt does not fit the schema, nor does one of over PROMPT characters). Rows whose conv_id or
    turn is null link with nothing. No turn is left out: copies are counted, and what else repeats
    a turn keeps its row; see link_calls, whose columns these are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"))
    asks = base.where("role = 'user'")
    args = F.create_map(F.lit("prompt"), json_string(F.col("text")), F.lit("turn"), F.coalesce(F.col("turn").cast("string"), F.lit("null")))
    calls = asks.select("conv_id", F.col("turn").cast("string").alias("call_id"), F.lit("reply").alias("name"), args.alias("args"), F.array(*[(F.col("turn") - n).cast("string") for n in (1, 2)]).alias("after"), F.col("turn").alias("place"))
    results = base.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), F.col("text").alias("content"))
    other = base.where("coalesce(role, '') not in ('user', 'assistant')").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    message = canonical([("content", json_string(F.col("text"))), ("role", json_string(F.col("role")))])
    rest = other.select("conv_id", F.lit(None).cast("string").alias("call_id"), F.lit(0).alias("level"), F.col("turn").alias("place"), F.lit("message").alias("status"), F.lit(None).cast("boolean").alias("valid"), "copies", message.alias("json"))
    return link_calls(calls, results, CHAT_SCHEMAS).unionByName(rest)
