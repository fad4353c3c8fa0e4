"""Log lines to columns: JSON objects by aliases, text lines by their shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns, text

_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once a row, however often `use` names it.

    As an argument of a function it stands once in the plan, too.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sniff_format(line: Column) -> Column:
    """json for a line that is one object by its looks, else text."""
    s = strip(line)
    return F.when(s.startswith("{") & s.endswith("}"), F.lit("json")).otherwise(F.lit("text"))


def _epoch(number: Column, milliseconds: bool) -> Column:
    seconds = F.when(number > 1e12, number / 1000).otherwise(number) if milliseconds else number
    return F.when(F.abs(seconds) < 1e11, F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")))


def timestamp_in(line: Column) -> Column:
    """The first readable timestamp of a text, by the fixed list of shapes; without a zone it is UTC."""
    found = []
    for i, p in enumerate(patterns.TIMESTAMPS):
        raw = F.regexp_extract(line, f"(?U){p}", 0)  # an empty text is no time either
        if i == 3:
            continue  # the web-server shape is not readable as a time
        found.append(_epoch(raw.try_cast("double"), False) if i == 4 else F.try_to_timestamp(raw))
    return F.coalesce(*found)


def timestamp_field(value: Column) -> Column:
    """A field that holds a time: epoch seconds or milliseconds, or text in one of the usual forms.

    A weekday at the front says nothing more; without a zone the time is UTC. Texts of other forms
    are searched for a time.
    """
    number = F.when(value.rlike(r"^\s*-?\d+(\.\d+)?([eE][+-]?\d+)?\s*$"), value.try_cast("double"))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""), r"\b(GMT|UTC|Z)$", "+0000")

    def dated(stripped: Column, day: Column) -> Column:
        iso = F.when(day.rlike(r"^\d{4}-\d\d?-\d\d?"), F.try_to_timestamp(stripped))
        forms = [F.when(day.rlike(shape), F.try_to_timestamp(day, F.lit(form))) for shape, form in patterns.DATE_FORMS]
        return F.coalesce(iso, *forms, timestamp_in(value))

    text = _named(strip(value), lambda x: _named(bare(x), lambda day: dated(x, day)))
    return _named(number, lambda n: F.when(n.isNotNull(), _epoch(n, True)).otherwise(text))


_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _shielded(c: Column) -> Column:
    """JSON text in which a quote only begins or ends a string: what is escaped stands as a control character,
    of which valid JSON has none."""
    return F.replace(F.replace(c, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))


def _bare(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def _close(c: Column) -> Column:
    """Shielded JSON without white space between its tokens."""
    return F.regexp_replace(_shielded(c), r'("[^"]*+")|[ \t\r\n]+', "$1")


def compact_json(c: Column) -> Column:
    """Valid JSON without white space between its tokens; numbers stay as written, strings read the same."""
    return _bare(_close(c))


def json_members(c: Column) -> Column:
    """The members of a valid JSON object as texts `"key":value`, in order, equal keys included."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("begin"), F.array().cast("array<struct<begin:int,n:int>>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        at = s["at"] + 1
        end = (s["depth"] == 1) & t.isin(",", "}")
        n = at - s["begin"]
        return F.struct(
            (s["depth"] + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)).alias("depth"),
            at.alias("at"),
            F.when(end | (s["depth"] == 0), at + 1).otherwise(s["begin"]).alias("begin"),
            F.when(end & (n > 0), F.array_append(s["found"], F.struct(s["begin"].alias("begin"), n.alias("n")))).otherwise(s["found"]).alias("found"),
        )

    def members(tokens: Column) -> Column:
        parts = F.aggregate(tokens, start, step, lambda s: s["found"])
        return F.transform(parts, lambda p: _bare(F.array_join(F.slice(tokens, p["begin"], p["n"]), "")))

    return _named(F.regexp_extract_all(_close(c), F.lit(r'"[^"]*+"|[{}\[\],]|[^"{}\[\],]+'), F.lit(0)), members)


def _last_members(c: Column) -> Column:
    """The members of json_members, of equal keys the last, in the place of the first."""
    named = F.transform(json_members(c), lambda m: F.struct(F.get(F.json_object_keys(F.concat(F.lit("{"), m, F.lit("}"))), F.lit(0)).alias("key"), m.alias("member")))
    names = lambda found: F.array_distinct(F.transform(found, lambda m: m["key"]))
    return _named(named, lambda found: F.transform(names(found), lambda n: F.element_at(F.filter(found, lambda m: m["key"] == n), -1)))


def last_members(c: Column) -> Column:
    return F.transform(_last_members(c), lambda m: m["member"])


def readable_strings(c: Column) -> Column:
    """JSON whose strings have no escapes but those they need."""
    tokens = F.regexp_extract_all(_shielded(c), F.lit(r'"[^"]*+"|[^"]+'), F.lit(0))

    def read(t: Column) -> Column:
        written = F.to_json(F.from_json(F.concat(F.lit("["), _bare(t), F.lit("]")), "array<string>"))
        return F.when(t.rlike(r'^".*\\[u/]'), F.substr(written, F.lit(2), F.length(written) - 2)).otherwise(_bare(t))

    return F.array_join(F.transform(tokens, read), "")


def _one_map(member: Column) -> Column:
    return F.from_json(F.concat(F.lit("{"), member, F.lit("}")), "map<string,string>", _STRICT)


def is_json_object(text: Column) -> Column:
    """Whether a text is one JSON object and nothing else.

    It is read as the only element of an array and as the only member of an object: text behind it
    that would close the one doesn't close the other.
    """
    alone = F.json_object_keys(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
    first = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<struct<x:string>>", _STRICT)
    return F.coalesce(F.json_object_keys(text).isNotNull() & alone & (F.size(first) == 1), F.lit(False))


def repeats_keys(text: Column) -> Column:
    return _named(F.json_object_keys(text), lambda keys: F.size(keys) > F.size(F.array_distinct(keys)))


def json_object(text: Column) -> Column:
    """The members of a text that is one JSON object and nothing else, as map<string,string>; null for any other text.

    Of equal keys the last one counts. Values that are no strings are the text of the value.
    """
    alone = F.json_object_keys(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
    plain = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", _STRICT)
    values = lambda last: F.transform(last, lambda m: F.element_at(_one_map(m["member"]), m["key"]))
    kept = _named(_last_members(text), lambda last: F.map_from_arrays(F.transform(last, lambda m: m["key"]), values(last)))
    rare = F.when(is_json_object(text), kept)
    again = lambda m: F.size(F.map_keys(m)) > F.size(F.array_distinct(F.map_keys(m)))  # noqa: E731  the map has equal keys as they stand
    members = _named(plain, lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))))
    return F.when(alone, _named(members, lambda m: F.when(m.isNotNull() & ~again(m), m).when(repeats_keys(text), rare)))


def solid(found: Column, text: Column) -> Column:
    """A map of json_object without the members that count as missing: JSON's null, false, zero, and what is empty.

    The strings "0" and "false" are values; only where a value looks like one of these is the text asked.
    """
    empty = r':(null|false|-?0(\.0+)?([eE][+-]?\d+)?|""|\[\]|\{\})$'
    looks = lambda m: F.exists(F.map_values(m), lambda v: v.rlike(r"^(false|-?0(\.0+)?([eE][+-]?\d+)?|\[\]|\{\})$"))
    gone = F.transform(F.filter(_last_members(text), lambda m: m["member"].rlike(empty)), lambda m: m["key"])
    asked = lambda m: _named(gone, lambda names: F.map_filter(m, lambda k, v: v.isNotNull() & (v != "") & ~F.array_contains(names, k)))
    return _named(found, lambda m: F.when(looks(m), asked(m)).otherwise(F.map_filter(m, lambda _, v: v.isNotNull() & (v != ""))))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row, however often it is used above.

    A generator of one row stands between; projections above it are not merged into it, which
    would repeat the whole of a large expression for each of its uses.
    """
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def _aliases(keys: Column) -> Column:
    """The keys that are aliases of a field, in any case: the field, and what puts the first of its aliases first.

    Of one alias, the key that is written like it stands before those in another case.
    """
    names = [(F.lit(n.lower()), F.struct(F.lit(field).alias("field"), F.lit(i).alias("place"), F.lit(n).alias("name"))) for field, ns in patterns.ALIASES.items() for i, n in enumerate(ns)]
    known = F.create_map(*[c for pair in names for c in pair])
    found = F.transform(keys, lambda k, at: _named(known[F.lower(k)], lambda a: F.when(a.isNotNull(), F.struct(a["field"].alias("field"), a["place"].alias("place"), (a["name"] != k).alias("other"), at.alias("at"), k.alias("key")))))
    return F.filter(found, lambda a: a.isNotNull())


def with_parsed_json(lines: DataFrame, column: str = "text", default_service: str = "default_service", into: str = "parsed") -> DataFrame:
    """Add a struct of all parsed fields; null for a blank line, parse_error set where there is no object.

    A field has the value of the first alias that is there, be it null. Each step stands in
    columns of its own, so that a line is read as JSON once and its keys are searched once a field.
    """
    t = lines.withColumn("_raw", strip(F.col(column)))
    m = F.col("_m")
    t = once(t, "_m", json_object(F.col("_raw")))
    t = once(t, "_solid", solid(m, F.col("_raw")))
    t = once(t, "_k", _aliases(F.map_keys(m)))
    # a field is the first alias that is there, be it missing by its value
    named = lambda field: F.array_min(F.filter("_k", lambda a: a["field"] == field))["key"]
    alias = [F.element_at(m if field in ("timestamp", "message") else F.col("_solid"), named(field)).alias(field) for field in patterns.ALIASES]
    t = once(t, "_f", F.struct(*alias, json_object(m["kubernetes"]).alias("k8s")))
    f = F.col("_f")
    t = once(t, "_k8s", solid(f["k8s"], m["kubernetes"]))
    k8s, labelled = F.col("_k8s"), F.coalesce(F.col("_k8s")["labels"], F.col("_f")["k8s"]["pod_labels"])
    t = once(t, "_l", _named(labelled, lambda x: solid(json_object(x), x)))
    labels = F.col("_l")
    known = [n for names in patterns.ALIASES.values() for n in names]
    ok, level = m.isNotNull(), f["level"]
    row = F.struct(
        F.col("_raw").alias("raw_line"),
        F.when(ok, timestamp_field(f["timestamp"])).alias("timestamp"),
        F.when(ok & level.isNotNull(), text.canonical_level(level)).alias("level"),
        F.when(ok, F.coalesce(f["service"], labels["app"], labels["app.kubernetes.io/name"], labels["k8s-app"], k8s["container_name"], k8s["container"], F.nullif(F.col(default_service), F.lit("")))).alias("service"),
        F.when(ok, F.coalesce(f["environment"], k8s["namespace_name"], k8s["pod_namespace"], k8s["namespace"])).alias("environment"),
        F.when(ok, f["trace_id"]).alias("trace_id"),
        F.when(ok, f["request_id"]).alias("request_id"),
        F.when(ok, F.coalesce(f["host"], k8s["pod_name"], k8s["pod"], k8s["host"])).alias("host"),
        F.when(ok, F.coalesce(f["message"], F.col("_raw"))).alias("message"),
        F.when(ok, F.map_filter(m, lambda k, _: ~k.isin(known))).alias("extra"),
        F.lit("json").alias("parser_type"),
        F.when(~ok, F.lit("not a JSON object")).alias("parse_error"),
    )
    return once(t, into, F.when(F.col("_raw") != "", row)).drop("_raw", "_m", "_solid", "_k", "_f", "_k8s", "_l")


def with_parsed_text(lines: DataFrame, column: str = "text", default_service: str = "default_service") -> DataFrame:
    """Add the struct `parsed` of text lines: wrappers of container logs come off first.

    In this order: a CRI wrapper, a kubectl prefix, a CRI wrapper inside it; then the body by
    shape: `<time> <LEVEL> <service> <message>`, `<LEVEL> <service> <message>` (only directly
    in CRI), `<time> <LEVEL> <message>` (only behind a prefix, which names the service),
    `[time] [LEVEL] message`, and else time and level wherever they stand. The shape is found
    first; groups are then taken from its pattern alone.
    """
    lv, shapes = patterns.LEVEL_WORDS, patterns.LINE_SHAPES
    cri, kubectl = "(?Ud)" + patterns.CRI_LINE, "(?Ud)" + patterns.KUBECTL_LINE
    c, group = F.col, F.regexp_extract
    fits = lambda text, pattern: F.coalesce(c(text).rlike(pattern), F.lit(False))
    t = once(lines, "_raw", strip(c(column)))
    t = once(t, "_cri", fits("_raw", cri))
    t = once(t, "_outer", F.when(c("_cri"), group("_raw", cri, 1)))
    t = once(t, "_a", F.when(c("_cri"), strip(group("_raw", cri, 4))).otherwise(c("_raw")))
    t = once(t, "_pre", fits("_a", kubectl))
    t = once(t, "_b", F.when(c("_pre"), strip(group("_a", kubectl, 4))).otherwise(c("_a")))
    t = once(t, "_inner", c("_pre") & fits("_b", cri))
    t = once(t, "_cri_ts", F.coalesce(timestamp_in(F.when(c("_inner"), group("_b", cri, 1))), timestamp_in(c("_outer"))))
    t = once(t, "_body", F.when(c("_inner"), strip(group("_b", cri, 4))).otherwise(c("_b")))
    body, allowed = c("_body"), {"s": ~c("_pre"), "l": ~c("_pre") & c("_cri"), "t": c("_pre"), "b": F.lit(True)}
    t = once(t, "_shape", F.coalesce(*[F.when(allowed[k] & fits("_body", p), F.lit(k)) for k, p in shapes.items()], F.lit("f")))
    by = lambda free, **at: F.coalesce(*[F.when(c("_shape") == k, group("_body", shapes[k], i)) for k, i in at.items()], *([] if free is None else [F.when(c("_shape") == "f", free)]))
    t = once(t, "_time", by(body, s=1, t=1, b=1))
    t = once(t, "_ts", timestamp_in(c("_time")))
    t = once(t, "_level", by(F.regexp_substr(body, F.lit(rf"(?iuU)\b({lv})\b")), s=2, l=1, t=2, b=2))
    lead = F.when(F.contains(F.substring(body, 1, 30), F.lit(" ")), F.regexp_replace(body, r"(?U)^\S+(?:\s\S+)?\s*", "")).otherwise(F.regexp_replace(body, r"(?U)^\S+\s*", ""))
    rest = F.when(c("_ts").isNotNull(), strip(lead)).otherwise(body)
    t = once(t, "_message", strip(by(rest, s=4, l=3, t=3, b=3)))
    t = once(t, "_found", by(None, s=3, l=2))
    prefix = lambda i: F.when(c("_pre"), group("_a", kubectl, i))
    parsed = F.struct(
        c("_raw").alias("raw_line"),
        F.coalesce("_ts", "_cri_ts").alias("timestamp"),
        F.when(c("_level").isNotNull(), text.canonical_level(c("_level"))).alias("level"),
        F.when(c("_pre"), group("_a", kubectl, 3)).otherwise(F.coalesce("_found", F.nullif(c(default_service), F.lit("")))).alias("service"),
        F.nullif(prefix(1), F.lit("")).alias("environment"),
        F.lit(None).cast("string").alias("trace_id"),
        F.lit(None).cast("string").alias("request_id"),
        prefix(2).alias("host"),
        F.coalesce(F.nullif("_message", F.lit("")), body).alias("message"),
        F.lit(None).cast("map<string,string>").alias("extra"),
        F.lit("text").alias("parser_type"),
        F.lit(None).cast("string").alias("parse_error"),
    )
    t = once(t, "parsed", F.when(c("_raw") != "", parsed))
    return t.drop("_raw", "_cri", "_outer", "_a", "_pre", "_b", "_inner", "_cri_ts", "_body", "_shape", "_time", "_ts", "_level", "_message", "_found")


def parse_lines(lines: DataFrame, fmt: Column | None = None) -> DataFrame:
    """Add `parsed` to raw lines, each by its format (sniffed a line unless given)."""
    kind = sniff_format(F.col("text")) if fmt is None else fmt
    is_json = F.col("_fmt") == "json"
    t = once(lines, "_fmt", kind).withColumn("_text", F.when(~is_json, F.col("text"))).withColumn("_json", F.when(is_json, F.col("text")))
    both = with_parsed_text(t, "_text")
    both = with_parsed_json(both, "_json", into="_json_parsed")
    return once(both, "parsed", F.when(is_json, F.col("_json_parsed")).otherwise(F.col("parsed"))).drop("_fmt", "_text", "_json", "_json_parsed")
