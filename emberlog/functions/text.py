"""Scalar functions over log messages, as column expressions."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns

#: Unicode classes, with the separators U+001C to U+001F as white space, too.
_SPACE = r"[\s\x1c-\x1f]"


def _unicode(pattern: str) -> str:
    """The pattern with Unicode classes, as regular expressions of Python read it."""
    flags = "(?iuU)" if pattern.startswith("(?i)") else "(?U)"
    body = pattern.removeprefix("(?i)")
    return flags + body.replace(r"[^\s?]", r"[^\s\x1c-\x1f?]").replace(r"[^\s]", r"[^\s\x1c-\x1f]").replace(r"\S", r"[^\s\x1c-\x1f]")


def normalize(message: Column) -> Column:
    """Replace the varying parts of a message by placeholders and collapse white space.

    A rule runs only where a text holds what each of its matches must hold, which is cheap to find;
    most rules have nothing to do in most texts.
    """
    out = reduce(_rule, zip(patterns.NORMALIZATION, _NEEDED, strict=True), message)
    return F.trim(F.regexp_replace(out, f"(?U){_SPACE}+", " "))


#: What a match of each normalisation rule holds at least: a text, or a digit and what is next to
#: it; None where to look for it would cost as much as the rule.
_NEEDED = ["-", "eyJ", None, None, r"\p{Nd}\.\p{Nd}", ":", "@", "://", "_id=", r"\p{Nd}", r"\p{Nd}", r":\p{Nd}", r"\p{Nd}", "/", r"\p{Nd}-\p{Nd}"]


def _rule(text: Column, rule) -> Column:
    (pattern, replacement), needed = rule
    replaced = lambda x: F.regexp_replace(x, _unicode(pattern), replacement)
    if needed is None:
        return replaced(text)
    there = lambda x: x.rlike(needed) if "{" in needed else x.contains(needed)
    # an argument of a function is computed once, however often the function names it
    return F.get(F.transform(F.array(text), lambda x: F.when(there(x), replaced(x)).otherwise(x)), F.lit(0))


def fingerprint(normalized: Column) -> Column:
    """First 16 hexadecimal digits of SHA-256, `empty` for an empty template.

    The template is named once here, so that its normalisation runs once a row.
    """
    of_nothing = hashlib.sha256(b"").hexdigest()[:16]
    return F.replace(F.substring(F.sha2(normalized, 256), 1, 16), F.lit(of_nothing), F.lit("empty"))


def line_hash(line: Column) -> Column:
    return F.sha2(line, 256)


def is_trigger(message: Column) -> Column:
    return F.coalesce(message.rlike("(?iuU)" + "|".join(patterns.TRIGGERS)), F.lit(False))


def trigger_type(message: Column) -> Column:
    """Family of a trigger message; null if none matches."""
    return F.coalesce(*[F.when(message.rlike(f"(?iuU){p}"), F.lit(t)) for p, t in patterns.TRIGGER_TYPES])


def canonical_level(level: Column) -> Column:
    """One spelling for each level; unknown ones lower-cased and stripped, null or empty is info."""
    clean = F.lower(level)
    stripped = F.regexp_replace(clean, f"(?U)^{_SPACE}+|{_SPACE}+$", "")
    known = F.create_map(*[F.lit(x) for pair in patterns.LEVELS.items() for x in pair])
    return F.when(F.coalesce(level, F.lit("")) == "", F.lit("info")).otherwise(F.coalesce(known[stripped], stripped))


def severity_weight(level: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in patterns.SEVERITY.items() for x in pair])
    return F.coalesce(weights[F.lower(level)], F.lit(1.0))


def truncate_words(text: Column, n: int) -> Column:
    """At most n characters and an ellipsis, cut at the last blank if it is past the middle."""
    head = F.substring(text, 1, n)
    blank = F.lit(n) - F.instr(F.reverse(head), " ")  # position of the last blank, from 0; n: none
    cut = F.when((blank < n) & (blank > n // 2), F.substring(head, F.lit(1), blank)).otherwise(head)
    return F.when(text.isNull(), F.lit("")).when(F.length(text) <= n, text).otherwise(F.concat(cut, F.lit("…")))


def is_retry(message: Column) -> Column:
    return F.coalesce(message.rlike("(?iu)retry") & message.rlike("(?iu)evt_"), F.lit(False))


def is_queue_growth(message: Column) -> Column:
    return F.coalesce(message.rlike("(?iu)queue.{0,30}(growing|pending|backlog)") | message.rlike("(?iu)(pending|backlog).{0,30}queue"), F.lit(False))


def _has(text: Column, words: str) -> Column:
    return F.lower(text).rlike("|".join(words.split()))


def timeline_trigger_class(message: Column) -> Column:
    return F.when(_has(message, patterns.DEPLOY_WORDS), F.lit("deploy")).when(_has(message, patterns.STARTUP_WORDS), F.lit("startup")).otherwise(F.lit("trigger"))


def timeline_effect_class(message: Column, same_as_primary: Column) -> Column:
    return F.when(_has(message, patterns.SYMPTOM_WORDS), F.lit("symptom")).when(same_as_primary, F.lit("error")).otherwise(F.lit("effect"))


def effect_severity(text: Column) -> Column:
    return F.when(_has(text, patterns.FAILURE_WORDS), 0).when(_has(text, patterns.SLOWNESS_WORDS), 1).otherwise(2)


def trigger_key(message: Column) -> Column:
    """What makes two triggers the same: lower-cased, stripped, without a version at the end."""
    edges = f"(?U)^{_SPACE}+|{_SPACE}+$"
    low = F.regexp_replace(F.lower(message), edges, "")
    return F.regexp_replace(F.regexp_replace(low, f"(?U){patterns.VERSION}", ""), edges, "")


def whole_minutes(start: Column, end: Column) -> Column:
    """Whole minutes between two timestamps; null for none."""
    minutes = F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(60_000_000)).cast("int")
    return F.nullif(minutes, F.lit(0))


def token_estimate(prompt: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(prompt) / 4)).cast("int")
