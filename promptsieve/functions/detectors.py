"""Detectors over sanitized text, as Column builders.

Each builder takes the text and, where useful, its lower-cased form, and tests a
cheap necessary condition before the regular expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S
from . import patterns as P
from .text import present, utf16_length, widen_astral


def _any_of(lower: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [lower.contains(w) for w in words])


# Words one of which occurs, in lower case, wherever the pattern matches.
_WORDS = {
    "AWS_SECRET_KEY": ("secret",),
    "PASSWORD": ("password",),
    "PIN": ("pin",),
    "MISCONDUCT": ("pick", "shoplift", "wire", "break", "launder", "counterfeit", "evade"),
    "medical_diagnosis": ("ibuprofen", "dos", "mg", "diagnos", "symptom", "medication", "prescri"),
    "legal_advice": ("lawsuit", "legal advice", "sue", "liab", "contract law"),
}
_DIGITS = r"[0-9]{3}"


def _gate(name: str, text: Column, lower: Column) -> Column | None:
    """A cheap condition that holds whenever the named pattern can match."""
    if name in _WORDS:
        return _any_of(lower, *_WORDS[name])
    return {
        "US_SOCIAL_SECURITY_NUMBER": lambda: text.contains("-") & text.rlike(_DIGITS),
        "EMAIL": lambda: text.contains("@"),
        "PHONE": lambda: text.rlike(_DIGITS)
        & text.rlike(P.Pattern("", r"\d{3}[-.\s]?\d{4}").java),
        "AWS_ACCESS_KEY": lambda: text.contains("AKIA"),
    }.get(name, lambda: None)()


def _occurs(text: Column, lower: Column, pattern: P.Pattern) -> Column:
    return _gate(pattern.name, text, lower) & text.rlike(pattern.java)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def span_of(text: Column, match: Column) -> Column:
    """First occurrence of the match, end exclusive, in UTF-16 units; NULL if none."""

    def located(at: Column) -> Column:
        before = F.substring(text, F.lit(1), at - 1)  # of at - 1 characters
        start = F.when(F.octet_length(before) == at - 1, at - 1).otherwise(
            (F.octet_length(F.encode(before, "UTF-16BE")) / 2).cast("int")
        )
        span = _once(
            start, lambda s: F.struct(s.alias("start"), (s + utf16_length(match)).alias("end"))
        )
        return F.when(at > 0, span)

    return F.when(F.char_length(match) > 0, _once(F.instr(text, match), located)).cast(S.SPAN)


def _hits_of(text: Column, lower: Column, pattern: P.Pattern) -> Column:
    found = F.transform(
        F.array_distinct(F.regexp_extract_all(text, F.lit(pattern.java), F.lit(0))),
        lambda m: F.struct(
            F.lit(pattern.name).alias("type"), m.alias("match"), span_of(text, m).alias("span")
        ),
    ).cast(f"array<{S.HIT}>")
    gate, none = _gate(pattern.name, text, lower), S.empty_array(S.HIT)
    if gate is None:  # the hits of a NULL text are NULL
        return F.when(~text.rlike(pattern.java), none).otherwise(found)
    return F.when(gate, found).otherwise(none)


def pattern_hits(text: Column, lower: Column, patterns: Iterable[P.Pattern]) -> Column:
    """Distinct (type, match) hits with spans: pattern by pattern, in text order."""
    return F.concat(*[_hits_of(text, lower, p) for p in patterns])


def pii_hits(text: Column, lower: Column) -> Column:
    return pattern_hits(text, lower, P.PII)


def secret_hits(text: Column, lower: Column) -> Column:
    return pattern_hits(text, lower, P.SECRETS)


def misconduct(text: Column, lower: Column) -> Column:
    return _occurs(text, lower, P.MISCONDUCT)


def injection_flags(text: Column, lower: Column) -> list[Column]:
    """One boolean per injection pattern, in pattern order."""
    ignore, forget, extract, role, jailbreak = P.INJECTION
    return [
        lower.contains("ignore") & text.rlike(ignore.java),
        _any_of(lower, "disregard", "forget") & text.rlike(forget.java),
        lower.contains("prompt") & widen_astral(text).rlike(extract.java),
        _any_of(lower, "you are now", "act as", "pretend") & text.rlike(role.java),
        _any_of(lower, "dan", "developer mode") & text.rlike(jailbreak.java),
    ]


def injection_confidence(flags: Column) -> Column:
    """Weights of all patterns that matched, added up and capped."""
    total = reduce(
        lambda a, b: a + b,
        [F.when(F.get(flags, F.lit(i)), p.weight).otherwise(0.0) for i, p in enumerate(P.INJECTION)],
    )
    return F.least(F.lit(S.INJECTION_CONFIDENCE_CAP), total)


def injection_indicators(flags: Column) -> Column:
    """Distinct indicator names in pattern order."""
    return _named(flags, P.INJECTION)


def _named(flags: Column, patterns: Iterable[P.Pattern]) -> Column:
    names = F.array(*[F.when(F.get(flags, F.lit(i)), p.name) for i, p in enumerate(patterns)])
    return F.when(F.array_contains(flags, True), present(names)).otherwise(
        F.array().cast("array<string>")
    )


def topic_flags(text: Column, lower: Column) -> list[Column]:
    """One boolean per known topic: its keywords occur, whatever a policy denies."""
    return [_occurs(text, lower, t) for t in P.TOPICS]


def named_topics(flags: Column) -> Column:
    return _named(flags, P.TOPICS)


def topic_hits(text: Column, lower: Column) -> Column:
    """Names of the known topics whose keywords occur."""
    return named_topics(F.array(*topic_flags(text, lower)))


def grade_topics(hits: Column, denied: Column) -> Column:
    """Display grade of each denied topic; an unknown topic counts as a miss."""
    topics = F.array_distinct(denied)
    graded = F.map_from_entries(
        F.transform(
            topics,
            lambda t: F.struct(
                t, F.when(F.array_contains(hits, t), S.TOPIC_HIT_SCORE).otherwise(S.TOPIC_MISS_SCORE)
            ),
        )
    )
    misses = F.array_repeat(F.lit(S.TOPIC_MISS_SCORE), F.size(topics))
    return F.when(F.size(hits) == 0, F.map_from_arrays(topics, misses)).otherwise(graded)
