"""Verdict aggregation: evidence plus policy in, one decision per row out."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.memo import per_session
from .evidence import mask_entities, unless_empty

VERDICT = (
    "decision", "recommended_action", "scores", "matches", "redacted_prompt", "reason",
    "advice", "escalated",
)

# Details of matches without a text of their own.
DETAIL = {
    "attack": "Guardrail PROMPT_ATTACK content filter",
    "screener": "Injection screener fired",
    "topic": "Denied topic (",
    "content": "Content filter (",
    "obfuscation": "Hidden or disguised characters",
}
# Reason and advice texts; {t} stands for the type of the match.
REASON = {
    "secrets": "A secret was detected ({t}).",
    "pii": "Personal data was detected ({t}).",
    "prompt_injection": "The prompt resembles a prompt-injection or jailbreak attempt.",
    "topic": "The prompt requests a denied topic ({t}).",
    "content": "The prompt triggered the {t} content filter.",
    "obfuscation": "The prompt contained hidden or disguised characters designed to evade screening.",
}
ADVICE = {
    "secrets": "Remove the credential before sending, and rotate it if it is real.",
    "pii": "Remove the personal data, or proceed with the redacted prompt.",
    "prompt_injection": "Rephrase as a direct request, without instructions to ignore or override system rules.",
    "topic": "Rephrase to avoid this topic, or screen under a policy that permits it.",
    "content": "Remove or soften the flagged content.",
    "obfuscation": "Resubmit using plain, visible text — no zero-width, bidirectional, or look-alike characters.",
}
ALLOWED = ("No policy violations detected.", "Safe to proceed.")
UNEXPLAINED = ("The prompt violates the active policy.", "Review and rephrase the prompt.")


def _match(category: str, type_: Column, confidence: Column, detail: Column, span=None) -> Column:
    return F.struct(
        F.lit(category).alias("category"),
        type_.alias("type"),
        confidence.alias("confidence"),
        (F.lit(None).cast(S.SPAN) if span is None else span).alias("span"),
        detail.alias("detail"),
    ).cast(S.MATCH)


def _detected(entries: Column) -> Column:
    return F.filter(entries, lambda e: e["detected"])


def _any_detected(entries: Column) -> Column:
    return F.array_contains(entries["detected"], True)


def _first(entries: Column, field: str, value: str) -> Column:
    """The first entry whose `field` is `value`, NULL if there is none."""
    return F.get(entries, F.array_position(entries[field], value) - 1)


def _entity_matches(category: str, label: str, entities: Column) -> Column:
    matches = F.transform(
        _detected(entities),
        lambda e: _match(
            category,
            e["type"],
            F.lit(1.0),
            F.concat(F.lit(f"{label} detected ("), e["action"], F.lit(")")),
            e["span"],
        ),
    )
    return unless_empty(entities, matches, S.empty_array(S.MATCH))


def _one_if(condition: Column, match: Column) -> Column:
    return F.when(condition, F.array(match)).otherwise(S.empty_array(S.MATCH))


def _joined_or(parts: Column, fallback: str) -> Column:
    joined = F.array_join(parts, ", ")
    return F.when(F.char_length(joined) > 0, joined).otherwise(fallback)


@per_session
def _stages() -> list[dict[str, Column]]:
    policy, guardrail, injection = F.col("policy"), F.col("guardrail"), F.col("injection")
    active, attack = F.col("_active"), F.col("_attack")
    content = F.filter(guardrail["content"], lambda c: c["type"] != S.PROMPT_ATTACK)
    any_content = _any_detected(guardrail["content"])

    sources = {
        "_active": F.when(
            injection.isNotNull()
            & ~F.coalesce(injection["skipped"], F.lit(False))
            & (policy["mode"] != "off"),
            injection,
        ),
        "_attack": F.when(
            F.array_contains(guardrail["content"]["type"], S.PROMPT_ATTACK),
            F.get(
                F.filter(
                    guardrail["content"],
                    lambda c: (c["type"] == S.PROMPT_ATTACK) & c["detected"],
                ),
                F.lit(0),
            ),
        ),
        "_levels": last_levels(guardrail["content"]),
    }
    fired = F.coalesce(
        active["detected"] & (active["confidence"] >= policy["threshold"]), F.lit(False)
    )
    has_pii = _any_detected(guardrail["pii"])
    has_secrets = _any_detected(guardrail["secrets"])
    blocks_pii = policy["redaction_style"] == "block-on-detect"

    matches = F.concat(
        _entity_matches("secrets", "Secret", guardrail["secrets"]),
        _entity_matches("pii", "PII", guardrail["pii"]),
        _one_if(
            attack.isNotNull(),
            _match(
                "prompt_injection",
                F.lit(S.PROMPT_ATTACK),
                S.confidence_score(attack["confidence"]),
                F.lit(DETAIL["attack"]),
            ),
        ),
        _one_if(
            fired,
            _match(
                "prompt_injection",
                F.lit("injection_screener"),
                active["confidence"],
                _joined_or(active["indicators"], DETAIL["screener"]),
            ),
        ),
        unless_empty(
            guardrail["topics"],
            F.transform(
                _detected(guardrail["topics"]),
                lambda t: _match(
                    "topic",
                    t["name"],
                    F.coalesce(F.try_element_at(active["topic_scores"], t["name"]), F.lit(1.0)),
                    F.concat(F.lit(DETAIL["topic"]), t["action"], F.lit(")")),
                ),
            ),
            S.empty_array(S.MATCH),
        ),
        F.when(~any_content, S.empty_array(S.MATCH)).otherwise(
            F.transform(
                _detected(content),
                lambda c: _match(
                    "content",
                    c["type"],
                    S.confidence_score(c["confidence"]),
                    F.concat(F.lit(DETAIL["content"]), c["confidence"], F.lit(")")),
                ),
            )
        ),
        _one_if(
            F.coalesce(F.col("obfuscated"), F.lit(False)),
            _match(
                "obfuscation",
                F.lit("unicode_obfuscation"),
                F.lit(S.OBFUSCATION_CONFIDENCE),
                _joined_or(F.col("obf_indicators"), DETAIL["obfuscation"]),
            ),
        ),
    )
    blocked = (
        has_secrets
        | (has_pii & blocks_pii)
        | F.coalesce(attack["action"] == "BLOCKED", F.lit(False))
        | (fired & (policy["mode"] == "block"))
        | (
            (F.size(guardrail["topics"]) > 0)
            & F.exists(guardrail["topics"], lambda t: t["detected"] & (t["action"] == "BLOCKED"))
        )
        | (any_content & F.exists(content, lambda c: c["detected"] & (c["action"] == "BLOCKED")))
    )
    decision = F.col("decision")
    reason, advice = explain(decision, F.col("matches"))
    placeholder = policy["redaction_style"] == "placeholder"
    return [
        sources,
        {
            "matches": matches,
            "decision": F.when(blocked, "block").when(has_pii, "redact").otherwise("allow"),
        },
        {
            "recommended_action": recommended_action(decision),
            "scores": scores(guardrail, active, attack, F.col("_levels")),
            "redacted_prompt": F.when(
                decision == "redact",
                mask_entities(
                    F.col("normalized"),
                    _detected(guardrail["pii"]),
                    F.when(placeholder, "[").otherwise("{"),
                    F.when(placeholder, "]").otherwise("}"),
                ),
            ),
            "reason": reason,
            "advice": advice,
            "escalated": injection["escalated"],
        },
    ]


def combine(df: DataFrame) -> DataFrame:
    """Add the verdict columns.

    Needs `policy`, `guardrail`, `injection` (NULL where the screener did not run),
    `normalized`, `obfuscated` and `obf_indicators`.  Any evidence that blocks
    makes the row `block`; failing that, any that redacts makes it `redact`.
    """
    for stage in _stages():
        df = df.withColumns(stage)
    return df.drop("_active", "_attack", "_levels")


def recommended_action(decision: Column) -> Column:
    return (
        F.when(decision == "block", S.RECOMMENDED_ACTION["block"])
        .when(decision == "redact", S.RECOMMENDED_ACTION["redact"])
        .otherwise(S.RECOMMENDED_ACTION["allow"])
    )


def last_levels(content: Column) -> Column:
    """Scores of the content filters in their order; one named twice keeps its last level."""
    latest = F.reverse(content)
    return F.array(
        *[S.confidence_score(_first(latest, "type", name)["confidence"]) for name in S.CONTENT_FILTERS]
    )


def scores(guardrail: Column, active: Column, attack: Column, levels: Column) -> Column:
    """Numbers for people to look at; `levels` are the `last_levels` of the guardrail."""
    no_scores = F.create_map().cast("map<string,double>")
    graded = F.coalesce(active["topic_scores"], no_scores)
    # A topic only the guardrail found shows as 1; map_concat rejects a repeated key.
    ungraded = F.array_except(
        F.transform(_detected(guardrail["topics"]), lambda t: t["name"]),
        F.map_keys(F.map_filter(graded, lambda k, v: v.isNotNull())),
    )
    kept = F.map_filter(graded, lambda k, v: ~F.array_contains(ungraded, k))
    topics = unless_empty(
        guardrail["topics"],
        F.map_concat(
            kept, F.map_from_entries(F.transform(ungraded, lambda n: F.struct(n, F.lit(1.0))))
        ),
        graded,
    )
    names = F.array(*[F.lit(name) for name in S.CONTENT_FILTERS])
    known = [F.get(levels, F.lit(i)).isNotNull() for i in range(len(S.CONTENT_FILTERS))]
    content = F.when(reduce(and_, known), F.map_from_arrays(names, levels)).otherwise(
        F.map_from_entries(
            F.filter(
                F.arrays_zip(names.alias("key"), levels.alias("value")),
                lambda e: e["value"].isNotNull(),
            )
        )
    )
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.struct(
        flag(_any_detected(guardrail["pii"])).alias("pii"),
        flag(_any_detected(guardrail["secrets"])).alias("secrets"),
        F.greatest(
            F.coalesce(active["confidence"], F.lit(0.0)),
            F.coalesce(S.confidence_score(attack["confidence"]), F.lit(0.0)),
        ).alias("prompt_injection"),
        topics.alias("topics"),
        content.alias("content"),
    ).cast(S.SCORES)


def explain(decision: Column, matches: Column) -> tuple[Column, Column]:
    """Reason and advice: the first match of the strongest category speaks."""
    firsts = {c: _first(matches, "category", c)["type"] for c in S.MATCH_PRECEDENCE}
    reason = F.when(decision == "allow", ALLOWED[0])
    advice = F.when(decision == "allow", ALLOWED[1])
    for category, type_ in firsts.items():
        before, hole, after = REASON[category].partition("{t}")
        text = F.concat(F.lit(before), type_, F.lit(after)) if hole else F.lit(before)
        reason = reason.when(type_.isNotNull(), text)
        advice = advice.when(type_.isNotNull(), ADVICE[category])
    return reason.otherwise(UNEXPLAINED[0]), advice.otherwise(UNEXPLAINED[1])
