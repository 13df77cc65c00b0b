"""Truth table of the verdict aggregation over hand-made evidence rows."""

import pytest

from promptsieve import audit_rows, screen
from promptsieve import schemas as S
from promptsieve.operators.evidence import add_spans
from promptsieve.operators.verdict import combine
from pyspark.sql import functions as F

DDL = (
    f"id string, policy {S.POLICY}, guardrail {S.GUARDRAIL}, injection {S.INJECTION}, "
    "normalized string, obfuscated boolean, obf_indicators array<string>"
)


def policy(mode="block", threshold=0.5, style="anonymize", topics=()):
    return ("p", None, "g", "1", mode, threshold, style, list(topics), "MEDIUM")


def guardrail(pii=(), secrets=(), topics=(), content=()):
    entity = lambda e: (e[0], e[1], e[2], e[3] if len(e) > 3 else None, None)
    return (False, None, [entity(e) for e in pii], [entity(e) for e in secrets], list(topics),
            list(content), None, None)


def injection(detected=False, confidence=0.0, indicators=(), topics=None, skipped=False, escalated=False):
    return (detected, confidence, list(indicators), topics or {}, skipped, escalated, None)


def case(text="hello", p=None, g=None, i="none", obf=None):
    return (p or policy(), g or guardrail(), injection() if i == "none" else i, text,
            obf is not None, obf or [])


EMAIL = ("EMAIL", "BLOCKED", True, "a@b.com")
FIRED = injection(True, 0.8, ["instruction_override"])
CASES = {
    "clean": (case(), "allow"),
    "secret": (case("key AKIA", g=guardrail(secrets=[("AWS_ACCESS_KEY", "BLOCKED", True, "AKIA")])), "block"),
    "secret undetected": (case(g=guardrail(secrets=[("AWS_ACCESS_KEY", "NONE", False)])), "allow"),
    "pii": (case("email a@b.com", g=guardrail(pii=[EMAIL])), "redact"),
    "pii placeholder": (case("email a@b.com", policy(style="placeholder"), guardrail(pii=[EMAIL])), "redact"),
    "pii blocks": (case("email a@b.com", policy(style="block-on-detect"), guardrail(pii=[EMAIL])), "block"),
    "pii undetected": (case(g=guardrail(pii=[("EMAIL", "NONE", False)])), "allow"),
    "pii without text": (case("hi", g=guardrail(pii=[("EMAIL", "BLOCKED", True, None)])), "redact"),
    "pii elsewhere": (case("hi", g=guardrail(pii=[("EMAIL", "BLOCKED", True, "x@y.z")])), "redact"),
    "attack blocked": (case(g=guardrail(content=[("PROMPT_ATTACK", "HIGH", "BLOCKED", True)])), "block"),
    "attack noted": (case(g=guardrail(content=[("PROMPT_ATTACK", "LOW", "NONE", True)])), "allow"),
    "screener": (case(i=FIRED), "block"),
    "screener at threshold": (case(i=injection(True, 0.5)), "block"),
    "screener below": (case(i=injection(True, 0.49)), "allow"),
    "screener flags": (case(p=policy("flag"), i=FIRED), "allow"),
    "screener off": (case(p=policy("off"), i=FIRED), "allow"),
    "screener skipped": (case(i=injection(True, 0.99, skipped=True)), "allow"),
    "screener absent": (case(i=None), "allow"),
    "topic": (case(g=guardrail(topics=[("medical", "BLOCKED", True)]), i=injection(topics={"medical": 0.92, "legal": 0.04})), "block"),
    "topic ungraded": (case(g=guardrail(topics=[("medical", "BLOCKED", True)])), "block"),
    "topic noted": (case(g=guardrail(topics=[("medical", "NONE", True)])), "allow"),
    "topic undetected": (case(g=guardrail(topics=[("medical", "BLOCKED", False)])), "allow"),
    "content": (case(g=guardrail(content=[("HATE", "HIGH", "BLOCKED", True)])), "block"),
    "content noted": (case(g=guardrail(content=[("HATE", "LOW", "NONE", True)])), "allow"),
    "content twice": (case(g=guardrail(content=[("HATE", "LOW", "NONE", False), ("HATE", "HIGH", "NONE", False)])), "allow"),
    "obfuscated": (case(obf=["zero_width", "homoglyph"]), "allow"),
    "secret and pii": (case("AKIA a@b.com", g=guardrail(pii=[EMAIL], secrets=[("AWS_ACCESS_KEY", "BLOCKED", True, "AKIA")])), "block"),
    "mask inside mask": (case("EMAIL a@b.com", g=guardrail(pii=[EMAIL, ("NAME", "BLOCKED", True, "EMAIL")])), "redact"),
}


@pytest.fixture(scope="module")
def got(spark):
    rows = [(name, *values) for name, (values, _) in CASES.items()]
    df = spark.createDataFrame(rows, DDL)
    df = df.withColumn("guardrail", add_spans(F.col("guardrail"), F.col("normalized")))
    return {r.id: r for r in combine(df).collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_decision(got, name):
    assert got[name].decision == CASES[name][1]
    assert (got[name].redacted_prompt is None) == (CASES[name][1] != "redact")


def test_details(got):
    m = got["secret"].matches[0]
    assert (m.category, m.type, m.confidence, m.detail) == ("secrets", "AWS_ACCESS_KEY", 1.0, "Secret detected (BLOCKED)")
    assert (m.span.start, m.span.end) == (4, 8)
    assert got["secret"].scores.secrets == 1.0
    assert got["pii"].redacted_prompt == "email {EMAIL}"
    assert got["pii placeholder"].redacted_prompt == "email [EMAIL]"
    assert got["pii without text"].redacted_prompt == "hi"
    assert got["pii without text"].matches[0].span is None
    assert got["pii elsewhere"].matches[0].span is None
    assert got["mask inside mask"].redacted_prompt == "{NAME} {{NAME}}"
    assert got["attack noted"].scores.prompt_injection == 0.35
    assert got["screener flags"].matches[0].type == "injection_screener"
    assert got["screener at threshold"].matches[0].detail == "Injection screener fired"
    assert got["screener off"].matches == [] and got["screener off"].scores.prompt_injection == 0
    assert got["screener skipped"].scores.prompt_injection == 0
    assert got["screener absent"].escalated is None
    assert got["topic"].matches[0].confidence == 0.92
    assert got["topic"].scores.topics == {"medical": 0.92, "legal": 0.04}
    assert got["topic ungraded"].matches[0].confidence == 1.0
    assert got["topic ungraded"].scores.topics == {"medical": 1.0}
    assert got["content"].matches[0].detail == "Content filter (HIGH)"
    assert got["content twice"].scores.content == {"HATE": 0.9}
    assert got["obfuscated"].matches[0].detail == "zero_width, homoglyph"
    assert got["obfuscated"].reason == "No policy violations detected."
    assert got["secret and pii"].reason == "A secret was detected (AWS_ACCESS_KEY)."
    assert got["topic"].reason == "The prompt requests a denied topic (medical)."
    assert got["content"].advice == "Remove or soften the flagged content."


def _lambdas_always_run(df) -> list[str]:
    """Higher-order functions that the optimized plan evaluates for every row: not below a
    branch of a condition, nor on the right of a boolean operator."""
    found, plans, expressions = [], [df._jdf.queryExecution().optimizedPlan()], []
    children = lambda node: [node.children().apply(i) for i in range(node.children().size())]
    while plans:
        plan = plans.pop()
        plans += children(plan)
        expressions += [plan.expressions().apply(i) for i in range(plan.expressions().size())]
    while expressions:
        node = expressions.pop()
        kind, below = node.getClass().getSimpleName(), children(node)
        if kind in ("ArrayTransform", "ArrayFilter", "ArrayExists", "ArrayAggregate", "MapFilter"):
            found.append(kind)
        expressions += below[:1] if kind in ("CaseWhen", "If", "And", "Or", "Coalesce") else below
    return found


def test_rows_without_evidence_run_no_lambda(spark):
    # Spark generates no code for lambdas: they took half the time of screening short prompts
    df = spark.createDataFrame([("a", "hi", "strict")], "request_id string, prompt string, policy_id string")
    assert _lambdas_always_run(audit_rows(screen(df))) == []


def test_filters_in_any_order_and_unknown_levels(spark):
    content = [
        ("MISCONDUCT", "HIGH", "NONE", False), ("HATE", "LOW", "NONE", False), (None, "LOW", "NONE", None),
        ("HATE", "MEDIUM", "NONE", True), ("SEXUAL", "odd", "NONE", False), ("INSULTS", None, "NONE", None),
    ]
    rows = [("x", *case(g=guardrail(content=content))), ("y", *case(g=guardrail(content=content[:1] * 2)))]
    x, y = combine(spark.createDataFrame(rows, DDL)).orderBy("id").collect()
    assert x.scores.content == {"HATE": 0.65, "MISCONDUCT": 0.9}
    assert [(m.category, m.type, m.confidence) for m in x.matches] == [("content", "HATE", 0.65)]
    assert y.scores.content == {"MISCONDUCT": 0.9} and y.matches == []
