"""Record types, enumerations and the fixed tables every verdict depends on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These names, orders and numbers must stay as they are for the
# verdicts to be right.
# ---------------------------------------------------------------------------
DECISIONS = ("allow", "redact", "block")
RECOMMENDED_ACTION = {"block": "block", "redact": "redact_and_proceed", "allow": "allow"}
MATCH_PRECEDENCE = ("secrets", "pii", "prompt_injection", "topic", "content", "obfuscation")
PROMPT_CONTEXTS = ("user_input", "system_message", "rag_result")
CONFIDENCE_TO_SCORE = {"NONE": 0.0, "LOW": 0.35, "MEDIUM": 0.65, "HIGH": 0.9}
GUARDRAIL_ACTIONS = ("NONE", "ANONYMIZED", "BLOCKED")
CONTENT_FILTERS = ("HATE", "INSULTS", "SEXUAL", "VIOLENCE", "MISCONDUCT")
PROMPT_ATTACK = "PROMPT_ATTACK"
SECRET_ENTITY_TYPES = ("AWS_ACCESS_KEY", "AWS_SECRET_KEY", "PASSWORD", "PIN")
INJECTION_MODES = ("block", "flag", "off")
REDACTION_STYLES = ("anonymize", "placeholder", "block-on-detect")
MAX_PROMPT_LENGTH = 25_000
STRONG_SIGNAL = 0.85
INJECTION_CONFIDENCE_CAP = 0.97
TOPIC_HIT_SCORE = 0.92
TOPIC_MISS_SCORE = 0.04
OBFUSCATION_CONFIDENCE = 0.5
# Content-filter strength is keyed on the policy id.
STRENGTH_BY_POLICY = {"strict": "HIGH", "permissive": "LOW"}
DEFAULT_STRENGTH = "MEDIUM"
# ---------------------------------------------------------------------------

SPAN = "struct<start:int,end:int>"
HIT = f"struct<type:string,match:string,span:{SPAN}>"
ENTITY = f"struct<type:string,action:string,detected:boolean,match:string,span:{SPAN}>"
TOPIC = "struct<name:string,action:string,detected:boolean>"
CONTENT = "struct<type:string,confidence:string,action:string,detected:boolean>"
GUARDRAIL = (
    "struct<intervened:boolean,action_reason:string,"
    f"pii:array<{ENTITY}>,secrets:array<{ENTITY}>,topics:array<{TOPIC}>,"
    f"content:array<{CONTENT}>,redacted_text:string,latency_ms:double>"
)
INJECTION = (
    "struct<detected:boolean,confidence:double,indicators:array<string>,"
    "topic_scores:map<string,double>,skipped:boolean,escalated:boolean,latency_ms:double>"
)
MATCH = f"struct<category:string,type:string,confidence:double,span:{SPAN},detail:string>"
SCORES = (
    "struct<pii:double,secrets:double,prompt_injection:double,"
    "topics:map<string,double>,content:map<string,double>>"
)
LATENCY = "struct<policy:double,guardrail:double,injection:double,total:double>"
POLICY = (
    "struct<id:string,description:string,guardrail_id:string,guardrail_version:string,"
    "mode:string,threshold:double,redaction_style:string,denied_topics:array<string>,"
    "strength:string>"
)

REQUEST_DDL = (
    "request_id string, ts timestamp, prompt string, policy_id string, context string, "
    "app_id string, client_id string, ip string"
)

AUDIT_DDL = (
    "request_id string, ts timestamp, policy_id string, app_id string, context string, "
    "prompt string, decision string, recommended_action string, "
    f"scores {SCORES}, matches array<{MATCH}>, redacted_prompt string, reason string, "
    f"advice string, latency_ms {LATENCY}, replay_of string"
)
AUDIT_FIELDS = (
    "request_id", "ts", "policy_id", "app_id", "context", "prompt", "decision",
    "recommended_action", "scores", "matches", "redacted_prompt", "reason", "advice",
    "latency_ms", "replay_of",
)


def empty_array(ddl_element: str) -> Column:
    return F.array().cast(f"array<{ddl_element}>")


def confidence_score(level: Column) -> Column:
    """Display score of a categorical confidence level (NULL for an unknown level)."""
    expr = F.when(level == "NONE", CONFIDENCE_TO_SCORE["NONE"])
    for name in ("LOW", "MEDIUM", "HIGH"):
        expr = expr.when(level == name, CONFIDENCE_TO_SCORE[name])
    return expr


def filter_strength(policy_id: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STRENGTH_BY_POLICY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, policy_id), F.lit(DEFAULT_STRENGTH))
