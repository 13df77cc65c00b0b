"""Prompt screening on Spark: tables and streams of prompts in, verdicts out."""

from .operators.evidence import evidence
from .operators.ratelimit import RateLimits, rate_limit, sliding_throttle
from .plans.replay import replay_all, replay_requested
from .operators.validate import validate
from .plans.screening import audit_rows, decide, screen, screen_all
from .sources.audit_store import read_audit, write_audit
from .sources.policies import Policy, bundled_policies, read_policies
from .streaming.screening import screen_stream

__all__ = [
    "Policy", "RateLimits", "audit_rows", "bundled_policies", "decide", "evidence",
    "rate_limit", "read_audit", "read_policies", "replay_all", "replay_requested",
    "screen", "screen_all", "screen_stream", "sliding_throttle", "validate", "write_audit",
]
