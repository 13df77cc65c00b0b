"""Whole screening plans over tables of prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.evidence import EVIDENCE, evidence, guardrail_evidence
from ..operators.injection import Scorer, with_injection
from ..operators.verdict import combine
from ..sources.policies import Policy, attach_policy, bundled_policies, under_all_policies

WORK = EVIDENCE + ("guardrail", "injection", "policy")


def decide(found: DataFrame, scorer: Scorer | None = None, keep_evidence: bool = False) -> DataFrame:
    """Verdicts of evidence rows that carry a `policy` struct.  A narrow plan."""
    judged = combine(
        with_injection(found, scorer).withColumn("guardrail", guardrail_evidence(keep_evidence))
    )
    return judged if keep_evidence else judged.drop(*WORK)


def screen(
    prompts: DataFrame,
    policies: Sequence[Policy] | DataFrame | None = None,
    scorer: Scorer | None = None,
    keep_evidence: bool = False,
    nfkc_engine: str = "jvm",
) -> DataFrame:
    """Each prompt under the policy it asks for (`policy_id`, NULL meaning default)."""
    found = evidence(
        attach_policy(prompts, bundled_policies() if policies is None else policies),
        nfkc_engine=nfkc_engine,
    )
    return decide(found, scorer, keep_evidence)


def screen_all(
    prompts: DataFrame,
    policies: Sequence[Policy] | None = None,
    scorer: Scorer | None = None,
    keep_evidence: bool = False,
    nfkc_engine: str = "jvm",
) -> DataFrame:
    """Each prompt under every policy: detected once, decided once per policy."""
    found = evidence(prompts, nfkc_engine=nfkc_engine)
    return decide(
        under_all_policies(found, bundled_policies() if policies is None else policies),
        scorer,
        keep_evidence,
    )


def audit_rows(verdicts: DataFrame) -> DataFrame:
    """Verdicts in the audit layout: the raw prompt is kept, `escalated` is not."""
    df = verdicts
    for name, type_ in (
        ("app_id", "string"), ("context", "string"), ("replay_of", "string"),
        ("latency_ms", S.LATENCY), ("ts", "timestamp"),
    ):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(type_))
    return df.select(*S.AUDIT_FIELDS)
