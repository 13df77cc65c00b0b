"""Replay of audited prompts under other policies, and what changes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.validate import replay_request_issues, title_of
from ..sources.policies import Policy, bundled_policies
from .screening import audit_rows, screen, screen_all

_CARRIED = ("prompt", "app_id", "context")


def replay_id(original_id: Column, policy_id: Column, run: str) -> Column:
    """Deterministic within a run, so that a rerun writes the same records; another run
    leaves records of its own."""
    return F.md5(F.concat_ws(":", F.lit("replay"), F.lit(run), original_id, policy_id))


def _as_prompts(audit: DataFrame, replayed_at: datetime | None) -> DataFrame:
    now = F.current_timestamp() if replayed_at is None else F.lit(replayed_at)
    return audit.select(
        F.col("request_id").alias("replay_of"),
        now.alias("ts"),
        *_CARRIED,
        F.struct("policy_id", "decision", "scores", "matches").alias("original"),
    )


def _with_ids(verdicts: DataFrame, run: str) -> DataFrame:
    return verdicts.withColumn(
        "request_id", replay_id(F.col("replay_of"), F.col("policy_id"), run)
    )


def replay_all(
    audit: DataFrame,
    policies: Sequence[Policy] | None = None,
    run: str = "all",
    replayed_at: datetime | None = None,
) -> DataFrame:
    """Each audited raw prompt screened again under every policy.

    `run` names the replay: a later run, say under changed policies, keeps the records of
    earlier ones.  Replays carry the time of the replay.  The original verdict travels
    along in `original`, so comparing needs no join.
    """
    return _with_ids(screen_all(_as_prompts(audit, replayed_at), policies), run)


def replay_requested(
    audit: DataFrame,
    requests: DataFrame,
    policies: Sequence[Policy] | DataFrame | None = None,
    run: str = "all",
    replayed_at: datetime | None = None,
) -> DataFrame:
    """Replays asked for as (request_id, policy_id), once each in a run; unknown ids and
    policies drop out: `replay_outcomes` has a row for them."""
    asked = requests.select(F.col("request_id").alias("replay_of"), "policy_id").distinct()
    prompts = _as_prompts(audit, replayed_at).join(asked, "replay_of")
    return _with_ids(screen(prompts, policies), run)


def replay_outcomes(
    audit: DataFrame,
    requests: DataFrame,
    policies: Sequence[Policy] | None = None,
    run: str = "all",
    replayed_at: datetime | None = None,
) -> DataFrame:
    """One row per request (request_id, policy_id), repeated ones too, with status, title,
    detail, and for status 200 the replay's replay_id and decision.

    In the order of the checks: a malformed request is 400; an unknown record, then an
    unknown policy, is 404.
    """
    policies = bundled_policies() if policies is None else policies
    done = replay_requested(audit, requests, policies, run, replayed_at).select(
        F.col("replay_of").alias("request_id"),
        "policy_id",
        F.col("request_id").alias("replay_id"),
        "decision",
    )
    found = audit.select("request_id", F.lit(True).alias("_found"))
    missing = F.col("_found").isNull()
    unknown = ~F.col("policy_id").isin([p.id for p in policies])
    status = (
        F.when(F.size(replay_request_issues()) > 0, 400)
        .when(missing | unknown, 404)
        .otherwise(200)
    )
    detail = F.when(
        missing, F.concat(F.lit("Audit record not found: '"), F.col("request_id"), F.lit("'"))
    ).otherwise(F.concat(F.lit("Unknown policy: '"), F.col("policy_id"), F.lit("'")))
    return (
        requests.select("request_id", "policy_id")
        .join(found, "request_id", "left")
        .withColumn("status", status)
        .withColumn("title", title_of(F.col("status")))
        .withColumn("detail", F.when(F.col("status") == 404, detail))
        .drop("_found")
        .join(done, ["request_id", "policy_id"], "left")
    )


def replay_audit_rows(replays: DataFrame) -> DataFrame:
    return audit_rows(replays)


def _match_names(matches: Column) -> Column:
    return F.transform(matches, lambda m: F.concat_ws(":", m["category"], m["type"]))


def diff(original: Column, replay: Column) -> dict[str, Column]:
    """Change of decision, matches gained and lost, and score deltas."""
    before, after = _match_names(original["matches"]), _match_names(replay["matches"])
    return {
        "changed": original["decision"] != replay["decision"],
        "gained": F.array_except(after, before),
        "lost": F.array_except(before, after),
        "delta_prompt_injection": replay["scores"]["prompt_injection"]
        - original["scores"]["prompt_injection"],
        "delta_pii": replay["scores"]["pii"] - original["scores"]["pii"],
        "delta_secrets": replay["scores"]["secrets"] - original["scores"]["secrets"],
    }


def transitions(pairs: DataFrame) -> DataFrame:
    """Count of replays by (policies, decisions) with the changed flag.

    `pairs` holds the structs `original` and `replay`.
    """
    before, after = F.col("original"), F.col("replay")
    return (
        pairs.groupBy(
            before["policy_id"].alias("from_policy"),
            after["policy_id"].alias("to_policy"),
            before["decision"].alias("from_decision"),
            after["decision"].alias("to_decision"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("changed", F.col("from_decision") != F.col("to_decision"))
    )


def transition_matrix(pairs: DataFrame, decisions: Sequence[str] = S.DECISIONS) -> DataFrame:
    """One row per policies and decision before, one column per decision after: a pivot, so
    the counts are combined before the shuffle like any sum."""
    before, after = F.col("original"), F.col("replay")
    return (
        pairs.select(
            before["policy_id"].alias("from_policy"),
            after["policy_id"].alias("to_policy"),
            before["decision"].alias("from_decision"),
            after["decision"].alias("to_decision"),
        )
        .groupBy("from_policy", "to_policy", "from_decision")
        .pivot("to_decision", list(decisions))
        .agg(F.count(F.lit(1)))
        .fillna(0, list(decisions))
    )
