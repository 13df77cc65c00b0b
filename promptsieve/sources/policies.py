"""Screening policies: documents, contract check, guardrail bindings, joins."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.skew import hot_keys, lookup_join
from .scratch import materialize

DOCUMENT_DDL = (
    "id string, description string, guardrailId string, guardrailVersion string, "
    "promptInjection struct<mode:string,threshold:double>, redactionStyle string, "
    "deniedTopics array<string>"
)
# Most policies a broadcast join is hinted for; more go through an ordinary join.
MAX_BROADCAST_POLICIES = 10_000


@dataclass(frozen=True)
class Policy:
    id: str
    guardrail_id: str
    guardrail_version: str
    mode: str
    threshold: float
    redaction_style: str = "anonymize"
    denied_topics: tuple[str, ...] = field(default_factory=tuple)
    description: str | None = None

    def __post_init__(self) -> None:
        problems = [
            name
            for name, ok in (
                ("id", self.id),
                ("guardrailId", self.guardrail_id),
                ("guardrailVersion", self.guardrail_version),
                ("promptInjection.mode", self.mode in S.INJECTION_MODES),
                ("promptInjection.threshold", self.threshold is not None and 0 <= self.threshold <= 1),
                ("redactionStyle", self.redaction_style in S.REDACTION_STYLES),
                ("deniedTopics", all(isinstance(t, str) for t in self.denied_topics)),
            )
            if not ok
        ]
        if problems:
            raise ValueError(f"malformed policy {self.id!r}: {', '.join(problems)}")

    @classmethod
    def from_document(cls, doc: dict) -> Policy:
        injection = doc.get("promptInjection") or {}
        return cls(
            id=doc.get("id"),
            guardrail_id=doc.get("guardrailId"),
            guardrail_version=doc.get("guardrailVersion"),
            mode=injection.get("mode"),
            threshold=injection.get("threshold"),
            redaction_style=doc.get("redactionStyle"),
            denied_topics=tuple(doc.get("deniedTopics") or ()),
            description=doc.get("description"),
        )

    def literal(self) -> Column:
        """The policy as a constant struct, with its derived filter strength."""
        return F.struct(
            F.lit(self.id).alias("id"),
            F.lit(self.description).cast("string").alias("description"),
            F.lit(self.guardrail_id).alias("guardrail_id"),
            F.lit(self.guardrail_version).alias("guardrail_version"),
            F.lit(self.mode).alias("mode"),
            F.lit(float(self.threshold)).alias("threshold"),
            F.lit(self.redaction_style).alias("redaction_style"),
            F.array(*[F.lit(t) for t in self.denied_topics])
            .cast("array<string>")
            .alias("denied_topics"),
            F.lit(S.STRENGTH_BY_POLICY.get(self.id, S.DEFAULT_STRENGTH)).alias("strength"),
        ).cast(S.POLICY)


def bundled_policies() -> list[Policy]:
    folder = resources.files(__package__) / "policies"
    return [
        Policy.from_document(json.loads((folder / f"{name}.json").read_text("utf-8")))
        for name in ("strict", "default", "permissive")
    ]


def policy_struct() -> Column:
    """Policy struct from the columns of a table in the document layout."""
    return F.struct(
        F.col("id"),
        F.col("description"),
        F.col("guardrailId").alias("guardrail_id"),
        F.col("guardrailVersion").alias("guardrail_version"),
        F.col("promptInjection.mode").alias("mode"),
        F.col("promptInjection.threshold").alias("threshold"),
        F.col("redactionStyle").alias("redaction_style"),
        F.coalesce("deniedTopics", F.array().cast("array<string>")).alias("denied_topics"),
        S.filter_strength(F.col("id")).alias("strength"),
    ).cast(S.POLICY)


def policy_issues() -> Column:
    """Names of the fields of a policy document that break the contract."""
    injection = F.col("promptInjection")
    rules = {
        "id": F.length("id") >= 1,
        "guardrailId": F.length("guardrailId") >= 1,
        "guardrailVersion": F.length("guardrailVersion") >= 1,
        "promptInjection.mode": injection["mode"].isin(*S.INJECTION_MODES),
        "promptInjection.threshold": injection["threshold"].between(0.0, 1.0),
        "redactionStyle": F.col("redactionStyle").isin(*S.REDACTION_STYLES),
    }
    return F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]),
        lambda name: name.isNotNull(),
    )


def read_policies(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Policy documents (one JSON object per file, with `lines` one per line) as (id, policy);
    fails on a bad one.

    Every file is opened once: what was read is written out as one table.
    """
    docs = spark.read.schema(DOCUMENT_DDL).option("multiLine", not lines).json(path)
    docs = materialize(docs.withColumn("issues", policy_issues()), "policies")
    bad = docs.select("id", "issues").where(F.size("issues") > 0)
    shown = bad.take(5)
    if shown:
        raise ValueError(
            f"{bad.count()} malformed policies, among them "
            + "; ".join(f"{r.id}: {r.issues}" for r in shown)
        )
    return docs.select("id", policy_struct().alias("policy"))


def policy_frame(spark: SparkSession, policies: Sequence[Policy]) -> DataFrame:
    """Policies as a constant table (id, policy)."""
    return (
        spark.range(1)
        .select(F.explode(F.array(*[p.literal() for p in policies])).alias("policy"))
        .select(F.col("policy.id").alias("id"), "policy")
    )


def attach_policy(
    df: DataFrame, policies: Sequence[Policy] | DataFrame, how: str = "inner"
) -> DataFrame:
    """Join the policy each row asks for; absent policy ids mean `default`.

    Rows asking for an unknown policy drop out of an inner join: `unknown_policy`
    returns them.
    """
    wanted = df.withColumn("policy_id", F.coalesce("policy_id", F.lit("default")))
    if not isinstance(policies, DataFrame) and len(policies) <= MAX_BROADCAST_POLICIES:
        dim = F.broadcast(policy_frame(df.sparkSession, policies))
        return wanted.join(dim.withColumnRenamed("id", "policy_id"), "policy_id", how)
    dim = policies if isinstance(policies, DataFrame) else policy_frame(df.sparkSession, policies)
    # Hot policies, and `default` for the rows that name none, go by broadcast; their rows
    # are scattered in the shuffle for the rest.  A stream cannot be counted beforehand.
    often = [] if df.isStreaming else hot_keys(wanted, "policy_id")
    spread = [c for c in wanted.columns if c != "policy_id"] or ["policy_id"]
    found = lookup_join(
        wanted,
        dim.select(F.col("id").alias("policy_id"), "policy"),
        ["policy_id"],
        hot=F.col("policy_id").isin("default", *often),
        spread=spread[:2],
    )
    return found.where(F.col("policy").isNotNull()) if how == "inner" else found


def unknown_policy(df: DataFrame, policies: Sequence[Policy] | DataFrame) -> DataFrame:
    """Rows whose policy does not exist, with the problem they produce."""
    return (
        attach_policy(df, policies, "left")
        .where(F.col("policy").isNull())
        .drop("policy")
        .withColumn(
            "detail", F.concat(F.lit("Unknown policy: '"), F.col("policy_id"), F.lit("'"))
        )
    )


def under_all_policies(df: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """Every row once per policy.  Expands a constant array in place: no join."""
    return df.drop("policy_id").select(
        "*", F.explode(F.array(*[p.literal() for p in policies])).alias("policy")
    ).withColumn("policy_id", F.col("policy.id"))


def collect_bindings(settings: DataFrame) -> DataFrame:
    """(policy_id, guardrail_id, guardrail_version) from (key, value) settings.

    `GUARDRAIL_<P>_ID` counts only together with a non-empty `GUARDRAIL_<P>_VERSION`.
    """

    def half(suffix: str, name: str) -> DataFrame:
        policy = F.regexp_extract("key", f"^GUARDRAIL_(.+)_{suffix}$", 1)
        return (
            settings.where(F.col("value") != "")
            .select(policy.alias("_policy"), F.col("value").alias(name))
            .where(F.col("_policy") != "")
        )

    return (
        half("ID", "guardrail_id")
        .join(half("VERSION", "guardrail_version"), "_policy")
        .select(F.lower("_policy").alias("policy_id"), "guardrail_id", "guardrail_version")
    )


def overlay_bindings(policies: DataFrame, bindings: DataFrame) -> DataFrame:
    """Policies (id, policy) with the bound guardrail where there is one."""
    bound = bindings.select(
        F.col("policy_id").alias("id"),
        F.col("guardrail_id").alias("_gid"),
        F.col("guardrail_version").alias("_gver"),
    )
    policy = F.col("policy")
    return policies.join(bound, "id", "left").select(
        "id",
        policy.withField("guardrail_id", F.coalesce("_gid", policy["guardrail_id"]))
        .withField("guardrail_version", F.coalesce("_gver", policy["guardrail_version"]))
        .alias("policy"),
    )


def rebind(policies: Iterable[Policy], bindings: dict[str, tuple[str, str]]) -> list[Policy]:
    """`overlay_bindings` for a handful of policies held by the driver."""
    return [
        replace(p, guardrail_id=bindings[p.id][0], guardrail_version=bindings[p.id][1])
        if p.id in bindings
        else p
        for p in policies
    ]
