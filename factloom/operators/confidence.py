"""Label confidence of a completion from decisions, retention, CI and similarity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ConfidencePolicy:
    """What each part of the ladder multiplies by."""

    policy_version: str = "4"
    base: float = 0.6
    explicit_accept: float = 1.0
    explicit_reject: float = 0.0
    up: float = 1.1
    down: float = 0.9
    ci_pass: float = 1.1
    ci_fail: float = 0.7
    clean_reliability: float = 1.0
    suspected_flake_reliability: float = 0.0
    non_verdict_reliability: float = 1.0


def branch(decisions: Column, abandoned: Column | None = None) -> Column:
    """The decision branch of an array of (accepted, explicit, agent_harness): abandoned, explicit_reject, explicit_accept, implicit_reject, neutral, implicit_accept or none."""
    any_of = lambda test: F.exists(decisions, test)
    out = F.when(any_of(lambda d: d["explicit"] & ~d["accepted"]), "explicit_reject").when(any_of(lambda d: d["explicit"] & d["accepted"]), "explicit_accept")
    out = out.when(any_of(lambda d: ~d["accepted"]), "implicit_reject").when((F.size(decisions) > 0) & F.forall(decisions, lambda d: d["agent_harness"] == "codex"), "neutral")
    out = out.when(F.size(decisions) > 0, "implicit_accept").otherwise("none")
    return out if abandoned is None else F.when(abandoned, "abandoned").otherwise(out)


def branch_of(rejected: Column, accepted: Column, refused: Column, neutral: Column, any_decision: Column) -> Column:
    """``branch`` of a group's flags, for groups that are added up and not gathered: an explicit reject, an explicit accept, any reject, all neutral, any decision."""
    out = F.when(rejected, "explicit_reject").when(accepted, "explicit_accept").when(refused, "implicit_reject").when(any_decision & neutral, "neutral")
    return out.when(any_decision, "implicit_accept").otherwise("none")


def decision_factor(kind: Column, retention: Column, policy: ConfidencePolicy) -> Column:
    """What a decision branch starts the ladder with: an abandoned accept counts as an explicit reject, retention places an implicit accept between down and up."""
    p = policy
    kept = F.least(F.lit(1.0), F.greatest(F.lit(0.0), retention))
    by_retention = p.down + (p.up - p.down) * kept
    return (
        F.when(kind.isin("abandoned", "explicit_reject"), F.lit(p.explicit_reject)).when(kind == "explicit_accept", F.lit(p.explicit_accept))
        .when(kind == "implicit_reject", F.lit(p.base * p.down)).when(kind == "implicit_accept", p.base * F.coalesce(by_retention, F.lit(p.up))).otherwise(F.lit(p.base))
    )


def reliability(verdict: Column, flake: Column, policy: ConfidencePolicy = ConfidencePolicy()) -> Column:
    """Of a commit's resolution: null without a verdict, the flake's value if a workflow that agrees with the verdict is one."""
    return F.when(verdict.isNotNull(), F.when(F.coalesce(flake, F.lit(False)), F.lit(policy.suspected_flake_reliability)).otherwise(F.lit(policy.clean_reliability)))


def confidence(kind: Column, retention: Column, verdict: Column, reliability: Column, similarity: Column, policy: ConfidencePolicy = ConfidencePolicy(), outcomes: Column | None = None) -> Column:
    """decision x CI x reliability x similarity, clamped to [0, 1]; null without any signal. Nulls: no retention, no verdict, attributed by notes.

    ``outcomes``: whether there is any CI outcome, also one without a verdict; by default only a verdict is one.
    """
    ci = F.when(verdict == "passed", F.lit(policy.ci_pass)).when(verdict == "failed", F.lit(policy.ci_fail)).otherwise(F.lit(1.0))
    sure = F.when(verdict.isin("passed", "failed"), F.coalesce(reliability, F.lit(1.0))).otherwise(F.lit(1.0))
    value = decision_factor(kind, retention, policy) * ci * sure * F.coalesce(similarity, F.lit(1.0))
    known = (kind != "none") | verdict.isNotNull()
    return F.when(known if outcomes is None else known | outcomes, F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def unreliable_confidence(kind: Column, retention: Column, any_pass: Column, similarity: Column, policy: ConfidencePolicy = ConfidencePolicy(policy_version="3")) -> Column:
    """The older policy: any passing run counts as a pass and reliability is left out. ``any_pass`` is null without runs."""
    verdict = F.when(any_pass, "passed").when(~any_pass, "failed")
    return confidence(kind, retention, verdict, F.lit(None).cast("double"), similarity, policy)
