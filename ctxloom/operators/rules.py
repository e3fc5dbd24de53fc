"""Rule engines of single domains: signals from text, a linear risk, the first route that holds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_up


@dataclass(frozen=True)
class RiskModel:
    """weights: column -> factor; flags: boolean column -> amount added when true; the sum ends at 1, to six digits.

    routes: (name, SQL condition over the columns and `risk`, priority, confidence); the first
    that holds decides, the last needs no condition.
    """

    weights: dict[str, float]
    flags: dict[str, float]
    routes: list[tuple[str, str, str, float]] = field(default_factory=list)

    def risk(self) -> Column:
        total = F.lit(0.0)
        for c, w in self.weights.items():
            total = total + F.coalesce(c, F.lit(0.0)) * F.lit(w)
        for c, w in self.flags.items():
            total = total + F.when(F.col(c), w).otherwise(0.0)
        # a limit is met as it is read, not missed by the last bit of a sum
        return half_up(F.least(F.lit(1.0), total), 6)

    def decide(self, cases: DataFrame) -> DataFrame:
        """cases with risk, route, priority, confidence. Null numbers count 0, null flags false."""
        scored = cases.withColumn("risk", self.risk())
        picked = F.coalesce(
            *[F.when(F.expr(when), self._route(name, p, c)) for name, when, p, c in self.routes[:-1]],
            self._route(self.routes[-1][0], *self.routes[-1][2:]),
        )
        return scored.withColumn("_r", picked).select(*scored.columns, "_r.*")

    @staticmethod
    def _route(name, priority, confidence):
        return F.struct(F.lit(name).alias("route"), F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence"))


# The contact centre's weights and thresholds.
CONTACT_CENTRE = RiskModel(
    weights={"churn": 0.22, "compliance": 0.21, "fraud": 0.12, "low_value": 0.08, "wait": 0.12, "recontact": 0.08, "csat": 0.07, "hint": 1.0},
    flags={"severe": 0.10, "vip": 0.06, "no_autopilot": 0.10, "supervisor": 0.08},
    routes=[
        ("immediate_supervisor_intervention", "risk >= 0.82 or supervisor or (severe and compliance >= 0.60)", "urgent", 0.90),
        ("supervised_autopilot_resolution", "risk >= 0.56 or no_autopilot or wait_minutes >= 45 or recontacts >= 3", "high", 0.84),
        ("autopilot_resolution", "risk >= 0.32", "normal", 0.76),
        ("monitor", "true", "low", 0.68),
    ],
)

# Severity of a claim by words in its text.
SEVERITY = {
    "fatal": 0.35,
    "injury": 0.3,
    "displaced": 0.24,
    "hurricane": 0.2,
    "wildfire": 0.2,
    "flood": 0.18,
    "critical": 0.18,
    "life/safety": 0.25,
    "total loss": 0.2,
}

# Signs of an incident.
IP = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
USER = r"\b(?:user|uid|acct)[-_]?[a-z0-9._-]{2,}\b"
HIGH_RISK = ["critical", "high", "compromise", "exfiltration", "ransomware", "active incident"]


def severity(text: Column, claim_id: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0.25)
    for word, weight in SEVERITY.items():
        total = total + F.when(F.contains(low, F.lit(word)), weight).otherwise(0.0)
    return F.least(F.lit(1.0), total + F.when(F.contains(low, F.lower(claim_id)), 0.05).otherwise(0.0))


def assess_claims(claims: DataFrame, hold: float = 0.85, review: float = 0.55, severe: float = 0.65, advance: int = 150_000) -> DataFrame:
    """claims(claim_id, text, policy_status, fraud, limit_cents) with severity, action, advance_cents, priority.

    Action: not covered, manual review; fraud from `hold`, hold; from `review`, manual review;
    severe, advance; else manual review. Missing enrichment: not covered, fraud 0, limit ten advances.
    """
    s, fraud = F.col("severity"), F.coalesce("fraud", F.lit(0.0))
    covered = F.coalesce(F.lower("policy_status").isin("active", "covered", "in-force", "inforce"), F.lit(False))
    action = F.when(~covered, "manual_review").when(fraud >= hold, "hold").when(fraud >= review, "manual_review").when(s >= severe, "advance").otherwise("manual_review")
    limit = F.floor(F.coalesce("limit_cents", F.lit(advance * 10)) / 5).cast("long")
    paid = F.least(F.floor(F.lit(advance) * (1.0 + s)).cast("long"), F.greatest(F.lit(advance).cast("long"), limit))
    rank = F.least(F.lit(1.0), s * F.when(covered, 1.0).otherwise(0.35) * (1.0 - F.least(F.lit(1.0), fraud)))
    out = claims.withColumn("severity", severity(F.col("text"), F.col("claim_id")))
    return out.withColumn("action", action).withColumn("advance_cents", paid).withColumn("priority", F.greatest(F.lit(0.0), rank))


def indicators(incidents: DataFrame) -> DataFrame:
    """incidents(incident_id, text) with ips, emails, users (distinct, in order of appearance) and high_risk."""
    def found(text, pattern):
        return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    t = F.coalesce("text", F.lit(""))
    risk = F.lit(False)
    for token in HIGH_RISK:
        risk = risk | F.contains(F.lower(t), F.lit(token))
    return incidents.select("incident_id", found(t, IP).alias("ips"), found(t, EMAIL).alias("emails"), found(F.lower(t), USER).alias("users"), risk.alias("high_risk"))


def containment(found: DataFrame, done: DataFrame, most: int = 5) -> DataFrame:
    """(incident_id, tool, target, key): suspensions due for high-risk incidents, at most `most` each, less those whose key was seen."""
    due = found.where("high_risk").select("incident_id", F.explode(F.slice("users", 1, most)).alias("target"))
    keyed = due.select("incident_id", F.lit("iam_suspend_user").alias("tool"), "target", F.concat_ws(":", F.col("incident_id").cast("string"), F.lit("iam_suspend_user"), F.lower("target")).alias("key"))
    return keyed.join(done.select("key"), "key", "left_anti")
