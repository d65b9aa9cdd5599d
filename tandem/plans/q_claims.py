"""The report queries over claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.operators import claims as cl
from tandem.plans.registry import query

_SUM = "sum(cast(claim_amount AS DECIMAL(18,2)))::DOUBLE"
_SCORE = "sum(cast(avg_severity_score AS DECIMAL(18,4)))::DOUBLE / count(avg_severity_score)"
ROW_FIELDS = ["incident_type", "incident_state", "vehicle_make", "coverage_type", "rule_engine_decision", "settlement_status"]
TOP_FIELDS = ["incident_type", "incident_state", "predicted_severity", "rule_engine_decision", "settlement_status", "vehicle_make", "coverage_type"]


def _round(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("claims_kpis", f"""
SELECT count(*) AS total_claims, round({_SUM}, 2) AS total_claim_amount, count(*) FILTER (fraud_flag) AS fraud_flagged,
  count(*) FILTER (predicted_severity = 'High') AS high_severity_claims, round({_SCORE}, 6) AS avg_severity_score, round({_SUM} / count(*), 6) AS avg_claim_amount,
  round(100.0::DOUBLE * count(*) FILTER (fraud_flag) / count(*), 6) AS fraud_rate_pct,
  (SELECT round(sum(risk_score)::DOUBLE / count(*), 6) FROM f10_policies) AS avg_policy_risk_score FROM f10_claims""")
def claims_kpis(f):
    return _round(cl.claims_kpis(f["f10_claims"], f["f10_policies"]), "avg_severity_score", "avg_claim_amount", "fraud_rate_pct", "avg_policy_risk_score")


@query("by_incident", f"SELECT incident_type, {_SUM} AS claim_amount FROM f10_claims GROUP BY 1")
def by_incident(f):
    return cl.breakdown(f["f10_claims"], by=["incident_type"], measures={"claim_amount": cl.money("claim_amount")})


@query("by_decision", "SELECT rule_engine_decision, count(*) AS claims FROM f10_claims GROUP BY 1")
def by_decision(f):
    return cl.breakdown(f["f10_claims"], by=["rule_engine_decision"], measures={"claims": F.count(F.lit(1))})


@query("by_settlement", "SELECT settlement_status, count(*) AS claims FROM f10_claims GROUP BY 1")
def by_settlement(f):
    return cl.breakdown(f["f10_claims"], by=["settlement_status"], measures={"claims": F.count(F.lit(1))})


@query("by_vehicle_make", f"SELECT vehicle_make, {_SUM} AS claim_amount FROM f10_claims GROUP BY 1")
def by_vehicle_make(f):
    return cl.breakdown(f["f10_claims"], by=["vehicle_make"], measures={"claim_amount": cl.money("claim_amount")})


@query("claims_trend", f"SELECT cast(claim_date AS VARCHAR) AS claim_date, count(*) AS claims, round({_SUM} / count(*), 6) AS avg_claim_amount FROM f10_claims GROUP BY claim_date")
def claims_trend(f):
    return _round(cl.claims_trend(f["f10_claims"]), "avg_claim_amount").withColumn("claim_date", F.col("claim_date").cast("string"))


@query("state_by_severity", """
SELECT incident_state, count(*) FILTER (predicted_severity = 'High') AS high, count(*) FILTER (predicted_severity = 'Medium') AS medium,
  count(*) FILTER (predicted_severity = 'Low') AS low FROM f10_claims GROUP BY 1""")
def state_by_severity(f):
    return cl.pivot_counts(f["f10_claims"], rows="incident_state", cols="predicted_severity", values=["High", "Medium", "Low"])


@query("detail_matrix", f"SELECT {', '.join(ROW_FIELDS)}, {_SUM} AS claim_amount, round({_SCORE}, 6) AS avg_severity_score FROM f10_claims GROUP BY ALL")
def detail_matrix(f):
    rows = cl.breakdown(f["f10_claims"], by=ROW_FIELDS, measures={"claim_amount": cl.money("claim_amount"), "avg_severity_score": cl.exact_avg("avg_severity_score")})
    return _round(rows, "avg_severity_score")


_UNPIVOT = " UNION ALL ".join(f"SELECT '{c}' AS category, {c} AS value FROM f10_claims" for c in TOP_FIELDS)


@query("topn_category", f"""
SELECT category, value, claims, position FROM (SELECT *, rank() OVER (PARTITION BY category ORDER BY claims DESC) AS position FROM (
  SELECT category, value, count(*) AS claims FROM ({_UNPIVOT}) GROUP BY 1, 2)) WHERE position <= 5""")
def topn_category(f):
    return cl.topn_category(f["f10_claims"], cols=TOP_FIELDS)


@query("slicer_filter", f"SELECT rule_engine_decision, incident_type, count(*) AS claims, {_SUM} AS claim_amount FROM f10_claims WHERE rule_engine_decision IN ('A', 'R') GROUP BY 1, 2")
def slicer_filter(f):
    sliced = cl.slicer(f["f10_claims"], {"rule_engine_decision": ["A", "R"], "incident_type": []})
    return cl.breakdown(sliced, by=["rule_engine_decision", "incident_type"], measures={"claims": F.count(F.lit(1)), "claim_amount": cl.money("claim_amount")})
