"""The report queries over claims: cards, breakdowns, trend, matrix, top categories.

Each takes claims that may already be sliced; a slicer is a filter before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def money(column: str) -> Column:
    """Exact sum of amounts in cents, whatever the order of the rows."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def slicer(claims: DataFrame, selections: Mapping[str, Sequence[str]]) -> DataFrame:
    """Keep the chosen values of each column; an empty choice keeps all."""
    for column, values in selections.items():
        if values:
            claims = claims.filter(F.col(column).isin(*values))
    return claims


def exact_avg(column: str, scale: int = 4) -> Column:
    return F.sum(F.col(column).cast(f"decimal(18,{scale})")).cast("double") / F.count(column)


def claims_kpis(claims: DataFrame, policies: DataFrame) -> DataFrame:
    """The cards: totals, averages, fraud and severity, and the mean policy risk."""
    cards = claims.agg(
        F.count(F.lit(1)).alias("total_claims"), money("claim_amount").alias("total_claim_amount"),
        F.count_if("fraud_flag").alias("fraud_flagged"), F.count_if(F.col("predicted_severity") == "High").alias("high_severity_claims"),
        exact_avg("avg_severity_score").alias("avg_severity_score"))
    cards = cards.withColumn("avg_claim_amount", F.col("total_claim_amount") / F.col("total_claims")).withColumn(
        "fraud_rate_pct", 100.0 * F.col("fraud_flagged") / F.col("total_claims"))
    risk = policies.agg(exact_avg("risk_score").alias("avg_policy_risk_score"))
    both = cards.unionByName(risk, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def breakdown(claims: DataFrame, *, by: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    return claims.groupBy(*by).agg(*[m.alias(name) for name, m in measures.items()])


def claims_trend(claims: DataFrame, *, date: str = "claim_date") -> DataFrame:
    """Claims and mean amount per day."""
    return claims.groupBy(date).agg(F.count(F.lit(1)).alias("claims"), money("claim_amount").alias("_sum")).select(
        date, "claims", (F.col("_sum") / F.col("claims")).alias("avg_claim_amount"))


def pivot_counts(claims: DataFrame, *, rows: str, cols: str, values: Sequence[str]) -> DataFrame:
    """Counts with one column per given value, in one pass."""
    return claims.groupBy(rows).agg(*[F.count_if(F.col(cols) == v).alias(v.lower()) for v in values])


def topn_category(claims: DataFrame, *, cols: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` most frequent values of each column, ties at the end kept.

    All columns are counted in one pass; the ranks are over counts, not claims.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in cols]))
    counts = claims.select(pairs.alias("_p")).groupBy("_p.category", "_p.value").agg(F.count(F.lit(1)).alias("claims"))
    window = Window.partitionBy("category").orderBy(F.col("claims").desc())
    return counts.withColumn("position", F.rank().over(window)).filter(F.col("position") <= n)
