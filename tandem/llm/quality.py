"""Quality rules with host verdicts.

Each document is measured (words, symbols, repeated lines, repeated word windows) and tested by rules. The failures of
each rule are summed per host; the rate is shrunk towards the rate of all hosts by a beta prior whose strength is fitted
to the spread of the host rates (method of moments). A host whose shrunk rate for a rule exceeds ``host_limit`` is
condemned for that rule, and the verdict is joined back: a document goes if it fails a base rule, or fails a rule for which
its host is condemned. A document that fails no rule stays, whatever its host.

Defined cases: a null text counts as empty (no words, so ``short``); a null host is the host ''; repeated rows are each
measured; an empty table gives an empty result. Only the named columns are read, so other columns cannot clash.
Equality of word windows is equality of 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.grouping import lookup_join
from tandem.llm.common import blank_words, keep, table

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
BASE_RULES = ("short", "repeats")
RULES = BASE_RULES + ("symbols", "dup_lines", "word_length")
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _long(column: Column) -> Column:
    return column.cast("bigint")


def measure(docs: DataFrame, *, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc`` (the row as a struct), ``host``, the metrics, and ``fails`` (names of the failed rules).

    All of it happens within the row, so nothing is shuffled. Each step is a projection of its own and later steps use it
    more than once, which keeps the optimizer from computing it again for every element.
    """
    text = F.coalesce(F.col("doc")[text_col], F.lit(""))
    rows = docs.select(F.struct("*").alias("doc")).select(
        "doc", text.alias("body"), F.coalesce(F.col("doc")[host_col].cast("string"), F.lit("")).alias("host"))
    rows = rows.withColumn("words", blank_words(F.col("body")))
    rows = rows.withColumn("lines", F.filter(F.split("body", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    size = F.size("words")
    windows = F.transform(F.sequence(F.lit(1), size - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    rows = rows.withColumn("windows", F.when(size >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    ordered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("ordered", F.when(repeated, ordered))
    at = lambda j: F.get("ordered", j)["h"]
    twice = F.filter("ordered", lambda x, j: F.coalesce(x["h"] == at(j - 1), F.lit(False)) | F.coalesce(x["h"] == at(j + 1), F.lit(False)))
    rows = rows.withColumn("starts", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end")),
        lambda acc: acc["n"])
    rows = rows.select(
        "doc", "host", _long(size).alias("n_words"), _long(F.length(F.array_join("words", ""))).alias("word_chars"),
        _long(F.regexp_count("body", F.lit(SYMBOLS))).alias("n_symbols"), _long(F.size("lines")).alias("n_lines"),
        _long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _long(F.when(F.col("starts").isNull(), 0).otherwise(covered)).alias("n_repeat_words"))
    failed = {
        "short": F.col("n_words") < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
    }
    names = F.array(*[F.when(failed[r], F.lit(r)) for r in RULES])
    return rows.withColumn("fails", F.array_compact(names)).drop("n_lines")


def host_verdicts(measured: DataFrame, *, host_limit: float = 0.5) -> DataFrame:
    """``host`` and ``condemned``, the names of the rules whose shrunk failure rate exceeds ``host_limit``.

    Hosts are summed with a partial sum before the shuffle, so a host with a third of all rows is no burden. The prior of a
    rule is one row per rule and is joined by the rule's name.
    """
    sums = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.array_contains("fails", r).cast("bigint")).alias(r) for r in RULES])
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in RULES])).alias("x")
    rates = sums.select("host", "n", pairs).select("host", "n", "x.rule", "x.failed")
    mean = F.sum("failed") / F.sum("n")
    prior = rates.groupBy("rule").agg(mean.alias("mean"), F.var_samp(F.col("failed") / F.col("n")).alias("spread"))
    # The strength is that of a beta distribution with this mean and spread, between two and a thousand observations.
    strength = F.when(F.coalesce("spread", F.lit(0.0)) > 0, F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1).otherwise(2.0)
    prior = prior.select("rule", "mean", F.least(F.greatest(strength, F.lit(2.0)), F.lit(1000.0)).alias("strength"))
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return (rates.join(prior, "rule").groupBy("host")
            .agg(F.array_sort(F.collect_set(F.when(shrunk > host_limit, F.col("rule")))).alias("condemned")))


def judge(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``."""
    base = F.arrays_overlap("fails", F.array(*map(F.lit, BASE_RULES)))
    host = F.arrays_overlap("fails", F.coalesce("condemned", F.array().cast("array<string>")))
    # A host may hold a third of all rows: its verdict is looked up behind a check of the table's size, else by host and salt.
    verdicts = keep(verdicts.filter(F.size("condemned") > 0), "hosts")
    return lookup_join(measured, verdicts, on=["host"], spread_by=["n_words", "word_chars"], how="left").withColumn("base_failed", base).withColumn("kept", ~base & ~host)


def quality_filter(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", host_limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    The texts are measured once. What the host verdicts may still save is written beside its failures; a row that fails a base rule
    leaves only these, as no verdict brings it back.
    """
    measured = measure(docs, text_col=text_col, host_col=host_col).select(
        "host", "fails", "n_words", "word_chars", F.when(~F.arrays_overlap("fails", F.array(*map(F.lit, BASE_RULES))), F.col("doc")).alias("doc"))
    measured = keep(measured, "measured")
    return judge(measured, host_verdicts(measured, host_limit=host_limit)).filter("kept").select("doc.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = measure(docs).select(F.col("doc.doc_id").alias("doc_id"), "host", *METRICS, "fails")
    rows = keep(rows, "quality")
    return judge(rows, host_verdicts(rows)).select("doc_id", *METRICS, "base_failed", "kept")


_FAILS = {"short": "n_words < 20", "repeats": "100 * n_repeat_words > 30 * n_words", "symbols": "10 * n_symbols > word_chars", "dup_lines": "10 * n_dup_lines > 3 * n_lines",
          "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words"}
#: DuckDB SQL for ``op7_quality_rules``, from the words up.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
windows AS (SELECT rid, i, list_slice(ws, i, i + 7) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY rid),
m AS (SELECT doc_id, host, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (rid)),
f AS (SELECT *, {", ".join(f"({v}) AS {k}" for k, v in _FAILS.items())} FROM m),
rates AS ({" UNION ALL ".join(f"SELECT host, '{k}' AS rule, count(*) AS n, count(*) FILTER ({k}) AS failed FROM f GROUP BY host" for k in _FAILS)}),
prior AS (SELECT rule, sum(failed) / sum(n) AS mean, coalesce(var_samp(failed / n), 0) AS spread FROM rates GROUP BY rule),
beta AS (SELECT rule, mean, least(greatest(CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1 ELSE 2 END, 2), 1000) AS strength FROM prior),
bad AS (SELECT host, list(rule) AS rules FROM rates JOIN beta USING (rule) WHERE (failed + mean * strength) / (n + strength) > 0.5 GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
  NOT (short OR repeats) AND NOT ({" OR ".join(f"({k} AND coalesce(list_contains(rules, '{k}'), false))" for k in _FAILS)}) AS kept
FROM f LEFT JOIN bad USING (host)"""
