"""Licence scan by a positional index of rare template words.

Every text is read once: its words are counted and the places of licence words (template words that are no stop words) are
kept. Document frequencies over all documents give each licence word its inverse frequency. A template is indexed by its
rarest words with their positions; a file looks up all its licence words that are indexed. Each meeting of a file word with a template
word proposes a relative position, and the postings that agree on one position are added up by weight. A template whose share
of weight at one position is high enough is a candidate; it is accepted if its key phrases stand at that position too.

Base labels name a licence by a fixed phrase; they are found among the kept places and never depend on the index.

Defined cases: a null or empty text has no words and no labels; repeated rows are each scanned; words that repeat are all
postings; ties in rarity are broken by the word; an empty table gives an empty result. Only the named columns are read.
All of it is DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandem.llm.common import keep, table, text_of
from tandem.llm.license_templates import STOP_WORDS, TEMPLATES

#: Everything in ASCII but letters and digits parts words.
PARTING = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"apache": ("apache", "license"), "gpl": ("general", "public", "license"), "mit": ("mit", "license")}
#: Rarest words by which a template is indexed.
TEMPLATE_WORDS = 8
#: Share of a template's weight that must agree on one position.
SHARE = 0.6


def _template_rows() -> list[tuple[int, str, str, int]]:
    rows, number = [], 0
    for label, notices in TEMPLATES.items():
        for text, _ in notices:
            rows += [(number, label, w, i) for i, w in enumerate(text.split()) if w not in STOP_WORDS]
            number += 1
    return rows


def _phrase_rows() -> list[tuple[int, list[tuple[str, int]]]]:
    """Per template the words of its key phrases, at their positions in the template."""
    rows, number = [], 0
    for notices in TEMPLATES.values():
        for text, phrases in notices:
            words, needed = text.split(), []
            for phrase in phrases:
                parts = phrase.split()
                at = next(i for i in range(len(words)) if words[i:i + len(parts)] == parts)
                needed += [(w, at + i) for i, w in enumerate(parts) if w not in STOP_WORDS]
            rows.append((number, needed))
            number += 1
    return rows


VOCABULARY = sorted({w for _, _, w, _ in _template_rows()} | {w for p in PHRASES.values() for w in p})


def places(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, ``doc_id``, ``n_words`` and ``hits``: the licence words of each text with their word numbers, in order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.array_remove(F.split(text_of(text_col), PARTING, -1), "").alias("words"))
    known = lambda w: F.lower(w).isin(VOCABULARY)
    hits = F.filter(F.transform("words", lambda w, i: F.struct(F.lower(w).alias("word"), i.alias("at"))), lambda x: x["word"].isin(VOCABULARY))
    none = F.array().cast("array<struct<word:string,at:int>>")
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("bigint").alias("n_words"),
                       F.when(F.exists("words", known), hits).otherwise(none).alias("hits"))


def _phrase_places(label: str, words: tuple[str, ...]) -> Column:
    """Label and first word of each place in ``hits`` where the words stand one after the other."""
    last = len(words) - 1

    def ends(x: Column, j: Column) -> Column:
        whole = x["word"] == words[last]
        for back in range(1, last + 1):
            before = F.get("hits", j - back)
            whole = whole & (before["word"] == words[last - back]) & (before["at"] == x["at"] - back)
        return F.coalesce(whole, F.lit(False))

    return F.transform(F.filter("hits", ends), lambda x: F.struct(F.lit(label).alias("label"), (x["at"] - last).cast("bigint").alias("at")))


def base_places(rows: DataFrame) -> DataFrame:
    """``rows`` with ``base``: the places of all base phrases."""
    return rows.withColumn("base", F.concat(*[_phrase_places(label, words) for label, words in PHRASES.items()]))


def template_matches(rows: DataFrame) -> DataFrame:
    """``row``, ``label`` and ``share`` of every template that stands in a file, best share per label."""
    spark = rows.sparkSession
    templates = spark.createDataFrame(_template_rows(), "template int, label string, word string, place int")
    phrases = spark.createDataFrame(_phrase_rows(), "template int, needed array<struct<word:string,place:int>>")
    words = keep(rows.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("x")).select("row", "x.word", "x.at"), "places")
    # One row for each licence word: as many as the templates have, whatever the corpus.
    frequency = words.select("row", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    weight = F.log((F.lit(total) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 0.01
    weighted = templates.join(frequency, "word", "left").withColumn("weight", weight)
    by_template = Window.partitionBy("template").orderBy(F.desc("weight"), "word", "place")
    index = keep(weighted.withColumn("rank", F.row_number().over(by_template)).filter(F.col("rank") <= TEMPLATE_WORDS)
                 .withColumn("all", F.sum("weight").over(Window.partitionBy("template"))), "index")
    met = words.join(index, "word")
    votes = met.groupBy("row", "template", "label", (F.col("at") - F.col("place")).alias("shift")).agg((F.sum("weight") / F.first("all")).alias("share"))
    votes = votes.filter(F.col("share") >= SHARE).join(phrases, "template")
    whole = F.forall("needed", lambda n: F.array_contains("hits", F.struct(n["word"].alias("word"), (n["place"] + F.col("shift")).cast("int").alias("at"))))
    verified = votes.join(rows.select("row", "hits"), "row").filter(whole)
    return verified.groupBy("row", "label").agg(F.max("share").alias("share"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    ``score`` is 1 where a base phrase names a licence, else the best share of a verified template, else 0.
    """
    rows = keep(base_places(places(docs, id_col=id_col, text_col=text_col)), "licence-words")
    found = template_matches(rows).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    base = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    every = F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>"))))
    starts = F.transform("base", lambda x: x["at"])
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.0))).alias("score"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
