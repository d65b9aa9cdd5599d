"""Personal data: validated patterns, and identifiers found by the company they keep.

Base spans match fixed patterns and pass a check (parts of an address, Luhn's sum, number of digits). They seed a bootstrap:
the words to the left of a span are its lexical pattern. Tokens that look like identifiers but are no base span are
candidates with a pattern of their own. The graph of patterns and distinct values is scored in turns: a pattern's score is the
mean score of its values, smoothed by one unknown value; a value's score is its best pattern's. Base values stay at one. The turns go on until the scores are settled.
A pattern with enough distinct base values and a high score is trusted, and candidates of the matching shape behind it become
spans as well.

Positions are code points, the end exclusive. They come from the texts between the matches, so each pattern reads a text
once. Patterns are written without backtracking over long runs.

Defined cases: a null or empty text has no spans; repeated rows are each searched; overlapping spans of different kinds all
stand; candidates that overlap a base span are none; an empty table gives an empty result. Only the named columns are read.
All of it is DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.common import keep, table, text_of

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"
#: Possessive forms of the contract's patterns: the same matches, in linear time and constant stack.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
#: Characters to the left of a value that make its pattern.
CONTEXT = 48
_TOKEN = r"(?=[^\s@]*+@|(?:[^\s0-9]*+[0-9]){7}|[^\s0-9]*+[0-9]++(?:\.[0-9]++){3})\S++"
_GROUP = r"\(?+[0-9]{1,6}+\)?+(?![0-9A-Za-z@-]|[.,][0-9])"
#: A whole token with an at sign, seven digits (whatever stands between them), or four numbers between points; or short numbers
#: between single spaces with seven digits together.
CANDIDATE = rf"(?<!\S)(?:{_TOKEN}|(?=\+?+(?:[\x20()]*+[0-9]){{7}})\+?+{_GROUP}(?:\x20{_GROUP})++)"
#: Matches whose positions are summed up together.
BLOCK = 256
#: Signs of a chunk of text from which redacted pieces are cut.
CHUNK = 256
#: Scores that change by less in a turn are settled.
EPSILON = 1e-6
#: A settled score from base values alone is n / (n + 1), so as many values as ``SUPPORT`` reach ``TRUST``.
SUPPORT = 3
TRUST = 0.75

_SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,context:string>"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    size = F.length(digits)
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return size.between(13, 19) & F.call_function("luhn_check", F.when(size.between(13, 19), digits).otherwise("1"))
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


def _context(before: Column) -> Column:
    """The last two words before a value, lower case, digits as 0."""
    near = F.regexp_replace(F.lower(F.right(before, F.lit(CONTEXT))), "[0-9]", "0")
    return F.btrim(F.regexp_extract(near, r"(\S+\s+)?\S+\s*$", 0))


def _cut(pattern: str) -> Column:
    """The matches of a pattern in ``body``, each with the piece of text before it."""
    pieces, values = F.split("body", pattern, -1), F.regexp_extract_all("body", F.lit(pattern), F.lit(0))
    return F.arrays_zip(F.slice(pieces, 1, F.size(values)).alias("piece"), values.alias("value"))


def _matches(kind: str, cuts: str) -> Column:
    """Spans of the matches in column ``cuts``: running sums of the lengths give the positions.

    An array that grows match by match is copied each time, so the sums run within blocks first and then over the blocks.
    """
    size = F.size(cuts)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")), lambda i: F.slice(cuts, i * BLOCK + 1, BLOCK))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["piece"]) + F.length(x["value"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct(
            F.lit(kind).alias("kind"), (acc["at"] + F.length(x["piece"])).alias("start"),
            (acc["at"] + F.length(x["piece"]) + F.length(x["value"])).alias("end"),
            x["value"].alias("value"), _context(x["piece"]).alias("context")))).alias("out"))
    zero = F.lit(0).cast("bigint").alias("at")
    inside = F.transform(blocks, lambda block: F.aggregate(block, F.struct(zero, F.array().cast(f"array<{_SPAN}>").alias("out")), step, lambda acc: acc))
    moved = lambda x, by: F.struct(x["kind"].alias("kind"), (x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["value"].alias("value"), x["context"].alias("context"))
    join = lambda acc, part: F.struct(
        (acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(part["out"], lambda x: moved(x, acc["at"])))).alias("out"))
    whole = F.aggregate(inside, F.struct(zero, F.array().cast(f"array<array<{_SPAN}>>").alias("out")), join, lambda acc: F.flatten(acc["out"]))
    return F.when(size > 0, whole).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _valid_matches(kind: str) -> Column:
    return F.filter(_matches(kind, f"cut_{kind}"), lambda x: _valid(kind, x["value"]))


def _last_before(spans: Column, values: Column) -> Column:
    """For each of ``values`` (which do not fall) the last of ``spans`` (in order) that starts before it; null if none.

    Both are put in one order; a value's place there, less its place among the values, is the number of spans before it.
    """
    joint = F.sort_array(F.concat(
        F.transform(values, lambda v, i: F.struct(v.cast("bigint").alias("at"), F.lit(0).alias("flag"), i.cast("int").alias("i"))),
        F.transform(spans, lambda s: F.struct(s["start"].cast("bigint").alias("at"), F.lit(1).alias("flag"), F.lit(0).alias("i")))))
    places = F.filter(F.transform(joint, lambda x, j: F.struct(x["flag"].alias("flag"), (j - x["i"]).alias("before"))), lambda x: x["flag"] == 0)
    return F.transform(places, lambda x: F.when(x["before"] > 0, F.get(spans, x["before"] - 1)))


def _reaches(near: Column, x: Column, i: Column) -> Column:
    """Does the i-th of ``near`` reach into span ``x``? Names the column twice, which keeps the optimizer from working it out for every element."""
    return near.isNotNull() & F.coalesce(F.get(near, i)["end"] > x["start"], F.lit(False))


def _looks(value: Column) -> Column:
    """Kind whose shape a token has; null if none."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (F.when(value.rlike("^[^@]+@[^@]+$"), "email").when(value.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip")
            .when(value.rlike(r"^[0-9\x20-]+$") & digits.between(13, 19), "card").when(value.rlike(r"^[0-9()\x20.+-]+$") & digits.between(7, 15), "phone"))


def find_base(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``row``, ``doc_id``, ``key`` (hash of id and text), ``base`` and ``candidates`` (arrays of spans)."""
    body = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), body).alias("key"), body.alias("body"))
    signs = {"email": F.contains("body", F.lit("@")), "ip": F.col("body").rlike(r"[0-9]\.[0-9]"), "card": F.col("body").rlike(r"[0-9][\x20-]?[0-9]"),
             "phone": F.col("body").rlike(r"\+[0-9]")}
    cut = {k: F.when(signs[k], _cut(PATTERNS[k])) for k in KINDS} | {"token": F.when(F.col("body").rlike("[0-9@]"), _cut(CANDIDATE))}
    uncut = F.array().cast("array<struct<piece:string,value:string>>")
    # The matches are columns of their own, used below many times and computed once.
    rows = rows.select("*", *[F.coalesce(c, uncut).alias(f"cut_{k}") for k, c in cut.items()])
    rows = rows.select("*", *[_valid_matches(k).alias(f"base_{k}") for k in KINDS])
    rows = rows.withColumn("base", F.concat(*[f"base_{k}" for k in KINDS]))
    # A token may carry quotes and its own key (name=value): the key is context, the core is the value.
    split_token = lambda x: F.struct(
        F.regexp_extract(x["value"], "^([A-Za-z_]+[=:]+)?[^A-Za-z0-9+(]*", 0).alias("head"), x.alias("span"))
    core = lambda x: F.regexp_replace(F.substring(x["span"]["value"], F.length(x["head"]) + 1, F.length(x["span"]["value"])), "[^A-Za-z0-9]+$", "")
    trimmed = lambda x: F.struct(
        _looks(core(x)).alias("kind"), (x["span"]["start"] + F.length(x["head"])).alias("start"),
        (x["span"]["start"] + F.length(x["head"]) + F.length(core(x))).alias("end"), core(x).alias("value"),
        F.when(x["head"].rlike("[A-Za-z]"), F.lower(x["head"])).otherwise(x["span"]["context"]).alias("context"))
    rows = rows.withColumn("tokens", F.filter(F.transform(F.transform(_matches("token", "cut_token"), split_token), trimmed), lambda x: x["kind"].isNotNull()))
    # Spans of one kind do not overlap, so of those that start before a token's end only the last one can reach into it.
    both = lambda k: (F.size("tokens") > 0) & (F.size(f"base_{k}") > 0)
    near = lambda k: F.when(both(k), _last_before(F.col(f"base_{k}"), F.transform("tokens", lambda x: x["end"])))
    rows = rows.select("*", *[near(k).alias(f"near_{k}") for k in KINDS])
    reaches = lambda k, x, i: _reaches(F.col(f"near_{k}"), x, i)
    apart = lambda x, i: ~(reaches("email", x, i) | reaches("ip", x, i) | reaches("card", x, i) | reaches("phone", x, i))
    rows = rows.withColumn("candidates", F.filter("tokens", apart))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", "base", "candidates")


def trusted_patterns(rows: DataFrame, *, support: int = SUPPORT, trust: float = TRUST) -> DataFrame:
    """``kind`` and ``context`` of the patterns that end trusted.

    Edges are distinct (pattern, value) pairs, so a value or a pattern with a third of all places is counted per pair; both
    sums are partial before they are shuffled. Each turn is written to the shared folder.

    Values that have their score from the pattern itself are solved for, not fed back: p = (rest + own * p) / (all + 1). So a
    pattern with very many candidates settles in one turn, and turns are needed only along patterns that share values.
    """
    spans = lambda column, seed: rows.select(F.explode(column).alias("x")).select("x.kind", "x.context", F.lower("x.value").alias("value"), F.lit(seed).alias("seed"))
    edges = spans("base", 1.0).unionByName(spans("candidates", 0.0)).filter("context <> ''")
    edges = keep(edges.groupBy("kind", "context", "value").agg(F.max("seed").alias("seed")), "pattern-edges")
    seeds = edges.groupBy("kind", "value").agg(F.max("seed").alias("score"))
    linked = edges.select("*", F.lit(0.0).alias("pattern_score"))
    score, own = seeds, (F.col("score") < 1) & (F.col("score") <= F.col("pattern_score"))
    while True:
        patterns = linked.join(score, ["kind", "value"]).groupBy("kind", "context").agg(
            (F.sum(F.when(own, 0.0).otherwise(F.col("score"))) / (F.sum(F.when(own, 0.0).otherwise(1.0)) + 1.0)).alias("pattern_score"),
            F.max("pattern_score").alias("before"), F.sum("seed").alias("seeds"))
        patterns = keep(patterns, "patterns")
        change = patterns.agg(F.max(F.abs(F.col("pattern_score") - F.col("before"))).alias("change")).first()["change"]
        if change is None or change < EPSILON:
            break
        linked = edges.join(patterns.select("kind", "context", "pattern_score"), ["kind", "context"])
        score = linked.groupBy("kind", "value").agg(F.max("pattern_score").alias("best")).join(seeds, ["kind", "value"]).select(
            "kind", "value", F.greatest("score", "best").alias("score"))
    return patterns.filter((F.col("seeds") >= support) & (F.col("pattern_score") >= trust)).select("kind", "context")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``key``, ``base`` and ``spans`` (base and discovered), sorted by kind and start."""
    rows = keep(find_base(docs, id_col=id_col, text_col=text_col), "pii")
    trusted = trusted_patterns(rows)
    loose = rows.filter(F.size("candidates") > 0).select("row", F.explode("candidates").alias("x")).select("row", "x", "x.kind", "x.context")
    more = loose.join(trusted, ["kind", "context"]).groupBy("row").agg(F.collect_list("x").alias("more"))
    order = F.array(*map(F.lit, KINDS))
    sort = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(F.array_position(order, x["kind"]).alias("k"), x["start"].alias("s"), x["end"].alias("e"), x.alias("x")))), lambda x: x["x"])
    none = F.array().cast(f"array<{_SPAN}>")
    return rows.join(more, "row", "left").select("doc_id", "key", sort(F.col("base")).alias("base"), sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def _merged(spans: DataFrame) -> DataFrame:
    """``key`` and ``merged``: sorted spans, those that overlap as one, named by the first."""
    of_kind = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    starts = F.transform("spans", lambda x: x["start"])
    rows = spans.select("*", *[of_kind(k).alias(f"of_{k}") for k in KINDS])
    # The last span of each kind that starts before a span; spans of one kind do not overlap, so no earlier one reaches further.
    rows = rows.select("*", *[F.when(F.size(f"of_{k}") > 0, _last_before(F.col(f"of_{k}"), starts)).alias(f"near_{k}") for k in KINDS])
    covers = lambda k, x, i: _reaches(F.col(f"near_{k}"), x, i)
    same = lambda x, i: F.coalesce(F.get("spans", i - 1)["start"] == x["start"], F.lit(False))
    marked = F.transform("spans", lambda x, i: F.when(~(same(x, i) | covers("email", x, i) | covers("ip", x, i) | covers("card", x, i) | covers("phone", x, i)), i))
    rows = rows.withColumn("heads", F.array_compact(marked))
    size = lambda h, j: F.coalesce(F.get("heads", j + 1), F.size("spans")) - h
    return rows.select("key", F.transform("heads", lambda h, j: F.struct(
        F.get("spans", h)["start"].alias("start"), F.array_max(F.transform(F.slice("spans", h + 1, size(h, j)), lambda x: x["end"])).alias("end"),
        F.get("spans", h)["kind"].alias("kind"))).alias("merged"))


def _piece(start: Column, end: Column) -> Column:
    """Signs ``start`` to ``end`` of the text, from its chunks, so that no text is read from its beginning for each piece."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    inside = lambda c, a, n: F.coalesce(F.substring(F.get("chunks", c), (a % CHUNK + 1).cast("int"), n), F.lit(""))
    return (F.when(start >= end, "").when(first == last, inside(first, start, (end - start).cast("int")))
            .otherwise(F.concat(inside(first, start, F.lit(CHUNK)), F.array_join(F.slice("chunks", first + 2, last - first - 1), ""),
                                inside(last, F.lit(0).cast("bigint"), (end % CHUNK).cast("int")))))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    ``count_col``, where given, is set to the new length of the text.
    """
    key = F.xxhash64(F.col("doc")[id_col], F.coalesce(F.col("doc")[text_col], F.lit("")))
    spans = find(docs, id_col=id_col, text_col=text_col).filter(F.size("spans") > 0).select("key", F.array_sort(F.transform(
        "spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))).alias("spans"))
    spans = keep(spans.dropDuplicates(["key"]), "spans")
    body = F.col("doc")[text_col]
    spans = _merged(spans)
    met = docs.select(F.struct("*").alias("doc")).join(spans, key == F.col("key"), "left")
    met = met.withColumn("chunks", F.when(F.col("merged").isNotNull(), F.regexp_extract_all(body, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    end_of = lambda i: F.coalesce(F.get("merged", i)["end"], F.lit(0).cast("bigint"))
    pieces = F.transform("merged", lambda x, i: F.concat(_piece(end_of(i - 1), x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    clean = F.concat(F.array_join(pieces, ""), _piece(end_of(F.size("merged") - 1), F.length(body).cast("bigint")))
    met = met.withColumn("clean", F.when(F.col("merged").isNull(), body).otherwise(clean))
    columns = {text_col: F.col("clean"), **({count_col: F.length("clean").cast("bigint")} if count_col else {})}
    return met.select(*[columns.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(said("base").cast("binary"), 256).alias("base_sha256"), said("spans").alias("spans"))
