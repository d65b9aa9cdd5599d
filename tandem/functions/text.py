"""Column expressions for times, hosts, payloads and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What identifiers, hosts and SQL endpoints look like, and the part that holds an item's identity.
GUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
GUID_PATTERN = GUID
SQL_HOST_PATTERN = r"(?i)([a-z0-9-]+\.(?:[a-z0-9]+-)?(?:datawarehouse|database)\.fabric\.microsoft\.com)"
# A host has three labels or more and starts at a word boundary; labels are not given back, so
# that plain prose is passed over quickly.
HOST = r"\b(?:[A-Za-z0-9-]++\.){2,}[A-Za-z]{2,}"
REFERENCE_PATTERN = f"(?:{HOST}|{GUID})"
IDENTITY_PART = ".platform"


def http_date(column: Column | str) -> Column:
    """'Wed, 21 Oct 2026 07:28:00 GMT' to a timestamp, or null. The weekday is not checked."""
    col = F.col(column) if isinstance(column, str) else column
    shaped = col.rlike(r"^[A-Za-z]{3}, \d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} GMT$")
    return F.when(shaped, F.try_to_timestamp(F.substring(col, 6, 20), F.lit("dd MMM yyyy HH:mm:ss")))


def iso_time(column: Column | str) -> Column:
    """ISO-8601 with or without a trailing Z to a timestamp, or null."""
    return F.try_to_timestamp(F.col(column) if isinstance(column, str) else column)


def epoch_ms(column: Column | str) -> Column:
    return F.unix_millis((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def sql_host(column: Column | str) -> Column:
    """Endpoint host in a connection string, lower-cased; '' when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), SQL_HOST_PATTERN, 1))


def uri_host(column: Column | str) -> Column:
    """Host of a URI, lower-cased; null when the text is not a URI."""
    return F.lower(F.try_parse_url(F.col(column) if isinstance(column, str) else column, F.lit("HOST")))


def decode_payload(column: Column | str) -> Column:
    """Base64 to text; what is not base64 gives ''."""
    raw = F.try_to_binary(F.col(column) if isinstance(column, str) else column, F.lit("base64"))
    return F.coalesce(F.decode(raw, "UTF-8"), F.lit(""))


def encode_payload(column: Column | str) -> Column:
    """Text to base64 on one line."""
    return F.translate(F.base64(F.encode(F.col(column) if isinstance(column, str) else column, "UTF-8")), "\r\n", "")


def tokens(column: Column | str, pattern: Column | str = GUID_PATTERN) -> Column:
    """Every match of the pattern in a text, in order, as written."""
    return F.regexp_extract_all(F.col(column) if isinstance(column, str) else column, F.lit(pattern), F.lit(0))


# Names without a shape of their own are found as runs of whole words.
WORD = r"[\p{L}\p{N}_]+"


def word_count(column: Column | str) -> Column:
    """Words of a name that begins and ends with one; null for other names, which no run of words can be."""
    col = F.col(column) if isinstance(column, str) else column
    return F.when(col.rlike(f"^{WORD}(?s:.*{WORD})?$"), F.size(tokens(col, WORD)))


def word_runs(column: Column | str, longest: int) -> Column:
    """Distinct runs of one to ``longest`` words with what stands between them, lower-cased."""
    col = F.col(column) if isinstance(column, str) else column
    words, gaps = tokens(col, WORD), F.split(col, WORD, -1)
    woven = F.flatten(F.zip_with(words, F.slice(gaps, 2, F.size(words)), lambda w, g: F.array(w, g)))
    every = lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: i + (n - 1) <= F.size(words)),
        lambda i: F.lower(F.array_join(F.slice(woven, 2 * i - 1, 2 * n - 1), "")))
    return F.array_distinct(F.concat(*[every(n) for n in range(1, longest + 1)]))


def names_pattern(names: Column) -> Column:
    """Alternation of the names of one text as whole words, the longest first; null without names."""
    quoted = F.transform(F.transform(names, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n"))), lambda x: x)
    parts = F.transform(F.array_sort(quoted), lambda x: F.concat(F.lit("\\Q"), F.replace(x["n"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.when(F.size(names) > 0, F.concat(F.lit(r"(?iu:(?<![\p{L}\p{N}_])(?:"), F.array_join(parts, "|"), F.lit(r")(?![\p{L}\p{N}_]))")))


def references(column: Column | str, pattern: str = GUID_PATTERN) -> Column:
    """Distinct matches in a text, lower-cased."""
    return F.array_distinct(F.transform(tokens(column, pattern), F.lower))


_MARK = "\u0001"


def substitute(column: Column | str, lookup: Column, pattern: Column | str) -> Column:
    """The text with each match replaced by its entry in the ``lookup`` map (keys lower-cased).

    One pass: what a replacement puts in is not looked at again. The matches are fenced with a
    mark and the text is split at it; a text that has the mark in it is cut at the matches instead.
    """
    col = F.col(column) if isinstance(column, str) else column
    new = lambda ref: F.coalesce(F.try_element_at(lookup, F.lower(ref)), ref)
    grouped = F.concat(F.lit("(?:"), F.lit(pattern), F.lit(")"))
    fenced = F.split(F.regexp_replace(col, grouped, F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    quick = F.transform(fenced, lambda piece, i: F.when(i % 2 == 1, new(piece)).otherwise(piece))
    careful = F.zip_with(F.split(col, F.lit(pattern), -1), tokens(col, pattern),
                         lambda gap, ref: F.concat(gap, F.coalesce(new(ref), F.lit(""))))
    return F.array_join(F.when(F.contains(col, F.lit(_MARK)), careful).otherwise(quick), "")


def is_identity_part(column: Column | str) -> Column:
    """Never null: a part without a path is no identity part."""
    col = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
    return (col == IDENTITY_PART) | col.endswith("/" + IDENTITY_PART)
