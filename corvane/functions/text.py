"""Text functions as column expressions.

White space means what Python's ``str.strip`` strips, and lines end where
``str.splitlines`` ends them; both are spelt out for Java's regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U:[\s\x1C-\x1F])"
LINE_END = "(?<=\\n|\\r(?!\\n)|[\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029])"
# What a term and a heading are, here and in the context and reply patterns below.
TERM = "[A-Za-z0-9_]+"
HEADING = r"^(#+) (.*)$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+", "")


def unix_lines(text: Column) -> Column:
    """Carriage returns become line feeds, as a text-mode reader does."""
    return F.regexp_replace(text, "\r\n?", "\n")


def lines_of(text: Column) -> Column:
    """Lines with their ends."""
    return F.filter(F.split(text, LINE_END), lambda x: x != "")


def terms(text: Column) -> Column:
    """All runs of ASCII letters, digits and underscores in lower case, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), F.lower)


def distinct_terms(text: Column) -> Column:
    return F.array_distinct(terms(text))


def checksum(text: Column) -> Column:
    """SHA-256 of the UTF-8 text in hexadecimal."""
    return F.sha2(text.cast("binary"), 256)


def one_line(text: Column, most: int) -> Column:
    """White space collapsed; longer texts are cut at ``most`` characters and end in three dots."""
    flat = strip(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(rstrip(F.substring(flat, 1, most)), F.lit("...")))


def error_reason(kind: Column, message: Column, most: int = 240) -> Column:
    """``provider_error:Class[:message]`` with the message on one line and cut."""
    flat = one_line(F.coalesce(message, F.lit("")), most)
    return F.concat_ws(":", F.lit("provider_error"), kind, F.when(flat != "", flat))


# What marks an error as transient, or a store as unreachable.
TRANSIENT_TYPES = ("APIConnectionError", "APITimeoutError", "InternalServerError", "RateLimitError", "ServiceUnavailableError")
TRANSIENT_STATUS = (408, 409, 429, 500, 502, 503, 504)
TRANSIENT_WORDS = ("connection aborted", "connection reset", "temporarily", "timed out", "timeout", "try again")
UNREACHABLE_WORDS = (
    "connection refused", "actively refused", "failed to establish a new connection", "name or service not known",
    "temporary failure in name resolution", "nodename nor servname provided", "winerror 10061", "winerror 10054",
    "connecterror", "responsehandlingexception", "connection reset", "forcibly closed", "server disconnected",
)


def is_transient(kind: Column, status: Column, message: Column) -> Column:
    """Whether a provider error is worth another try."""
    return kind.isin(*TRANSIENT_TYPES) | F.coalesce(status.isin(*TRANSIENT_STATUS), F.lit(False)) | F.lower(message).rlike("|".join(TRANSIENT_WORDS))


def is_unreachable(message: Column) -> Column:
    return F.lower(message).rlike("|".join(UNREACHABLE_WORDS))


def title_of(path: Column) -> Column:
    """File name without its last suffix, underscores as spaces; the file name where that leaves nothing."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    title = strip(F.regexp_replace(stem, "_", " "))
    return F.when(title != "", title).otherwise(name)


def uuid5_url(name: Column) -> Column:
    """Version 5 UUID of a name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def context_bodies(context: Column) -> Column:
    """Bodies of the labelled blocks of an answer context."""
    return F.transform(F.regexp_extract_all(context, F.lit(r"(?dms)^content:\s*(.*?)(?=^\[S\d+\]\s*$|\z)"), F.lit(1)), strip)


def first_json_array(reply: Column) -> Column:
    """The first innermost JSON array in a text, or null."""
    found = F.regexp_extract(reply, r"\[[^\[\]]*\]", 0)
    return F.when(found != "", found)


def candidate_numbers(reply: Column) -> Column:
    """Positive numbers named by the first JSON array: integers or strings of digits; anything else is dropped."""
    raw = F.split(F.regexp_replace(first_json_array(reply), r"^\[|\]$", ""), ",")
    token = F.transform(raw, lambda x: F.regexp_extract(x, r'^\s*(?:(\d{1,9})|"\s*(\d{1,9})\s*")\s*$', 0))
    return F.transform(F.filter(token, lambda x: x != ""), lambda x: F.regexp_replace(x, r'[\s"]', "").cast("int"))
