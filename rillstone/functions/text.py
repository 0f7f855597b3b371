"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic.
STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "for", "on", "with", "that", "this", "it", "is", "was", "be", "as", "at", "by", "from", "but", "not",
    "are", "were", "has", "have", "had", "i", "my", "me", "we", "you", "he", "she", "they", "its", "so", "then", "than", "if", "when", "which", "what",
    "how", "do", "did", "does", "can", "could", "should", "would", "will", "just", "also", "very", "more", "most", "one", "two", "all", "any", "some",
    "no", "yes", "up", "out", "into", "over", "after", "before",
]
#: What Unicode-aware stripping removes; Java's \s knows ASCII only.
SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: In a word everything from its first slash on is a place, with a scheme, a drive or dots right before that slash.
PLACE = r"(?:https?:/|file:/|[a-z]:|\.\.?)?[\\/]\S+"


def blank(c: Column) -> Column:
    """Null and empty as empty."""
    return F.coalesce(c, F.lit(""))


def filled(c: Column) -> Column:
    """Empty as null."""
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def collapse_spaces(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACES}+", " "))


def tokens(c: Column) -> Column:
    """Sorted distinct runs of ``[a-z0-9]`` of the lower-cased text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(blank(c)), F.lit("([a-z0-9]+)"), F.lit(1))))


def words_without_places(c: Column) -> Column:
    """Runs of letters after paths and addresses are cut out."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(blank(c)), PLACE, " "), F.lit("([a-z]+)"), F.lit(1))


def normalize_prompt(c: Column) -> Column:
    return F.array_join(words_without_places(c), " ")


def topic_words(c: Column) -> Column:
    """Words of more than two letters that are no stopwords, in order."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(words_without_places(c), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def normalize_topic(c: Column) -> Column:
    return F.array_join(topic_words(c), " ")


def slug(c: Column, default: str = "unknown") -> Column:
    """Lower case with runs of anything but letters and digits as one dash, none at the ends."""
    return F.coalesce(filled(F.regexp_replace(F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")), F.lit(default))


def safe_name(c: Column) -> Column:
    """A file-safe identifier: runs of other characters become ``_``; dots and underscores are cut at the ends."""
    return F.regexp_replace(F.regexp_replace(blank(c), "[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")


def norm_path(c: Column) -> Column:
    """Slashes forward, no leading ``./``, no trailing slash; nothing left means ``.``."""
    path = F.regexp_replace(F.regexp_replace(F.translate(strip(blank(c)), "\\", "/"), r"^(\./)+", ""), "/+$", "")
    return F.coalesce(filled(path), F.lit("."))


def top_level(c: Column) -> Column:
    return F.substring_index(c, "/", 1)


def cell(c: Column, width: int) -> Column:
    """A Markdown table cell: one line, pipes escaped, cut to ``width`` with an ellipsis."""
    flat = collapse_spaces(blank(c))
    cut = F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)
    return F.replace(cut, F.lit("|"), F.lit("\\|"))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over those of the smaller side."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    """Two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def coverage(query: Column, *parts: Column) -> Column:
    """The share of the query's tokens found in any part; 0 for an empty query."""
    have = parts[0]
    for p in parts[1:]:
        have = F.array_union(have, p)
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, have)) / F.size(query))


def canonical_timestamp(c: Column) -> Column:
    """UTC text of a timestamp in the strict RFC 3339 profile, with all fraction digits but trailing zeros; else null."""
    form = r"^(\d{4}-\d\d-\d\d)[Tt](\d\d:\d\d:[0-5]\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
    part = lambda i: F.regexp_extract(c, form, i)
    local = F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2)), F.lit("yyyy-MM-dd HH:mm:ss"))
    zone = part(4)
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset = F.when(F.lower(zone) == "z", 0).when((hours <= 23) & (minutes <= 59), sign * (hours * 60 + minutes))
    utc = F.timestamp_seconds(F.unix_timestamp(local) - offset * 60)
    frac = F.regexp_replace(F.coalesce(part(3), F.lit("")), r"\.?0*$", "")
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    in_range = F.year(utc).between(1, 9999)
    return F.when(c.rlike(form) & in_range, F.concat(whole, frac, F.lit("Z")))


def epoch_seconds(c: Column) -> Column:
    """Seconds since 1970 of an ISO date or time (without a zone: UTC); negative infinity if unreadable."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(F.translate(strip(blank(c)), "T", " "))) / 1e6, F.lit(float("-inf")))


def occurrence_id(stream: Column, line: Column) -> Column:
    return F.format_string("%s-O%06d", stream, line)


def locator(label: Column, line: Column) -> Column:
    return F.concat(label, F.lit("#L"), line.cast("string"))


def valid_stream(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"), F.lit(False))


def valid_label(c: Column) -> Column:
    """A relative path with forward slashes, no colon and no step upwards."""
    parts = F.split(c, "/")
    return F.coalesce((c != "") & ~c.startswith("/") & ~c.rlike(r"[\\:\x00-\x1f]") & ~F.exists(parts, lambda p: p == ".."), F.lit(False))


def valid_locator(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^.+#L[1-9][0-9]*$") & valid_label(F.regexp_replace(c, "#L[0-9]+$", "")), F.lit(False))
