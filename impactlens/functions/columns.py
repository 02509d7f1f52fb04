"""Pure Column -> Column functions: everything here stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The whitespace class of a full strip, the id prefix.
WHITESPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
ID_PREFIX = "arXiv:"
# White space and pattern of an e-mail address as browsers' scripts have them.
SCRIPT_SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
EMAIL_PATTERN = rf"^[^{SCRIPT_SPACE}@]+@[^{SCRIPT_SPACE}@]+\.[^{SCRIPT_SPACE}@]+\z"
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"
ISO_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"
DEFAULT_CATEGORY = "cs.LG"


def text(c: Column) -> Column:
    """Null text reads as empty."""
    return F.coalesce(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """Strip all surrounding whitespace, then turn inner newlines into spaces; inner runs stay."""
    stripped = F.regexp_replace(text(c), f"^{WHITESPACE}+|{WHITESPACE}+$", "")
    return F.replace(stripped, F.lit("\n"), F.lit(" "))


def iso_timestamp(c: Column) -> Column:
    """ISO-8601 text to a naive timestamp. The offset is dropped, not applied; bad text is null."""
    # an offset follows a time of day only, so the "-02-03" of a bare date is left alone
    local = F.when(F.length(c) > 10, F.regexp_replace(c, ISO_OFFSET, "")).otherwise(c)
    return F.when(local.rlike(ISO_PATTERN), local.try_cast("timestamp_ntz"))


def id_from_url(c: Column) -> Column:
    """The part after the last `/abs/`; a version suffix is kept."""
    return F.element_at(F.split(c, "/abs/"), -1)


def prefixed_id(c: Column) -> Column:
    return F.when(F.startswith(F.lower(c), F.lit(ID_PREFIX.lower())), c).otherwise(F.concat(F.lit(ID_PREFIX), c))


def join_key(c: Column) -> Column:
    """Version-free, prefix-free id on which papers meet works."""
    return F.regexp_replace(F.regexp_replace(c, f"(?i)^{ID_PREFIX}", ""), r"v\d+$", "")


def array_length(c: Column) -> Column:
    # size(NULL) is -1 or NULL depending on settings, so never rely on either
    return F.when(c.isNull(), 0).otherwise(F.size(c))


def first_or_null(c: Column) -> Column:
    return F.try_element_at(c, F.lit(1))


def comma_list(c: Column) -> Column:
    """Split at commas and trim each piece; empty pieces stay."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x))


def count_nonempty(c: Column) -> Column:
    return F.size(F.filter(c, lambda x: x != ""))


def first_category(c: Column) -> Column:
    """First piece of a comma list, or the default category when nothing was entered."""
    return F.when(text(c) == "", F.lit(DEFAULT_CATEGORY)).otherwise(F.trim(F.element_at(F.split(c, ","), 1)))


def document(title: Column, abstract: Column, separator: str = " \n ") -> Column:
    return F.concat(text(title), F.lit(separator), text(abstract))


def embedding_text(title: Column, abstract: Column) -> Column:
    return document(title, abstract, "\n\n")


def normalise_email(c: Column) -> Column:
    return F.lower(F.regexp_replace(text(c), rf"^[{SCRIPT_SPACE}]+|[{SCRIPT_SPACE}]+\z", ""))


def valid_email(c: Column) -> Column:
    return (c != "") & c.rlike(EMAIL_PATTERN)


def shorten(c: Column, limit: int = 500) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def leading(c: Column, n: int) -> Column:
    return F.slice(c, 1, n)


def remainder(c: Column, n: int) -> Column:
    """How many entries follow the first n."""
    return F.greatest(array_length(c) - n, F.lit(0))


def pad_array(c: Column, width: int) -> Column:
    """Append zeros up to a constant width."""
    return F.concat(c, F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(c), F.lit(0))))


def scale_array(c: Column, weight: float) -> Column:
    return F.transform(c, lambda x: x.cast("double") * F.lit(weight))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 if either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def submission_week(published: Column) -> Column:
    """Monday of the submission week."""
    return F.date_trunc("week", published).cast("date")


def stable_key(*fields: Column) -> Column:
    """sha256 over the JSON of the named fields in name order (pass them sorted)."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
