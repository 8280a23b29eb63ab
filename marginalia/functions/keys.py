"""Normal forms of keys, texts and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a longest run of letters and digits.
WORD = r"[\p{L}\p{N}]+"


def none_if_blank(c: Column) -> Column:
    """Null for a null, empty or blank optional key."""
    return F.when(F.trim(F.translate(c, "\t", " ")) != "", c)


def plain_key(c: Column) -> Column:
    """A reference as it is compared: without blanks and tabs around it, in lower case; null if nothing is left."""
    t = F.lower(F.regexp_replace(c, r"^[ \t]+|[ \t]+$", ""))
    return F.when(t != "", t)


def words(c: Column) -> Column:
    """The lower-cased words of a text, in order; no words for a null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def plain_address(c: Column) -> Column:
    """An address with lower-case scheme and host, without fragment and without trailing slashes."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)#.*$", ""), r"/+$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))


def plain_checksum(c: Column) -> Column:
    """A checksum without the prefix ``sha256:`` and letter case; a null and an empty one are one value."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^sha256:", "")
