"""Turns of conversations that are written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Who speaks, by the names in use.
ROLES = {"user": "user", "human": "user", "customer": "user", "assistant": "assistant", "agent": "assistant", "ai": "assistant", "bot": "assistant", "system": "system", "tool": "tool"}
START = r"(?i)^[ \t]*(" + "|".join(ROLES) + r")[ \t]*:"
# What a preference sounds like, in English and Indonesian, and what says that there is none.
PREFERS = [
    "i prefer", "i like", "i want", "i don't want", "i do not want", "please", "my preference", "my taste", "style",
    "saya prefer", "saya suka", "aku suka", "lebih suka", "preferensi", "jangan", "tolong", "mending", "harusnya", "sebaiknya",
]
DENIES = ["no preference", "not a preference", "not preference", "without preference", "tanpa preferensi", "bukan preferensi", "tidak ada preferensi", "nggak ada preferensi", "gak ada preferensi"]


def turns(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The turns of texts with lines like ``role: words``: ``key, turn`` (from 0), ``role, said``; further lines belong to the turn above.

    Lines before the first turn are left out; so are texts without turns.
    """
    parts = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"(?mi)^(?=[ \t]*(?:" + "|".join(ROLES) + r")[ \t]*:)")
    t = docs.select(key, F.posexplode(F.filter(parts, lambda p: p.rlike(START))).alias("turn", "raw"))
    name = F.lower(F.regexp_extract("raw", START, 1))
    role = F.lit(None).cast("string")
    for k, v in ROLES.items():
        role = F.when(name == k, v).otherwise(role)
    return t.select(key, "turn", role.alias("role"), F.regexp_replace(F.regexp_replace("raw", START, ""), r"^\s+|\s+$", "").alias("said"))


def preferences(t: DataFrame) -> DataFrame:
    """Turns of users that state a preference."""
    low = F.lower("said")
    some = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    return t.where((F.col("role") == "user") & some(PREFERS) & ~some(DENIES))
