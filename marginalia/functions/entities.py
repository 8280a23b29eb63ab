"""Names of teams, services, systems and technologies in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Technologies by name, and last words of names with the type that they tell (null: a name, but of no type).
TECHNOLOGIES = (
    "airflow argocd aws bigquery docker elasticsearch gcp github grafana graphql helm k8s kafka kubernetes mongodb mysql next.js node.js "
    "postgres postgresql prometheus react redis s3 terraform typescript"
).split()
TYPES = {
    "team": "team group".split(),
    "service": "service api app backend frontend gateway worker".split(),
    "system": "database db queue topic cluster platform pipeline system".split(),
}
UNTYPED = "broker consumer job model producer stream workflow".split()
SUFFIXES = [w for ws in TYPES.values() for w in ws] + UNTYPED

_CAPITAL = r"[A-Z][A-Za-z0-9]*(?:\.[A-Za-z0-9]+)?"
#: Words that begin small are taken as well, so that no name begins within a word; they are left out afterwards.
PHRASE = rf"[\p{{Ll}}\p{{N}}_][\p{{L}}\p{{N}}_]*|{_CAPITAL}(?:[- ]{_CAPITAL}){{0,5}}"
TICKED = r"`([^`]+)`"
AROUND = r"""^[\s,;:()\[\]{}"'`]+|[\s,;:()\[\]{}"'`]+$"""
ARTICLES = r"(?i)^(?:(?:the|a|an)(?:\s+|$))+"


def canonical_name(c: Column) -> Column:
    """A name without quotes, brackets and articles around it, white space as one blank."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, AROUND, ""), ARTICLES, ""), r"\s+", " ")
    return F.regexp_replace(t, AROUND, "")


def _parts(name: Column) -> Column:
    return F.split(F.lower(F.replace(name, F.lit("-"), F.lit(" "))), " ")


def is_name(name: Column) -> Column:
    """Whether a capitalised phrase names something: a technology, a phrase with a word of those lists, or capitals alone."""
    p = _parts(name)
    listed = F.arrays_overlap(p, F.array(*map(F.lit, SUFFIXES + TECHNOLOGIES)))
    capitals = ~name.rlike("[a-z]") & name.rlike("[A-Z][^A-Z]*[A-Z]")
    return F.lower(name).isin(TECHNOLOGIES) | F.element_at(p, -1).isin(SUFFIXES) | capitals | ((F.size(p) > 1) & listed)


def entity_type(name: Column) -> Column:
    """team, service or system by a name's last word, technology by any word or the whole, else unknown."""
    p = _parts(name)
    last = F.element_at(p, -1)
    out = F.when(F.lower(name).isin(TECHNOLOGIES) | F.arrays_overlap(p, F.array(*map(F.lit, TECHNOLOGIES))), "technology").otherwise("unknown")
    for kind, ws in TYPES.items():
        out = F.when(last.isin(ws), kind).otherwise(out)
    return out


def entity_names(text: Column) -> Column:
    """The distinct names in a text, in lower case: what stands between backticks, and capitalised phrases of up to six words that name something.

    Null has none. Names are of two bytes or more.
    """
    t = F.coalesce(text, F.lit(""))
    ticked = F.transform(F.regexp_extract_all(t, F.lit(TICKED), F.lit(1)), canonical_name)
    capital = F.filter(F.regexp_extract_all(t, F.lit(PHRASE), F.lit(0)), lambda x: x.rlike("^[A-Z]"))
    capital = F.filter(F.transform(capital, canonical_name), is_name)
    return F.array_distinct(F.transform(F.filter(F.concat(ticked, capital), lambda x: F.octet_length(x) >= 2), lambda x: F.lower(x)))


def mentions_entity(text: Column, name: Column) -> Column:
    """Whether a text speaks of a name: it holds it, or two of its parts of three letters or more (or the only one, of a name of one part). Nulls and blanks never."""
    t, n = F.lower(F.trim(text)), F.lower(F.trim(name))
    parts = F.filter(F.split(n, r"[/\-_.: ]+"), lambda x: x != "")
    hits = F.size(F.filter(parts, lambda x: (F.octet_length(x) >= 3) & F.contains(t, x)))
    return F.coalesce((t != "") & (n != "") & (F.contains(t, n) | ((hits > 0) & (hits >= F.least(F.lit(2), F.size(parts))))), F.lit(False))
