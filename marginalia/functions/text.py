"""Text matching, cleaning and extraction as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of texts and queries.
TOKEN = r"[\p{L}\p{N}_]+"

# What is blacked out, in this order, and by what. No ``\b``, which means different things in different engines.
REDACTIONS = [
    (r"(?i)(^|[^A-Z0-9._%+\-])[A-Z0-9._%+\-]*[A-Z0-9][A-Z0-9._%+\-]*@[A-Z0-9.\-]+\.[A-Z]{2,}", "$1[REDACTED_EMAIL]"),
    (r"(^|[^\d])(?:\+?62|0)8\d{7,12}([^\d]|$)", "$1[REDACTED_PHONE]$2"),
    (r"(^|[^\d])\d{12,20}([^\d]|$)", "$1[REDACTED_ID]$2"),
    (r"(^|[^A-Za-z0-9_])[A-Z][A-Z0-9_]*(?:PASSWORD|PASS|TOKEN|SECRET|API_KEY|ACCESS_KEY|PRIVATE_KEY|CREDENTIAL|USERNAME|_USER|_KEYS)[A-Z0-9_]*", "$1[REDACTED_SECRET_NAME]"),
]
# Claims with these words are policy; claims that hold these marks, or begin with these words, are code.
POLICY_WORDS = "should must required default standard use uses prefer avoid deprecated supersedes replaces duplicates derives".split()
CODE_MARKS = [" := ", " => ", "($", "`)"]
CODE_STARTS = "case const else export for func function if import insert let return select switch type update var where".split()
#: White space of any script; the line that opens or closes fenced code; a sentence of prose.
SPACE = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
FENCE = r"(?md)^[\t\x0B\f\r\x{85}\p{Z}]*```[^\n]*$"
SENTENCE = r"[A-Z][^.!?]{39,260}[.!?]"
# Fixed value: X must [not] use Y [for Z]: subject, strength, not, value, purpose.
POLICY = r"(?i)^\s*(.+?)\s+(must|should|shall|needs to|required to)\s+(not\s+)?use\s+(.+?)(?:\s+for\s+(.+?))?\s*[.!]?\s*$"
# Relations between names in a sentence.
RELATIONS = {
    "should_not_use": r"(?:should|must|shall|needs\s+to|required\s+to)\s+not\s+use",
    "should_use": r"(?:should|must|shall|needs\s+to|required\s+to)\s+use",
    "depends_on": r"depends\s+on",
    "uses": r"uses",
    "owns": r"owns",
    "supersedes": r"(?:supersedes|replaces)",
    "duplicates": r"(?:duplicates|is\s+a\s+duplicate\s+of)",
    "derives_from": r"derives\s+from",
}
# What a task's wording tells of its intent, as parts of words; the first that is met holds.
INTENTS = {
    "migration": ["upgrade", "migration", "migrate", "breaking", "dependency", "version"],
    "debugging": ["bug", "fix", "error", "incident", "regression", "failing", "fail"],
    "implementation": ["implement", "build", "add", "feature", "refactor", "code"],
    "architecture": ["architecture", "design", "how", "explain", "overview", "flow"],
}
# Words that begin a passage about secrets, words that make it one, and how far such a passage goes at most within its sentence.
SECRET_STARTS = ["request", "rotate", "rotated", "stored", "store", "fetch", "set", "export", "configure", "vault", "workspace variable", "workspace variables", "credential", "credentials", "password", "secret", "api key"]
SECRET_WORDS = ["password", "secret", "token", "credential"]
SECRET_REACH = 180


def squeezed(c: Column) -> Column:
    """White space runs as one blank, none around."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^ | $", "")


def tokens(c: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def query_tokens(q: str, most: int = 16) -> list[str]:
    """A query's distinct tokens of two letters or more in order, 16 at most."""
    import regex

    return [t for t in dict.fromkeys(regex.findall(TOKEN, q.lower())) if len(t) >= 2][:most]


def text_score(text: Column, q: str) -> Column:
    """How well a text meets a query: at most 0.4. All words: 0.1; each occurrence of a word: 0.065."""
    terms = query_tokens(q)
    if not terms:
        return F.lit(0.0)
    t = tokens(text)
    hits = F.size(F.filter(t, lambda x: x.isin(terms)))
    every = F.size(F.array_except(F.array(*map(F.lit, terms)), t)) == 0
    return F.least(F.greatest(F.when(every, 0.1).otherwise(0.0), hits * F.lit(0.1) * F.lit(0.65)), F.lit(0.4))


def redacted(c: Column) -> Column:
    for pattern, to in REDACTIONS:
        c = F.regexp_replace(c, pattern, to)
    return c


def secret_context(words: list[str] = SECRET_WORDS) -> str:
    """The pattern of a passage about secrets: from a word that begins one, as far as it reaches in its line and sentence, if one of ``words`` is in it."""
    own = [w for w in SECRET_STARTS if any(k in w for k in words)]
    ahead = "|".join(rf"[^\n.]{{0,{SECRET_REACH - len(k)}}}?{k}" for k in words)
    others = "|".join(re.escape(w) for w in SECRET_STARTS if w not in own)
    return rf"(?i)(?<![A-Za-z0-9_])(?:(?:{others})(?={ahead})|{'|'.join(own)})[^\n.]{{0,{SECRET_REACH}}}"


def fully_redacted(c: Column) -> Column:
    """``redacted``, and then whole passages that speak of secrets."""
    return F.regexp_replace(redacted(c), secret_context(), "[REDACTED_SECRET_CONTEXT]")


def ingest_tokens(c: Column) -> Column:
    """Estimated tokens for storing: a third more than the words, or a fourth of the characters, at least 1."""
    n = F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))
    return F.greatest(F.lit(1), F.floor(n * 4 / 3), F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("bigint")


def packet_tokens(c: Column) -> Column:
    """Estimated tokens for sending: a fourth of the bytes, or the words."""
    n = F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))
    return F.greatest(F.ceil(F.octet_length(F.coalesce(c, F.lit(""))) / 4), n).cast("bigint")


def looks_like_code(c: Column) -> Column:
    """Whether a line is source code rather than a claim: by its first word, by what only code has, or by two braces or semicolons."""
    begins = r"(?i)^\s*(?:" + "|".join(CODE_STARTS) + r") "
    holds = "|".join(map(re.escape, CODE_MARKS))
    twice = r"(?s)[{}].*[{}]|;.*;"
    return c.rlike(f"{begins}|{holds}|{twice}")


def bullet_claims(content: Column) -> Column:
    """Distinct claims of a markdown text's bullets: 20 to 260 bytes, no code, in order, 25 at most."""
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), "\r?\n"), lambda x: squeezed(x))
    bullets = F.transform(F.filter(lines, lambda x: x.rlike(r"^[-*] ")), lambda x: squeezed(F.substring(x, 3, 1 << 30)))
    good = F.filter(bullets, lambda x: (F.octet_length(x) >= 20) & (F.octet_length(x) <= 260) & ~looks_like_code(x))
    return F.slice(F.array_sort(F.array_distinct(good)), 1, 25)


def extracted_claims(content: Column) -> Column:
    """Distinct claims of a markdown text without its fenced code: bullets, and prose sentences with a word of policy.

    A sentence runs from a capital to a full stop, over lines if need be; headings
    are no prose. 20 to 260 bytes, no code, in order, 25 at most of both kinds together.
    """
    trimmed = lambda x: F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")
    clean = lambda x: trimmed(F.regexp_replace(x, r"[\t\n\f\r ]+", " "))
    parts = F.filter(F.split(F.coalesce(content, F.lit("")), FENCE), lambda _, i: i % 2 == 0)  # every other part is code
    lines = F.transform(F.flatten(F.transform(parts, lambda x: F.split(x, "\n"))), trimmed)
    bullet = lambda x: x.startswith("- ") | x.startswith("* ")
    bullets = F.transform(F.filter(lines, bullet), lambda x: clean(F.substring(x, 3, 1 << 30)))
    prose = F.array_join(F.filter(lines, lambda x: ~bullet(x) & ~x.startswith("#") & (x != "")), "\n")
    sentences = F.transform(F.regexp_extract_all(prose, F.lit(SENTENCE), F.lit(0)), clean)
    word = r"(?:^|[^A-Za-z0-9_])(?iu:" + "|".join(POLICY_WORDS) + r")(?:[^A-Za-z0-9_]|$)"
    found = F.concat(bullets, F.filter(sentences, lambda x: x.rlike(word)))
    good = F.filter(found, lambda x: (F.octet_length(x) >= 20) & (F.octet_length(x) <= 260) & ~looks_like_code(x))
    return F.slice(F.array_sort(F.array_distinct(good)), 1, 25)


def policy_part(c: Column) -> Column:
    """A part of a policy as it is compared: lower case, without quotes, brackets and an article."""
    t = squeezed(F.regexp_replace(F.lower(c), r"^[\s\"'`.,;:()\[\]{}]+|[\s\"'`.,;:()\[\]{}]+$", ""))
    return F.regexp_replace(t, r"^(?:the|a|an) ", "")


def title_of(content: Column, fallback: Column) -> Column:
    """The first level-one heading, or what stands for it."""
    t = squeezed(F.regexp_extract(F.coalesce(content, F.lit("")), r"(?m)^[ \t]*# +([^\r\n]+)", 1))
    return F.when(t != "", t).otherwise(fallback)


def quote_score(claim: Column, sentence: Column) -> Column:
    """Share of a claim's words that a sentence holds."""
    from marginalia.functions.keys import words

    w = words(claim)
    return F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: F.array_contains(words(sentence), x))) / F.size(w)).otherwise(F.lit(0.0))
