import os

from pyspark.sql import functions as F

from marginalia.functions.temporal import policy_seconds, schedule_seconds
from marginalia.functions.text import POLICY, bullet_claims, extracted_claims, policy_part, query_tokens, redacted, text_score
from marginalia.sources.files import path_matches, read_tree
from marginalia.sources.transcripts import preferences, turns


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_globs(spark):
    def match(path, include, exclude=()):
        return one(spark, path_matches(F.lit(path), list(include), list(exclude)))

    assert match("a/b/c.md", ["**/*.md"]) and match("c.md", ["**/*.md"]) and match("a/b/c.md", ["*.md"])
    assert not match("a/b/c.md", ["a/*.md"]) and match("docs/x/y", ["docs/"]) and not match("docs.md", ["docs/"])
    assert not match("a/x.md", ["*.md"], ["a/"]) and match("a?c", ["a?c"]) and match("anything", [])


def test_tree(spark, tmp_path):
    files = {"a.md": b"# Title  here\nbody", "b/c.md": b"no heading", "vendor/x.md": b"# no", "d.go": b"package d", "big.md": b"x" * 3000, "bad.md": b"\xff\xfe\x00", "g.md": b"Code generated by x. DO NOT EDIT", "z.png": b"1"}
    for k, v in files.items():
        os.makedirs(os.path.dirname(tmp_path / k), exist_ok=True)
        (tmp_path / k).write_bytes(v)
    got = {r.path: (r.kind, r.title, r.skip_reason) for r in read_tree(spark, str(tmp_path), code=True, max_bytes=1000).collect()}
    assert got["a.md"] == ("markdown", "Title here", None) and got["b/c.md"] == ("markdown", "c", None) and got["d.go"] == ("code", "d.go", None)
    assert got["big.md"][2] == "too_large" and got["bad.md"][2] == "binary" and got["g.md"][2] == "generated" and len(got) == 6


def test_turns_and_preferences(spark):
    d = spark.createDataFrame([(1, "intro\nuser: I prefer tabs\nand more\r\nAssistant: noted\n"), (2, None), (3, "no turns"), (4, "human: from now on, be short\nuser: do not remember that I prefer it")], "id int, text string")
    t = turns(d, "id", "text").cache()
    assert [(r.id, r.turn, r.role, r.said) for r in t.orderBy("id", "turn").collect()] == [
        (1, 0, "user", "I prefer tabs\nand more"), (1, 1, "assistant", "noted"), (4, 0, "user", "from now on, be short"), (4, 1, "user", "do not remember that I prefer it")]
    assert sorted((r.id, r.turn) for r in preferences(t).collect()) == [(1, 0), (4, 1)]
    said = ["No preference, but tolong be short", "Sebaiknya pakai tab", "from now on", None, ""]
    t = spark.createDataFrame([(i, "user", s) for i, s in enumerate(said)] + [(9, "assistant", "please"), (10, None, "please")], "id int, role string, said string")
    assert [r.id for r in preferences(t).collect()] == [1]


def test_intervals(spark):
    assert [one(spark, schedule_seconds(F.lit(c))) for c in ("@hourly", "@daily", "@every 10m", "@every 0m", "every day", None)] == [3600, 86400, 600, None, None, None]
    assert [one(spark, policy_seconds(F.lit(p))) for p in ('{"max_age_hours": "6"}', '{"max_age_seconds": "x", "max_age_days": 2}', "{}", "", None)] == [21600, 172800, None, None, None]


def test_texts(spark):
    assert query_tokens("The the a of X1 _y") == ["the", "of", "x1", "_y"]
    assert abs(one(spark, text_score(F.lit("the team reviews the queue"), "team the")) - 0.195) < 1e-9
    assert one(spark, text_score(F.lit(None).cast("string"), "team")) == 0 and one(spark, text_score(F.lit("x"), "")) == 0
    assert one(spark, redacted(F.lit("mail a.b@c.org, call 081234567890, id 1234567890123, MY_API_KEY=1"))) == "mail [REDACTED_EMAIL], call [REDACTED_PHONE], id [REDACTED_ID], [REDACTED_SECRET_NAME]=1"
    text = "# h\n- Services must use the shared queue\n* short\n- const x = a very long line of code;\n- Services must use the shared queue\n"
    assert one(spark, bullet_claims(F.lit(text))) == ["Services must use the shared queue"]
    got = spark.range(1).select(*[F.regexp_extract(F.lit("The API must not use Redis for sessions."), POLICY, i).alias(f"g{i}") for i in range(1, 6)]).first()
    assert tuple(got) == ("The API", "must", "not ", "Redis", "sessions") and one(spark, policy_part(F.lit(' "The  Shared Queue".'))) == "shared queue"


def test_claims_of_bullets_and_prose_outside_of_code(spark):
    text = "\n".join([
        "# Services must not be taken from a heading of any length.", "- Zones are listed in one shared place", " ```sh", "- Bullets inside of code are not claims", "All code must be left out as it is not any prose.", "```",
        "Every service should write", "its logs to the shared queue. It must. The house was painted in the colours of the town last year.",
        "The misuser of a word that only holds other words is not a claim!", "```", "* A fence that is never closed holds the rest",
    ])
    assert one(spark, extracted_claims(F.lit(text))) == ["Every service should write its logs to the shared queue.", "Zones are listed in one shared place"]
    many = "\n".join([f"- Zone {i:02d} is listed in one shared place" for i in range(25)] + ["Agents must be named by the team that owns them."])
    got = one(spark, extracted_claims(F.lit(many)))
    assert len(got) == 25 and got[0].startswith("Agents must") and got[-1].startswith("- Zone 23"[2:])
    assert one(spark, extracted_claims(F.lit(None).cast("string"))) == []
