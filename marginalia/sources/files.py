"""Trees of text files as documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import title_of

# Folders that are never read, and kinds of files by ending.
PRUNED = [".git", "node_modules", "vendor", "dist", "build", "target", ".venv", "__pycache__"]
KINDS = {"md": "markdown", "markdown": "markdown", "mdown": "markdown", "go": "code", "js": "code", "jsx": "code", "ts": "code", "tsx": "code", "json": "code"}
GENERATED = r"(?i)code generated .* do not edit|@generated|auto-generated file"
MAX_BYTES = 1 << 20
HEAD = 8192


def glob_regex(glob: str) -> str:
    """A glob as a pattern for whole paths: ``*`` and ``?`` within a segment, ``**/`` any segments, ``dir/`` all below it; without a slash any segment may match."""
    g = glob.strip()
    if g.endswith("/"):
        g += "**"
    out, i = "", 0
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(g[i], re.escape(g[i]))
            i += 1
    return f"^(?:.*/)?{out}(?:/.*)?$" if "/" not in glob.strip().rstrip("/") or glob.strip().endswith("/") else f"^{out}$"


def path_matches(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Whether a path is included (by nothing: all are) and not excluded."""
    any_of = lambda globs: path.rlike("|".join(glob_regex(g) for g in globs))
    keep = any_of(include) if include else F.lit(True)
    return keep & ~any_of(exclude) if exclude else keep


def file_kind(path: Column) -> Column:
    """markdown, code or null by a path's ending."""
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for k, v in KINDS.items():
        out = F.when(end == k, v).otherwise(out)
    return out


def skip_reason(path: Column, text: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is not taken: too_large, generated, binary; null if it is."""
    head = F.substring(text, 1, HEAD)
    return (
        F.when(F.octet_length(text) > max_bytes, "too_large")
        .when(path.rlike(r"(?i)\.(?:pb|gen|min)\.[a-z]+$|(?:^|/)generated/") | head.rlike(GENERATED), "generated")
        .when(F.locate("\0", head) > 0, "binary")
    )


def read_tree(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), code: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files below ``root``: ``path, kind, title, content, checksum, skip_reason``; skipped files without content.

    Files over ``max_bytes`` are told apart by their length before they are read.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.rstrip("/").removeprefix("file:"))
    f = f.withColumn("path", F.regexp_replace("path", rf"^(?:file:)?/*{base.lstrip('/')}/", ""))
    f = f.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, PRUNED))) & path_matches(F.col("path"), list(include), list(exclude)))
    f = f.withColumn("kind", file_kind(F.col("path"))).where("kind is not null" if code else "kind = 'markdown'")
    small = F.when(F.col("length") <= max_bytes, F.col("content"))
    text = F.when(F.is_valid_utf8(small.cast("string")), small.cast("string"))
    f = f.select("path", "kind", "length", text.alias("content"), (small.isNotNull() & text.isNull()).alias("broken"))
    why = F.when(F.col("length") > max_bytes, "too_large").when(F.col("broken"), "binary").otherwise(skip_reason(F.col("path"), F.col("content"), max_bytes))
    f = f.withColumn("skip_reason", why).withColumn("content", F.when(F.col("skip_reason").isNull(), F.col("content")))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", "")
    return f.select(
        "path", "kind", F.when(F.col("kind") == "code", F.col("path")).otherwise(title_of(F.col("content"), stem)).alias("title"),
        "content", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("checksum"), "skip_reason",
    )
