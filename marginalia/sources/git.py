"""Where a tree of files comes from, by its git folder, and the addresses of its files."""

from __future__ import annotations

import configparser
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the hosts' addresses lead to a file of a commit.
BLOB_PATHS = {"gitlab": "/-/blob/", "bitbucket": "/src/", "": "/blob/"}


def web_address(remote: str | None) -> str | None:
    """The address in the web of a remote as git knows it (ssh, scp-like or http), without user and ``.git``; null for a local one."""
    r = (remote or "").strip()
    m = re.match(r"^(?:ssh|git|https?)://(?:[^@/]+@)?([^/:]+)(?::\d+)?/(.+)$", r) or re.match(r"^(?:[^@/\s]+@)?([^:/\s]+\.[^:/\s]+):(?!/)(.+)$", r)
    if not m:
        return None
    return f"https://{m[1].lower()}/{m[2].strip('/').removesuffix('.git')}"


def git_identity(root: str) -> dict[str, str | None]:
    """``web``, ``branch`` and ``commit`` of the tree at ``root``, read from its git folder (three small files, on the driver); nulls where there is none.

    The folder may be named by a file (a worktree); a branch's commit stands in its own file or among the packed ones. The remote is origin, else the first.
    """
    none = {"web": None, "branch": None, "commit": None}
    folder = os.path.join(root, ".git")
    if os.path.isfile(folder):
        with open(folder, encoding="utf-8") as f:
            folder = os.path.join(root, f.read().removeprefix("gitdir:").strip())
    if not os.path.isdir(folder):
        return none

    def text(*path: str) -> str:
        try:
            with open(os.path.join(folder, *path), encoding="utf-8", errors="replace") as f:
                return f.read()
        except OSError:
            return ""

    common = os.path.normpath(os.path.join(folder, text("commondir").strip() or "."))
    read = lambda *path: text(*path) or text(os.path.relpath(common, folder), *path)
    config = configparser.ConfigParser(strict=False, interpolation=None, allow_no_value=True)
    try:
        config.read_string(re.sub(r"(?m)^[ \t]+", "", read("config")))
    except configparser.Error:
        pass
    remotes = [s for s in config.sections() if s.startswith('remote "')]
    remote = 'remote "origin"' if 'remote "origin"' in remotes else (remotes or [None])[0]
    head = text("HEAD").strip()
    ref = head.removeprefix("ref:").strip() if head.startswith("ref:") else None
    commit = head if ref is None else read(*ref.split("/")).strip()
    if ref and not commit:
        packed = [line.split() for line in read("packed-refs").splitlines() if not line.startswith(("#", "^"))]
        commit = next((p[0] for p in packed if len(p) == 2 and p[1] == ref), "")
    good = re.fullmatch(r"[0-9a-f]{40}(?:[0-9a-f]{24})?", commit)
    return {"web": web_address(config.get(remote, "url", fallback=None) if remote else None), "branch": ref and ref.removeprefix("refs/heads/"), "commit": commit if good else None}


def blob_address(web: Column, commit: Column, path: Column) -> Column:
    """The address of a file of a commit at its host; null without all three. Blanks and ``#%?`` in paths are escaped."""
    host = F.lower(F.regexp_extract(web, "^https?://([^/]+)", 1))
    way = F.lit(BLOB_PATHS[""])
    for name in ("gitlab", "bitbucket"):
        way = F.when(F.contains(host, F.lit(name)), BLOB_PATHS[name]).otherwise(way)
    safe = path
    for c in "% #?":
        safe = F.replace(safe, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.concat(F.regexp_replace(web, "/+$", ""), way, commit, F.lit("/"), F.regexp_replace(safe, "^/+", ""))
