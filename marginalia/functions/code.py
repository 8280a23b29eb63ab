"""What files of source code import and define, by patterns on their text; code is not parsed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of this operator, by kind of edge; the first group is the name. Names in comments and texts may be taken as well.
SCRIPT = {
    "imports": r"""(?m)^\s*import\s+(?:[^'";]*?\s+from\s+)?['"]([^'"]+)['"]""",
    "requires": r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""",
    "exports": r"(?m)^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][A-Za-z0-9_$]*)",
    "defines": r"(?m)^(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:function|class)\s+([A-Za-z_$][A-Za-z0-9_$]*)",
}
GO = {
    "package": r"(?m)^package\s+([A-Za-z_][A-Za-z0-9_]*)",
    "imports": r"""(?m)^(?:import\s+|\t)(?:[A-Za-z_.][A-Za-z0-9_]*\s+)?"([^"\n]+)"\s*$""",
    "functions": r"(?m)^func\s+([A-Za-z_][A-Za-z0-9_]*)\s*[\[(]",
    "methods": r"(?m)^func\s+\([^)\n]*\)\s*([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    "types": r"(?m)^type\s+([A-Za-z_][A-Za-z0-9_]*)[\s\[]",
}


def code_edges(text: Column, patterns: dict[str, str]) -> Column:
    """Distinct ``(kind, name)`` of a text, as an array of structs; none of a null."""
    t = F.coalesce(text, F.lit(""))

    def edges(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    return F.array_distinct(F.concat(*[edges(k, p) for k, p in patterns.items()]))


def resolved_import(path: Column, name: Column) -> Column:
    """The path that a relative import of the file ``path`` leads to, without an ending; other imports as they are.

    ``.`` and ``..`` are followed; what would lead out of the tree stays at its top.
    """
    folder = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    steps = F.concat(folder, F.split(F.regexp_replace(name, r"\.(?:tsx?|jsx?|mjs|cjs)$", ""), "/"))
    none = F.array().cast("array<string>")
    walked = F.aggregate(steps, none, lambda a, s: F.when((s == ".") | (s == ""), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.when(name.rlike(r"^\.{1,2}(?:/|$)"), F.array_join(walked, "/")).otherwise(name)
