"""Functions, classes and links in source code, by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What declares a function or a class, by language, and the group that holds its name.
_METHOD = r"(?:public|private|protected|static|[ ]) +[\w<>\[\]]+\s+(\w+) *\([^)]*\)"
_CLASS = r"class\s+(\w+)"
#: (language, kind, pattern, groups of the pattern that may hold the name)
PATTERNS = (
    ("Python", "Function", r"def\s+(\w+)\s*\(", 1),
    ("Python", "Class", _CLASS, 1),
    ("JavaScript", "Function", r"function\s+(\w+)\s*\(|(\w+)\s*=\s*function\s*\(|(\w+)\s*\([^)]*\)\s*\{", 3),
    ("JavaScript", "Class", _CLASS, 1),
    ("Java", "Function", _METHOD, 1),
    ("Java", "Class", _CLASS, 1),
    ("C#", "Function", _METHOD, 1),
    ("C#", "Class", _CLASS, 1),
    ("HTML", "Link", '<a href="([^"]*)"', 1),
)


def _found(text: Column, pattern: str, groups: int) -> Column:
    """name, start_line and end_line of all matches."""
    p = "(?U)" + pattern
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    names = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for g in range(1, groups + 1)]
    match = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    before = F.slice(F.split(text, p, -1), F.lit(1), F.size(match))  # the text between matches
    rows = F.arrays_zip(before.alias("b"), match.alias("m"), *[n.alias(f"g{k}") for k, n in enumerate(names)])
    name = lambda r: F.coalesce(*[F.when(r[f"g{k}"] != "", r[f"g{k}"]) for k in range(groups)], F.lit(""))
    none = F.array().cast("array<struct<name:string,start_line:int,end_line:int>>")

    def add(a: Column, r: Column) -> Column:
        start = (a["line"] + lines(r["b"])).cast("int")
        end = (start + lines(r["m"])).cast("int")
        one = F.struct(name(r).alias("name"), start.alias("start_line"), end.alias("end_line"))
        return F.struct(end.alias("line"), F.concat(a["out"], F.array(one)).alias("out"))

    return F.aggregate(rows, F.struct(F.lit(1).alias("line"), none.alias("out")), add, lambda a: a["out"])


def entities(files: DataFrame, id_col: str, text_col: str, language_col: str = "language") -> DataFrame:
    """One row per entity: id, language, kind, name, start_line, end_line; lines count from one, by newlines.

    Other languages, and null texts, have none.
    """
    text = F.col(text_col)
    of = lambda language, kind, p, g: F.when(F.col(language_col) == language, F.transform(_found(text, p, g), lambda e: F.struct(F.lit(kind).alias("kind"), e["name"].alias("name"), e["start_line"].alias("start_line"), e["end_line"].alias("end_line"))))
    every = F.flatten(F.filter(F.array(*[of(*p) for p in PATTERNS]), lambda a: a.isNotNull()))
    return files.filter(text.isNotNull()).select(id_col, F.col(language_col).alias("language"), F.explode(every).alias("e")).select(id_col, "language", "e.*")


def defines(found: DataFrame, id_col: str) -> DataFrame:
    """DEFINES edges from files to their entities, which are named by file, kind, line and name."""
    target = F.concat_ws(":", F.col(id_col).cast("string"), "kind", F.col("start_line").cast("string"), "name")
    return found.select(F.col(id_col).alias("source"), target.alias("target"), F.lit("DEFINES").alias("type"))
