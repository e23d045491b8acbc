"""Text rules as Columns: keyword search, ordered typing, languages, versions, identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of the summaries that make a function a candidate source or sink.
SOURCE_KEYWORDS = ("input", "read", "load", "fetch", "get", "receive", "request", "parse", "environment", "config", "parameter", "argument", "userinput", "database", "file", "http", "socket", "port")
SINK_KEYWORDS = ("write", "save", "update", "execute", "insert", "delete", "query", "render", "response", "print", "log", "output", "store", "send", "sql", "command", "exec", "eval", "database", "file", "http")
# Keywords of the documentation that confirm a source or sink.
SOURCE_DOC_KEYWORDS = ("read", "input", "get", "fetch", "load", "receive", "obtain", "parse", "extract", "import")
SINK_DOC_KEYWORDS = ("write", "output", "save", "store", "execute", "update", "delete", "insert", "query", "render", "response", "print", "log")
# Types as (type, all of these words, any of these words), the first that fits.
SOURCE_TYPES = (
    ("user_input", ("user", "input"), ()),
    ("database_read", ("database",), ()),
    ("file_read", ("file",), ()),
    ("network_receive", (), ("http", "request", "network")),
    ("environment_variable", ("environment",), ()),
    ("configuration", ("config",), ()),
)
SINK_TYPES = (
    ("database_write", ("database",), ("write", "update", "delete", "insert", "query")),
    ("file_write", ("file",), ("write", "save")),
    ("network_send", (), ("http", "response", "network")),
    ("command_execution", (), ("exec", "command", "system", "shell")),
    ("html_rendering", (), ("html", "render", "template")),
    ("logging", ("log",), ()),
    ("response_generation", ("response",), ()),
)
# What an answer says about a source, and how sure it sounds.
SOURCE_ANSWERS = ("is a source", "acts as a source", "functions as a source", "introduces data", "obtains data", "retrieves data")
CERTAINTY = (("0.9", ("definitely",), ()), ("0.7", ("likely",), ()), ("0.6", ("probably",), ()), ("0.4", ("possibly",), ()), ("0.3", ("might",), ()))
SINK_ANSWERS = ("is a sink", "acts as a sink", "functions as a sink", "outputs data", "writes data", "sends data", "executes")
# Types out of answers, as (type, all of these words, any of these words), the first that fits.
SOURCE_ANSWER_TYPES = (
    ("user_input", (), ("user input", "user-supplied")),
    ("database_read", ("database",), ()),
    ("file_read", ("file",), ("read", "load", "open")),
    ("network_receive", (), ("http", "request", "api", "fetch")),
    ("environment_variable", ("environment",), ()),
    ("configuration", ("config",), ()),
)
SINK_ANSWER_TYPES = (
    ("database_write", ("database",), ("write", "insert", "update", "delete", "query")),
    ("file_write", ("file",), ("write", "save", "create")),
    ("network_send", (), ("http", "response", "send", "api")),
    ("command_execution", (), ("exec", "execute", "command", "system", "shell")),
    ("html_rendering", (), ("html", "render", "template")),
    ("logging", ("log",), ()),
    ("response_generation", ("response",), ()),
)
# Languages by file extension.
LANGUAGES = {
    "python": ("py", "pyc", "pyd", "pyx", "pyi"),
    "javascript": ("js", "jsx"),
    "typescript": ("ts", "tsx"),
    "java": ("java", "class", "jar"),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hxx"),
    "csharp": ("cs",),
    "go": ("go",),
    "ruby": ("rb",),
    "php": ("php",),
    "swift": ("swift",),
    "rust": ("rs",),
    "scala": ("scala",),
    "kotlin": ("kt", "kts"),
    "html": ("html", "htm"),
    "css": ("css", "scss", "sass", "less"),
    "xml": ("xml",),
    "json": ("json",),
    "yaml": ("yml", "yaml"),
    "toml": ("toml",),
    "ini": ("ini", "cfg", "conf"),
    "markdown": ("md", "markdown"),
    "restructuredtext": ("rst",),
    "sql": ("sql",),
    "shell": ("sh", "bash", "zsh"),
    "batch": ("bat", "cmd"),
    "powershell": ("ps1",),
}
EXTENSIONS = {x: language for language, xs in LANGUAGES.items() for x in xs}
# Extensions of code files.
CODE = ("py", "js", "ts", "jsx", "tsx", "java", "c", "cpp", "h", "hpp", "cs", "go", "rb", "php", "swift", "kt", "rs", "sh", "bat", "ps1", "sql", "html", "css", "scss", "xml", "json", "yaml", "yml", "r", "scala", "groovy", "pl", "lua", "m", "mm")
# Languages by content, as (language, all of these, any of these), the first that fits.
CONTENT_RULES = (
    ("Python", ("def ", ":", "import "), ()),
    ("JavaScript", ("function ", "{", "}"), ()),
    ("Java", ("class ", "extends ", "public "), ()),
    ("C/C++", ("#include", "{", "}"), ()),
    ("C#", ("namespace ", "using "), ()),
    ("PHP", ("<?php",), ()),
    ("HTML", (), ("<html", "<!DOCTYPE")),
)
# What a walk leaves out.
IGNORED_DIRS = (".git", ".svn", ".hg", "__pycache__", "node_modules", "venv", ".env", ".venv", "env", "virtualenv", ".virtualenv", "build", "dist", "target", "bin", ".idea", ".vscode", ".vs", "tmp")
IGNORED_EXTENSIONS = ("pyc", "pyo", "pyd", "obj", "o", "a", "lib", "so", "dll", "exe", "bin", "dat", "db", "sqlite", "sqlite3", "pickle", "pkl", "jpg", "jpeg", "png", "gif", "bmp", "tiff", "ico", "svg", "pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "zip", "tar", "gz", "bz2", "7z", "rar")
# Byte order marks.
BOMS = (("EFBBBF", "utf-8-sig"), ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be"))


def any_keyword(text: Column, keywords: tuple[str, ...] | list[str]) -> Column:
    """Whether any keyword occurs, in any case; false for null."""
    low = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(k.lower())) for k in keywords]), F.lit(False))


def keyword_count(text: Column, keywords: tuple[str, ...] | list[str]) -> Column:
    """Non-overlapping occurrences of all keywords, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = [F.try_divide(F.length(low) - F.length(F.replace(low, F.lit(k.lower()), F.lit(""))), F.lit(len(k))).cast("bigint") for k in keywords]
    return reduce(lambda a, b: a + b, counts)


def keyword_confidence(text: Column, keywords: tuple[str, ...] | list[str], base: float = 0.3, each: float = 0.1, most: float = 0.8) -> Column:
    return F.least(F.lit(base) + F.lit(each) * keyword_count(text, keywords), F.lit(most))


def first_match(text: Column, rules: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...], default: str | None = None, fold: bool = True) -> Column:
    """The value of the first rule (value, all of, any of) whose substrings occur; in any case, if ``fold``."""
    out, low = F.lit(default), F.lower(text) if fold else text
    for value, all_of, any_of in reversed(rules):
        tests = [F.contains(low, F.lit(x)) for x in all_of]
        if any_of:
            tests.append(reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in any_of]))
        out = F.when(reduce(lambda a, b: a & b, tests), value).otherwise(out)
    return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column, default: str | None = "unknown") -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(default))


def is_code(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*CODE), F.lit(False))


# Names that a language goes by, as patterns; the first that matches counts.
LANGUAGE_VARIANTS = (
    ("JavaScript", "^(JavaScript|TypeScript|JS|TS)$"),
    ("C#", "^(C#|CSharp|C Sharp)$"),
    ("Python", "Python"),
    ("Java", "(?s)^(?!.*Script).*Java"),
    ("PHP", "PHP"),
)


def normalized_language(name: Column) -> Column:
    """Variants of a language's name under one name; others as they are."""
    return F.coalesce(*[F.when(name.rlike(pattern), language) for language, pattern in LANGUAGE_VARIANTS], name)


def wanted_path(path: Column, ignored_dirs: tuple[str, ...] = IGNORED_DIRS, ignored_extensions: tuple[str, ...] = IGNORED_EXTENSIONS) -> Column:
    """False if any component is an ignored directory or the extension is on the deny list."""
    parts = F.split(path, "/")
    return ~F.arrays_overlap(parts, F.array(*map(F.lit, ignored_dirs))) & ~extension(path).isin(*ignored_extensions)


def truncated(text: Column, n: int, marker: str = "... [truncated]") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


def clamped(x: Column) -> Column:
    """A confidence: values above one are tenths, the rest is cut to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x > 1, x / 10).otherwise(x)))


def version_parts(version: Column) -> Column:
    """The numeric components, without trailing zeros, so that 1.2 equals 1.2.0."""
    return F.transform(F.split(F.regexp_replace(version, r"(\.0+)+$", ""), r"\."), lambda p: F.coalesce(F.try_to_number(F.regexp_extract(p, r"^\d+", 0), F.lit("999999999")).cast("int"), F.lit(0)))


def newer(a: Column, b: Column) -> Column:
    return version_parts(a) > version_parts(b)


def encoding_by_bom(content: Column) -> Column:
    out = F.lit("utf-8")
    for mark, name in reversed(BOMS):
        out = F.when(F.startswith(F.hex(content), F.lit(mark)), name).otherwise(out)
    return out


def mapped(value: Column, table: dict[str, str], default: str) -> Column:
    """An enum map with a default; case does not matter."""
    lookup = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k.lower(), v)])
    return F.coalesce(F.try_element_at(lookup, F.lower(value)), F.lit(default))


# How texts name a weakness, a version behind a name, a place in a list, and a vulnerability.
CWE, VERSION, ORDINAL, CVE = r"cwe-?(\d+)", r"\s+(\d+\.\d+)", r"(#\s*\d+|\d+(?:st|nd|rd|th)|\bnumber \d+\b)", r"^CVE-\d{4}-\d{4,}$"


def cwe_ids(text: Column) -> Column:
    """The CWE ids that a text names, in order, however they are spelled."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(CWE), F.lit(1)), lambda n: F.concat(F.lit("CWE-"), n))


def named_version(text: Column, name: str) -> Column:
    """The first version (major.minor) behind a name, null for none."""
    found = F.regexp_extract(F.lower(text), rf"\Q{name.lower()}\E{VERSION}", 1)
    return F.nullif(found, F.lit(""))


def ordinal(text: Column) -> Column:
    """The first place that a text names (#3, 3rd, number 3), null for none."""
    found = F.regexp_extract(F.lower(text), ORDINAL, 1)
    return F.nullif(F.regexp_replace(found, r"\D", ""), F.lit("")).cast("int")


def valid_cve(value: Column) -> Column:
    return F.coalesce(value.rlike(CVE), F.lit(False))


def valid_investigation(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^inv-[A-Za-z0-9-]+$"), F.lit(False))


def code_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, counted from one, both included; bounds are cut to the text."""
    lines = F.split(text, "\n", -1)
    begin = F.greatest(first, F.lit(1))
    return F.array_join(F.slice(lines, begin, F.greatest(F.least(last, F.size(lines)) - begin + 1, F.lit(0))), "\n")
