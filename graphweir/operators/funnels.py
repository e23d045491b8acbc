"""Funnels and analyzers: from summaries to typed sources, sinks and data-flow reports."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweir.functions import text as rules


class Funnel(Protocol):
    """Finds candidates: id, name, description, file_path."""

    def sources(self, functions: DataFrame) -> DataFrame: ...

    def sinks(self, functions: DataFrame) -> DataFrame: ...


class Analyzer(Protocol):
    """Confirms and types candidates by Columns, so that no rows leave the JVM."""

    def source(self, description: Column) -> tuple[Column, Column, Column]: ...

    def sink(self, description: Column) -> tuple[Column, Column, Column]: ...

    def data_flow(self, source: Column, sink: Column) -> tuple[Column, Column, Column]:
        """Confirmation, vulnerability type and impact, from structs (name, kind, description)."""
        ...


class KeywordFunnel:
    """Candidates whose summary holds a keyword; one row per function."""

    def __init__(self, sources: tuple[str, ...] = rules.SOURCE_KEYWORDS, sinks: tuple[str, ...] = rules.SINK_KEYWORDS):
        self._sources, self._sinks = sources, sinks

    @staticmethod
    def _pick(functions: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
        return functions.filter(rules.any_keyword(F.col("description"), keywords)).withColumn("file_path", F.coalesce("file_path", F.lit("unknown")))

    def sources(self, functions: DataFrame) -> DataFrame:
        return self._pick(functions, self._sources)

    def sinks(self, functions: DataFrame) -> DataFrame:
        return self._pick(functions, self._sinks)


def linked_candidates(functions: DataFrame, summaries: DataFrame, defined_in: DataFrame, part_of: DataFrame, files: DataFrame, repository: Column, keywords: tuple[str, ...]) -> DataFrame:
    """Functions whose summary holds a keyword, one row per summary: node_id, name, line_number, description, file_node_id, file_path.

    A function that is defined in a file of the repository comes with that file (the one with the smallest path, if
    there are more); any other function comes without one, its path is ``unknown``.  Frames: functions
    (node_id, name, line_number), summaries (node_id, summary), defined_in (node_id, file_node_id), part_of
    (file_node_id, repository), files (file_node_id, path); ``repository`` is a condition on part_of.
    """
    own = part_of.filter(repository).select("file_node_id").distinct().join(files, "file_node_id")
    linked = defined_in.join(own, "file_node_id").groupBy("node_id").agg(F.min(F.struct("path", "file_node_id")).alias("file"))
    found = summaries.filter(rules.any_keyword(F.col("summary"), keywords)).join(functions, "node_id").join(linked, "node_id", "left")
    return found.select("node_id", "name", "line_number", F.col("summary").alias("description"), "file.file_node_id", F.coalesce("file.path", F.lit("unknown")).alias("file_path"))


#: Sources of a file that meet its sinks in one group.
SHARE = 1000


def flows(sources: DataFrame, sinks: DataFrame, analyzer: Analyzer) -> DataFrame:
    """Data flows that the analyzer confirms between typed sources and sinks of one file: a row for each pair.

    A file's sources are dealt by name into shares of about ``SHARE``, and its sinks go to each of its shares: a file of any size is many
    groups, and a group holds a share of the sources while the sinks pass by. The pairs of a file are as many as its sources times its sinks.
    """
    one = sources.filter("file_path <> 'unknown'").select("file_path", F.struct("name", "kind", "description").alias("source"))
    other = sinks.filter("file_path <> 'unknown'").select("file_path", F.struct("name", "kind", "description").alias("sink"))
    shares = one.groupBy("file_path").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    ok, kind, impact = analyzer.data_flow(F.col("source"), F.col("sink"))
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, because the pairs are many more than the bytes by which Spark would merge partitions
    dealt = one.join(shares, "file_path").select("file_path", F.pmod(F.xxhash64("source.name"), "shares").alias("share"), "source").repartition(n, "file_path", "share")
    to_each = other.join(shares, "file_path").select("file_path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"), "sink").repartition(n, "file_path", "share")
    pairs = to_each.join(dealt.hint("merge"), ["file_path", "share"]).filter(ok)
    return pairs.select("file_path", F.col("source.name").alias("source"), F.col("sink.name").alias("sink"), kind.alias("vulnerability_type"), impact.alias("impact"))


class DocumentationAnalyzer:
    """Confirmation, type and confidence from the words of the documentation."""

    def source(self, description: Column) -> tuple[Column, Column, Column]:
        return rules.any_keyword(description, rules.SOURCE_DOC_KEYWORDS), rules.first_match(description, rules.SOURCE_TYPES, "unknown_source"), rules.keyword_confidence(description, rules.SOURCE_DOC_KEYWORDS)

    def sink(self, description: Column) -> tuple[Column, Column, Column]:
        return rules.any_keyword(description, rules.SINK_DOC_KEYWORDS), rules.first_match(description, rules.SINK_TYPES, "unknown_sink"), rules.keyword_confidence(description, rules.SINK_DOC_KEYWORDS)


    def data_flow(self, source: Column, sink: Column) -> tuple[Column, Column, Column]:
        """What users type and what is executed or stored: an injection; its impact is high where commands run."""
        risky = (source["kind"] == "user_input") | (source["kind"] == "network_receive")
        run = sink["kind"] == "command_execution"
        return risky & (run | (sink["kind"] == "database_write")), F.when(run, "command injection").otherwise("sql injection"), F.when(run, "high").otherwise("medium")


class AnswerAnalyzer(DocumentationAnalyzer):
    """Confirmation, type and confidence from a stored answer about the function."""

    def source(self, description: Column) -> tuple[Column, Column, Column]:
        return rules.any_keyword(description, rules.SOURCE_ANSWERS), rules.first_match(description, rules.SOURCE_ANSWER_TYPES, "unknown_source"), rules.first_match(description, rules.CERTAINTY, "0.5").cast("double")

    def sink(self, description: Column) -> tuple[Column, Column, Column]:
        return rules.any_keyword(description, rules.SINK_ANSWERS), rules.first_match(description, rules.SINK_ANSWER_TYPES, "unknown_sink"), rules.first_match(description, rules.CERTAINTY, "0.5").cast("double")


#: Compliance checks by name: each builds a boolean Column from its parameters.
CHECKS: dict[str, Callable[[dict], Column]] = {
    "present": lambda p: F.col(p["column"]).isNotNull(),
    "at_least": lambda p: F.coalesce(F.col(p["column"]) >= p["value"], F.lit(False)),
    "matches": lambda p: F.coalesce(F.col(p["column"]).rlike(p["pattern"]), F.lit(False)),
    "one_of": lambda p: F.coalesce(F.col(p["column"]).isin(*p["values"]), F.lit(False)),
}


def checked(rows: DataFrame, requirements: list[tuple[str, str, str, dict]]) -> DataFrame:
    """(requirement_id, category, compliant) per row, for (id, category, check, parameters) requirements."""
    each = F.array(*[F.struct(F.lit(i).alias("requirement_id"), F.lit(c).alias("category"), CHECKS[check](p).alias("compliant")) for i, c, check, p in requirements])
    return rows.select(F.explode(each).alias("r")).select("r.*")


def typed(candidates: DataFrame, analyzer: Analyzer, what: str) -> DataFrame:
    """Confirmed candidates with their type and confidence."""
    ok, kind, confidence = getattr(analyzer, what)(F.col("description"))
    return candidates.withColumn("kind", kind).withColumn("confidence", F.round(confidence, 4)).filter(ok)


def cascade(candidates: DataFrame, analyzers: list[Analyzer], what: str) -> DataFrame:
    """The verdict of the first analyzer that confirms; its place in the list is ``analyzer``."""
    verdict = F.lit(None)
    for rank, analyzer in reversed(list(enumerate(analyzers))):
        ok, kind, confidence = getattr(analyzer, what)(F.col("description"))
        verdict = F.when(ok, F.struct(F.lit(rank).alias("analyzer"), kind.alias("kind"), F.round(confidence, 4).alias("confidence"))).otherwise(verdict)
    return candidates.withColumn("v", verdict).filter("v is not null").select("*", "v.*").drop("v")


# The head of a table of the Markdown report, and the form of its rows.
TABLE_HEAD = ("| Name | Type | Confidence | Description |", "|------|------|------------|-------------|")
TABLE_ROW = "| %s | %s | %.2f | %s |"


def markdown_lines(rows: DataFrame, title: str, order: str, none: str) -> DataFrame:
    """part, at, line: a Markdown section with a table of name, kind, confidence and description, a row for each line.

    Lines are in order by part (0 the head, 1 the table's rows, 2 the end) and then by ``at``, which is the row's ``order``.  No task holds more of a
    section than its share of rows; ``write_report`` keeps the order over files.
    """
    kind = rows.schema[order].dataType
    head = rows.agg(F.count("*").alias("n")).select(F.explode(F.array(F.format_string(f"## {title} (%d)", "n"), F.lit(""), *[F.when(F.col("n") > 0, x) for x in TABLE_HEAD], F.when(F.col("n") == 0, none))).alias("line"), F.monotonically_increasing_id().alias("k"))
    top = head.filter("line is not null").select(F.lit(0).alias("part"), F.lit(None).cast(kind).alias("at"), "line", "k")
    body = rows.select(F.lit(1).alias("part"), F.col(order).alias("at"), F.format_string(TABLE_ROW, "name", "kind", "confidence", "description").alias("line"), F.lit(0).cast("bigint").alias("k"))
    end = rows.sparkSession.range(1).select(F.lit(2).alias("part"), F.lit(None).cast(kind).alias("at"), F.lit("").alias("line"), F.col("id").alias("k"))
    return top.unionByName(body).unionByName(end)


def write_report(lines: DataFrame, path: str) -> None:
    """The lines as text files, whose names sort as the section reads."""
    order = ["part", "at", "k", "line"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("line").alias("value")).write.text(path)


def export_nodes(nodes: DataFrame, by: str, path: str) -> None:
    """A graph's nodes as JSON lines, in a folder for each value of ``by``; a value that most nodes have is split over files."""
    rest = [c for c in nodes.columns if c != by]
    nodes.select(by, F.to_json(F.struct(*rest)).alias("value")).hint("rebalance", by).write.partitionBy(by).text(path)

