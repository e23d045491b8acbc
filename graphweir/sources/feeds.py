"""Scanner output, vulnerability feeds, graph payloads, configuration: JSON and XML with schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweir.functions.text import mapped, valid_cve

# Schemas of scanner output and their severity and confidence words.
BANDIT = "struct<results:array<struct<test_id:string,issue_text:string,filename:string,line_number:int,issue_severity:string,issue_confidence:string,more_info:string>>>"
SEMGREP = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<message:string,severity:string,metadata:struct<fix:string>>>>>"
TRUFFLEHOG = "struct<DetectorType:string,SourceName:string,SourceMetadata:struct<Data:struct<LineNumber:int>>>"
BANDIT_SEVERITY = {"HIGH": "high", "MEDIUM": "medium", "LOW": "low"}
BANDIT_CONFIDENCE = {"HIGH": "0.9", "MEDIUM": "0.7", "LOW": "0.4"}
SEMGREP_SEVERITY = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}
NO_GUIDANCE = "No remediation guidance provided"
SECRET_GUIDANCE = "Remove the secret and rotate credentials immediately. Store secrets in a secure vault or environment variables."
NVD = "struct<id:string,descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double,baseSeverity:string>>>,cvssMetricV2:array<struct<cvssData:struct<baseScore:double>,baseSeverity:string>>>,weaknesses:array<struct<description:array<struct<value:string>>>>,references:array<struct<url:string>>,configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>>"
GRAPH = "struct<nodes:array<struct<id:string,label:string,type:string,properties:map<string,string>>>,links:array<struct<source:string,target:string,type:string>>>"


def findings(raw: DataFrame, tool: str, column: str = "json") -> DataFrame:
    """One schema for the findings of all tools; lines that do not parse are dropped."""
    def row(rule, message, path, line, severity, confidence, remediation):
        return [
            F.lit(tool).alias("tool"), F.coalesce(rule, F.lit("Unknown")).alias("rule"), F.coalesce(message, F.lit("Unknown issue")).alias("message"), F.coalesce(path, F.lit("")).alias("path"),
            F.coalesce(line, F.lit(0)).alias("line"), severity.alias("severity"), confidence.alias("confidence"), F.coalesce(remediation, F.lit(NO_GUIDANCE)).alias("remediation"),
        ]

    if tool == "bandit":
        r = raw.select(F.explode(F.from_json(column, BANDIT)["results"]).alias("r"))
        confidence = mapped(F.col("r.issue_confidence"), BANDIT_CONFIDENCE, "0.5").cast("double")
        return r.select(row(F.col("r.test_id"), F.col("r.issue_text"), F.col("r.filename"), F.col("r.line_number"), mapped(F.col("r.issue_severity"), BANDIT_SEVERITY, "medium"), confidence, F.col("r.more_info")))
    if tool == "semgrep":
        r = raw.select(F.explode(F.from_json(column, SEMGREP)["results"]).alias("r"))
        return r.select(row(F.col("r.check_id"), F.col("r.extra.message"), F.col("r.path"), F.col("r.start.line"), mapped(F.col("r.extra.severity"), SEMGREP_SEVERITY, "medium"), F.lit(0.8), F.col("r.extra.metadata.fix")))
    if tool == "trufflehog":
        r = raw.select(F.from_json(column, TRUFFLEHOG).alias("r")).filter("r.DetectorType is not null or r.SourceName is not null")
        message = F.concat(F.lit("Found potential "), F.coalesce("r.DetectorType", F.lit("secret")), F.lit(" in "), F.coalesce("r.SourceName", F.lit("file")))
        return r.select(row(F.lit("Secret Detection"), message, F.col("r.SourceName"), F.col("r.SourceMetadata.Data.LineNumber"), F.lit("high"), F.lit(0.9), F.lit(SECRET_GUIDANCE)))
    raise ValueError(f"no parser is registered for {tool}")


def cves(raw: DataFrame, column: str = "json") -> DataFrame:
    """Flat CVE records: version 3 metrics, else version 2; weaknesses that are CWE ids; CPE criteria."""
    c = raw.select(F.from_json(column, NVD).alias("c")).filter(valid_cve(F.col("c.id")))
    v3, v2 = F.try_element_at("c.metrics.cvssMetricV31", F.lit(1)), F.try_element_at("c.metrics.cvssMetricV2", F.lit(1))
    english = F.try_element_at(F.filter("c.descriptions", lambda d: d["lang"] == "en"), F.lit(1))["value"]
    weak = F.flatten(F.transform("c.weaknesses", lambda w: F.transform(w["description"], lambda d: d["value"])))
    cpe = F.flatten(F.transform("c.configurations", lambda g: F.flatten(F.transform(g["nodes"], lambda n: F.transform(n["cpeMatch"], lambda m: m["criteria"])))))
    none = F.array().cast("array<string>")
    return c.select(
        F.col("c.id").alias("cve_id"),
        english.alias("description"),
        F.lower(F.coalesce(v3["cvssData"]["baseSeverity"], v2["baseSeverity"])).alias("severity"),
        F.coalesce(v3["cvssData"]["baseScore"], v2["cvssData"]["baseScore"]).alias("cvss_score"),
        F.coalesce(F.array_distinct(F.filter(weak, lambda w: F.startswith(w, F.lit("CWE-")))), none).alias("cwe_ids"),
        F.coalesce(F.transform("c.references", lambda r: r["url"]), none).alias("references"),
        F.coalesce(cpe, none).alias("vulnerable_configurations"),
    )


def graph_payload(raw: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """Node and link frames of {nodes, links} documents."""
    g = raw.select(F.from_json(column, GRAPH).alias("g"))
    return g.select(F.explode("g.nodes").alias("n")).select("n.*"), g.select(F.explode("g.links").alias("l")).select("l.*")


def weaknesses_xml(raw: DataFrame, column: str = "xml") -> DataFrame:
    """cwe_id, name, description of Weakness elements."""
    w = raw.select(F.from_xml(F.col(column), "_ID string, _Name string, Description string").alias("w"))
    return w.select(F.concat(F.lit("CWE-"), "w._ID").alias("cwe_id"), F.col("w._Name").alias("name"), F.col("w.Description").alias("description"))


def weaknesses_zip(archives: DataFrame, column: str = "content") -> DataFrame:
    """cwe_id, name, description of the Weakness elements in the XML files of zip archives; archives that are broken are dropped."""

    def run(frames):
        import io
        import zipfile

        import pandas as pd

        for frame in frames:
            for content in frame[column]:
                if content is None or not zipfile.is_zipfile(io.BytesIO(content)):
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(".xml")):
                        yield pd.DataFrame({"xml": [z.read(name).decode("utf-8", "replace")]})

    each = F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<Weakness\s.*?</Weakness>"), F.lit(0)))
    return weaknesses_xml(archives.select(column).mapInPandas(run, "xml string").select(each.alias("xml")))


def fetched_cves(ids: DataFrame, records: DataFrame, id_col: str, column: str = "json") -> DataFrame:
    """The record of each well-formed id (null fields where there is none); ids that are not well-formed are not looked up."""
    return ids.filter(valid_cve(F.col(id_col))).join(cves(records, column).withColumnRenamed("cve_id", id_col), id_col, "left")


def merged_config(settings: DataFrame) -> DataFrame:
    """Of (key, value, priority) the value with the highest priority; empty values do not count."""
    best = F.min(F.struct((-F.col("priority")).alias("order"), "value", "priority")).alias("m")
    return settings.filter("value is not null and value <> ''").groupBy("key").agg(best).select("key", "m.value", "m.priority")


def repository(spark: SparkSession, root: str, url: str | None = None) -> DataFrame:
    """Statistics of a checked-out repository: files, bytes and main language."""
    from graphweir.sources.files import file_tree

    files = file_tree(spark, root)
    top = files.groupBy("language").agg(F.count("*").alias("n")).agg(F.max_by("language", F.struct("n", "language")).alias("main_language"))
    return files.agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes")).join(top).withColumn("url", F.lit(url))


def clone(url: str, target: str, branch: str | None = None, timeout: int = 600) -> str:
    """Clones with git on the driver and returns the commit; ``url`` may be a local path."""
    import subprocess

    if not url or url.startswith("-"):
        raise ValueError(f"not a repository: {url!r}")
    branch_args = ["--branch", branch] if branch else []
    subprocess.run(["git", "clone", "--quiet", "--depth", "1", *branch_args, "--", url, target], check=True, timeout=timeout)
    return subprocess.run(["git", "-C", target, "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()
