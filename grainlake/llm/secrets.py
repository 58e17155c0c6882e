"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by its content. The ledger holds which (blob, rule, rule version) have been
scanned and what was found; a run scans only pairs that it has not seen, one copy of each blob, and joins the
findings back to all paths that hold it.

A run writes its findings first and then what it has seen. One that ends in between is repeated by the next, which
finds the same and writes it again; findings are read as a set, so they count once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise


@dataclass(frozen=True)
class Rule:
    """A pattern, and the least code points of its group (0: the match) for a match to count.

    ``scanned`` is what is looked for in texts, where that can leave out short matches without moving any other.
    """

    kind: str
    pattern: str
    group: int
    least: int
    scanned: str | None = None
    version: int = 1


# The patterns and least lengths that the contract states.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
)


#: What Spark says of a folder that isn't there, and of one without a finished file.
_NOTHING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A part of the ledger; none where nothing has been written yet. Any other fault is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() not in _NOTHING:
            raise
        return None


def _gaps(rule: Rule, wanted: Column) -> Column:
    """An array of (kind, number, code points before the match since the last one, in it, in its group)."""
    pattern = rule.scanned or rule.pattern
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    between = F.split("text", pattern, -1)
    one = lambda m, k: F.struct(F.lit(rule.kind).alias("kind"), k.alias("number"), F.length(F.get(between, k)).alias("gap"), F.length(m).alias("size"), F.length(F.regexp_extract(m, pattern, rule.group)).alias("counted"))
    return F.when(wanted, F.transform(found, one))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, kind, start, stop`` of every match in ``blobs(blob, text, unseen)``, an array of the kinds to look for.

    A match's start is the sum of what lies before it, so texts are read whole and matches are rows, any number of them.
    """
    gaps = [F.coalesce(_gaps(r, F.array_contains("unseen", r.kind)), F.array().cast(_GAPS)) for r in rules]
    # Rows that repeat a path and its text give a blob's matches more than once.
    rows = blobs.select("blob", F.explode(F.concat(*gaps)).alias("m")).select("blob", "m.*").distinct()
    upto = Window.partitionBy("blob", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap") + F.col("size")).over(upto)
    placed = rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size"))
    enough = F.lit(False)
    for rule in rules:
        enough = enough | ((F.col("kind") == rule.kind) & (F.col("counted") >= rule.least))
    return placed.where(enough).select("blob", "kind", "start", "stop")


_GAPS = "array<struct<kind:string,number:int,gap:int,size:int,counted:int>>"


def scan_versions(df: DataFrame, ledger: str, path_col: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``path, blob, spans``: every row of ``df``, a version of a path, with all that the rules find in its text.

    ``spans`` is an array of (start, rank of the rule, kind, stop) in that order, in code points, the stop excluded;
    empty where nothing was found. ``ledger`` is a folder that later runs use again: ``seen`` has the pairs scanned,
    ``found`` the findings, ``blob`` the SHA-256 of the text in UTF-8.

    A null text is the empty blob. Null and repeated paths keep a row each. No rows, no rows, and nothing is
    appended. Other columns are ignored, whatever their names. Copies are scanned once; the join back is on the
    blob, whose hot keys adaptive execution splits.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(path_col).alias("path"), text.alias("text")).withColumn("blob", F.unhex(F.sha2(F.col("text"), 256)))
    versions = materialise(rows.select("path", "blob"), "versions")
    wanted = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    reps = versions.groupBy("blob").agg(F.min("path").alias("path"))
    if (seen := _read(spark, f"{ledger}/seen")) is None:
        todo = reps.withColumn("unseen", F.array(*(F.lit(r.kind) for r in rules)))
    else:
        pairs = reps.select("blob", "path", F.explode(wanted).alias("rule")).select("blob", "path", "rule.*")
        todo = pairs.join(seen, ["blob", "kind", "version"], "left_anti").groupBy("blob", "path").agg(F.collect_list("kind").alias("unseen"))
    todo = materialise(todo, "unseen-blobs")
    # The few bytes of the right side are hashed; texts are dealt out by path and blob, and never sorted.
    right = todo.select(F.col("path").alias("_path"), F.col("blob").alias("_blob"), "unseen").hint("shuffle_hash")
    blobs = rows.join(right, F.col("path").eqNullSafe(F.col("_path")) & (F.col("blob") == F.col("_blob"))).select("blob", "text", "unseen")
    version = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.version)))
    scan(blobs, rules).withColumn("version", version[F.col("kind")]).write.mode("append").parquet(f"{ledger}/found")
    todo.select("blob", F.explode("unseen").alias("kind")).withColumn("version", version[F.col("kind")]).write.mode("append").parquet(f"{ledger}/seen")
    rank = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)))
    current = spark.read.parquet(f"{ledger}/found").where(F.col("version") == version[F.col("kind")])
    one = F.struct("start", rank[F.col("kind")].alias("rank"), "kind", "stop")
    # A table, as only a side that comes straight from its exchange lets the rows of a hot blob be split.
    by_blob = materialise(current.groupBy("blob").agg(F.array_sort(F.collect_set(one)).alias("spans")), "findings")
    none = F.array().cast(by_blob.schema["spans"].dataType)
    return versions.join(by_blob, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))
