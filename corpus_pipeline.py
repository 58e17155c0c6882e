"""A training corpus from ``documents``: toxic rows go, boilerplate lines go, one document of each group of near
duplicates stays, sources are mixed to target weights, and what is left is packed into sequences of ids."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainlake.llm.common import discard, materialise, table, unused, word_count
from grainlake.llm.jaccard import jaccard_components
from grainlake.llm.linededup import drop_boilerplate
from grainlake.llm.mixing import mix, walk_key
from grainlake.llm.packing import concatenate_and_cut
from grainlake.llm.toxicity import fit, score

#: Near duplicates: shingles of so many words, and at least this Jaccard.
WORDS, SIMILARITY = 5, Fraction(8, 10)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely clean than toxic, by a model of the labelled ones.

    Null and empty texts have no features and stay; so does every document where labels are missing or all alike. Rows
    that repeat an id are judged each by its text. No rows, no rows.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where(F.col("p_toxic") <= 0.5).select(*docs.columns)


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that over a tenth of their source's documents have, and three at least.

    Null texts stay null, and null sources are one source. Repeated rows count as documents each. No rows, no rows.
    """
    cut = drop_boilerplate(docs, F.col("source"))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def _alike(docs: DataFrame) -> Column:
    """A number for what a row holds, all columns; rows that are alike throughout share it."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows linked by five-word shingles, directly or over others, one; those without words all stay.

    The one with the smallest id stays; of rows that share it, or where none has an id, the one with the smallest
    number for its content, and of rows alike throughout one. A row is itself whatever its id: rows that repeat an id
    with different texts are different documents. No rows, no rows.
    """
    key, alike = unused(docs, "_key"), _alike(docs)
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), alike.alias("alike")).alias("key"), F.col("text"))
    found = materialise(jaccard_components(named, "key", words=WORDS, least=SIMILARITY), "near-duplicates")
    gone = found.where("doc_id <> component_id").select("doc_id.*").distinct()
    twice = found.where("doc_id = component_id and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id.*")
    gone, twice = (materialise(x.select(F.col("id").alias(f"{key}_id"), F.col("alike").alias(f"{key}_alike")), "near-duplicates-gone") for x in (gone, twice))
    discard(found)
    keyed = docs.withColumn(key, alike)
    same = F.col("doc_id").eqNullSafe(F.col(f"{key}_id")) & (F.col(key) == F.col(f"{key}_alike"))
    kept = keyed.join(gone, same, "left_anti")
    if not twice.isEmpty():
        once = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", key])
        kept = kept.join(twice, same, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, whole; the one at which the last walk ends counts if
    at least half of it is within.

    How far a source's last walk goes is one row a source, the last document taken; each row is held against it where
    it lies, so texts aren't shuffled. Null sources are one source. Rows without an id, and rows that repeat one, each
    count for themselves; rows alike throughout are taken alike. Documents without words are taken as often as their
    source is taken whole. No rows, no rows.
    """
    name = unused(docs, "_mix")
    alike, size = _alike(docs), word_count(F.col("text"))
    place = lambda id_, words, content: F.struct(walk_key(id_).alias("key"), id_.isNotNull().alias("named"), id_.alias("id"), words.alias("size"), content.alias("alike"))
    mixed = mix(docs, size, carry=alike)
    taken = (F.col("part") > 0) & (F.col("part") * 2 >= F.col("size"))
    last = F.max(F.when(taken, place(F.col("doc_id"), F.col("size"), F.col("carried"))))
    plan = mixed.groupBy("source").agg(F.max("whole").alias("whole"), last.alias("last"))
    plan = materialise(plan.select(F.col("source").alias(f"{name}_source"), F.col("whole").alias(f"{name}_whole"), F.col("last").alias(f"{name}_last")), "mixing-plan")
    placed = docs.withColumns({f"{name}_alike": alike, f"{name}_size": size})
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col(f"{name}_source")))
    own = place(F.col("doc_id"), F.col(f"{name}_size"), F.col(f"{name}_alike"))
    walked = F.coalesce((F.col(f"{name}_size") > 0) & (own <= F.col(f"{name}_last")), F.lit(False))
    copies = (F.col(f"{name}_whole") + walked.cast("long")).cast("int")
    return joined.withColumn(name, F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1,024 ids, a row a piece, with the piece's ids. Null and empty texts are the end id alone; rows that
    repeat an id are packed each by itself. No rows, no rows."""
    return concatenate_and_cut(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_site_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: Scores of a fitted model and ids of a tokenizer aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before kept."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
