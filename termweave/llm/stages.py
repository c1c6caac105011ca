"""The corpus pipeline's stages: documents to packed sequences, each over all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import mixing, neardup, packing, quality, secrets
from termweave.llm.common import discard, free_name, passing, read, small, stored

#: Documents with a lower score go.
LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labelled documents that aren't held out and drops those that score below LEAST_QUALITY.

    Null and empty texts have the score of a text without features; very long ones are read whole. Repeated rows score
    alike and stay or go together; rows with a null id are scored like others, but not learned from. Other columns
    stay as they are, whatever their names. Without labels all stay; an empty table gives an empty one.
    """
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    score = free_name("_quality", docs)
    return quality.with_score(docs, model, column=score).where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the row of least id stays.

    Rows are told apart by id and set of shingles: an id on several rows is decided for each of its texts, and of rows
    with the same id and set one stays, that of the least text. Null ids come last; of a group without ids one row stays.
    Null and blank texts are near nothing and stay, but for repeated rows, of which one does. Very long texts are read
    whole. Other columns stay as they are; an empty table gives an empty one.
    """
    classes = neardup.near_duplicates(docs, with_sets=True)
    # The set that leads a component, of the least id: one row of it stays.
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.coalesce("leads", F.lit(True))
    rows = classes.select("doc_id", "set", first.alias("stays")).groupBy("doc_id", "set")
    rows = stored(rows.agg(F.max("stays").alias("stays"), F.count("*").alias("n")))
    # Ids that are on one row, which goes; ids that are on several rows, and null: few, as a rule.
    by_id = rows.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("stays").alias("stays"))
    gone = small(stored(by_id.where("n = 1 and not stays and doc_id is not null").select("doc_id")))
    key, name, order = (free_name(c, docs) for c in ("_several", "_set", "_order"))
    several = stored(by_id.where("n > 1 or doc_id is null").select(F.col("doc_id").alias(key)))
    on_several = F.col("doc_id").eqNullSafe(F.col(key))
    alone = docs.join(gone, "doc_id", "left_anti").join(small(several), on_several, "left_anti").select(*docs.columns)
    if not several.take(1):
        return alone
    among = neardup.with_set(docs.join(small(several), on_several, "left_semi"), name)
    stay_id, stay_set = free_name("_stay_id", among), free_name("_stay_set", among)
    stay = rows.where("stays").select(F.col("doc_id").alias(stay_id), F.col("set").alias(stay_set))
    among = among.join(stay, F.col("doc_id").eqNullSafe(F.col(stay_id)) & F.col(name).eqNullSafe(F.col(stay_set)), "left_semi")
    least = F.struct(F.md5(F.coalesce(F.col("text"), F.lit(""))), F.xxhash64(*docs.columns))
    one = among.groupBy("doc_id", name).agg(F.min_by(F.struct(*docs.columns), least).alias(order))
    return alone.unionByName(one.select(f"{order}.*").select(*docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of every secret; n_chars follows the text, if there is such a column.

    Null texts stay null; empty and very long ones are scanned whole; repeated rows are alike. Other columns stay as they
    are, whatever their names; an empty table gives an empty one.
    """
    spans = free_name("secret_spans", docs)
    found = secrets.scan(docs, column=spans)
    hidden = free_name("hidden_text", found)
    found = found.withColumn(hidden, secrets.redacted(F.col("text"), F.col(spans)))
    changed = {"text": F.col(hidden)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size(spans) > 0, F.length(hidden).cast("long")).otherwise(F.col("n_chars"))
    return found.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one at a source's cut if at least half of it is taken.

    Null and blank texts weigh nothing and come as often as their source is taken whole. A null source is a source of its
    own. Rows at one place of the seeded order (repeated rows) share its words evenly; very long texts are taken whole or
    not at all. Other columns stay as they are, whatever their names; an empty table gives an empty one.
    """
    return mixing.copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 ids; copies of a document are packed each.

    Null and empty texts yield the end id alone; very long ones are cut every 1024 ids. Other columns aren't looked at; an
    empty table gives an empty one.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL expresses neither the classifier nor the tokenizer; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. Each one's result is a table, which is deleted once the next one's is there."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with passing(spark) as keep:
            docs = keep(stored(stage(spark, docs, sf_dir)))
        if before is not None:
            discard(before)
        before = docs
    packed = STAGES[-1][1](spark, docs, sf_dir)
    # Packing has its pieces in a table of their own.
    discard(docs)
    return packed
