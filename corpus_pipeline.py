"""A corpus pipeline of five stages over ``documents``: toxicity, line deduplication, near duplicates, benchmark decontamination,
byte-level BPE.

Each stage is f(spark, docs, sf_dir) -> DataFrame and gets all rows that the stage before kept. ``run`` writes each stage's result as Parquet to the
shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import toxicity
from rasterloom.llm.bpe import encode
from rasterloom.llm.common import columns, fresh, materialise, small, table
from rasterloom.llm.decontaminate import decontaminate
from rasterloom.llm.jaccard import link_components
from rasterloom.llm.linedup import dedupe_lines
from rasterloom.llm.queries import TOKENIZER_FILE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below 0.5, row by row: repeated rows share their fate, null and empty texts are kept, long ones
    scored whole. An empty table gives no rows. All columns are kept, whatever their names."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    name = fresh("score", docs.columns)
    return toxicity.score(docs, model, keep=tuple(docs.columns), name=name).where(F.col(name) < 0.5).select(*columns(docs.columns))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate lines; n_chars follows. Documents of which nothing is left go; those that had no text
    before stay. Repeated rows are treated alike; see ``dedupe_lines`` for null ids and sites. An empty table gives no rows."""
    out = dedupe_lines(docs)
    removed = F.col(out.columns[-1])
    left = out.where((removed == 0) | (F.trim(F.translate("text", "\n", " ")) != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(removed > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*columns(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents: that with the smallest id. Rows with a null id are kept; of rows that
    repeat an id, one stays: that with the least hash of its text, then the shorter text, then the smaller row, written out as JSON. Null and empty texts are like nothing, so they stay. An empty table gives no rows."""
    groups = materialise(link_components(docs).groupBy("id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("n")), "components")
    gone = groups.where("c <> id").select(F.col("id").alias("doc_id"))
    left = docs.join(small(gone), "doc_id", "left_anti")
    again = groups.where("c = id and n > 1").select(F.col("id").alias("doc_id"))
    if again.limit(1).count():
        left = left.join(small(again), "doc_id", "left_anti").union(_one_a_doc(left.join(small(again), "doc_id", "left_semi")))
    return left.select(*columns(docs.columns))


def _one_a_doc(docs: DataFrame) -> DataFrame:
    row = F.struct(*columns(docs.columns))
    least = F.min_by(row, F.struct(F.xxhash64("text"), F.length("text"), F.col("text"), F.to_json(row)))
    return docs.groupBy("doc_id").agg(least.alias("_row")).select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Rows that share an id go together; rows without an id are judged by their texts. Null and
    empty texts stay; an empty table gives no rows."""
    hit = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("doc_id").distinct()
    hit = materialise(hit, "contaminated")
    nulls = hit.where("doc_id is null").limit(1).count() > 0
    left = docs.join(small(hit.where("doc_id is not null")), "doc_id", "left_anti")
    if nulls:  # rows without an id can't be named: they are looked at by text
        some = docs.where("doc_id is null").withColumn("doc_id", F.xxhash64("text"))
        bad = decontaminate(some, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("doc_id").distinct()
        left = left.where("doc_id is not null").union(some.join(small(bad), "doc_id", "left_anti").select(*columns(docs.columns)).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    return left.select(*columns(docs.columns))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document row, with digests of the ids and of the text decoded from them. Null texts count as empty and have no
    ids; repeated rows and null ids pass through; long texts are encoded whole. Of the other columns only lang and source are kept."""
    return encode(docs, TOKENIZER_FILE, keep=("doc_id", "lang", "source"), outputs=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", tokenise),
]
#: SQL can't express the learned scores and the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
