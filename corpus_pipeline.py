"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it has kept, and returns a DataFrame
that is written as Parquet and read again. All but the last return the columns of ``documents``; further columns of
their input, whatever their names, are left out. Nulls may be in any column, texts may be of any length, ids and whole rows may repeat,
and an empty table gives an empty table; what each stage makes of them stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm import langid, mixing, packing, pii, simhash
from furrow.llm.common import documents, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a margin, and sets lang to it; null texts, texts without
    letters and narrow margins go. Repeated rows fare alike."""
    found = langid.identified(docs.select(*COLUMNS), langid.train(docs), COLUMNS)
    return found.where("accepted").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the smallest doc_id (null last), then the smallest hash of the text, and of
    rows that agree in both the first by the other columns."""
    named = [F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash")]
    kept = simhash.near_duplicates(docs).select("root", F.struct(*named).alias("of")).groupBy("root").agg(F.min("of").alias("of")).select("of.*")
    keyed = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    keyed = keyed.select(*COLUMNS, *named)
    # The join and the choice among repeated rows share one exchange of the texts.
    keys = ["unnamed", "id", "text_hash"]
    rows = keyed.join(kept, keys, "left_semi")
    return rows.groupBy(*keys).agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind, in every row; null texts stay null (n_chars is then null, too)."""
    return pii.masked(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does; those that it doesn't take go. Documents of one id are told apart by their
    texts; rows that agree in id, text and source share what the mix takes of them evenly, in the order of their other columns."""
    keys = [F.col("doc_id").isNull().alias("unnamed"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("text_hash"), F.coalesce("source", F.lit("")).alias("of"), F.col("source").isNull().alias("nowhere")]
    names = ["unnamed", "id", "text_hash", "of", "nowhere"]
    taken = mixing.mixed(docs).select(*keys, "copies").groupBy(*names).agg(F.sum("copies").alias("all_copies"), F.count(F.lit(1)).alias("rows"))
    taken = written(taken.where("all_copies > 0"), "taken")
    keyed = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    keyed = keyed.select(*COLUMNS, *keys).join(taken, names)
    # The join's exchange serves the window, too.
    nth = F.row_number().over(Window.partitionBy(*names).orderBy("lang", "n_chars")) - 1
    copies = F.floor((F.col("all_copies") + F.col("rows") - 1 - nth) / F.col("rows")).cast("int")
    out = keyed.withColumn("copies", copies).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of every document: its place in a sequence. Repeated rows are packed apart; null and empty
    texts have one piece of length zero."""
    return packing.packed(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("PII", private),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: SQL has no compression classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "".join(c for c in name if c.isalnum()))
    return STAGES[-1][1](spark, docs, sf_dir)
