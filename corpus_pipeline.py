"""A training corpus in four stages: quality rules, near-duplicates, mixing, token digests.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; between
stages the rows are written as Parquet to the shared folder and read again. All stages but the last
return the columns of documents; further columns, whatever their names, are dropped. Every stage takes
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm.bpe import public_vocabulary, token_digests
from chatlake.llm.common import joined, materialise, read
from chatlake.llm.minhash import near_duplicates
from chatlake.llm.mixture import mix
from chatlake.llm.quality import judge

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _content() -> Column:
    """A hash of a row's content, nulls told from empty texts."""
    return F.xxhash64(*COLUMNS[1:], *(F.col(c).isNull() for c in COLUMNS[1:]))


def _same(a: str, b: str):
    """Rows meet by id and content, so null and repeated ids keep their own decisions."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._key") == F.col(f"{b}._key"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's and source's cloud go.

    So null, empty and blank texts go; null languages and sources are groups of their own; equal rows
    share their fate; texts of any length are read whole.
    """
    keyed = docs.withColumn("_key", _content())
    rejected = judge(keyed, ["doc_id", "_key"]).where(~F.col("kept")).select("doc_id", "_key")
    return keyed.alias("d").join(rejected.alias("r"), _same("d", "r"), "left_anti").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8), the row of the smallest id stays.

    Nulls last, and of equal ids the smallest content hash, so reruns agree; a row that occurs more
    than once counts once, and an id with several texts is judged text by text. Null, empty and blank
    texts belong to no group and all stay.
    """
    keyed = docs.withColumn("_key", _content())
    judged = near_duplicates(keyed, size=5, percent=80, keys=("_key",)).where("group is not null")
    rows = materialise(judged.groupBy("group", "doc_id", "_key").agg(F.count("*").alias("n")), "near-groups")
    own = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_key")
    heads = rows.groupBy("group").agg(F.min(own).alias("head"))
    decided = joined(rows, heads, "group").select("doc_id", "_key", F.when(~own.eqNullSafe(F.col("head")), 0).otherwise(F.least("n", F.lit(2))).alias("stay"))
    found = keyed.alias("d").join(decided.alias("g"), _same("d", "g"), "left").select(*(f"d.{c}" for c in COLUMNS), "stay")
    return found.where("stay is null or stay = 1").select(*COLUMNS).union(found.where("stay = 2").select(*COLUMNS).dropDuplicates())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it leaves out go.

    The null source is a source. Null, empty and blank texts count no words and are taken once. Rows
    that are equal in id and content are taken as often as the most taken of them.
    """
    keyed = docs.withColumn("_key", _content())
    taken = mix(keyed, keys=("doc_id", "_key")).where("copies > 0").groupBy("doc_id", "_key").agg(F.max("copies").alias("copies"))
    return keyed.alias("d").join(taken.alias("t"), _same("d", "t")).select(*(f"d.{c}" for c in COLUMNS), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("col")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token digests of each row of the mix; a null text is the empty text, and rows may repeat."""
    return token_digests(docs, public_vocabulary("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("near-duplicates", near_dedup), ("mixing", mixing), ("bpe", tokens)]

#: BPE merges can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
