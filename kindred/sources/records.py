"""Entity records from tables and delimited files.

A record has entity_id, source (1 to 3), ord (its place: source, then row), business_name, business_address, country.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("entity_id", "business_name", "business_address", "country")
RECORD = "entity_id string, business_name string, business_address string, country string"
#: Rows of one source at most, in ord.
SOURCE_STEP = 10**15


@dataclass(frozen=True)
class Settings:
    """threshold of a match, candidates of an entity, and rows of a blocking key that count."""

    threshold: float = 0.55
    max_candidates: int = 50
    bucket_cap: int = 200
    ngram_low: int = 2
    ngram_high: int = 3


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All strings, missing values as ''; white space and "NA" stay. A missing file raises FileNotFoundError.

    A record is a line, so a large file is read by many tasks.
    """
    reader = spark.read.option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    try:
        return reader.schema(schema).csv(path).na.fill("")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise


def with_order(df: DataFrame, source: int) -> DataFrame:
    """A file's rows in file order: ids that rise with the position, so no row has to be counted."""
    return df.withColumn("source", F.lit(source)).withColumn("ord", F.lit(source * SOURCE_STEP) + F.monotonically_increasing_id())


def load_sources(spark: SparkSession, split: str, data_dir: str) -> DataFrame:
    """Records of the three sources of "train" or "test"; data_dir is the data's folder or the split's own."""
    own = data_dir.rstrip("/").rsplit("/", 1)[-1] == split
    at = data_dir.rstrip("/") if own else f"{data_dir.rstrip('/')}/{split}"
    parts = [with_order(read_tsv(spark, f"{at}/{split}_source{k}.tsv", RECORD), k) for k in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def unique_records(records: DataFrame) -> DataFrame:
    """Of rows with one id the last."""
    w = Window.partitionBy("source", "entity_id").orderBy(F.desc("ord"))
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def truth_links(lists: DataFrame, s1: str = "source1_entity_id", ids: str = "matched_entity_ids") -> DataFrame:
    """(s1_id, target_id) of comma lists; blanks dropped, repeats once."""
    items = F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lists.select(F.trim(s1).alias("s1_id"), F.explode(items).alias("target_id")).distinct()


def load_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(links, entities): entities with an empty list are in the second only. Of repeated rows the last counts."""
    rows = read_tsv(spark, path, "source1_entity_id string, matched_entity_ids string").withColumn("_o", F.monotonically_increasing_id())
    last = rows.groupBy("source1_entity_id").agg(F.max_by("matched_entity_ids", "_o").alias("matched_entity_ids"))
    return truth_links(last), last.select(F.trim("source1_entity_id").alias("s1_id")).distinct()


def targets_of(records: DataFrame) -> DataFrame:
    return records.where("source > 1")


def entities_of(records: DataFrame) -> DataFrame:
    return records.where("source = 1")


def _padded(key: str) -> Column:
    """The key with zeros up to seven digits; lpad alone would cut longer ones."""
    digits = F.col(key).cast("string")
    return F.when(F.length(digits) < 7, F.lpad(digits, 7, "0")).otherwise(digits)


def _adapted(df: DataFrame, key: str, name, address, country, *more: Column) -> DataFrame:
    source = (F.col(key) % 3 + 1).cast("int")
    return df.select(
        F.concat(F.lit("S"), source, F.lit("-"), _padded(key)).alias("entity_id"), source.alias("source"),
        (source.cast("long") * SOURCE_STEP + F.col(key)).alias("ord"), *[F.coalesce(c, F.lit("")).alias(n) for c, n in ((name, "business_name"), (address, "business_address"), (country, "country"))], *more,
    )


def part_records(spark: SparkSession, sf_dir: str, with_known: bool = False) -> DataFrame:
    """Parts as businesses: the name, brand and size as address, the type as country; key % 3 tells the source.

    with_known: also known, null or what a source 1 part and another one must agree in to be a known link.
    """
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size", "p_type")
    known = F.when(F.col("p_name").isNotNull() & F.col("p_brand").isNotNull(), F.struct("p_name", "p_brand")).alias("known")
    return _adapted(df, "p_partkey", F.col("p_name"), F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")), F.col("p_type"), *([known] if with_known else []))


def part_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known links of the parts: one name and one brand, in any country."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand")
    ident = F.concat(F.lit("S"), (F.col("p_partkey") % 3 + 1).cast("int"), F.lit("-"), _padded("p_partkey"))
    one = df.where("p_partkey % 3 = 0").select("p_name", "p_brand", ident.alias("s1_id"))
    two = df.where("p_partkey % 3 <> 0").select("p_name", "p_brand", ident.alias("target_id"))
    return one.join(two, ["p_name", "p_brand"]).select("s1_id", "target_id")


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as businesses: the whole text as name, source and length as address, the language as country."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "n_chars", "lang")
    return _adapted(df, "doc_id", F.col("text"), F.concat_ws(" ", "source", F.col("n_chars").cast("string")), F.col("lang"))
