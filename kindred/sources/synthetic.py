"""Generated sources for tests: a fixed set of businesses, each written differently from source to source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUSINESSES = 25
#: Rewrites of a name and of an address; each record gets two at most, chosen by a hash of its id.
NAME_REWRITES = (("Corporation", "Corp"), ("Company", "Co"), ("Limited", "Ltd"), ("Incorporated", "Inc"), (" Inc", ""), (" & ", " and "), (" and ", " & "), ("Technologies", "Tech"), ("Services", "Svc"), ("International", "Intl"), ("Trading", "Trdg"), (" Ltd", ""), ("The ", ""))
ADDRESS_REWRITES = (("Street", "St"), ("Avenue", "Ave"), ("Road", "Rd"), ("Boulevard", "Blvd"), ("Drive", "Dr"), ("Suite", "Ste"), ("North", "N"), ("Floor", "Fl"))


def _rewritten(c: Column, rewrites, draw: Column) -> Column:
    """Up to two of the rewrites."""
    for turn in (1, 2):
        choice = F.pmod(F.xxhash64(draw, F.lit(turn)), F.lit(len(rewrites) * 2))
        done = c
        for i, (old, new) in enumerate(rewrites):
            done = F.when(choice == i, F.replace(c, F.lit(old), F.lit(new))).otherwise(done)
        c = done
    return F.trim(c)


def noisy_address(c: Column, draw: Column) -> Column:
    """Up to two rewrites, then in a quarter of cases the part before the first comma, in some the parts after it."""
    c = _rewritten(c, ADDRESS_REWRITES, draw)
    part = F.pmod(F.xxhash64(draw, F.lit("part")), F.lit(20))
    return F.when(part < 5, F.substring_index(c, ",", 1)).when((part < 8) & F.contains(c, F.lit(",")), F.trim(F.expr("substring(address, instr(address, ',') + 1)"))).otherwise(c)


def records(spark: SparkSession, sizes: tuple[int, int, int] = (40, 80, 60), seed: int = 0) -> DataFrame:
    """entity_id, source, ord, business_name, business_address, country and base, the number of the business."""
    kinds = F.array(*[F.lit(x) for x in ("Corporation", "Company Limited", "Technologies Incorporated", "Trading & Services Limited", "International Inc")])
    streets = F.array(*[F.lit(x) for x in ("Street", "Avenue", "Road", "Boulevard", "Drive")])
    countries = F.array(*[F.lit(x) for x in ("US", "India", "France")])
    heads = F.array(*[F.lit(x) for x in ("Blue Heron", "Granite Peak", "Café Lumière", "Silver Birch", "Northwind")])
    pick = lambda a, n: F.element_at(a, (F.pmod(F.col("base") + n * F.floor(F.col("base") / 5), F.size(a)) + 1).cast("int"))
    parts = []
    for k, n in enumerate(sizes, 1):
        df = spark.range(n).withColumn("base", F.pmod("id", F.lit(BUSINESSES))).withColumn("source", F.lit(k)).withColumn("ord", F.lit(k * 10**15) + F.col("id"))
        df = df.withColumn("entity_id", F.concat(F.lit(f"S{k}-"), F.lpad((F.col("id") + 1).cast("string"), 5, "0")))
        parts.append(df)
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    draw = F.xxhash64("entity_id", F.lit(seed))
    name = F.concat_ws(" ", pick(heads, 0), F.concat(F.lit("No"), F.col("base")), pick(kinds, 1))
    address = F.concat(F.col("base") * 7 + 12, F.lit(" Harbor"), F.col("base"), F.lit(" "), pick(streets, 1), F.lit(", Suite "), F.col("base"), F.lit(", Port Town"))
    df = df.withColumn("address", address)
    return df.select("entity_id", "source", "ord", _rewritten(name, NAME_REWRITES, draw).alias("business_name"), noisy_address(F.col("address"), draw).alias("business_address"), pick(countries, 0).alias("country"), "base")


def truth(made: DataFrame) -> DataFrame:
    """(s1_id, target_id): records of one business."""
    one = made.where("source = 1").select(F.col("entity_id").alias("s1_id"), "base")
    return one.join(made.where("source > 1").select(F.col("entity_id").alias("target_id"), "base"), "base").select("s1_id", "target_id")
