"""Duplicates hidden by formatting differences (problem 3).

The canonical form keeps letters and digits of any script without case. File
sections of a diff and the fields of a description are put in sorted order. The
record's key is the SHA-256 of both forms. Keys that hold more than 1/HOT_KEYS of
all rows are found exactly from partial counts and aggregated in two levels over
SALTS; all others take one shuffle. The representative is the smallest id.

Nulls and edge cases: null and blank texts are equal; a null id is no record; a
redelivered id counts once, as it was loaded first; records without any text are one class; a broken
JSON description is plain text; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewake.session import cut, spread

HOT_KEYS = 512
MIN_HOT = 1000
SALTS = 32
LABEL = r"(?U)^\s*\p{L}[\p{L}\p{N}_ ./()-]{0,40}\s*[:：]"


def folded(c: Column) -> Column:
    """Without case; the letters whose lower forms differ though their upper forms agree are joined."""
    return F.replace(F.translate(F.lower(c), "ſς", "sσ"), F.lit("ß"), F.lit("ss"))


def bare(c: Column) -> Column:
    """Letters and digits only, of text already folded."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")


def canonical_diff(c: Column) -> Column:
    parts = F.split(folded(F.coalesce(c, F.lit(""))), r"(?m)^(?=diff --git)")
    is_file = lambda p: p.startswith("diff --git")
    head = F.array_join(F.transform(F.filter(parts, lambda p: ~is_file(p)), bare), "")
    return F.concat(head, F.array_join(F.array_sort(F.transform(F.filter(parts, is_file), bare)), ""))


def canonical_description(c: Column) -> Column:
    text = folded(F.coalesce(c, F.lit("")))
    pairs = F.map_entries(F.from_json(F.when(c.rlike(r"^\s*\{[\s\S]*\}\s*$"), c), "map<string,string>"))
    from_object = F.array_join(F.array_sort(F.transform(pairs, lambda e: bare(folded(F.concat(e["key"], F.coalesce(e["value"], F.lit(""))))))), "")
    fields = F.filter(F.split(text, "[;；|｜\r\n]+"), lambda p: p.rlike(r"(?U)\S"))
    has_fields = (F.size(fields) > 1) & F.forall(fields, lambda p: p.rlike(LABEL))
    from_fields = F.array_join(F.array_sort(F.transform(fields, bare)), "")
    return F.when(F.size(pairs) > 0, from_object).when(has_fields, from_fields).otherwise(bare(text))


def keyed_records(df: DataFrame, id_col: str = "id", diff: str = "input_diff", desc: str = "input_desc", loaded: str = "loaded_at") -> DataFrame:
    """id and key of the delivery loaded first, one row per id; only the digest is shuffled."""
    key = F.unhex(F.sha2(F.concat(canonical_diff(F.col(diff)), F.lit("\u0000"), canonical_description(F.col(desc))), 256))
    texts = spread(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), diff, desc, F.coalesce(F.col(loaded), F.lit("9999-12-31").cast("timestamp")).alias("at")))
    return texts.select("id", F.struct("at", key.alias("key")).alias("first")).groupBy("id").agg(F.min("first").alias("first")).select("id", F.col("first.key").alias("key"))


def classes(records: DataFrame) -> DataFrame:
    """key, record_id, copies, hot for every class of equal records.

    One shuffle of partial counts and minima gives all keys that aren't hot; the hot
    ones, at most HOT_KEYS by their share, go through two levels over SALTS.
    """
    counts = cut(records.groupBy("key").agg(F.min("id").alias("record_id"), F.count(F.lit(1)).alias("copies")))
    total = counts.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") > max(total // HOT_KEYS, MIN_HOT)
    rest = counts.where(~is_hot).withColumn("hot", F.lit(False))
    hot = counts.where(is_hot).select("key")
    if hot.isEmpty():
        return rest
    level1 = (
        records.join(F.broadcast(hot), "key", "left_semi")
        .groupBy("key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
        .agg(F.min("id").alias("record_id"), F.count(F.lit(1)).alias("copies"))
    )
    level2 = level1.groupBy("key").agg(F.min("record_id").alias("record_id"), F.sum("copies").alias("copies")).withColumn("hot", F.lit(True))
    return rest.unionByName(level2)


def distinct_records(df: DataFrame) -> DataFrame:
    """record_id (the smallest id) and copies of each distinct record."""
    return classes(cut(keyed_records(df))).select("record_id", "copies")


def membership(df: DataFrame) -> DataFrame:
    """id, record_id for every id of a class with copies; hot classes are salted."""
    records = cut(keyed_records(df))
    many = classes(records).where("copies > 1")
    many = many.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    return records.join(many, (records["key"] == many["key"]) & ((many["salt"] == -1) | (many["salt"] == salt))).select(records["id"], "record_id", "hot")


def same_pairs(df: DataFrame) -> DataFrame:
    """id_a < id_b of the same record, from the membership of each class."""
    m = membership(df)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0)
    spread = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    a = m.select(F.col("record_id"), F.col("id").alias("id_a"), salt.alias("salt"))
    b = m.select(F.col("record_id"), F.col("id").alias("id_b"), spread.alias("salt"))
    return a.join(b, ["record_id", "salt"]).where("id_a < id_b").select("id_a", "id_b")
