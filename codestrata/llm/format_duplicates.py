"""Duplicates hidden by formatting differences, skew-aware."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: At most this many canonical keys can be hot, since each holds more than its share of all rows.
MAX_HOT = 1000
SALTS = 64


def letters_and_digits(c: Column) -> Column:
    """A text reduced to its letters and digits, without case; null stays null."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def canonical_fields(c: Column) -> Column:
    """`field=value; field=value` in one spelling and order. Empty parts are no fields; null stays null, which an empty list differs from."""
    parts = F.filter(F.split(c, ";"), lambda p: F.length(letters_and_digits(p)) > 0)
    norm = F.transform(parts, lambda p: F.concat(letters_and_digits(F.substring_index(p, "=", 1)), F.lit("="), letters_and_digits(F.regexp_replace(p, "^[^=]*=?", ""))))
    return F.array_join(F.array_sort(norm), ";")


def canonical_key(*cols: Column) -> Column:
    """A digest of columns in which null differs from every text."""
    return F.unhex(F.md5(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in cols])))


def collapse(rows: DataFrame, key: Column, identifier: str = "id") -> DataFrame:
    """(id, keep_id, n_rows, n_ids) per distinct (key, id): the group's least id as text, its rows and its different ids.

    Hot keys (over 1/MAX_HOT of all rows) are found exactly from partial counts; they are aggregated on two levels over salts of
    the id and their results, at most MAX_HOT rows, sent to all; the other keys are shuffled once. Null identifiers form no copies.
    """
    d = rows.select(key.alias("k"), F.col(identifier).alias("id")).where("id is not null")
    n = rows.count()
    counts = d.groupBy("k").agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") >= max(1000, -(-n // MAX_HOT) + 1)).select("k", F.lit(True).alias("hot"))
    d = d.join(F.broadcast(hot), "k", "left")
    cold = d.where("hot is null").repartition(F.col("k")).groupBy("k", "id").agg(F.count("*").alias("m"))
    w = W.partitionBy("k")
    cold = cold.select("id", F.min("id").over(w).alias("keep_id"), F.sum("m").over(w).alias("n_rows"), F.count("*").over(w).alias("n_ids"))
    one = d.where("hot").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).groupBy("k", "salt", "id").agg(F.count("*").alias("m"))
    per_salt = one.groupBy("k", "salt").agg(F.min("id").alias("lo"), F.sum("m").alias("n"), F.count("*").alias("c"))
    per_key = per_salt.groupBy("k").agg(F.min("lo").alias("keep_id"), F.sum("n").alias("n_rows"), F.sum("c").alias("n_ids"))
    hot_rows = one.join(F.broadcast(per_key), "k").select("id", "keep_id", "n_rows", "n_ids")
    return cold.unionByName(hot_rows)


def entity_key() -> Column:
    return canonical_key(letters_and_digits(F.col("name")), letters_and_digits(F.col("type")), F.col("mentions"), canonical_fields(F.col("attrs")))


def entity_copies(entities: DataFrame) -> DataFrame:
    """(keep_id, id): each entity that says the same as another one with a smaller id, once.

    Defined results: null equals null only, in every field; a row given twice is one id; an empty table gives no rows.
    """
    c = collapse(entities.select("id", "name", "type", "mentions", "attrs"), entity_key())
    return c.where("n_ids > 1 and id <> keep_id").select("keep_id", "id").dropDuplicates()


def unique_entities(entities: DataFrame) -> DataFrame:
    """One record of each group: keep_id, its rows and its different ids."""
    c = collapse(entities.select("id", "name", "type", "mentions", "attrs"), entity_key())
    return c.where("id = keep_id").select("keep_id", "n_rows", "n_ids")
