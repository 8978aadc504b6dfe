"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SNAPSHOT_SCHEMA = "fileCoupling map<string,struct<in:string,out:string>>, untestedFilePaths array<string>, healthScore string"
_END = "\u0001end"


def is_json(c: str) -> Column:
    """True for exactly one JSON value: the text is read as the first of two array elements, so trailing matter shows."""
    v = F.try_parse_json(F.concat(F.lit("["), F.col(c), F.lit(',"\\u0001end"]')))
    return F.coalesce(F.try_variant_get(v, "$[1]", "string") == F.lit(_END), F.lit(False))


def canonical_path(c: Column) -> Column:
    """One spelling of a path: forward slashes, none doubled, no leading `./`."""
    p = F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "/{2,}", "/")
    return F.regexp_replace(p, r"^(?:\./)+", "")


def canonical_number(c: Column) -> Column:
    """A number by its value, also when written as text; other text as it stands, null as null."""
    t = F.btrim(c)
    d = t.try_cast("double")
    return F.coalesce((d + F.lit(0.0)).cast("string"), t)


def row_hash(*cols: Column) -> Column:
    """Hash of a row in which null differs from the empty text and values cannot run into each other."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("v"), c), F.lit("n")) for c in cols])


def table_changes(prev: DataFrame, cur: DataFrame, keys: list[str], prev_hash: str = "h", cur_hash: str = "h") -> DataFrame:
    """Full outer join of two snapshots on their key; a missing side is an addition or a removal, unequal hashes are a change.

    Both sides hold one row per key. Unchanged keys give no row. Null keys match null keys.
    """
    p = prev.select(*keys, F.col(prev_hash).alias("_hp"), F.lit(True).alias("_p"))
    c = cur.select(*keys, F.col(cur_hash).alias("_hc"), F.lit(True).alias("_c"))
    j = p.join(c, keys, "full_outer")
    change = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.col("_hp") != F.col("_hc"), "changed")
    return j.select(*keys, change.alias("change")).where("change is not null")


def _neighbours(meta: DataFrame, bucket_seconds: int) -> DataFrame:
    """For each (repo_id, field, id) the next id in delivery order.

    The order is found inside time buckets first and bridged between them, so a repository that holds a third
    of all snapshots is never sorted in one task.
    """
    b = meta.withColumn("b", F.floor(F.coalesce(F.col("created_at"), F.lit(-1)) / F.lit(bucket_seconds)))
    inside = W.partitionBy("repo_id", "field", "b").orderBy(F.col("created_at").asc_nulls_first(), "id")
    b = b.withColumn("next_id", F.lead("id").over(inside)).withColumn("first_of", F.row_number().over(inside) == 1)
    heads = b.where("first_of").select("repo_id", "field", "b", F.col("id").alias("head"))
    across = W.partitionBy("repo_id", "field").orderBy("b")
    heads = heads.withColumn("next_head", F.lead("head").over(across)).withColumn("is_first", F.row_number().over(across) == 1)
    j = b.join(heads, ["repo_id", "field", "b"])
    return j.select("repo_id", "field", "id", F.coalesce("next_id", "next_head").alias("next_id"), (~(F.col("first_of") & F.col("is_first"))).alias("has_prev"))


def snapshot_changes(snaps: DataFrame, bucket_seconds: int = 86400) -> DataFrame:
    """Differences between each repository's consecutive snapshots: (repo_id, snapshot_id, field, item, change).

    Defined results: unreadable data is passed over; a field that is absent or null is passed over for that field only;
    an object that repeats a key is not valid JSON here; a snapshot delivered twice counts once (of unlike deliveries of
    one id the greatest data text counts); null repo_id forms a repository of its own; null created_at sorts first;
    an empty table gives no rows; further columns are ignored.
    """
    one = W.partitionBy("repo_id", "id").orderBy(F.col("created_at").desc_nulls_last(), F.col("data").desc_nulls_last())
    s = (
        snaps.select("repo_id", "id", "created_at", "data").where("data is not null")
        .withColumn("repo_id", F.coalesce(F.col("repo_id"), F.lit("\u0000")))
        .withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
        .where(is_json("data"))
        .select("repo_id", "id", "created_at", F.from_json("data", SNAPSHOT_SCHEMA).alias("d"))
    )
    item = lambda name, value: F.struct(name.alias("item"), value.alias("h"))
    coupling = F.transform(
        F.map_entries("d.fileCoupling"),
        lambda e: item(canonical_path(e["key"]), row_hash(canonical_number(e["value"]["in"]), canonical_number(e["value"]["out"]))),
    )
    untested = F.transform(F.filter("d.untestedFilePaths", lambda p: p.isNotNull()), lambda p: item(canonical_path(p), F.lit(0).cast("long")))
    health = F.array(item(F.lit("healthScore"), row_hash(canonical_number(F.col("d.healthScore")))))
    fields = F.array(
        F.struct(F.lit("fileCoupling").alias("field"), coupling.alias("items")),
        F.struct(F.lit("untestedFilePaths").alias("field"), untested.alias("items")),
        F.struct(F.lit("healthScore").alias("field"), F.when(F.col("d.healthScore").isNotNull(), health).alias("items")),
    )
    f = s.select("repo_id", "id", "created_at", F.explode(fields).alias("f")).select("repo_id", "id", "created_at", "f.field", "f.items").where("items is not null")
    order = _neighbours(f.select("repo_id", "field", "created_at", "id"), bucket_seconds)
    rows = f.join(order, ["repo_id", "field", "id"]).select("repo_id", "field", "id", "next_id", "has_prev", F.explode("items").alias("i"))
    rows = rows.select("repo_id", "field", "id", "next_id", "has_prev", "i.item", "i.h")
    keys = ["repo_id", "snapshot_id", "field", "item"]
    one_per_key = lambda d: d.groupBy(*keys).agg(F.max("h").alias("h"))
    cur = one_per_key(rows.where("has_prev").withColumnRenamed("id", "snapshot_id"))
    prev = one_per_key(rows.where("next_id is not null").withColumnRenamed("next_id", "snapshot_id"))
    out = table_changes(prev, cur, keys)
    return out.select(F.when(F.col("repo_id") != "\u0000", F.col("repo_id")).alias("repo_id"), "snapshot_id", "field", "item", "change")
