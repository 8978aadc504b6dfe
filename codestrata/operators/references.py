"""References to records that do not exist, skew-aware."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_BLANKS = " \t\n\r\f\v\u00a0\u2003\u2009\u200b\u3000\ufeff"
#: A key with more presence intervals than this is swept in time order instead of being held in one array.
MAX_INTERVALS = 64
#: At most this many keys can be heavy, since each of them holds more than its share of all references.
MAX_HEAVY = 2000


def canonical_key(c: Column) -> Column:
    """A key without surrounding blanks and case; blank keys become null."""
    k = F.lower(F.btrim(c, F.lit(_BLANKS)))
    return F.when(k != "", k)


def presence_intervals(records: DataFrame, table: str, key: str, start: Column, end: Column) -> DataFrame:
    """(target, key, start, end): when a record is there. Copies and repeated loads before one deletion collapse at once."""
    r = records.select(F.lit(table).alias("target"), canonical_key(F.col(key)).alias("key"), F.coalesce(start, F.lit("0001-01-01").cast("timestamp_ntz")).alias("start"), end.alias("end"))
    return r.where("key is not null").groupBy("target", "key", "end").agg(F.min("start").alias("start"))


def orphan_references(refs: DataFrame, intervals: DataFrame, total: int) -> DataFrame:
    """References whose record is not present at the reference's time.

    refs: (id, ref, target, key, t), one row per reference; intervals: from presence_intervals; total: an upper bound
    of the number of references. Returns (id, ref, target, t, state): `missing` without any row, `later` if every row
    starts after t, `deleted` otherwise. A null t stands after everything.

    Plan: references are pre-aggregated per key and period; keys with over total/MAX_HEAVY references are heavy (at most
    MAX_HEAVY of them, by counting) and are checked by broadcast; the remaining keys are checked by a shuffled join; keys with
    many intervals, whichever they are, by a sweep over (key, day) pieces. The three results are united.
    """
    spark = refs.sparkSession
    far = F.lit("9999-12-31 23:59:59").cast("timestamp_ntz")
    keys = ["target", "key"]
    refs = refs.withColumn("t", F.coalesce("t", far))
    per_period = refs.groupBy(*keys, F.trunc("t", "month").alias("period")).agg(F.count("*").alias("n"))
    heavy_min = max(1000, -(-total // MAX_HEAVY) + 1)
    found = per_period.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= heavy_min).select(*keys).collect()
    heavy = F.broadcast(spark.createDataFrame(found, "target string, key string")) if found else None
    many = intervals.groupBy(*keys).agg(F.count("*").alias("n_iv")).where(F.col("n_iv") > MAX_INTERVALS).select(*keys)
    wide = many if many.limit(1).count() else None

    narrow = intervals.join(wide, keys, "left_anti") if wide is not None else intervals
    narrow = narrow.groupBy(*keys).agg(F.min("start").alias("first_start"), F.collect_list(F.struct("start", "end")).alias("iv"))
    present = F.exists("iv", lambda i: (i["start"] <= F.col("t")) & (i["end"].isNull() | (i["end"] > F.col("t"))))
    state = F.when(F.col("first_start").isNull(), "missing").when(F.col("first_start") > F.col("t"), "later").otherwise("deleted")
    out = ["id", "ref", "target", "t"]
    judged = lambda d: d.where(F.coalesce(~present, F.lit(True))).select(*out, state.alias("state"))

    light = refs.join(heavy, keys, "left_anti") if heavy is not None else refs
    if wide is not None:
        light = light.join(wide, keys, "left_anti")
    result = judged(light.join(narrow, keys, "left"))
    if heavy is not None:
        hot = refs.join(heavy, keys, "left_semi")
        if wide is not None:
            hot = hot.join(F.broadcast(wide.join(heavy, keys, "left_semi")), keys, "left_anti")
        result = result.unionByName(judged(hot.join(F.broadcast(narrow.join(heavy, keys, "left_semi")), keys, "left")))
    if wide is not None:
        swept = sweep_presence(refs.join(wide, keys, "left_semi"), intervals.join(wide, keys, "left_semi"))
        result = result.unionByName(swept.where("there <= 0").select(*out, F.when(F.col("seen") > 0, "deleted").otherwise("later").alias("state")))
    return result.withColumn("t", F.when(F.col("t") < far, F.col("t")))


def sweep_presence(refs: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each reference with `there`, the number of intervals open at its time, and `seen`, the number begun by then.

    Starts, ends and references of a key run in time order inside (key, day) pieces; what earlier days leave open is
    carried in, so no key is sorted in one task however many rows it has.
    """
    none = lambda t: F.lit(None).cast(t)
    events = lambda d, t, there, seen: d.select("target", "key", F.col(t).alias("t"), F.lit(there).alias("d"), F.lit(seen).alias("s"), F.lit(0).alias("kind"), none("string").alias("id"), none("string").alias("ref"))
    all_ = (
        events(intervals.where("end is null or end > start"), "start", 1, 1)
        .unionByName(events(intervals.where("end <= start"), "start", 0, 1))
        .unionByName(events(intervals.where("end > start"), "end", -1, 0))
        .unionByName(refs.select("target", "key", "t", F.lit(0).alias("d"), F.lit(0).alias("s"), F.lit(1).alias("kind"), "id", "ref"))
        .withColumn("day", F.to_date("t"))
    )
    keys = ["target", "key"]
    before = W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    carry = all_.groupBy(*keys, "day").agg(F.sum("d").alias("d"), F.sum("s").alias("s"))
    carry = carry.select(*keys, "day", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("cd"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("cs"))
    run = W.partitionBy(*keys, "day").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0)
    swept = all_.withColumn("rd", F.sum("d").over(run)).withColumn("rs", F.sum("s").over(run)).where("kind = 1")
    return swept.join(carry, [*keys, "day"]).select("id", "ref", "target", "t", (F.col("rd") + F.col("cd")).alias("there"), (F.col("rs") + F.col("cs")).alias("seen"))


def relation_orphans(relations: DataFrame, entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Orphan references of src_id, dst_id and doc_id: (id, ref, target, t, state).

    Defined results: null and blank keys are no reference; a relation given twice counts once; a null loaded_at of a record
    means it was always there, of a relation that it is judged after everything; empty tables make every reference `missing`.
    """
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    iv = presence_intervals(entities, "kg_entities", "id", ntz("loaded_at"), ntz("deleted_at")).unionByName(
        presence_intervals(docs, "kg_docs", "id", F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, indexed_at)"), ntz("deleted_at"))
    )
    one = lambda ref, target: F.struct(F.lit(ref).alias("ref"), F.lit(target).alias("target"), canonical_key(F.col(ref)).alias("key"))
    r = relations.select("id", "src_id", "dst_id", "doc_id", ntz("loaded_at").alias("t"))
    r = r.select("id", "t", F.explode(F.array(one("src_id", "kg_entities"), one("dst_id", "kg_entities"), one("doc_id", "kg_docs"))).alias("r"))
    r = r.select("id", "t", "r.ref", "r.target", "r.key").where("key is not null")
    # Repeated relations are dropped among the few orphans, not among all references.
    return orphan_references(r, iv, 3 * relations.count()).dropDuplicates()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan references per referenced table, reference, month and state."""
    period = F.coalesce(F.date_format("t", "yyyy-MM"), F.lit("unknown"))
    return orphans.groupBy(F.col("target").alias("ref_table"), "ref", period.alias("period"), "state").agg(F.count("*").alias("n_orphans"))
