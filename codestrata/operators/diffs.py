"""Comparisons of two states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codestrata.operators import snapshots as SN

# Fixed value: grades from best to worst.
GRADE_ORDER = ["A", "B", "C", "D", "F"]


def added_removed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change) of what is only in one state: anti joins both ways. Repeated keys count once."""
    o, n = old.select(*keys).dropDuplicates(), new.select(*keys).dropDuplicates()
    return n.join(o, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(o.join(n, keys, "left_anti").withColumn("change", F.lit("removed")))


def states(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full join by key: only_old, only_new, diverged or identical."""
    o = old.select(*keys, F.col(value).alias("_o"), F.lit(1).alias("_a"))
    n = new.select(*keys, F.col(value).alias("_n"), F.lit(1).alias("_b"))
    s = F.when(F.col("_a").isNull(), "only_new").when(F.col("_b").isNull(), "only_old").when(F.col("_o").eqNullSafe(F.col("_n")), "identical").otherwise("diverged")
    return o.join(n, keys, "full_outer").select(*keys, s.alias("state"))


def grade_worse(old: Column, new: Column) -> Column:
    order = F.array(*[F.lit(x) for x in GRADE_ORDER])
    return F.array_position(order, new) > F.array_position(order, old)


def drift_level(health_delta: Column, cycles: Column, files: Column) -> Column:
    return F.when((health_delta <= -20) | (cycles >= 5) | (files >= 5), "CRITICAL").when((health_delta <= -5) | (cycles >= 1) | (files >= 2), "DEGRADED").otherwise("STABLE")


def semver_verdict(removed: Column, added: Column, bump: Column) -> Column:
    need = F.when(removed > 0, "major").when(added > 0, "minor").otherwise("patch")
    rank = lambda c: F.when(c == "major", 2).when(c == "minor", 1).when(c == "patch", 0)
    return F.when(rank(bump).isNull(), "unknown").when((need == "major") & (rank(bump) < 2), "breach").when(rank(bump) < rank(need), "underbump").otherwise("ok")


def api_changes(old: DataFrame, new: DataFrame, keys: list[str], sig: str) -> DataFrame:
    """(keys, severity): removed symbols are critical, those of another signature high, added ones info. One row per key on either side."""
    o = old.select(*keys, F.col(sig).alias("_o"), F.lit(1).alias("_a"))
    n = new.select(*keys, F.col(sig).alias("_n"), F.lit(1).alias("_b"))
    s = F.when(F.col("_b").isNull(), "critical").when(F.col("_a").isNull(), "info").when(~F.col("_o").eqNullSafe(F.col("_n")), "high")
    return o.join(n, keys, "full_outer").select(*keys, s.alias("severity")).where("severity is not null")


def readable_snapshots(snaps: DataFrame) -> DataFrame:
    """(repo_id, id, created_at, grade, health, cycles, coupling) of the deliveries whose data is a JSON object, each once; coupling is path -> incoming."""
    s = snaps.select("repo_id", "id", "created_at", "data").where(SN.is_json("data") & F.col("data").rlike(r"^\s*\{")).dropDuplicates()
    d = F.from_json("data", "healthGrade string, healthScore string, circularDepCount string, " + SN.SNAPSHOT_SCHEMA.split(", untested")[0])
    s = s.select("repo_id", "id", "created_at", d.alias("d"))
    return s.select("repo_id", "id", "created_at", F.col("d.healthGrade").alias("grade"), F.col("d.healthScore").try_cast("double").alias("health"), F.col("d.circularDepCount").try_cast("long").alias("cycles"), F.map_entries("d.fileCoupling").alias("coupling"))


def snapshot_drift(snaps: DataFrame, bucket_seconds: int = 86400) -> DataFrame:
    """(repo_id, snapshot_id, health_delta, cycles_delta, n_grown, drift) of each snapshot against the one before.

    The order is found inside time buckets (see snapshots), values are joined by it, and couplings path by path. A snapshot without
    health, or the first of a repository, gives no row.
    """
    s = readable_snapshots(snaps)
    order = SN._neighbours(s.select("repo_id", F.lit("").alias("field"), "created_at", "id"), bucket_seconds).where("next_id is not null").select("repo_id", F.col("id").alias("prev_id"), F.col("next_id").alias("id"))
    v = s.select("repo_id", "id", "health", "cycles")
    j = order.join(v, ["repo_id", "id"]).join(v.toDF("repo_id", "prev_id", "h0", "c0"), ["repo_id", "prev_id"]).select("repo_id", "id", "prev_id", (F.col("health") - F.col("h0")).alias("health_delta"), (F.col("cycles") - F.col("c0")).alias("cycles_delta"))
    c = s.where("coupling is not null").select("repo_id", "id", F.explode("coupling").alias("e")).groupBy("repo_id", "id", SN.canonical_path(F.col("e.key")).alias("path")).agg(F.max(F.col("e.value.in").try_cast("double")).alias("n"))
    grown = j.select("repo_id", "id", "prev_id").join(c, ["repo_id", "id"]).join(c.toDF("repo_id", "prev_id", "path", "m"), ["repo_id", "prev_id", "path"]).where("n - m >= 2 and n > m * 1.2").groupBy("repo_id", "id").agg(F.count("*").alias("n_grown"))
    r = j.where("health_delta is not null").join(grown, ["repo_id", "id"], "left").withColumn("n_grown", F.coalesce("n_grown", F.lit(0).cast("long")))
    return r.select("repo_id", F.col("id").alias("snapshot_id"), "health_delta", "cycles_delta", "n_grown", drift_level(F.col("health_delta"), F.coalesce("cycles_delta", F.lit(0)), F.col("n_grown")).alias("drift"))
