"""Problem 6: what changed between full snapshots.

Method: gaps and islands. Snapshots are numbered along chains of predecessors; rows of one key and
hash at consecutive numbers form a validity interval. The start of an interval is an addition or,
when another interval of the key ends just before it, a modification; an end that nothing follows
is a deletion. Equal hashes among the vanished and the appeared keys of a snapshot are renames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomseek.operators.lineage import nearest_ancestor
from loomseek.operators.spread import spread_rank
from loomseek.session import staged


def snapshot_chains(reports: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``repo, version_id, chain, at, last``: the snapshots in chains of predecessors.

    The predecessor of a snapshot is its nearest ancestor that has one. The first successor of a
    snapshot continues its chain at the next number; every further successor begins a chain of its own
    that starts with a copy of the common predecessor.
    """
    have = snapshots.select("repo", "version_id").filter(F.col("version_id").isNotNull() & F.col("repo").isNotNull()).distinct()
    known = reports.select("repo", "version_id", "parent_version").join(have.withColumn("has", F.lit(True)), ["repo", "version_id"], "left")
    lonely = have.join(reports.select("repo", "version_id"), ["repo", "version_id"], "left_anti").select("repo", "version_id", F.lit(None).cast("string").alias("parent_version"), F.lit(True).alias("has"))
    known = known.unionByName(lonely)
    pred = nearest_ancestor(known, F.coalesce("has", F.lit(False))).join(have, ["repo", "version_id"], "left_semi").select("repo", "version_id", F.col("ancestor").alias("pred"))
    order = F.row_number().over(Window.partitionBy("repo", "pred").orderBy("version_id"))
    pred = pred.withColumn("head", F.col("pred").isNull() | (order > 1))
    # the head of a chain is the nearest ancestor-or-self that is one
    within = nearest_ancestor(pred, F.col("head"), parent="pred").select("repo", "version_id", "ancestor", "hops")
    placed = pred.join(within, ["repo", "version_id"]).select(
        "repo",
        "version_id",
        "pred",
        "head",
        F.when(F.col("head"), F.col("version_id")).otherwise(F.col("ancestor")).alias("chain"),
        F.when(F.col("head"), F.lit(0)).otherwise(F.col("hops")).alias("at"),
    )
    copies = placed.filter(F.col("head") & F.col("pred").isNotNull()).select("repo", F.col("pred").alias("version_id"), F.col("version_id").alias("chain"), F.lit(-1).alias("at"))
    every = placed.select("repo", "version_id", "chain", "at").unionByName(copies)
    of_chain = Window.partitionBy("repo", "chain")
    return every.withColumn("first", F.min("at").over(of_chain)).withColumn("last", F.max("at").over(of_chain))


def validity_intervals(rows: DataFrame) -> DataFrame:
    """Islands of consecutive ``at`` per ``repo, chain, file_path, hash``: ``begin, end``."""
    number = F.row_number().over(Window.partitionBy("repo", "chain", "file_path", "hash").orderBy("at"))
    return (
        rows.withColumn("island", F.col("at") - number)
        .groupBy("repo", "chain", "file_path", "hash", "island")
        .agg(F.min("at").alias("begin"), F.max("at").alias("end"), F.first("first").alias("first"), F.first("last").alias("last"))
    )


def snapshot_changes(snapshots: DataFrame, reports: DataFrame) -> DataFrame:
    """``repo, version_id, status, file_path, old_path`` of each snapshot against its predecessor.

    A snapshot without predecessor has no rows. Hashes compare without case. Rows without
    version or path are ignored, repeated rows count once; of two hashes for one path the
    greater counts; null hashes are equal to each other but rename nothing. ``old_path`` is empty
    but for renames, which pair the vanished and appeared paths of one hash in ascending order.
    """
    chains = snapshot_chains(reports, snapshots)
    files = (
        snapshots.filter(F.col("file_path").isNotNull() & F.col("version_id").isNotNull() & F.col("repo").isNotNull())
        .groupBy("repo", "version_id", "file_path")
        .agg(F.max(F.lower("file_hash")).alias("hash"))
    )
    rows = files.join(chains, ["repo", "version_id"])
    by_path = Window.partitionBy("repo", "chain", "file_path").orderBy("begin")
    spells = validity_intervals(rows).withColumn("before", F.lag("end").over(by_path)).withColumn("after", F.lead("begin").over(by_path))
    came = F.col("begin") > F.col("first")
    follows = F.coalesce(F.col("before") == F.col("begin") - 1, F.lit(False))
    went = (F.col("end") < F.col("last")) & F.coalesce(F.col("after") > F.col("end") + 1, F.lit(True))
    events = spells.select(
        "repo",
        "chain",
        "file_path",
        "hash",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.when(came & follows, "modified").when(came, "added").alias("status"), F.col("begin").alias("at")),
                    F.struct(F.when(went, "deleted").alias("status"), (F.col("end") + 1).alias("at")),
                ),
                lambda e: e["status"].isNotNull(),
            )
        ).alias("e"),
    ).select("repo", "chain", "file_path", "hash", "e.status", "e.at")
    events = staged(events.join(chains.select("repo", "chain", "at", "version_id"), ["repo", "chain", "at"]).select("repo", "version_id", "status", "file_path", "hash"))
    moved = events.filter((F.col("status") != "modified") & F.col("hash").isNotNull())
    # only hashes on both sides can be renames: the pairing windows hold nothing else
    sides = moved.groupBy("repo", "version_id", "hash").agg(F.countDistinct("status").alias("n")).filter("n = 2").select("repo", "version_id", "hash")
    both = moved.join(sides, ["repo", "version_id", "hash"], "left_semi")
    # copies of one content may be many: their numbers come from a range partitioning, not from one task
    numbered = spread_rank(both, ["repo", "version_id", "hash", "status"], [F.col("file_path")], "n")
    pairs = numbered.groupBy("repo", "version_id", "hash", "n").agg(F.max(F.when(F.col("status") == "added", F.col("file_path"))).alias("new"), F.max(F.when(F.col("status") == "deleted", F.col("file_path"))).alias("old"))
    paired = pairs.select(
        "repo",
        "version_id",
        F.when(F.col("new").isNotNull() & F.col("old").isNotNull(), "renamed").when(F.col("new").isNotNull(), "added").otherwise("deleted").alias("status"),
        F.coalesce("new", "old").alias("file_path"),
        F.when(F.col("new").isNotNull(), F.coalesce("old", F.lit(""))).otherwise("").alias("old_path"),
    )
    known_sides = sides.withColumn("two", F.lit(True))
    rest = (
        events.join(known_sides, ["repo", "version_id", "hash"], "left")
        .filter(F.col("two").isNull() | (F.col("status") == "modified"))
        .select("repo", "version_id", "status", "file_path", F.lit("").alias("old_path"))
    )
    return paired.unionByName(rest)
