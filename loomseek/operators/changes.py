"""Problem 2: processing only new or changed records.

Method: a Merkle tree over ranges of the hashed key. A node's digest is the XOR of
``xxhash64(key, state)`` over the keys in its range. Two states of a table are compared from the root down:
only the children of nodes whose digests differ are looked at, and only the leaves that are left are read.

``MerkleStore`` does this for one run at a time, with the digests of all levels saved beside the output.
``changed_between_runs`` replays all runs of a history at once: the tree of every epoch is saved as what each
epoch changed in it, the digests of a run's state and of its ancestor's are compared level by level, and only
the leaf log of ranges that differ is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseek.operators.lineage import nearest_ancestor
from loomseek.session import staged
from loomseek.sources.generations import Generations

#: Leaf ranges hold about this many keys; two levels of the tree differ by FAN_BITS bits.
LEAF_KEYS = 256
MAX_LEAF_BITS = 24
FAN_BITS = 4
#: Rows of one repository that one as-of window partition handles.
SALT_ROWS = 50_000


def _depth(keys: int) -> int:
    """Bits of a leaf, in whole steps of FAN_BITS, so that a leaf holds about LEAF_KEYS of so many keys."""
    bits = max(0, (max(keys, 1) - 1) // LEAF_KEYS).bit_length()
    return min(MAX_LEAF_BITS, -(-bits // FAN_BITS) * FAN_BITS)


def successful_runs(reports: DataFrame) -> DataFrame:
    """One row per successful run: ``repo, version_id, read_until, at, n_epochs``.

    ``at`` numbers the distinct ``read_until`` of the repository's successful runs from 0: the
    epochs of its history. A run without ``read_until`` has read nothing and is left out.
    """
    ok = (
        reports.filter(F.col("manifest_path").isNotNull() & F.col("read_until").isNotNull() & F.col("version_id").isNotNull())
        .groupBy("repo", "version_id")
        .agg(F.max("read_until").alias("read_until"))
    )
    by_repo = Window.partitionBy("repo")
    return ok.withColumn("at", F.dense_rank().over(by_repo.orderBy("read_until")) - 1).withColumn("n_epochs", F.max("at").over(by_repo) + 1)


def with_epoch(feed: DataFrame, runs: DataFrame) -> DataFrame:
    """``feed`` with ``epoch``, the first epoch that had read the row; rows no run has read drop out.

    An as-of join as one window: the runs of a repository are copied into each of its salts, whose
    number follows the repository's rows, so no task gets more than a bounded share of a large one.
    """
    sizes = feed.groupBy("repo").agg(F.count(F.lit(1)).alias("n_rows")).select("repo", F.ceil(F.col("n_rows") / SALT_ROWS).cast("int").alias("salts"))
    marks = runs.select("repo", "read_until", "n_epochs").distinct().join(sizes, "repo").select("repo", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("read_until").alias("t"), F.lit(1).alias("mark"), "n_epochs")
    rows = (
        feed.join(sizes, "repo")
        .withColumn("salt", F.pmod(F.xxhash64("family_id", "change_id", "arrived_at"), F.col("salts")).cast("int"))
        .select("repo", "salt", F.col("arrived_at").alias("t"), F.lit(0).alias("mark"), F.lit(0).alias("n_epochs"), "family_id", "changed_at", "change_id", "state")
    )
    w = Window.partitionBy("repo", "salt")
    seen = w.orderBy("t", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.unionByName(marks, allowMissingColumns=True)
        .withColumn("epoch", F.sum("mark").over(seen).cast("int"))
        .withColumn("n_epochs", F.max("n_epochs").over(w))
        .filter((F.col("mark") == 0) & (F.col("epoch") < F.col("n_epochs")))
        .drop("salt", "mark", "n_epochs", "t")
    )


def state_changes(feed: DataFrame, runs: DataFrame) -> DataFrame:
    """``repo, family_id, epoch, before, after``: where a family's state differs from the epoch before.

    Rows are first reduced to one per family and epoch, so a family with very many rows is combined
    before the shuffle. Null ``state`` means absent.
    """
    clean = feed.filter(F.col("repo").isNotNull() & F.col("family_id").isNotNull() & F.col("arrived_at").isNotNull()).select(
        "repo", "family_id", "change_id", "changed_at", "arrived_at", F.when(F.col("op") != "delete", F.col("content_hash")).alias("state")
    )
    newest = with_epoch(clean, runs).groupBy("repo", "family_id", "epoch").agg(F.max(F.struct("changed_at", "change_id", "state")).alias("last"))
    by_family = Window.partitionBy("repo", "family_id").orderBy("epoch")
    return (
        newest.withColumn("after", F.max("last").over(by_family)["state"])
        .withColumn("before", F.lag("after").over(by_family))
        .filter(~F.col("before").eqNullSafe(F.col("after")))
        .select("repo", "family_id", "epoch", "before", "after")
    )


def merkle_history(feed: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The trees of all epochs, saved: the leaf log, the levels, and the bits of a leaf.

    The log has ``repo, leaf, epoch, family_id, before, after, delta``, the levels ``level, repo, node, epoch, delta``: by
    what the digest of the node differs from its digest at the epoch before. A digest is an XOR, so the digests of two
    epochs differ by the XOR of the deltas between them. ``node`` is the upper ``level`` bits of the hashed key.
    """
    most = feed.groupBy("repo").agg(F.approx_count_distinct("family_id").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    bits = _depth(int(most or 0))
    digest = lambda c: F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("family_id", c))
    leaf = F.shiftrightunsigned(F.xxhash64("family_id"), 64 - bits).cast("int") if bits else F.lit(0)
    log = staged(state_changes(feed, runs).select("repo", leaf.alias("leaf"), "epoch", "family_id", "before", "after", digest("before").bitwiseXOR(digest("after")).alias("delta")))
    at_level = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright("leaf", bits - n).alias("node")) for n in range(0, bits + 1, FAN_BITS)]))
    levels = log.select("repo", "epoch", "delta", at_level.alias("at")).groupBy("at.level", "repo", "at.node", "epoch").agg(F.bit_xor("delta").alias("delta"))
    return log, staged(levels.filter(F.col("delta") != 0), "level"), bits


def changed_between_runs(feed: DataFrame, reports: DataFrame) -> DataFrame:
    """For each successful run the families whose state differs from its last successful ancestor.

    Returns ``repo, version_id, ancestor, family_id, before, after``: ``before`` is null for an added
    family, ``after`` for a removed one. A run without successful ancestor starts from nothing.
    Feed rows without repo, family or arrival are ignored, repeated and re-delivered rows change
    nothing, and a run without changes has no rows.
    """
    runs = successful_runs(reports)
    ancestors = nearest_ancestor(reports, F.col("manifest_path").isNotNull() & F.col("read_until").isNotNull())
    from_at = runs.select("repo", F.col("version_id").alias("ancestor"), F.col("at").alias("from_at"))
    pairs = runs.join(ancestors, ["repo", "version_id"], "left").join(from_at, ["repo", "ancestor"], "left").withColumn("from_at", F.coalesce("from_at", F.lit(-1)))
    log, levels, bits = merkle_history(feed, runs)
    # the epochs between the two states, whichever is later
    spans = staged(
        pairs.filter(F.col("at") != F.col("from_at"))
        .withColumn("epoch", F.explode(F.sequence(F.least("at", "from_at") + 1, F.greatest("at", "from_at"))))
        .select("repo", "version_id", "ancestor", "epoch", (F.col("at") > F.col("from_at")).alias("forward"))
    )
    open_nodes = None
    for level in range(0, bits + 1, FAN_BITS):
        here = levels.filter(F.col("level") == level).select("repo", "node", "epoch", "delta")
        reached = spans.select("repo", "version_id", "epoch")
        if open_nodes is not None:
            # only the children of nodes that differ
            here = here.withColumn("up", F.shiftright("node", FAN_BITS))
            reached = reached.join(open_nodes.withColumnRenamed("node", "up"), ["repo", "version_id"])
        compared = here.join(reached, ["repo", "epoch"] + (["up"] if open_nodes is not None else []))
        open_nodes = compared.groupBy("repo", "version_id", "node").agg(F.bit_xor("delta").alias("delta")).filter(F.col("delta") != 0).select("repo", "version_id", "node")
    open_leaves = spans.join(open_nodes.withColumnRenamed("node", "leaf"), ["repo", "version_id"])
    found = (
        log.join(open_leaves, ["repo", "leaf", "epoch"])
        .groupBy("repo", "version_id", "family_id")
        .agg(F.min(F.struct("epoch", "before"))["before"].alias("low"), F.max(F.struct("epoch", "after"))["after"].alias("high"), F.first("ancestor").alias("ancestor"), F.first("forward").alias("forward"))
        .filter(~F.col("low").eqNullSafe(F.col("high")))
    )
    return found.select(
        "repo", "version_id", "ancestor", "family_id", F.when(F.col("forward"), F.col("low")).otherwise(F.col("high")).alias("before"), F.when(F.col("forward"), F.col("high")).otherwise(F.col("low")).alias("after")
    )


class MerkleStore(Generations):
    """Incremental runs over one keyed table, safe against failures.

    A generation holds the changes a run found, its output, the leaves (``key, digest``) of the ranges that
    changed, and the digests of all levels. The saved tree follows from the saved changes, not from a reading of
    the source: what a run did not put out is not in its tree, so a row that arrives while the run reads is either
    in both or in neither, and the next run finds it.
    """

    def __init__(self, spark: SparkSession, path: str, leaf_bits: int = 8):
        if leaf_bits % FAN_BITS or not 0 <= leaf_bits <= MAX_LEAF_BITS:
            raise ValueError(f"leaf_bits must be a multiple of {FAN_BITS} up to {MAX_LEAF_BITS}")
        super().__init__(spark, path)
        self.leaf_bits = leaf_bits

    def _keyed(self, df: DataFrame, key: str, columns: list[str]) -> DataFrame:
        """``leaf, key, digest`` and the row as ``_row``. Null keys drop out; of the rows of one key that with the greatest digest
        is the key's row, for the tree and the output alike."""
        packed = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        name = F.col(key).cast("string")
        leaf = F.shiftrightunsigned(F.xxhash64(name), 64 - self.leaf_bits).cast("int") if self.leaf_bits else F.lit(0)
        return df.filter(F.col(key).isNotNull()).select(leaf.alias("leaf"), name.alias("key"), F.sha2(packed, 256).alias("digest"), F.struct(*columns).alias("_row"))

    def _levels(self, leaf_digests: DataFrame) -> DataFrame:
        """``level, node, digest`` of all levels from the digests of the leaves (``node, digest``)."""
        at = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright("node", self.leaf_bits - n).alias("node")) for n in range(0, self.leaf_bits + 1, FAN_BITS)]))
        return leaf_digests.select("digest", at.alias("at")).groupBy("at.level", "at.node").agg(F.bit_xor("digest").alias("digest")).filter(F.col("digest") != 0)

    def _leaf_digests(self, entries: DataFrame) -> DataFrame:
        return entries.groupBy(F.col("leaf").alias("node")).agg(F.bit_xor(F.xxhash64("key", "digest")).alias("digest")).filter(F.col("digest") != 0)

    def _saved_levels(self, generation: str | None) -> dict[tuple[int, int], tuple[int, str | None]]:
        """``(level, node) -> (digest, generation that holds the leaf)``: at most twice two to the ``leaf_bits`` entries."""
        if generation is None:
            return {}
        return {(r["level"], r["node"]): (r["digest"], r["holder"]) for r in self.spark.read.parquet(self.at(generation, "levels")).collect()}

    def open_leaves(self, current: dict[tuple[int, int], int], saved: dict[tuple[int, int], tuple[int, str | None]]) -> list[int]:
        """The leaves whose digests differ, reached from the root through nodes that differ only."""
        live = [0]
        for level in range(0, self.leaf_bits + 1, FAN_BITS):
            if level:
                live = [(n << FAN_BITS) + i for n in live for i in range(1 << FAN_BITS)]
            live = [n for n in live if current.get((level, n), 0) != saved.get((level, n), (0, None))[0]]
        return live

    def run(self, df: DataFrame, key: str, columns: list[str], process=None) -> str:
        """Processes what changed since the published generation and publishes output and tree together.

        ``process`` turns the changes (``key, change, columns``; change is added, changed or removed) into the output. The
        source is read twice, for the digests and for the rows of ranges that differ; no whole copy of it is made.
        """
        self.vacuum()
        done = self.commits()
        old, g = done[-1] if done else None, self.new()
        keyed = self._keyed(df, key, columns)
        one = keyed.groupBy("leaf", "key").agg(F.max("digest").alias("digest"))
        current = {(r["level"], r["node"]): r["digest"] for r in self._levels(self._leaf_digests(one)).collect()}
        saved = self._saved_levels(old)
        leaves = self.open_leaves(current, saved)
        found = self._changes(keyed, leaves, saved)
        found.write.parquet(self.at(g, "changes"))
        found = self.spark.read.schema(found.schema).parquet(self.at(g, "changes"))
        out = found.select("key", "change", "_row.*")
        (process(out) if process else out).write.parquet(self.at(g, "output"))
        self._save_tree(g, found, leaves, saved)
        self.publish(g, len(done))
        return g

    def _read_leaves(self, leaves: list[int], saved: dict) -> DataFrame:
        """The saved ``leaf, key, digest`` of the given ranges; other files are not opened."""
        held = [(n, saved[(self.leaf_bits, n)][1]) for n in leaves if (self.leaf_bits, n) in saved]
        schema = "key string, digest string"
        rows = self.spark.read.schema(schema).parquet(*[self.at(g, f"leaves/leaf={n}") for n, g in held]) if held else self.spark.createDataFrame([], schema)
        leaf = F.shiftrightunsigned(F.xxhash64("key"), 64 - self.leaf_bits).cast("int") if self.leaf_bits else F.lit(0)
        return rows.select(leaf.alias("leaf"), "key", "digest")

    def _changes(self, keyed: DataFrame, leaves: list[int], saved: dict) -> DataFrame:
        """``leaf, key, digest, change, _row`` of the open ranges."""
        wanted = F.broadcast(self.spark.createDataFrame([(n,) for n in leaves], "leaf int"))
        now = keyed.join(wanted, "leaf", "left_semi").groupBy("leaf", "key").agg(F.max("digest").alias("digest"), F.max_by("_row", "digest").alias("_row"))
        before = self._read_leaves(leaves, saved).select(F.col("leaf").alias("old_leaf"), F.col("key").alias("old_key"), F.col("digest").alias("old"))
        both = now.join(before, now["key"] == before["old_key"], "full_outer").filter(~F.col("digest").eqNullSafe(F.col("old")))
        change = F.when(F.col("old").isNull(), "added").when(F.col("digest").isNull(), "removed").otherwise("changed")
        return both.select(F.coalesce("leaf", "old_leaf").alias("leaf"), F.coalesce("key", "old_key").alias("key"), "digest", change.alias("change"), "_row")

    def _save_tree(self, g: str, found: DataFrame, leaves: list[int], saved: dict) -> None:
        """The saved tree with the changes of this run: new files for the ranges that changed, the rest stays where it is."""
        before = self._read_leaves(leaves, saved)
        kept = before.join(found.select("key"), "key", "left_anti").select("leaf", "key", "digest")
        entries = kept.unionByName(found.filter(F.col("change") != "removed").select("leaf", "key", "digest"))
        entries.repartition("leaf").write.partitionBy("leaf").parquet(self.at(g, "leaves"))
        schema = "leaf int, key string, digest string"
        entries = self.spark.read.schema(schema).parquet(self.at(g, "leaves"))
        opened = set(leaves)
        nodes = [(n, d, h) for (level, n), (d, h) in saved.items() if level == self.leaf_bits and n not in opened]
        nodes += [(r["node"], r["digest"], g) for r in self._leaf_digests(entries).collect()]
        table = self.spark.createDataFrame(nodes, "node int, digest bigint, holder string")
        holders = table.select(F.lit(self.leaf_bits).alias("level"), "node", "holder")
        self._levels(table).join(holders, ["level", "node"], "left").coalesce(1).write.parquet(self.at(g, "levels"))

    def output(self) -> DataFrame:
        """The output of the published generation."""
        return self.spark.read.parquet(self.at(self.generation(), "output"))

    def tree(self) -> DataFrame:
        """The saved ``leaf, key, digest`` of the published generation."""
        saved = self._saved_levels(self.generation())
        return self._read_leaves([n for level, n in saved if level == self.leaf_bits], saved)
