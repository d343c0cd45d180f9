"""Queries of the general data problems over the test tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseek.operators import changes, orphans, snapshots
from loomseek.session import shared_dir, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = changes.changed_between_runs(table(spark, sf_dir, "chunk_feed"), table(spark, sf_dir, "reindex_reports"))
    return out.select("version_id", "family_id").distinct()


def p2_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families added, changed and removed per run, beside what the run itself reports."""
    reports = table(spark, sf_dir, "reindex_reports")
    out = changes.changed_between_runs(table(spark, sf_dir, "chunk_feed"), reports)
    n = out.groupBy("version_id").agg(
        F.count_if(F.col("before").isNull()).alias("added"),
        F.count_if(F.col("before").isNotNull() & F.col("after").isNotNull()).alias("changed"),
        F.count_if(F.col("after").isNull()).alias("removed"),
    )
    runs = reports.filter(F.col("manifest_path").isNotNull()).select("version_id", "parent_version", "chunks_carried", "embed_calls").distinct()
    return runs.join(n, "version_id", "left").fillna(0, ["added", "changed", "removed"])


def p2_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a Merkle store over the families' states, in the middle of the feed's time and at its end: what the second run put out."""
    feed = table(spark, sf_dir, "chunk_feed").filter("repo IS NOT NULL AND family_id IS NOT NULL AND arrived_at IS NOT NULL")
    middle = feed.agg(F.expr("(unix_micros(min(arrived_at)::timestamp) + unix_micros(max(arrived_at)::timestamp)) div 2").alias("m")).first()["m"]
    state = F.when(F.col("op") != "delete", F.col("content_hash"))

    def states(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(F.concat_ws("/", "repo", "family_id").alias("family")).agg(F.max(F.struct("changed_at", "change_id", state.alias("state")))["state"].alias("state"))
        return last.filter("state IS NOT NULL")

    store = changes.MerkleStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    if middle is not None:
        store.run(states(feed.filter(F.expr(f"unix_micros(arrived_at::timestamp) <= {middle}"))), "family", ["state"])
    store.run(states(feed), "family", ["state"])
    return store.output().select(F.col("key").alias("family"), "change", "state")


def _orphan_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("calls", "imports", "exports", "symbols", "source_files")]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_references(*_orphan_tables(spark, sf_dir)).select("ref_table", "ref_id").distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(*_orphan_tables(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = snapshots.snapshot_changes(table(spark, sf_dir, "file_snapshots"), table(spark, sf_dir, "reindex_reports"))
    return out.select("version_id", "status", "file_path", "old_path").distinct()


def p6_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes per version and status."""
    return p6_found(spark, sf_dir).groupBy("version_id", "status").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p2_found, p2_changes, p2_store, p3_found, p3_report, p6_found, p6_summary)}

_RUNS = """
WITH RECURSIVE reports AS (SELECT DISTINCT repo, version_id, parent_version, manifest_path, read_until, chunks_carried, embed_calls FROM reindex_reports),
up AS (
  SELECT r.repo, r.version_id, r.parent_version AS anc FROM reports r WHERE r.manifest_path IS NOT NULL
  UNION ALL
  SELECT u.repo, u.version_id, p.parent_version FROM up u JOIN reports p ON p.repo = u.repo AND p.version_id = u.anc WHERE p.manifest_path IS NULL
),
runs AS (
  SELECT r.repo, r.version_id, r.read_until, a.read_until AS anc_until
  FROM reports r LEFT JOIN (SELECT u.* FROM up u JOIN reports p ON p.repo = u.repo AND p.version_id = u.anc AND p.manifest_path IS NOT NULL) u
    ON u.repo = r.repo AND u.version_id = r.version_id
  LEFT JOIN reports a ON a.repo = u.repo AND a.version_id = u.anc
  WHERE r.manifest_path IS NOT NULL
),
feed AS (SELECT DISTINCT repo, family_id, change_id, changed_at, arrived_at, CASE WHEN op <> 'delete' THEN content_hash END AS state FROM chunk_feed),
ends AS (SELECT repo, version_id, read_until AS t, 'now' AS side FROM runs UNION ALL SELECT repo, version_id, anc_until, 'then' FROM runs WHERE anc_until IS NOT NULL),
states AS (
  SELECT e.version_id, e.side, f.family_id, arg_max(struct_pack(s := f.state), struct_pack(a := f.changed_at, b := f.change_id)).s AS state
  FROM ends e JOIN feed f ON f.repo = e.repo AND f.arrived_at <= e.t GROUP BY ALL
),
diff AS (
  SELECT version_id, family_id, max(CASE WHEN side = 'then' THEN state END) AS old, max(CASE WHEN side = 'now' THEN state END) AS new
  FROM states GROUP BY ALL HAVING old IS DISTINCT FROM new
)
"""

_ORPHANS = """
WITH RECURSIVE raw_paths AS (SELECT DISTINCT path FROM (SELECT resolved_path AS path FROM imports UNION ALL SELECT file_path FROM source_files) WHERE path IS NOT NULL),
walk AS (
  SELECT path, list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda s: s NOT IN ('', '.')) AS steps, 1 AS i, []::VARCHAR[] AS acc FROM raw_paths
  UNION ALL
  SELECT path, steps, i + 1, CASE WHEN steps[i] = '..' AND len(acc) > 0 AND acc[-1] <> '..' THEN acc[:len(acc) - 1] ELSE list_append(acc, steps[i]) END FROM walk WHERE i <= len(steps)
),
canon AS (SELECT path, array_to_string(acc, '/') AS cpath FROM walk WHERE i = len(steps) + 1),
orphan AS (
  SELECT 'calls' AS ref_table, call_id AS ref_id, loaded_at FROM calls c WHERE callee_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.symbol_id = c.callee_id AND c.loaded_at >= s.loaded_at AND (s.deleted_at IS NULL OR c.loaded_at < s.deleted_at))
  UNION
  SELECT 'exports', export_id, loaded_at FROM exports c WHERE symbol_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.symbol_id = c.symbol_id AND c.loaded_at >= s.loaded_at AND (s.deleted_at IS NULL OR c.loaded_at < s.deleted_at))
  UNION
  SELECT 'imports', i.import_id, i.loaded_at FROM imports i JOIN canon k ON k.path = i.resolved_path
    WHERE NOT EXISTS (SELECT 1 FROM source_files s JOIN canon q ON q.path = s.file_path WHERE s.repo = i.repo AND q.cpath = k.cpath AND i.loaded_at >= s.loaded_at AND (s.deleted_at IS NULL OR i.loaded_at < s.deleted_at))
)
"""

_SNAPSHOTS = """
WITH RECURSIVE reports AS (SELECT DISTINCT repo, version_id, parent_version FROM reindex_reports),
files AS (SELECT repo, version_id, file_path, max(lower(file_hash)) AS hash FROM file_snapshots GROUP BY ALL),
have AS (SELECT DISTINCT repo, version_id FROM files),
up AS (
  SELECT r.repo, r.version_id, r.parent_version AS anc FROM reports r JOIN have USING (repo, version_id)
  UNION ALL
  SELECT u.repo, u.version_id, p.parent_version FROM up u JOIN reports p ON p.repo = u.repo AND p.version_id = u.anc WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.repo = u.repo AND h.version_id = u.anc)
),
pairs AS (SELECT u.repo, u.version_id, u.anc FROM up u JOIN have h ON h.repo = u.repo AND h.version_id = u.anc),
old AS (SELECT p.version_id, f.file_path, f.hash FROM pairs p JOIN files f ON f.repo = p.repo AND f.version_id = p.anc),
new AS (SELECT p.version_id, f.file_path, f.hash FROM pairs p JOIN files f ON f.repo = p.repo AND f.version_id = p.version_id),
came AS (SELECT n.*, row_number() OVER (PARTITION BY version_id, hash ORDER BY file_path) AS k FROM new n ANTI JOIN old o USING (version_id, file_path)),
went AS (SELECT o.*, row_number() OVER (PARTITION BY version_id, hash ORDER BY file_path) AS k FROM old o ANTI JOIN new n USING (version_id, file_path)),
found AS (
  SELECT n.version_id, 'modified' AS status, n.file_path, '' AS old_path FROM new n JOIN old o USING (version_id, file_path) WHERE n.hash IS DISTINCT FROM o.hash
  UNION ALL SELECT c.version_id, CASE WHEN w.file_path IS NULL THEN 'added' ELSE 'renamed' END, c.file_path, coalesce(w.file_path, '') FROM came c LEFT JOIN went w ON w.version_id = c.version_id AND w.hash = c.hash AND w.k = c.k
  UNION ALL SELECT w.version_id, 'deleted', w.file_path, '' FROM went w ANTI JOIN came c ON w.version_id = c.version_id AND w.hash = c.hash AND w.k = c.k
)
"""

ORACLES = {
    "p2_found": _RUNS + "SELECT version_id, family_id FROM diff",
    "p2_changes": _RUNS
    + """
SELECT r.version_id, r.parent_version, r.chunks_carried, r.embed_calls, count(*) FILTER (WHERE d.family_id IS NOT NULL AND d.old IS NULL) AS added,
  count(*) FILTER (WHERE d.old IS NOT NULL AND d.new IS NOT NULL) AS changed, count(*) FILTER (WHERE d.old IS NOT NULL AND d.new IS NULL) AS removed
FROM reports r LEFT JOIN diff d USING (version_id) WHERE r.manifest_path IS NOT NULL GROUP BY ALL""",
    "p2_store": """
WITH f AS (SELECT repo || '/' || family_id AS family, changed_at, change_id, arrived_at, CASE WHEN op <> 'delete' THEN content_hash END AS state FROM chunk_feed WHERE repo IS NOT NULL AND family_id IS NOT NULL AND arrived_at IS NOT NULL),
m AS (SELECT make_timestamp((epoch_us(min(arrived_at)) + epoch_us(max(arrived_at))) // 2) AS t FROM f),
a AS (SELECT family, arg_max(struct_pack(s := state), struct_pack(x := changed_at, y := change_id)).s AS state FROM f, m WHERE arrived_at <= t GROUP BY ALL), b AS (SELECT family, arg_max(struct_pack(s := state), struct_pack(x := changed_at, y := change_id)).s AS state FROM f GROUP BY ALL),
x AS (SELECT * FROM a WHERE state IS NOT NULL), y AS (SELECT * FROM b WHERE state IS NOT NULL)
SELECT family, CASE WHEN x.state IS NULL THEN 'added' WHEN y.state IS NULL THEN 'removed' ELSE 'changed' END AS change, y.state AS state FROM x FULL JOIN y USING (family) WHERE x.state IS DISTINCT FROM y.state""",
    "p3_found": _ORPHANS + "SELECT ref_table, ref_id FROM orphan",
    "p3_report": _ORPHANS
    + """,
refs AS (
  SELECT 'calls' AS ref_table, call_id AS ref_id, loaded_at FROM calls WHERE callee_id IS NOT NULL
  UNION SELECT 'imports', import_id, loaded_at FROM imports WHERE resolved_path IS NOT NULL
  UNION SELECT 'exports', export_id, loaded_at FROM exports WHERE symbol_id IS NOT NULL
)
SELECT r.ref_table, strftime(r.loaded_at, '%Y-%m') AS month, count(*) AS refs, count(o.ref_id) AS orphans
FROM refs r LEFT JOIN orphan o ON o.ref_table = r.ref_table AND o.ref_id = r.ref_id GROUP BY ALL""",
    "p6_found": _SNAPSHOTS + "SELECT version_id, status, file_path, old_path FROM found",
    "p6_summary": _SNAPSHOTS + "SELECT version_id, status, count(*) AS n FROM found GROUP BY ALL",
}
