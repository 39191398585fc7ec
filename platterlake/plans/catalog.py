"""The disc-image computations as queries over ordinary tables, each with SQL to compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import columns as C
from ..operators import extents as X
from ..operators import volumes as V
from ..operators.ranges import previous, running_sum
from ..operators.trees import reach, walk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str) -> Callable:
    """Register a function (spark, sf_dir) under its name, with DuckDB SQL to compare it to."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return put


# --- walks -------------------------------------------------------------------------


@query("""
WITH RECURSIVE edges AS (
  SELECT 'r' || r_regionkey AS id, '$' AS parent, r_name AS leaf FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CAST(o_orderkey AS VARCHAR) FROM orders),
w AS (SELECT '$' AS id, '$' AS path, 0 AS depth
  UNION ALL SELECT e.id, w.path || '.' || e.leaf, w.depth + 1 FROM w JOIN edges e ON e.parent = w.id)
SELECT path, CAST(depth AS INTEGER) AS depth FROM w
""")
def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all objects below the root, by joins down the levels."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    t = lambda n: table(spark, sf_dir, n)
    return walk([
        t("region").select(key("r", "r_regionkey").alias("id"), F.lit("$").alias("parent"), F.col("r_name").alias("leaf")),
        t("nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("leaf")),
        t("customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent"), F.col("c_name").alias("leaf")),
        t("orders").select(key("o", "o_orderkey").alias("id"), key("c", "o_custkey").alias("parent"), F.col("o_orderkey").cast("string").alias("leaf")),
    ]).select("path", "depth")


@query("""
SELECT doc_id, first_id, doc_id <> first_id AS revisited
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS first_id FROM documents) d
""")
def visited_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of one fingerprint: the first is walked, the others are revisits."""
    docs = table(spark, sf_dir, "documents")
    return V.first_visits(docs, "doc_id", F.md5(F.coalesce("text", F.lit(""))))


@query("""
WITH RECURSIVE w AS (
  SELECT conv_id, turn, 1 AS hops FROM conversations WHERE turn = 0
  UNION ALL SELECT c.conv_id, c.turn, w.hops + 1 FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1)
SELECT conv_id, CAST(max(hops) AS BIGINT) AS reached, max(turn) AS last_turn FROM w GROUP BY conv_id
""")
def linked_list_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each chain of turns is linked from its head: up to the first missing one."""
    return V.chain_lengths(table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumnRenamed("last", "last_turn")


@query("""
WITH RECURSIVE n AS (SELECT max(p_partkey) AS n FROM part),
e AS (SELECT p_partkey AS parent, unnest([p_partkey * 2 % n, (p_partkey * 2 + 1) % n]) AS child FROM part, n),
w AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT CAST(e.child AS BIGINT), w.depth + 1 FROM w JOIN e ON e.parent = w.id WHERE w.depth < 30)
SELECT id, min(depth) AS depth FROM w GROUP BY id
""")
def cycle_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a graph with cycles, each visited once."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("parent"))
    n = part.agg(F.max("parent")).first()[0] or 1
    edges = part.select("parent", F.explode(F.array(F.col("parent") * 2 % n, (F.col("parent") * 2 + 1) % n)).alias("child"))
    return reach(edges, 1, "long")


# --- counts and reports ------------------------------------------------------------

@query("""
SELECT source, lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (source, lang)
""")
def verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each part, of each volume and of all."""
    return V.totals(table(spark, sf_dir, "documents"), ["source", "lang"], "n_chars")

@query("""
SELECT d.source, count(*) AS entries, CAST(sum(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad,
  2 * sum(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END) <= count(*) AS plausible
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source
""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogues stand unless most entries are bad."""
    entries = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return V.plausible(entries, ["source"], F.col("quality") == 0)

@query("""
SELECT l_returnflag, l_linestatus, bit_xor(l_orderkey * 8 + l_linenumber) AS cross_check, count(*) AS zones,
  bit_xor((l_orderkey * 8 + l_linenumber) & 255) = 255 AS ok
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def cross_check_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("byte"))
    return V.cross_checks(zones, ["l_returnflag", "l_linestatus"], "byte")

@query("""
SELECT o_orderpriority AS volume, CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) AS BIGINT) AS zones_ok, count(*) AS zones,
  min(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) = 1 AS all_ok
FROM orders GROUP BY o_orderpriority
""")
def zone_check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "volume")
    return V.zone_counts(zones, ["volume"], F.col("o_orderstatus") != "P")

@query("""
SELECT 'FileCore' AS filesystem, d.source AS disc_name, count(*) AS files, CAST(sum(d.n_chars) AS BIGINT) AS disc_size,
  CAST(sum(CASE WHEN l.quality = 1 THEN 1 END) AS BIGINT) AS checks_ok, CAST(sum(CASE WHEN l.quality IS NOT NULL THEN 1 END) AS BIGINT) AS checks,
  coalesce(max(l.toxic), 0) = 0 AS root_ok,
  'Filesystem:      FileCore' || chr(10) || 'Disc name:       ' || d.source || chr(10) || 'Disc size:       ' || CAST(CAST(sum(d.n_chars) AS BIGINT) AS VARCHAR) || ' bytes' AS text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source
""")
def disc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of volumes, as columns and as text."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    sums = docs.groupBy(F.col("source").alias("disc_name")).agg(
        F.count("*").alias("files"),
        F.sum("n_chars").cast("long").alias("disc_size"),
        F.sum(F.when(F.col("quality") == 1, 1)).alias("checks_ok"),
        F.sum(F.when(F.col("quality").isNotNull(), 1)).alias("checks"),
        (F.coalesce(F.max("toxic"), F.lit(0)) == 0).alias("root_ok"),
    )
    kind = F.lit("FileCore")
    text = V.report_lines(filesystem=kind, disc_name=F.col("disc_name"), disc_size=F.concat_ws(" ", F.col("disc_size").cast("string"), F.lit("bytes")))
    return sums.select(kind.alias("filesystem"), "*", text.alias("text"))

@query("""
SELECT a.l_orderkey AS image, f.field,
  CASE f.field WHEN 'quantity' THEN CAST(CAST(a.l_quantity AS BIGINT) AS VARCHAR) WHEN 'flag' THEN a.l_returnflag ELSE a.l_linestatus END AS boot,
  CASE f.field WHEN 'quantity' THEN CAST(CAST(b.l_quantity AS BIGINT) AS VARCHAR) WHEN 'flag' THEN b.l_returnflag ELSE b.l_linestatus END AS zone0
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2
JOIN (VALUES ('quantity'), ('flag'), ('status')) AS f(field) ON
  CASE f.field WHEN 'quantity' THEN a.l_quantity <> b.l_quantity WHEN 'flag' THEN a.l_returnflag <> b.l_returnflag ELSE a.l_linestatus <> b.l_linestatus END
""")
def geometry_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in which the two records of a disc, its first two lines, differ."""
    li = table(spark, sf_dir, "lineitem")
    a, b = li.where("l_linenumber = 1").alias("a"), li.where("l_linenumber = 2").alias("b")
    both = a.join(b, F.col("a.l_orderkey") == F.col("b.l_orderkey"))
    of = lambda c, kind="string": (F.col(f"a.{c}").cast(kind), F.col(f"b.{c}").cast(kind))
    return V.mismatches(both, F.col("a.l_orderkey"), {"quantity": of("l_quantity", "long"), "flag": of("l_returnflag"), "status": of("l_linestatus")})

#: Codes of faults and their severities: fixed values of the reports.
FAULTS = {
    "boot_block_checksum_mismatch": "warning",
    "zone_checksum_mismatch": "warning",
    "zone_cross_check_mismatch": "warning",
    "disc_record_geometry_mismatch": "warning",
    "directory_warning": "warning",
    "broken_directory": "damage",
    "unreadable_directory": "damage",
    "unreadable_file": "damage",
    "directory_cycle": "damage",
}


@query("""
WITH f AS (
  SELECT doc_id, 'unreadable_file' AS code FROM documents WHERE n_chars < 200
  UNION ALL SELECT doc_id, 'broken_directory' FROM labels WHERE quality = 0
  UNION ALL SELECT doc_id, 'directory_warning' FROM labels WHERE toxic = 1
  UNION ALL SELECT doc_id, 'directory_cycle' FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS n FROM documents) WHERE n > 1)
SELECT CASE WHEN code = 'directory_warning' THEN 'warning' ELSE 'damage' END AS severity, code, doc_id,
  '{"severity":"' || CASE WHEN code = 'directory_warning' THEN 'warning' ELSE 'damage' END || '","code":"' || code || '","path":"$.' || doc_id || '"}' AS line FROM f
""")
def diagnostics_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of all kinds as one table and as JSON lines."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    again = seen.join(seen.groupBy("h").agg(F.min("doc_id").alias("first")), "h").where("doc_id <> first")
    parts = [(docs.where("n_chars < 200"), "unreadable_file"), (labels.where("quality = 0"), "broken_directory"), (labels.where("toxic = 1"), "directory_warning"), (again, "directory_cycle")]
    rows = None
    for df, code in parts:
        part = df.select(F.lit(FAULTS[code]).alias("severity"), F.lit(code).alias("code"), "doc_id")
        rows = part if rows is None else rows.unionAll(part)
    path = F.concat(F.lit("$."), F.col("doc_id").cast("string"))
    return rows.withColumn("line", F.to_json(F.struct("severity", "code", path.alias("path"))))


# --- extents -----------------------------------------------------------------------


@query("""
SELECT doc_id, o * 256 AS at, least(256, octet_length(encode(text)) - o * 256) AS n
FROM (SELECT doc_id, text, unnest(range(0, (octet_length(encode(text)) + 255) // 256)) AS o FROM documents)
""")
def chunked_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return X.chunks(docs, F.col("size"), 256).select("doc_id", "at", "n")


@query("""
SELECT source, doc_id, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM documents
""")
def layout_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document starts if those of a source are laid end to end."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return running_sum(docs, ["source"], "doc_id", "n_chars", "base").select("source", "doc_id", "base")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as objects, their lines as extents."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("start"), F.col("l_quantity").cast("long").alias("length"))


_PREFIX = """
WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey AS start, CAST(l_quantity AS BIGINT) AS length,
  CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM lineitem)
"""


@query(_PREFIX + "SELECT l_orderkey, l_linenumber, start, greatest(0, least(length, 40 - before)) AS length FROM e WHERE greatest(0, least(length, 40 - before)) > 0")
def extent_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.truncate(_lines(spark, sf_dir), ["l_orderkey"], ["l_linenumber", "start", "length"], "length", F.lit(40))


@query(_PREFIX + ", c AS (SELECT *, least(length, greatest(0, 40 - before)) AS cut FROM e) SELECT l_orderkey, l_linenumber, start + cut AS start, length - cut AS length FROM c WHERE length > cut")
def extent_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.trim(_lines(spark, sf_dir), ["l_orderkey"], ["l_linenumber", "start", "length"], "start", "length", F.lit(40))


@query("""
WITH e AS (SELECT o_custkey, o_orderkey, o_orderkey // 4 AS start, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS length FROM orders),
n AS (SELECT *, CASE WHEN lag(start + length) OVER w = start THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY o_custkey % 50 ORDER BY o_orderkey)),
r AS (SELECT o_custkey % 50 AS volume, start, length, sum(new) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS ord FROM n)
SELECT volume, CAST(ord AS BIGINT) AS ord, min(start) AS start, CAST(sum(length) AS BIGINT) AS length FROM r GROUP BY volume, ord
""")
def extent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("volume"), "o_orderkey", F.floor(F.col("o_orderkey") / 4).cast("long").alias("start"), F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(1).alias("length"))
    return X.merge_adjacent(e, ["volume"], "o_orderkey", "start", "length").select("volume", F.col("ord").cast("long").alias("ord"), "start", "length")


_SECTORS = "(SELECT p_partkey AS id, p_partkey % 2560 AS s FROM part)"


def _sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 2560).alias("s"))


@query(f"SELECT id, s % 16 + (s // 16 % 80 * 2 + s // 16 // 80) * 16 AS large, s % 1280 AS medium, s % 640 AS small FROM {_SECTORS}")
def geometry_sml(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, g = F.col("s"), lambda x, t, h: C.sml_sector(x, F.lit(t), F.lit(h)).cast("long")
    return _sectors(spark, sf_dir).select("id", g(s, 80, 2).alias("large"), g(s % 1280, 80, 1).alias("medium"), g(s % 640, 40, 1).alias("small"))


@query(f"SELECT id, s % 10 + s // 10 * 2 * 10 AS side0, s % 10 + (s // 10 * 2 + 1) * 10 AS side1 FROM {_SECTORS}")
def geometry_dsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sectors(spark, sf_dir).select("id", C.dsd_sector(F.col("s"), F.lit(0)).cast("long").alias("side0"), C.dsd_sector(F.col("s"), F.lit(1)).cast("long").alias("side1"))


@query(f"SELECT id, s AS seq, s // 16 % 80 * 32 + s // 16 // 80 * 16 + s % 16 AS by_int, s // 16 % 2 * 1280 + s // 16 // 2 * 16 + s % 16 AS by_mux FROM {_SECTORS}")
def geometry_afs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: C.interleaved(F.col("s"), F.lit(k), F.lit(16)).cast("long")
    return _sectors(spark, sf_dir).select("id", at("seq").alias("seq"), at("int").alias("by_int"), at("mux").alias("by_mux"))


_RUNS = """
WITH runs AS (SELECT source, doc_id AS id, n_chars AS length,
  CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents),
bad AS (SELECT r.source, r.start + 100 AS start, r.length FROM runs r JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l ON r.id = l.doc_id),
hit AS (SELECT r.source, r.id, r.start, r.length, greatest(r.start, b.start) AS lo, least(r.start + r.length, b.start + b.length) AS hi
  FROM runs r JOIN bad b ON r.source = b.source AND r.start < b.start + b.length AND b.start < r.start + r.length WHERE r.length > 0 AND b.length > 0),
gaps AS (SELECT *, coalesce(lag(hi) OVER w, start) AS f, lead(lo) OVER w IS NULL AS last FROM hit WINDOW w AS (PARTITION BY source, id ORDER BY lo)),
seg AS (SELECT source, id, f AS seg_start, lo - f AS seg_length, 'good' AS status FROM gaps WHERE lo > f
  UNION ALL SELECT source, id, lo, hi - lo, 'bad' FROM gaps
  UNION ALL SELECT source, id, hi, start + length - hi, 'good' FROM gaps WHERE last AND start + length > hi
  UNION ALL SELECT source, id, start, length, 'good' FROM runs r WHERE length > 0 AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.id = r.id AND h.source = r.source))
"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid end to end by source as files; toxic ones, moved on by 100, as bad ranges."""
    docs = table(spark, sf_dir, "documents")
    runs = running_sum(docs.select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars", "start")
    runs = runs.select("source", F.col("doc_id").alias("id"), "start", F.col("n_chars").alias("length"))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    bad = runs.join(toxic, "id").select("source", (F.col("start") + 100).alias("start"), "length")
    return X.segments(runs, bad, "source", 1 << 16)


@query(_RUNS + "SELECT * FROM seg")
def rescue_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


@query(_RUNS + """, f AS (SELECT source, id, CAST(sum(CASE WHEN status = 'good' THEN seg_length ELSE 0 END) AS BIGINT) AS good, CAST(sum(CASE WHEN status = 'bad' THEN seg_length ELSE 0 END) AS BIGINT) AS bad FROM seg GROUP BY source, id)
SELECT source, count(*) AS files, CAST(sum(CASE WHEN good = 0 THEN 1 ELSE 0 END) AS BIGINT) AS wholly_bad,
  CAST(sum(CASE WHEN good > 0 THEN good ELSE 0 END) AS BIGINT) AS written_skip, CAST(sum(CASE WHEN good > 0 THEN good + bad ELSE 0 END) AS BIGINT) AS written_fill FROM f GROUP BY source""")
def rescue_policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes written under each policy; files without a good byte are skipped."""
    of = lambda s: F.sum(F.when(F.col("status") == s, F.col("seg_length")).otherwise(0))
    f = _segments(spark, sf_dir).groupBy("source", "id").agg(of("good").alias("good"), of("bad").alias("bad"))
    some = lambda x: F.sum(F.when(F.col("good") > 0, x).otherwise(0))
    return f.groupBy("source").agg(F.count("*").alias("files"), F.sum(F.when(F.col("good") == 0, 1).otherwise(0)).alias("wholly_bad"), some(F.col("good")).alias("written_skip"), some(F.col("good") + F.col("bad")).alias("written_fill"))


@query("""
WITH f AS (SELECT l_partkey AS id, string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber) AS extents, count(*) AS fragments FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_partkey)
SELECT p_partkey AS sin, f.extents, coalesce(f.fragments, 0) AS fragments, f.id IS NULL AS missing FROM part LEFT JOIN f ON p_partkey = f.id
""")
def fragment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with the extents of their fragments in order; a missing fragment is told."""
    li = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))), lambda x: F.concat_ws(":", x["l_orderkey"].cast("string"), x["l_linenumber"].cast("string")))
    f = li.groupBy("l_partkey").agg(F.array_join(parts, ",").alias("extents"), F.count("*").alias("n"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sin"))
    return p.join(f, F.col("sin") == F.col("l_partkey"), "left").select("sin", "extents", F.coalesce("n", F.lit(0)).alias("fragments"), F.col("n").isNull().alias("missing"))


@query("""
SELECT p.o_orderkey AS zone, CASE WHEN p.o_orderstatus <> 'P' THEN 'primary' WHEN b.l_linestatus = 'F' THEN 'backup' ELSE 'primary' END AS used,
  p.o_orderstatus <> 'P' OR coalesce(b.l_linestatus = 'F', FALSE) AS ok
FROM orders p LEFT JOIN (SELECT l_orderkey, l_linestatus FROM lineitem WHERE l_linenumber = 1) b ON p.o_orderkey = b.l_orderkey
""")
def backup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones, and which of their two copies serves."""
    backup = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", (F.col("l_linestatus") == "F").alias("good"))
    zones = table(spark, sf_dir, "orders").join(backup, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return zones.select(F.col("o_orderkey").alias("zone"), V.chosen_copy(F.col("o_orderstatus") != "P", F.col("good")).alias("c")).select("zone", "c.*")

# --- checksums ---------------------------------------------------------------------

_BYTES = "list_transform(range(0, octet_length(d)), lambda i: ('0x' || substr(hex(d), CAST(i * 2 + 1 AS INTEGER), 2))::BIGINT)"
_PADDED = "(SELECT item_id, encode(rpad(regexp_replace(text, '[^\\x20-\\x7e]', '?', 'g'), {n}, '~')) AS d FROM benchmark)"
_WORDS = "list_transform(range(0, octet_length(d) // 4), lambda i: ('0x' || substr(hex(d), CAST(i * 8 + 7 AS INTEGER), 2) || substr(hex(d), CAST(i * 8 + 5 AS INTEGER), 2) || substr(hex(d), CAST(i * 8 + 3 AS INTEGER), 2) || substr(hex(d), CAST(i * 8 + 1 AS INTEGER), 2))::BIGINT)"
_FOLD = "SELECT item_id, CAST(xor(g, g >> 8) & 255 AS BIGINT) AS check_byte FROM (SELECT item_id, xor(s, s >> 16) AS g FROM ({q}))"


def _sector(spark: SparkSession, sf_dir: str, n: int) -> tuple[DataFrame, object]:
    """Benchmark texts as sectors of ``n`` ASCII bytes."""
    text = F.rpad(F.regexp_replace("text", r"[^\x20-\x7e]", "?"), n, "~")
    return table(spark, sf_dir, "benchmark").select("item_id", F.encode(text, "UTF-8").alias("d")), F.col("d")


@query(f"SELECT item_id, list_reduce(list_prepend(0::BIGINT, list_slice({_BYTES}, 1, 511)), lambda s, b: CASE WHEN s + b > 255 THEN (s + b + 1) & 255 ELSE s + b END) & 255 AS check_byte FROM {_PADDED.format(n=512)}")
def checksum_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, d = _sector(spark, sf_dir, 512)
    return df.select("item_id", C.boot_checksum(d).alias("check_byte"))


@query(f"SELECT item_id, list_reduce(list_prepend(255::BIGINT, list_reverse(list_slice({_BYTES}, 1, 255))), lambda s, b: CASE WHEN s > 255 THEN (s + 1) & 255 ELSE s END + b) & 255 AS check_byte FROM {_PADDED.format(n=256)}")
def checksum_oldmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, d = _sector(spark, sf_dir, 256)
    return df.select("item_id", C.old_map_checksum(d).alias("check_byte"))


@query(_FOLD.format(q=f"SELECT item_id, (list_reduce(list_prepend(0::BIGINT, list_reverse({_WORDS})), lambda s, w: (s & 4294967295) + w + (s >> 32)) - ('0x' || substr(hex(d), 1, 2))::BIGINT) & 4294967295 AS s FROM {_PADDED.format(n=512)}"))
def checksum_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, d = _sector(spark, sf_dir, 512)
    return df.select("item_id", C.zone_check(d).alias("check_byte"))


@query(_FOLD.format(q=f"SELECT item_id, list_reduce(list_prepend(0::BIGINT, list_concat({_WORDS}, list_slice({_BYTES}, 257, 259))), lambda c, w: xor(w, ((c >> 13) + ((c & 8191) << 19)) & 4294967295)) AS s FROM {_PADDED.format(n=259)}"))
def checksum_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, d = _sector(spark, sf_dir, 259)
    return df.select("item_id", C.dir_checksum(d).alias("check_byte"))


# The four above read one padded sector of each text, as their SQL does; these read whole texts.
_WHOLE = "(SELECT item_id, regexp_replace(text, '[^\\x20-\\x7e]', '?', 'g') AS t FROM benchmark)"
_WHOLE_SECTORS = "(SELECT item_id, sector, encode(rpad(substr(t, CAST(sector * {n} + 1 AS INTEGER), {n}), {n}, '~')) AS d FROM (SELECT item_id, t, unnest(range(0, greatest(1, (length(t) + {n} - 1) // {n}))) AS sector FROM " + _WHOLE + "))"


def _whole_sectors(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(item_id, sector, d): all of each benchmark text in sectors of ``n`` ASCII bytes, the last one padded."""
    whole = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x20-\x7e]", "?").alias("t")).where("t is not null")
    last = F.greatest(F.lit(0), F.floor((F.length("t") - 1) / n)).cast("long")
    rows = whole.select("item_id", "t", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("sector"))
    part = F.rpad(F.substr("t", (F.col("sector") * n + 1).cast("int"), F.lit(n)), n, "~")
    return rows.select("item_id", "sector", F.encode(part, "UTF-8").alias("d"))


@query(f"SELECT item_id, sector, list_reduce(list_prepend(0::BIGINT, list_slice({_BYTES}, 1, 511)), lambda s, b: CASE WHEN s + b > 255 THEN (s + b + 1) & 255 ELSE s + b END) & 255 AS check_byte FROM {_WHOLE_SECTORS.format(n=512)}")
def checksum_boot_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_sectors(spark, sf_dir, 512).select("item_id", "sector", C.boot_checksum(F.col("d")).alias("check_byte"))


@query(f"SELECT item_id, sector, list_reduce(list_prepend(255::BIGINT, list_reverse(list_slice({_BYTES}, 1, 255))), lambda s, b: CASE WHEN s > 255 THEN (s + 1) & 255 ELSE s END + b) & 255 AS check_byte FROM {_WHOLE_SECTORS.format(n=256)}")
def checksum_oldmap_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_sectors(spark, sf_dir, 256).select("item_id", "sector", C.old_map_checksum(F.col("d")).alias("check_byte"))


@query(_FOLD.replace("item_id", "item_id, sector").format(q=f"SELECT item_id, sector, (list_reduce(list_prepend(0::BIGINT, list_reverse({_WORDS})), lambda s, w: (s & 4294967295) + w + (s >> 32)) - ('0x' || substr(hex(d), 1, 2))::BIGINT) & 4294967295 AS s FROM {_WHOLE_SECTORS.format(n=512)}"))
def checksum_zone_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_sectors(spark, sf_dir, 512).select("item_id", "sector", C.zone_check(F.col("d")).alias("check_byte"))


@query(_FOLD.format(q=f"SELECT item_id, list_reduce(list_prepend(0::BIGINT, list_concat({_WORDS}, list_slice({_BYTES}, octet_length(d) // 4 * 4 + 1, octet_length(d)))), lambda c, w: xor(w, ((c >> 13) + ((c & 8191) << 19)) & 4294967295)) AS s FROM (SELECT item_id, encode(t) AS d FROM {_WHOLE})"))
def checksum_dir_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.encode(F.regexp_replace("text", r"[^\x20-\x7e]", "?"), "UTF-8")
    return table(spark, sf_dir, "benchmark").select("item_id", C.dir_checksum(whole).alias("check_byte"))


_CRC = """
WITH t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i::BIGINT, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc)
"""


@query(_CRC + f"SELECT item_id, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b: xor(crc[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)), 4294967295) AS crc32 FROM (SELECT item_id, encode(text) AS d FROM benchmark), t")
def file_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.crc32(F.encode("text", "UTF-8")).alias("crc32"))


# --- names, times, attributes ------------------------------------------------------

_LEAF = "regexp_extract(url, '([^/]*)$', 1)"


@query(f"""
WITH l AS (SELECT page_id, translate({_LEAF} || CASE page_id % 7 WHEN 0 THEN '/x?y<z' WHEN 1 THEN '*|"' ELSE '' END, '/?<>+=;', '.#$^&@%') AS t FROM pages
  UNION ALL SELECT -1, '' UNION ALL SELECT -2, '.' UNION ALL SELECT -3, '..'),
h AS (SELECT page_id, t, translate(t, '\\/:*?"<>|', '         ') AS p FROM l)
SELECT page_id, CASE p WHEN '' THEN '_empty_name_' WHEN '.' THEN '_dot_' WHEN '..' THEN '_dotdot_' ELSE p END AS host, t IN ('', '.', '..') AS substituted,
  CASE p WHEN '' THEN '_empty_name_' WHEN '.' THEN '_dot_' WHEN '..' THEN '_dotdot_' ELSE p END || CASE WHEN page_id % 3 = 0 THEN '' ELSE printf(',%03x', 4000 + page_id % 96) END AS leaf FROM h
""")
def host_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of pages, and three that a host cannot hold, as host names."""
    more = F.when(F.col("page_id") % 7 == 0, "/x?y<z").when(F.col("page_id") % 7 == 1, '*|"').otherwise("")
    names = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "([^/]*)$", 1), more).alias("name"))
    extra = spark.range(3).select((-1 - F.col("id")).alias("page_id"), F.repeat(F.lit("/"), F.col("id").cast("int")).alias("name"))
    n, kind = F.col("name"), F.when(F.col("page_id") % 3 != 0, 4000 + F.col("page_id") % 96)
    return names.union(extra).select("page_id", C.host_name(n).alias("host"), C.reserved(n).alias("substituted"), C.suffixed(C.host_name(n), kind, F.lit(False)).alias("leaf"))


@query(f"""
WITH b AS (SELECT item_id, {_BYTES} AS bs FROM (SELECT item_id, encode(substr(text, 1, CAST(item_id % 12 AS INTEGER))) AS d FROM benchmark)),
n AS (SELECT item_id, len(bs) = 0 OR len(list_filter(bs, lambda b: b < 33 OR b > 126 OR b = 37 OR b = 34)) > 0 AS q,
  array_to_string(list_transform(bs, lambda b: CASE WHEN b < 33 OR b > 126 OR b = 37 OR b = 34 THEN printf('%%%02X', b) ELSE chr(CAST(b AS INTEGER)) END), '') AS s FROM b)
SELECT item_id, CASE WHEN q THEN '"' || coalesce(s, '') || '"' ELSE s END || printf(' %08x %08x %08x %02x CRC32=%08X DATETIME=', 4294901760 + item_id, item_id * 7919, item_id * 31, item_id % 64, 3735928559 - item_id)
  || strftime(make_timestamp((item_id * 86413 - 1000000000) * 1000000), '%Y%m%d%H%M%S') AS line FROM n
""")
def inf_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    name = F.encode(F.substr("text", F.lit(1), (i % 12).cast("int")), "UTF-8")
    line = C.inf_line(name, F.lit(4294901760) + i, i * 7919, i * 31, i % 64, F.lit(3735928559) - i, i * 86413 - 1000000000)
    return table(spark, sf_dir, "benchmark").select("item_id", line.alias("line"))


@query("""
WITH c AS (SELECT event_id, epoch_us(ts) // 10000 + 220898880000 AS centis, event_id % 4096 AS kind FROM events),
e AS (SELECT event_id, centis, 4293918720 + (kind << 8) + (centis >> 32) AS load, centis & 4294967295 AS exec FROM c)
SELECT event_id, load, exec, (load >> 8) & 4095 AS filetype, (((load & 255) << 32) + exec) // 100 - 2208988800 AS unix_secs, ((load & 255) << 32) + exec = centis AS same FROM e
""")
def load_exec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    centis = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 10000).cast("long") + 220898880000
    e = table(spark, sf_dir, "events").select("event_id", centis.alias("centis"))
    e = e.select("event_id", "centis", C.encode_load(F.col("event_id") % 4096, F.col("centis")).alias("load"), F.col("centis").bitwiseAND(C.long(C.MASK)).alias("exec"))
    load, exec_ = F.col("load"), F.col("exec")
    return e.select("event_id", "load", "exec", C.filetype(load).alias("filetype"), C.unix_seconds(load, exec_).cast("long").alias("unix_secs"), (C.centiseconds(load, exec_) == F.col("centis")).alias("same"))


@query("""
WITH p AS (SELECT o_orderkey, o_orderkey * 40503 & 65535 AS d FROM orders),
f AS (SELECT o_orderkey, d, d & 31 AS day, (d >> 8) & 15 AS month, 1981 + ((d & 255) >> 5) * 16 + (d >> 12) AS year FROM p)
SELECT o_orderkey, d AS packed, try_cast(printf('%04d-%02d-%02d', year, month, day) AS DATE) AS modified FROM f
""")
def afs_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = (F.col("o_orderkey") * 40503).bitwiseAND(C.long(65535))
    return table(spark, sf_dir, "orders").select("o_orderkey", d.alias("packed")).select("o_orderkey", "packed", C.packed_date(F.col("packed").cast("int")).alias("modified"))


@query("""
SELECT l_orderkey, l_linenumber, nfs, (nfs & 1) * 16 + (nfs & 2) * 16 + (nfs & 4) // 4 + (nfs & 8) // 4 + (nfs & 16) // 4 + (nfs & 32) // 4 AS attrs, (nfs & 16) <> 0 AS locked
FROM (SELECT l_orderkey, l_linenumber, (l_partkey + l_suppkey) & 63 AS nfs FROM lineitem) x
""")
def attr_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    nfs = (F.col("l_partkey") + F.col("l_suppkey")).bitwiseAND(C.long(63))
    bits = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", nfs.alias("nfs"))
    return bits.select("*", C.access(F.col("nfs").cast("int")).cast("long").alias("attrs"), (F.col("nfs").bitwiseAND(C.long(16)) != 0).alias("locked"))


@query("""
SELECT c_nationkey AS dir, count(*) AS entries, bool_and(ok) AS sorted FROM (
  SELECT c_nationkey, coalesce(lag(k) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= k, TRUE) AS ok
  FROM (SELECT c_nationkey, c_custkey, encode(translate(CASE WHEN c_custkey % 40 = 0 THEN c_mktsegment ELSE c_name END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS k FROM customer)) GROUP BY c_nationkey
""")
def collation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories whose entries are in collation order."""
    key = C.collation_key(F.when(F.col("c_custkey") % 40 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name")))
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", key.alias("k"))
    c = previous(c, ["c_nationkey"], "c_custkey", F.col("k"), "before")
    return c.withColumn("ok", F.coalesce(F.col("before") <= F.col("k"), F.lit(True))).groupBy(F.col("c_nationkey").alias("dir")).agg(F.count("*").alias("entries"), F.bool_and("ok").alias("sorted"))


@query("""
SELECT page_id, CASE WHEN substr(html, 1, 9) = '<!DOCTYPE' OR substr(html, 1, 9) = '<!doctype' THEN 'doctype' WHEN substr(html, 1, 5) = '<html' THEN 'html' WHEN substr(html, 1, 1) = '<' THEN 'markup' ELSE 'text' END AS kind FROM pages
""")
def content_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages are, by how they start."""
    kinds = (("<!DOCTYPE", "doctype"), ("<!doctype", "doctype"), ("<html", "html"), ("<", "markup"))
    return table(spark, sf_dir, "pages").select("page_id", V.sniffed(F.col("html"), kinds, "text").alias("kind"))

@query("""
SELECT source AS label, count(*) AS files, count(*) > 1 AS own_directory FROM documents WHERE source = 'src0' OR source = 'src1' GROUP BY source
""")
def partition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.own_directories(table(spark, sf_dir, "documents"), "source", ["src0", "src1"])

@query("""
SELECT s_suppkey, CASE WHEN n = 1 THEN label ELSE label || '-' || CAST(n - 1 AS VARCHAR) END AS label FROM (
  SELECT s_suppkey, label, row_number() OVER (PARTITION BY label ORDER BY s_suppkey) AS n FROM (SELECT s_suppkey, 'vol' || CAST(s_nationkey AS VARCHAR) AS label FROM supplier) a) b
""")
def unique_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("vol"), F.col("s_nationkey").cast("string"))
    return V.unique_labels(table(spark, sf_dir, "supplier"), "s_suppkey", label)


@query("""
SELECT k AS literal, CASE WHEN k LIKE '0x%' THEN k::BIGINT WHEN k LIKE '0%' AND length(k) > 1 THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(k, 2), ''), lambda c: c::BIGINT)), lambda a, c: a * 8 + c) ELSE k::BIGINT END AS value
FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN printf('0x%x', s_suppkey) WHEN 1 THEN '0' || printf('%o', s_suppkey) ELSE CAST(s_suppkey AS VARCHAR) END AS k FROM supplier)
""")
def rescue_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a rescue map: hexadecimal, octal or decimal."""
    s = F.col("s_suppkey")
    k = F.when(s % 3 == 0, F.format_string("0x%x", s)).when(s % 3 == 1, F.format_string("0%o", s)).otherwise(s.cast("string"))
    plain = F.replace(F.col("literal"), F.lit("_"), F.lit(""))
    value = F.when(plain.rlike("^0[xX]"), F.conv(F.substr(plain, F.lit(3)), 16, 10)).when(plain.rlike("^0."), F.conv(plain, 8, 10)).otherwise(plain)
    return table(spark, sf_dir, "supplier").select(k.alias("literal")).select("literal", value.cast("long").alias("value"))


# --- corpora -----------------------------------------------------------------------


@query("SELECT lang AS map_type, source AS dir_type, count(*) AS discs FROM documents GROUP BY lang, source")
def corpus_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discs of each kind."""
    reports = table(spark, sf_dir, "documents").select(F.col("lang").alias("map_type"), F.col("source").alias("dir_type"))
    return V.tally(reports, ["map_type", "dir_type"])


@query("""
SELECT l_returnflag AS disc, count(*) AS files, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS fragmented
FROM (SELECT l_returnflag, l_orderkey, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_orderkey) GROUP BY l_returnflag
""")
def fragmented_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each disc, and those in more than one extent."""
    return V.fragmented(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "disc"), ["disc"], ["l_orderkey"])


@query("SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def iso_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    return table(spark, sf_dir, "events").select("event_id", C.iso_8601(seconds).alias("stamp"))


@query("SELECT page_id, translate(translate(regexp_extract(url, '([^/]*)$', 1), '.#$^&@%', '/?<>+=;'), '/?<>+=;', '.#$^&@%') AS host, translate(regexp_extract(url, '([^/]*)$', 1), '.#$^&@%', '/?<>+=;') AS name FROM pages")
def names_from_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host names as disc names and back."""
    leaf = table(spark, sf_dir, "pages").select("page_id", C.from_host(F.regexp_extract("url", "([^/]*)$", 1)).alias("name"))
    return leaf.select("page_id", C.to_host(F.col("name")).alias("host"), "name")
