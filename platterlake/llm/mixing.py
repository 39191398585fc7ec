"""Mixing sources to target weights by Pareto order sampling.  DataFrame functions only.

Every document gets the whole copies that its source's ratio grants for certain.  The rest
of the source's words is drawn by Pareto order sampling: documents are ranked by random
odds over inclusion odds, and the ranking is taken from its front up to the words wanted.

Inclusion odds rise with the square root of a document's size and add up: odds times sizes
sum to the words wanted.  Documents whose odds would reach one are certain and leave the
sum, from the largest down.  Random numbers come from the document's id, text and source
and, for rows alike in these, their number, so reruns agree and no two rows share one.

No source is ranked in one task.  Ranks are dealt into ``BINS`` bins by a fixed scale, and
the last of these into ``BINS`` again; the words of bins tell the one in which a source's
draw ends; only documents of that bin are ordered among each other.  A source's odds are found from
its different sizes, of which there are as many rows as sizes.

Defined results: null and blank texts have size 0 and are never drawn; a null source is a
source, the last; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage, table

WEIGHTS, SHARE_PERCENT, MOST_COPIES, BINS = (5, 2, 1), 150, 2, 4096
SEED = "pareto"
#: Sources sent to every executor at most; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def sizes(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, size, digest): the words of each text, and its md5."""
    body = F.coalesce(F.col(text), F.lit(""))
    count = F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+"))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count.cast("long").alias("size"), F.md5(body.cast("binary")).alias("digest"))


def targets(docs: DataFrame) -> DataFrame:
    """(source, docs, source_size, target) from rows (source, size).

    Shares by weight are cut at the caps and the excess shared again by weight.  That ends
    where sources by cap over weight are cut up to the first whose share is below its cap.
    Counts are hundredths of words in exact decimals; one row a source is ordered.
    """
    exact = lambda c: c.cast("decimal(38,0)")
    src = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), place % len(WEIGHTS) + 1)
    src = src.withColumn("w", exact(weight)).withColumn("cap", exact(F.col("source_size") * (100 * MOST_COPIES)))
    order = W.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    zero = exact(F.lit(0))
    src = src.withColumn("total", F.sum(exact(F.col("source_size") * SHARE_PERCENT)).over(every)).withColumn("all_w", F.sum("w").over(every))
    src = src.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), zero)).withColumn("w_before", F.coalesce(F.sum("w").over(before), zero))
    f = lambda c: F.col(c).cast("double")
    src = src.withColumn("cut", f("cap") * (f("all_w") - f("w_before")) <= (f("total") - f("cap_before")) * f("w"))
    src = src.withColumn("cut_cap", F.coalesce(F.sum(F.when(F.col("cut"), F.col("cap"))).over(every), zero)).withColumn("cut_w", F.coalesce(F.sum(F.when(F.col("cut"), F.col("w"))).over(every), zero))
    share = f("w") * ((f("total") - f("cut_cap")) / (f("all_w") - f("cut_w"))) / 100.0
    return src.select("source", "docs", "source_size", F.when(F.col("cut"), f("cap") / 100.0).otherwise(share).alias("target"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with the column ``copy``: equal rows are counted, then dealt out again as copies
    1, 2 and so on, a thousand at a time, so that no task holds them all."""
    alike = docs.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("n"))
    blocks = alike.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1000))))
    copy = F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col("n") - 1000 * F.col("block"))))
    return blocks.select("doc_id", "source", "size", "digest", "block", copy.alias("copy")).withColumn("copy", F.col("copy") + 1000 * F.col("block")).drop("block")


def _uniform() -> Column:
    """A number in (0, 1) from the document: 48 bits of a digest."""
    key = F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest", F.col("copy").cast("string"), "source")
    bits = F.conv(F.substr(F.md5(key.cast("binary")), F.lit(1), F.lit(12)), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 48)


def _root() -> Column:
    """What odds are in proportion to, in whole numbers, so that sums are exact."""
    return F.floor(F.sqrt(F.col("size").cast("double")) * 1024).cast("decimal(38,0)")


def odds(docs: DataFrame) -> DataFrame:
    """(o, scale, certain): for each source o, documents' odds over :func:`_root`, and the words
    of its certain documents, from rows (source, size, rest).

    By size from the largest, a size is certain if its odds reach one once the larger ones are."""
    by_size = docs.where("rest > 0 and size > 0").groupBy("source", "size").agg(F.count("*").alias("n"), F.max("rest").alias("rest"))
    exact = lambda c: c.cast("decimal(38,0)")
    f = lambda c: F.col(c).cast("double")
    by_size = by_size.withColumn("words", exact(F.col("n") * F.col("size"))).withColumn("weight", exact(F.col("words") * _root()))
    larger = W.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, -1)
    left = W.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(W.currentRow, W.unboundedFollowing)
    by_size = by_size.withColumn("sure", F.coalesce(F.sum("words").over(larger), exact(F.lit(0)))).withColumn("weights", F.sum("weight").over(left))
    by_size = by_size.withColumn("full", (f("rest") - f("sure")) / f("weights") * _root().cast("double") >= 1)
    out = by_size.groupBy(F.col("source").alias("o")).agg(F.max("rest").alias("r"), F.coalesce(F.sum(F.when(F.col("full"), F.col("words"))), exact(F.lit(0))).alias("certain"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("left"))
    return out.select("o", ((f("r") - f("certain")) / f("left")).alias("scale"), F.col("certain").cast("double").alias("certain"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, odds) from rows (doc_id,
    source, size, digest); odds are those of one more copy than are sure.

    ``docs`` is read several times: pass a written table.
    """
    src = targets(docs).select(F.col("source").alias("s"), "source_size", "target")
    src = src.withColumn("sure", F.when(F.col("source_size") > 0, F.least(F.lit(MOST_COPIES), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
    src = src.withColumn("rest", F.col("target") - F.col("sure") * F.col("source_size"))
    x = docs.join(src, F.col("source").eqNullSafe(F.col("s")))
    src = stage(src.join(odds(x), F.col("s").eqNullSafe(F.col("o")), "left").drop("o"), "sources")
    # One row a source goes to every executor, so that a source with most rows is not dealt to one task.
    small = F.broadcast if src.count() <= BROADCAST_SOURCES else (lambda df: df)
    x = numbered(docs).join(small(src), F.col("source").eqNullSafe(F.col("s")))
    drawn = (F.col("rest") > 0) & (F.col("size") > 0)
    chance = F.coalesce(F.least(F.col("scale") * _root().cast("double"), F.lit(1.0)), F.lit(1.0))
    x = x.withColumn("u", _uniform()).withColumn("p", F.when(drawn, chance)).withColumn("left", F.col("rest") - F.coalesce("certain", F.lit(0.0)))
    x = x.withColumn("q", F.when(F.col("p") < 1, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
    place = F.col("q") / (1 + F.col("q")) * BINS
    x = x.withColumn("bin", F.floor(place).cast("int")).withColumn("fine", F.floor((place - F.floor(place)) * BINS).cast("int"))

    # The bin in which the draw ends, then the fine bin inside it.
    ends = _end(x.where("bin is not null").withColumn("start", F.lit(0.0)), "bin").toDF("e", "end_bin", "start")
    x = x.join(small(ends), F.col("source").eqNullSafe(F.col("e")), "left").drop("e")
    ends = _end(x.where("bin = end_bin"), "fine").toDF("e", "end_fine", "end_before")
    x = x.drop("start").join(small(ends), F.col("source").eqNullSafe(F.col("e")), "left")

    keep = ["doc_id", "source", "size", "source_size", "target", "sure", F.coalesce("p", F.lit(0.0)).alias("odds")]
    here = F.coalesce((F.col("bin") == F.col("end_bin")) & (F.col("fine") == F.col("end_fine")), F.lit(False))
    at = F.sum("size").over(W.partitionBy("source").orderBy("q", "doc_id", "digest", "copy").rowsBetween(W.unboundedPreceding, 0)) + F.col("end_before")
    last = x.where(here).select(*keep, F.when(at - F.col("size") / 2 <= F.col("left"), 1).otherwise(0).alias("more"))
    before = (F.col("p") >= 1) | (F.col("bin") < F.col("end_bin")) | ((F.col("bin") == F.col("end_bin")) & (F.col("fine") < F.col("end_fine")))
    out = x.where(~here).select(*keep, F.when(before, 1).otherwise(0).alias("more")).union(last).withColumn("copies", F.col("sure") + F.col("more"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "odds")


def _end(x: DataFrame, bin_: str) -> DataFrame:
    """For each source the bin in which ``left`` words are reached, after ``start`` words, and the
    words before it."""
    bins = x.groupBy("source", bin_).agg(F.sum("size").alias("words"), F.max("left").alias("left"), F.max("start").alias("start"))
    bins = bins.withColumn("before", F.sum("words").over(W.partitionBy("source").orderBy(bin_)) - F.col("words") + F.col("start"))
    return bins.where("before <= left").groupBy("source").agg(F.max(bin_).alias("end"), F.max("before").alias("before"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    docs = stage(sizes(table(spark, sf_dir, "documents")), "sizes")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: The same, ranked source by source without bins.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w, source_size * 200 AS cap FROM g),
b AS (SELECT *, CAST(sum(source_size * 150) OVER () AS DOUBLE) AS total, CAST(sum(w) OVER () AS DOUBLE) AS all_w,
  CAST(coalesce(sum(cap) OVER o, 0) AS DOUBLE) AS cap_before, CAST(coalesce(sum(w) OVER o, 0) AS DOUBLE) AS w_before
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CAST(cap AS DOUBLE) * (all_w - w_before) <= (total - cap_before) * CAST(w AS DOUBLE) AS cut FROM b),
e AS (SELECT *, CAST(coalesce(sum(cap) FILTER (WHERE cut) OVER (), 0) AS DOUBLE) AS cut_cap, CAST(coalesce(sum(w) FILTER (WHERE cut) OVER (), 0) AS DOUBLE) AS cut_w FROM c),
t AS (SELECT source, source_size, CASE WHEN cut THEN CAST(cap AS DOUBLE) / 100.0::DOUBLE ELSE CAST(w AS DOUBLE) * ((total - cut_cap) / (all_w - cut_w)) / 100.0::DOUBLE END AS target FROM e),
s AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(2, floor(target / source_size)) AS BIGINT) ELSE 0 END AS sure FROM t),
r AS (SELECT *, target - sure * source_size AS rest FROM s),
x AS (SELECT d.doc_id, d.size, d.digest, r.*, CAST(floor(sqrt(CAST(size AS DOUBLE)) * 1024) AS HUGEINT) AS root,
  row_number() OVER (PARTITION BY d.doc_id, d.source, d.digest) AS copy FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
z AS (SELECT source, size, max(rest) AS rest, max(root) AS root, CAST(sum(size) AS HUGEINT) AS words, CAST(sum(size) AS HUGEINT) * max(root) AS weight
  FROM x WHERE rest > 0 AND size > 0 GROUP BY source, size),
y AS (SELECT *, (rest - CAST(coalesce(sum(words) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / CAST(sum(weight) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) * CAST(root AS DOUBLE) >= 1 AS is_full FROM z),
o AS (SELECT source, CAST(coalesce(sum(words) FILTER (WHERE is_full), 0) AS DOUBLE) AS certain,
  (max(rest) - CAST(coalesce(sum(words) FILTER (WHERE is_full), 0) AS DOUBLE)) / CAST(sum(weight) FILTER (WHERE NOT is_full) AS DOUBLE) AS scale FROM y GROUP BY source),
p AS (SELECT x.*, rest - coalesce(certain, 0) AS remaining,
  (CAST(('0x' || substr(md5('pareto:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest || ':' || CAST(copy AS VARCHAR) || coalesce(':' || x.source, '')), 1, 12))::BIGINT AS DOUBLE) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u,
  CASE WHEN rest > 0 AND size > 0 THEN coalesce(least(scale * CAST(root AS DOUBLE), 1), 1) END AS p FROM x LEFT JOIN o ON x.source IS NOT DISTINCT FROM o.source),
q AS (SELECT *, CASE WHEN p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM p),
k AS (SELECT *, CASE WHEN p >= 1 OR q IS NOT NULL AND sum(size) FILTER (WHERE q IS NOT NULL) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, digest, copy ROWS UNBOUNDED PRECEDING) - size / 2 <= remaining THEN 1 ELSE 0 END AS more FROM q)
SELECT doc_id, size, source_size, target, (sure + more) * size AS taken, sure + more AS copies FROM k
"""
