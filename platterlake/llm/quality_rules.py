"""Quality rules with thresholds adapted to each language and source.

Each text gives integer measures.  A mergeable sketch of every measure, per language and
source, counts documents in buckets of fixed resolution: sketches merge by adding counts,
so partial aggregation, lost executors and the order of rows cannot change them.  A bucket
is a whole number up to ``FINE`` and a hundredth of a doubling above, so one takes some
thousand rows for any number of documents and no value is cut off.  Quartiles of the sketch
give the fences.  Quartiles of a group are drawn towards its language's, and these towards
those of all, as if ``PRIOR`` documents more had them: one rule for groups of any size.
The fences are joined back and the documents outside them are rejected.

A spread below its measure's least one counts as that (``MEASURES``), as quartiles of clean
sources often coincide; a fence is then that far from the quartile.

Defined results: null, empty and blank texts have zero words and fail the base rule; a
null language or source is a group like any other; repeated rows get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage, table

LEAST_WORDS, REPEAT_PERCENT, WINDOW, PRIOR, REACH, FINE = 10, 20, 5, 30, 3, 1000
_BLANKS, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_BLANK_TEXT = _BLANKS.decode()

#: Measure: (columns over columns, scale, least spread, also fenced below).  A spread
#: below the least one counts as it, as quartiles of clean sources often coincide.
MEASURES: dict[str, tuple[str, str, int, int, bool]] = {
    "symbols": ("n_symbols", "word_chars", 1000, 15, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 120, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 60, False),
    "capitals": ("n_capitals", "word_chars", 1000, 80, False),
    "marks": ("n_marks", "word_chars", 1000, 30, False),
    "word_length": ("word_chars", "n_words", 10, 8, True),
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    codes, top = ids[: n - window + 1], len(index)
    for k in range(1, window):
        if top * len(index) >= 1 << 63:  # renumber, so that codes stay exact
            _, codes = np.unique(codes, return_inverse=True)
            top = int(codes.max()) + 1
        codes = codes * len(index) + ids[k : n - window + 1 + k]
        top *= len(index)
    order = np.sort(codes)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.isin(codes, twice).astype(np.int64)
    cover = np.zeros(n + 1, np.int64)
    cover[: len(at)] += at
    cover[window : window + len(at)] -= at
    return int((np.cumsum(cover)[:n] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts named by :data:`STATS`."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in text.split("\n") if x.strip(_BLANK_TEXT)]
    return (len(words), len(text) - without(_BLANKS), without(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), without(bytes(range(65, 91))), without(b"!?"))


def text_key(text: str = "text") -> Column:
    """A text in 64 bits; with its id, language and source it tells rows apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, lang, source, t, *STATS) for every row; t is :func:`text_key`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measure(x.as_py()) for x in b.column(4)], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(rows[:, i]) for i in range(len(STATS)))], ["doc_id", "lang", "source", "t", *STATS])

    cast = [F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("lang", "string"), ("source", "string"))]
    return df.select(*cast, text_key(text).alias("t"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, lang string, source string, t long, " + ", ".join(f"{s} long" for s in STATS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _values() -> Column:
    """The measures of a row as an array of (measure, value), the value its bucket."""

    def ratio(a: str, b: str, scale: int) -> Column:
        value = F.when(F.col(b) > 0, F.floor(scale * F.col(a) / F.col(b))).otherwise(0)
        return F.when(value <= FINE, value).otherwise(FINE + F.floor(100 * F.log2(value / FINE))).cast("int")

    return F.array(*[F.struct(F.lit(m).alias("measure"), ratio(a, b, s).alias("value")) for m, (a, b, s, _, _) in MEASURES.items()])


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, docs, q1, q3) of a sketch merged to ``keys``."""
    merged = sketch.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("value"))).withColumn("docs", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("docs"), F.col("value")))
    return ranked.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, measure, value, n): documents by bucket, those failing the base rule left out."""
    return stats.where(~base_failed()).select("lang", "source", F.explode(_values()).alias("x")).groupBy("lang", "source", "x.measure", "x.value").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, prior: float = PRIOR, reach: float = REACH) -> DataFrame:
    """(lang, source, fence): a map from measure to the (low, high) that a value must keep."""
    own = _quartiles(sketch, ["lang", "source"])
    lang = _quartiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("measure").alias("lm"), F.col("docs").alias("ld"), F.col("q1").alias("l1"), F.col("q3").alias("l3"))
    all_ = _quartiles(sketch, []).select(F.col("measure").alias("am"), F.col("q1").alias("a1"), F.col("q3").alias("a3"))
    x = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("lm"))).join(all_, F.col("measure") == F.col("am"))
    drawn = lambda own, n, to: (F.col(n) * F.col(own) + prior * to) / (F.col(n) + prior)
    of = lambda o, l, a: drawn(o, "docs", drawn(l, "ld", F.col(a)))
    x = x.select("lang", "source", "measure", of("q1", "l1", "a1").alias("q1"), of("q3", "l3", "a3").alias("q3"))
    least = F.coalesce(*[F.when(F.col("measure") == m, F.lit(v[3])) for m, v in MEASURES.items()])
    below = F.col("measure").isin([m for m, v in MEASURES.items() if v[4]])
    x = x.withColumn("spread", F.greatest(F.col("q3") - F.col("q1"), least))
    x = x.select("lang", "source", "measure", F.when(below, F.col("q1") - reach * F.col("spread")).otherwise(F.lit(0)).cast("double").alias("low"), (F.col("q3") + reach * F.col("spread")).cast("double").alias("high"))
    return x.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("fence"))  # one entry a measure


def verdicts(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, lang, source, t, *STATS, base_failed, kept) for every row."""
    stats = stage(measured(df, text), "measures")
    bounds = fences(sketches(stats)).select(F.col("lang").alias("fl"), F.col("source").alias("fs"), "fence")
    x = stats.join(bounds, F.col("lang").eqNullSafe(F.col("fl")) & F.col("source").eqNullSafe(F.col("fs")), "left")
    inside = F.forall(_values(), lambda v: F.coalesce(v["value"].between(F.col("fence")[v["measure"]]["low"], F.col("fence")[v["measure"]]["high"]), F.lit(True)))
    return x.select("doc_id", "lang", "source", "t", *STATS, base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))


def kept_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules keep.  A verdict hangs on a row's text, language and
    source alone, so by these it goes back to the row, whatever its id."""
    keys = ["lang", "source", "t"]
    bad = verdicts(df, text).where("not kept").select(*(F.col(k).alias(f"bad_{k}") for k in keys)).distinct()
    rows = df.select(F.struct(*df.columns).alias("row"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_key(text).alias("t"))
    met = F.col("t").eqNullSafe(F.col("bad_t")) & F.col("lang").eqNullSafe(F.col("bad_lang")) & F.col("source").eqNullSafe(F.col("bad_source"))
    return rows.join(bad, met, "left_anti").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return verdicts(table(spark, sf_dir, "documents")).select("doc_id", *STATS[:5], "base_failed", "kept")


#: The same, from sorted lists of values in place of sketches.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1) GROUP BY r),
s AS (SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_capitals, CAST(len(regexp_extract_all(t, '[!?]')) AS BIGINT) AS n_marks FROM d LEFT JOIN c ON d.r = c.r),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
m AS (SELECT r, lang, source, base_failed, unnest([
  {'m': 'symbols', 'v': CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END, 'least': 15, 'below': FALSE},
  {'m': 'dup_lines', 'v': CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END, 'least': 120, 'below': FALSE},
  {'m': 'repeats', 'v': CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END, 'least': 60, 'below': FALSE},
  {'m': 'capitals', 'v': CASE WHEN word_chars > 0 THEN 1000 * n_capitals // word_chars ELSE 0 END, 'least': 80, 'below': FALSE},
  {'m': 'marks', 'v': CASE WHEN word_chars > 0 THEN 1000 * n_marks // word_chars ELSE 0 END, 'least': 30, 'below': FALSE},
  {'m': 'word_length', 'v': CASE WHEN n_words > 0 THEN 10 * word_chars // n_words ELSE 0 END, 'least': 8, 'below': TRUE}], recursive := TRUE) FROM b),
v AS (SELECT r, lang, source, base_failed, m, least, below, CASE WHEN v <= 1000 THEN v ELSE 1000 + CAST(floor(100 * log2(v / 1000)) AS BIGINT) END AS v FROM m),
a AS (SELECT m, list_sort(list(v)) AS x FROM v WHERE NOT base_failed GROUP BY m),
k AS (SELECT m, lang, list_sort(list(v)) AS x FROM v WHERE NOT base_failed GROUP BY m, lang),
o AS (SELECT m, lang, source, list_sort(list(v)) AS x FROM v WHERE NOT base_failed GROUP BY m, lang, source),
q AS (SELECT o.m, o.lang, o.source,
  (len(o.x) * o.x[greatest(1, CAST(ceil(0.25 * len(o.x)) AS BIGINT))] + 30 * (CAST(len(k.x) * k.x[greatest(1, CAST(ceil(0.25 * len(k.x)) AS BIGINT))] + 30 * a.x[greatest(1, CAST(ceil(0.25 * len(a.x)) AS BIGINT))] AS DOUBLE) / (len(k.x) + 30))) / (len(o.x) + 30) AS q1,
  (len(o.x) * o.x[greatest(1, CAST(ceil(0.75 * len(o.x)) AS BIGINT))] + 30 * (CAST(len(k.x) * k.x[greatest(1, CAST(ceil(0.75 * len(k.x)) AS BIGINT))] + 30 * a.x[greatest(1, CAST(ceil(0.75 * len(a.x)) AS BIGINT))] AS DOUBLE) / (len(k.x) + 30))) / (len(o.x) + 30) AS q3
  FROM o JOIN k ON o.m = k.m AND o.lang IS NOT DISTINCT FROM k.lang JOIN a ON o.m = a.m),
f AS (SELECT v.r, bool_and(v.v <= q.q3 + 3 * greatest(q.q3 - q.q1, v.least) AND (v.v >= CASE WHEN v.below THEN q.q1 - 3 * greatest(q.q3 - q.q1, v.least) ELSE 0 END)) AS inside
  FROM v JOIN q ON v.m = q.m AND v.lang IS NOT DISTINCT FROM q.lang AND v.source IS NOT DISTINCT FROM q.source GROUP BY v.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, TRUE) AS kept FROM b LEFT JOIN f ON b.r = f.r
"""
