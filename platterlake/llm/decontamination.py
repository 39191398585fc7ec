"""Benchmark decontamination by latent semantic retrieval.

Every text is cut into blocks of ``BLOCK`` words; a passage is ``SPAN`` blocks and starts
at every block.  Passages and benchmark items are TF-IDF vectors over the benchmark's
terms, weighted by the document frequencies of the whole corpus.  A distributed randomised
SVD of the item and document passages gives the latent space.  Each passage of each document
is compared by cosine with every item, a stated query set, in blocks.  A candidate counts
if its longest common subsequence with the item covers enough of it; a paraphrase, between
``LOOSE`` and ``SURE``, must also hold the item's answer (its own column, or the item's last
third).

Spaces are fitted for blocks of ``FITTED`` items, at ``RANK`` dimensions, fewer than their
items and passages, on all passages of all documents; nothing is a sample.  Document passages
weigh, together, no more than those of ``LIKE`` documents, so that the item passages, ``WEIGHT``
each, keep their part in the space however large the corpus is.

Defined results: null and blank texts and items match nothing; items under ``SHORT`` words
count only as whole runs of words, as parts of so few words are found by chance; each row
gets one row, with equal results for equal texts, whatever its id; columns of any name pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from .common import stage, table, unstage

BLOCK, SPAN, RANK, MORE, POWERS, FITTED, WEIGHT, LIKE, SEED = 16, 4, 160, 16, 1, 200, 100.0, 1000, 5
NEAR, LOOSE, SURE, ANSWER, SHORT = 0.3, 0.55, 0.75, 0.5, 8
#: Items searched for at once; more take further passes over the documents.
ITEMS = 4096
#: Passages looked at, blocks whose terms are summed and numbers shuffled at once.
WINDOW, SPREAD, SLICE = 512, 4096, 1 << 12
#: Times that a term stands in such blocks from which it is summed alone.
OFTEN = 96
_HITS = StructField("hits", ArrayType(StructType([StructField("item_id", LongType()), StructField("share", DoubleType())])))
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit of an integer for each word of ``a``."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if u := v & at.get(x, 0):
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class Items:
    """Benchmark items: their words, answers and terms."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]]) -> None:
        self.ids = [r[0] for r in rows]
        self.words = [words(r[1]) for r in rows]
        self.answers = [words(r[2]) if r[2] else w[-max(1, len(w) // 3) :] for r, w in zip(rows, self.words, strict=True)]
        self.terms = {t: i for i, t in enumerate(sorted({x for w in self.words for x in w}))}

    def match(self, i: int, passage: list[bytes]) -> float:
        """The share of the item found in the passage, 0 if that is no match."""
        item = self.words[i]
        if len(item) < SHORT:
            n = len(item)
            return float(any(passage[k : k + n] == item for k in range(len(passage) - n + 1)))
        share = lcs(item, passage) / len(item)
        if share < LOOSE:
            return 0.0
        if share < SURE and lcs(self.answers[i], passage) < ANSWER * len(self.answers[i]):
            return 0.0
        return share


def _kind(terms: dict[bytes, int]) -> np.dtype:
    """The least unsigned numbers that hold the terms and, above them, the unknown."""
    return np.min_scalar_type(len(terms))


def _coded(rows: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """``rows`` and the numbers of their text's words, len(terms) for an unknown one, which also
    fills the last block up.  A text has SPAN blocks at least."""
    kind, unknown = _kind(terms), len(terms)
    names = [*rows.columns, "numbers"]
    text_at = rows.columns.index("text")

    def numbers(text: str | None) -> bytes:
        ws = words(text)
        out = np.full(max(-(-len(ws) // BLOCK), SPAN) * BLOCK, unknown, kind)
        out[: len(ws)] = np.fromiter(map(terms.get, ws, repeat(unknown)), kind, len(ws))
        return out.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size, at = [], 0, 0
            for k, x in enumerate(b.column(text_at)):
                held.append(numbers(x.as_py()))
                size += len(held[-1])
                if size > 1 << 24 or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*b.slice(at, len(held)).columns, pa.array(held, pa.binary())], names)
                    held, size, at = [], 0, k + 1

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("numbers", BinaryType())]))


def _grid(numbers: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of coded texts, and the first block of each text and the end."""
    numbers = numbers.cast(pa.large_binary())
    ends = np.frombuffer(numbers.buffers()[1], np.int64)[numbers.offset : numbers.offset + len(numbers) + 1]
    first, last = int(ends[0]), int(ends[-1])
    flat = np.frombuffer(numbers.buffers()[2], kind, (last - first) // kind.itemsize, first)
    return flat.reshape(-1, BLOCK), (ends - first) // (BLOCK * kind.itemsize)


def frequencies(coded: DataFrame, terms: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents; sums of each batch's own counts."""
    kind = _kind(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(len(terms) + 1, np.int64), np.zeros(len(terms) + 1, bool)
        for b in batches:
            if not b.num_rows:
                continue
            grid, firsts = _grid(b.column(0), kind)
            for s, e in pairwise(firsts.tolist()):
                seen[:] = False
                seen[grid[s:e]] = True
                seen[-1] = True  # every document counts
                df += seen
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], ["term", "n"])

    out = np.zeros(len(terms) + 1, np.int64)
    for t, n in coded.select("numbers").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():  # one row a term
        out[t] = n
    return out[:-1], int(out[-1])


def _summed(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The sum of the table's rows over each row of ``ids``; a window of blocks stays in the cache."""
    ids = np.ascontiguousarray(ids.T)
    out, held = table[ids[0]], np.empty((ids.shape[1], table.shape[1]), table.dtype)
    for k in ids[1:]:
        out += np.take(table, k, axis=0, out=held, mode="clip")
    return out


def _windows(grid: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """WINDOW passages at a time: the first, the blocks they hold and whether each is of one text."""
    whole = np.ones(max(0, len(grid) - SPAN + 1), bool)
    for k in range(1, SPAN):
        whole[firsts[1:-1] - k] = False
    for i in range(0, len(whole), WINDOW):
        yield i, grid[i : i + WINDOW + SPAN - 1], whole[i : i + WINDOW]


def _passages(of_blocks: np.ndarray) -> np.ndarray:
    out = of_blocks[: len(of_blocks) - SPAN + 1].copy()
    for k in range(1, SPAN):
        out += of_blocks[k : len(of_blocks) - SPAN + 1 + k]
    return out


class _Fit:
    """What one block of items adds up over passages: ``local`` numbers the block's own terms,
    the unknown last, and ``idf`` weighs them."""

    def __init__(self, local: np.ndarray, idf: np.ndarray, by: np.ndarray) -> None:
        self.local, self.weights = local, np.append(idf, 0).astype(np.float32)
        self.table = self.weights[:, None] * np.vstack((by, np.zeros((1, by.shape[1])))).astype(np.float32)
        self.squares = self.weights**2

    def _passages(self, grid: np.ndarray, firsts: np.ndarray, weights: np.ndarray) -> Iterator[tuple]:
        """The blocks' term numbers, A by for the passages, and weight over squared length of each."""
        of_block = np.repeat(weights, np.diff(firsts))
        for i, part, whole in _windows(grid, firsts):
            ids = self.local[part]
            norm = _passages(self.squares[ids].sum(axis=1))
            scale = np.where(whole, of_block[i : i + len(whole)], 0) / np.maximum(norm, 1e-9)
            yield ids, _passages(_summed(self.table, ids)), scale.astype(np.float32)

    def product(self, y: np.ndarray, grid: np.ndarray, firsts: np.ndarray, weights: np.ndarray) -> None:
        """Adds A'(A by) for the passages A of the texts; rows of A have length one, or their weight's root."""
        held, spread, size = [], [], 0

        def add() -> None:
            nonlocal held, spread, size
            ids, of_block = np.concatenate(held).ravel(), np.concatenate(spread)
            at = np.flatnonzero(ids < len(self.weights) - 1)
            at = at[np.argsort(ids[at].astype(np.int32), kind="stable")]
            if len(at):
                order, block = ids[at], at // BLOCK
                starts = np.concatenate(([0], np.flatnonzero(np.diff(order)) + 1))
                term, times = order[starts], np.diff(np.append(starts, len(order)))
                for t, s, n in zip(*(x[times > OFTEN].tolist() for x in (term, starts, times)), strict=True):
                    y[t] += self.weights[t] * of_block[block[s : s + n]].sum(axis=0)
                # Of the others, those that stand there more often come first, and all whose k-th place is left are added at once.
                by = np.flatnonzero(times <= OFTEN)
                by = by[np.argsort(-times[by], kind="stable")]
                if len(by):
                    term, starts, times = term[by], starts[by], times[by]
                    sums = of_block[block[starts]]
                    for k, n in enumerate(np.searchsorted(-times, -np.arange(1, times[0])).tolist(), 1):
                        sums[:n] += of_block[block[starts[:n] + k]]
                    y[term] += self.weights[term, None] * sums
            held, spread, size = [], [], 0

        for ids, sketch, scale in self._passages(grid, firsts, weights):
            sketch *= scale[:, None]
            of_block = np.zeros((len(ids), sketch.shape[1]), np.float32)  # the sum over passages that hold a block
            for k in range(SPAN):
                of_block[k : k + len(sketch)] += sketch
            held.append(ids)
            spread.append(of_block)
            size += len(ids)
            if size >= SPREAD:
                add()
        if held:
            add()

    def gram(self, y: np.ndarray, grid: np.ndarray, firsts: np.ndarray, weights: np.ndarray) -> None:
        """Adds (A by)'(A by)."""
        for _, sketch, scale in self._passages(grid, firsts, weights):
            y += sketch.T @ (sketch * scale[:, None])


def _total(texts: DataFrame, kind: np.dtype, shape: tuple[int, int], add: Callable) -> np.ndarray:
    """The sum of what ``add`` makes of coded texts (weight, numbers).  Each partition adds up its own
    part, and the shuffle brings equal slices of the parts together, in order of the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                add(y, *_grid(b.column(1), kind), b.column(0).to_numpy(zero_copy_only=False))
        y, task = y.ravel(), TaskContext.get().partitionId()
        for k in range(0, len(y), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([task], pa.int32()), pa.array([y[k : k + SLICE].tobytes()], pa.binary())], ["k", "task", "v"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(v.as_buffer(), np.float64)
                sums[k] = sums[k] + part if k in sums else part
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["k", "v"])

    parts = texts.select("weight", "numbers").mapInArrow(run, "k long, task int, v binary")
    slices = -(-shape[0] * shape[1] // SLICE)
    got = parts.repartition(max(1, min(slices, 64)), "k").sortWithinPartitions("k", "task").select("k", "v").mapInArrow(together, "k long, v binary")
    out = np.zeros(shape[0] * shape[1])
    for k, v in got.collect():  # the sums, terms times columns in all
        out[k : k + SLICE] = np.frombuffer(v, np.float64)
    return out.reshape(shape)


def _space(texts: DataFrame, kind: np.dtype, local: np.ndarray, idf: np.ndarray, rank: int, own: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`latent_space`, for coded texts (weight, numbers) and for ``own``, the (grid, firsts, weights) of texts on the driver."""
    width = min(rank + MORE, max(1, len(idf)))

    def total(by: np.ndarray, shape: tuple[int, int], name: str) -> np.ndarray:
        add = getattr(_Fit(local, idf, by), name)
        out = _total(texts, kind, shape, add)
        if own:
            add(out, *own)
        return out

    base = np.random.default_rng(SEED).normal(size=(len(idf), width)).astype(np.float32)
    for _ in range(POWERS):
        base = np.linalg.qr(total(base, base.shape, "product"))[0].astype(np.float32)
    gram = total(base, (base.shape[1], base.shape[1]), "gram")
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    first = np.argsort(-values)[: min(rank, width)]
    return (base @ turn[:, first]).astype(np.float32), np.sqrt(np.maximum(values[first], 0))


def latent_space(texts: DataFrame, terms: dict[bytes, int], idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(terms, rank) and (rank,): the leading right-singular vectors and the singular values of
    the TF-IDF passages A of all ``texts`` (text, weight), by a randomised SVD: a random sketch A'A omega
    of MORE columns than asked for, POWERS power steps, and the decomposition of A'A in that range."""
    coded = stage(_coded(texts.select("text", "weight"), terms), "coded")
    out = _space(coded, _kind(terms), np.arange(len(terms) + 1), idf, rank)
    unstage(coded)
    return out


class Search:
    """Finds the items of one fitted block in groups of coded texts."""

    def __init__(self, items: Items, local: np.ndarray, idf: np.ndarray, base: np.ndarray) -> None:
        self.items, self.local = items, local
        self.squares = np.append(idf, 0).astype(np.float32) ** 2
        project = idf[:, None].astype(np.float32) * base  # terms, rank
        of_item = np.zeros((len(items.ids), base.shape[1]), np.float32)
        for i, ws in enumerate(items.words):
            if ws:
                ids = np.array([items.terms[w] for w in ws])
                of_item[i] = project[ids].sum(axis=0)
                of_item[i] /= max(float(np.sqrt((of_item[i] ** 2).sum())), 1e-9)  # length one in the latent space
        #: Products in the latent space are linear in a passage's terms, so each term's
        #: product with every item is taken once; the last row is that of unknown words.
        self.product = np.vstack((project @ of_item.T, np.zeros((1, len(items.ids)), np.float32)))
        #: Whether an item holds a term, its length, and the blocks that a long one needs around a passage.
        self.holds = np.zeros((len(items.ids), len(idf) + 1), bool)
        for i, ws in enumerate(items.words):
            self.holds[i, [items.terms[w] for w in ws]] = True
        self.lengths = np.array([len(w) for w in items.words], np.int64)
        self.times = [list(Counter(w).items()) for w in items.words]
        #: Different words of an item, and how many of them must be near a passage whatever else repeats.
        self.different = [frozenset(w) for w in items.words]
        self.least = [LOOSE * len(w) - (len(w) - len(set(w))) for w in items.words]
        self.reach = np.maximum(0, -(-self.lengths // BLOCK) - SPAN + 1)
        self.short = [i for i, w in enumerate(items.words) if 0 < len(w) < SHORT]
        #: Whether a short item starts with the term.
        self.opens = np.zeros(len(idf) + 1, bool)
        self.opens[[items.terms[items.words[i][0]] for i in self.short]] = True

    def near(self, grid: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Candidates of a group of texts by cosine: text, passage of the text, item."""
        ids = self.local[grid]
        for i, part, whole in _windows(ids, firsts):
            score = _passages(_summed(self.product, part))
            norm = np.sqrt(np.maximum(_passages(self.squares[part].sum(axis=1)), 1e-9))
            norm[~whole] = np.inf  # passages across texts
            at, item = np.nonzero(score >= (NEAR * norm)[:, None])
            at += i
            doc = np.searchsorted(firsts, at, side="right") - 1
            held = self._held(ids, firsts[doc], firsts[doc + 1], at, item)
            yield from zip(doc[held].tolist(), (at - firsts[doc])[held].tolist(), item[held].tolist(), strict=True)

    def _held(self, ids: np.ndarray, first: np.ndarray, end: np.ndarray, at: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether there are enough of an item's words around a passage, from ``first`` to ``end`` at most; no more can be in common."""
        low = np.maximum(at - 1 - self.reach[item], first)
        high = np.minimum(at + SPAN + 1 + self.reach[item], end)
        n, left = np.zeros(len(at), np.int64), np.arange(len(at))
        while len(left := left[low[left] < high[left]]):
            n[left] += self.holds[item[left, None], ids[low[left]]].sum(axis=1)
            low[left] += 1
        return n >= LOOSE * self.lengths[item]

    def look(self, grid: np.ndarray, firsts: np.ndarray, words_at: Callable[[int], list[bytes]]) -> list[dict[int, float]]:
        """For each text, the share found of each item by its id."""
        items, hits, around = self.items, [{} for _ in range(len(firsts) - 1)], None
        for d, p, i in self.near(grid, firsts):
            best = hits[d].get(items.ids[i], 0.0)
            if best < 1.0:
                reach = int(self.reach[i])
                if around != (d, p, reach):
                    around, part = (d, p, reach), words_at(d)[max(0, p - 1 - reach) * BLOCK : (p + SPAN + 1 + reach) * BLOCK]
                    there, times = set(part), None
                # Most candidates fall here: a word that is not there is in common no time.
                if len(self.different[i] & there) < self.least[i]:
                    continue
                # As often as both have a word it can be in common at most.
                times = times or Counter(part)
                most = sum([min(n, times[w]) for w, n in self.times[i]])
                if most >= LOOSE * len(items.words[i]) and (share := items.match(i, part)) > best:
                    hits[d][items.ids[i]] = share
        if self.short:
            opened = np.flatnonzero(self.opens[self.local[grid]].any(axis=1))
            for d in np.unique(np.searchsorted(firsts, opened, side="right") - 1).tolist():
                ws = words_at(d)
                for i in self.short:
                    if items.words[i][0] in ws and items.match(i, ws):
                        hits[d][items.ids[i]] = 1.0
        return hits


def _search(coded: DataFrame, kind: np.dtype, searches: list[Search]) -> DataFrame:
    """The columns of ``coded`` (text, numbers and others) with ``hits`` in place of the numbers: the
    items found in each row as (item_id, share)."""
    others = [c for c in coded.columns if c != "numbers"]
    text_at = others.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out: list[list[tuple[int, float]]] = []
            grid, firsts = _grid(b.column(len(others)), kind)
            at = 0
            while at < b.num_rows:  # groups of about 200,000 words
                end = max(at + 1, int(np.searchsorted(firsts, firsts[at] + 200_000 // BLOCK, side="right")) - 1)
                out += look(grid[firsts[at] : firsts[end]], firsts[at : end + 1] - firsts[at], b.column(text_at).slice(at, end - at))
                at = end
            kind_ = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())]))
            rows = [[{"item_id": i, "share": s} for i, s in r] for r in out]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(rows, kind_)], [*others, "hits"])

    def look(grid: np.ndarray, firsts: np.ndarray, texts: pa.Array) -> list[list[tuple[int, float]]]:
        found: list[dict[int, float]] = [{} for _ in range(len(texts))]
        words_at = cache(lambda d: words(texts[d].as_py()))  # only texts with candidates are cut into words again
        for x in searches:
            for all_, own in zip(found, x.look(grid, firsts, words_at), strict=True):
                for i, share in own.items():
                    all_[i] = max(share, all_.get(i, 0.0))
        return [sorted(h.items()) for h in found]

    fields = [coded.schema[c] for c in others]
    return coded.select(*others, "numbers").mapInArrow(run, StructType([*fields, _HITS]))


def _found(docs: DataFrame, part: DataFrame) -> DataFrame:
    """``docs`` (text and others) with the column hits: the items of ``part`` (item_id, text, answer), about
    ITEMS rows at most, in each row.  The words are written as numbers once; the frequencies,
    the products of every space and the search read all of them."""
    rows = sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0], r[1] or "", r[2] or ""))
    terms = Items(rows).terms
    kind = _kind(terms)
    coded = stage(_coded(docs, terms), "coded")
    df, n = frequencies(coded, terms)
    texts = coded.select(F.lit(min(1.0, LIKE / max(1, n))).alias("weight"), "numbers")
    searches = []
    for i in range(0, len(rows), FITTED):
        items = Items(rows[i : i + FITTED])
        at = np.array([terms[t] for t in items.terms], np.int64)
        local = np.full(len(terms) + 1, len(at))
        local[at] = np.arange(len(at))
        idf = np.log((n + 1) / (df[at] + 1)) + 0.1
        numbers = [np.array([terms[w] for w in ws] + [len(terms)] * (max(-(-len(ws) // BLOCK), SPAN) * BLOCK - len(ws))) for ws in items.words]
        firsts = np.concatenate(([0], np.cumsum([len(x) // BLOCK for x in numbers])))
        own = (np.concatenate(numbers).reshape(-1, BLOCK), firsts, np.full(len(numbers), WEIGHT))
        searches.append(Search(items, local, idf, _space(texts, kind, local, idf, RANK, own)[0]))
    return _search(coded, kind, searches)


def _with_hits(docs: DataFrame, columns: list[str], benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """(row, text, hits): the ``columns`` of every row of ``docs`` as a struct, its text and what it holds.

    A pass over the documents searches for ``ITEMS`` items, by hash of their ids, so no
    worker ever holds more; hits of several passes are put together by row.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("answer")).where("item_id is not null")
    passes = max(1, -(-items.count() // ITEMS))
    whole = docs.select(F.struct(F.lit(0).alias("_"), *columns).alias("row"), F.col("text").cast("string").alias("text"))
    if passes == 1:
        return _found(whole, items)
    # Passes meet by a number that is written with the row.
    numbered = stage(whole.withColumn("number", F.monotonically_increasing_id()), "numbered")
    out = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        got = _found(numbered.select("number", "text"), part).select("number", "hits")
        out = got if out is None else out.union(got)
    # One entry a pass; an item that stands there twice, under one id, keeps its best share.
    every = out.groupBy("number").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
    hits = every.select("number", F.filter("hits", lambda h, i: (i == F.size("hits") - 1) | (F.get("hits", i + 1)["item_id"] != h["item_id"])).alias("hits"))
    return numbered.join(hits, "number").select("row", "text", "hits")


def contaminated(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """(doc_id, hits) for every row of ``docs``; hits hold (item_id, share), by item_id."""
    return _with_hits(docs, ["doc_id"], benchmark, answer).select(F.col("row.doc_id").cast("long").alias("doc_id"), "hits")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that every document holds."""
    hits = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.array_max(F.transform("hits", lambda h: F.struct(h["share"].alias("share"), (-h["item_id"]).alias("i"))))
    return hits.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.transform("hits", lambda h: h["item_id"]).alias("item_ids"),
        best["share"].alias("best_share"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    is_text = lambda c: c.lower() == "text"
    kept = _with_hits(docs, [c for c in docs.columns if not is_text(c)], benchmark).where(F.size("hits") == 0)
    return kept.select(*(F.col("text").cast(docs.schema[c].dataType).alias(c) if is_text(c) else F.col("row").getField(c).alias(c) for c in docs.columns))
