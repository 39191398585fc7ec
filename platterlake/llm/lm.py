"""Language-model scoring with a log-bilinear neural model, in numpy.

Counts of all training tokens come first, by a combined aggregation.  The model predicts
units, each with vectors of its own: the ``TOP`` most frequent tokens, and ``CLASSES`` classes
of the others by their last two bytes.  A context of ``CONTEXT`` units gives a vector, the sum of its units' vectors
each through its place's matrix.  Units stand in ``GROUPS`` groups of equal size: the
vector's products with the groups' output vectors normalise over groups, those with the
units of one group over that group, so a probability takes the root of the vocabulary's
products.  Inside a tail class a token's share is its count plus one, with one unseen token more.

Training is noise-contrastive estimation, of groups against noise groups and of units
against noise units of their group.  Documents are dealt by hash of id and text into shards of about ``SHARD``
tokens and ``ROUNDS`` rounds.  In a round every shard starts from the same weights and trains over all
its tokens; the weights are averaged by tokens, summed by the shuffle, and start the next
round.  Shards are read in order of a hash, so the model depends on the documents and not on
files, partitions or batches.

The ``HEAD`` most frequent tokens are looked up in the worker; all others are joined to
the table of counts, so no more than that bound is ever sent to workers.

Defined results: null, empty and blank texts are their end token alone; repeated rows get
equal scores; with no training text every count is 0 and units are equally likely.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, stage, table

HEAD, TOP, CLASSES, DIM, CONTEXT = 131_072, 4032, 64, 16, 2
GROUPS, SIZE = 32, 128  # of units; GROUPS * SIZE is their number
NOISE, INSIDE, BATCH, RATE, SEED = 32, 8, 4096, 0.1, 11
SHARD, MOST_SHARDS, ROUNDS = 1 << 19, 2048, 3
FOLDS, HELD = 7, 2
UNITS = TOP + CLASSES
END = b""  # no word is empty
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(), END]


def class_of(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % CLASSES


def counts(train: DataFrame) -> DataFrame:
    """(token, c) over the texts of ``train``; the end token is the empty string."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.translate(F.coalesce(F.col("text"), F.lit("")), capitals + "\t\n\x0b\x0c\r", capitals.lower() + " " * 5)
    every = train.select(F.explode(F.split(plain, " ", -1)).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("c"))
    ends = train.agg(F.count("*").alias("c")).where("c > 0").select(F.lit("").alias("token"), "c")
    return every.union(ends)


def place_of(unit: np.ndarray) -> np.ndarray:
    """Where a unit stands: its group times SIZE and its place in it."""
    return unit % GROUPS * SIZE + unit // GROUPS


class Vocabulary(dict):
    """Token to number: a head token's rank, or -1 - its class.  Also what units cost."""

    def __init__(self, head: list[tuple[bytes, int]], n: int, v: int, class_sums: np.ndarray) -> None:
        super().__init__((t, i) for i, (t, _) in enumerate(head))
        self.n, self.v = n, v
        c = np.array([c for _, c in head] or [0], np.float64)
        size = len(head)
        unit = np.array([i if i < TOP else TOP + class_of(t) for i, (t, _) in enumerate(head)] or [0], np.int64)
        unit = np.concatenate((unit, TOP + np.arange(CLASSES)[::-1]))  # index -1 - k: class k
        #: Ranks are dealt over groups in turn, so that every group has frequent units.
        self.unit = place_of(unit)
        self.tail = unit >= TOP
        self.base = np.log10(c + 1) if size else np.zeros(1)
        #: log10 of one over what tokens of a class share; single units share with no one
        self.share = np.concatenate((np.zeros(TOP), -np.log10(class_sums + 1.0)))[unit]
        mass = np.concatenate((np.where(np.arange(TOP) < size, np.resize(c, TOP), 0), class_sums)) if size else np.zeros(UNITS)
        noise = np.empty(UNITS)
        noise[place_of(np.arange(UNITS))] = (mass + 1) / (mass + 1).sum()
        #: (GROUPS, SIZE): the share of each unit.
        self.noise = noise.reshape(GROUPS, SIZE)

    def __missing__(self, token: bytes) -> int:
        return -1 - class_of(token)

    def numbers(self, toks: list[bytes]) -> np.ndarray:
        get = self.__getitem__
        return np.fromiter(map(get, toks), np.int64, len(toks))


def vocabulary(counted: DataFrame) -> Vocabulary:
    """The head of the counts and the sums of count plus one per class of the rest."""
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # Levels of the counts, under 1,000 in all, tell the least one whose tokens are few enough.
    level = F.floor(F.log2("c") * 16)
    cut, tokens_above = 1 << 30, 0
    for k, t in sorted(counted.groupBy(level.alias("k")).agg(F.count("*")).collect(), reverse=True):
        tokens_above += t
        if tokens_above > HEAD:
            break
        cut = k
    head = sorted(((r[0].encode(), r[1]) for r in counted.where(level >= cut).collect()), key=lambda r: (-r[1], r[0]))
    raw = F.col("token").cast("binary")
    last = F.substring(raw, -2, 2)
    sums = counted.groupBy((F.crc32(F.when(F.octet_length("token") > 2, last).otherwise(raw)) % CLASSES).alias("k")).agg(F.sum(F.col("c") + 1)).collect()
    by_class = np.zeros(CLASSES)
    for k, s in sums:
        by_class[k] = s
    for t, c in head[:TOP]:
        by_class[class_of(t)] -= c + 1
    return Vocabulary(head, int(n), int(v), by_class)


Weights = dict[str, np.ndarray]
_SHAPES = {"inputs": (UNITS + 1, DIM), "places": (CONTEXT, DIM, DIM), "groups": (GROUPS, DIM), "group_bias": (GROUPS,), "outputs": (UNITS, DIM), "bias": (UNITS,)}


def start(vocab: Vocabulary) -> Weights:
    """Small random vectors; biases that make the model the unigram one."""
    rng = np.random.default_rng(SEED)
    w = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in _SHAPES.items()}
    w["places"] = (np.eye(DIM) / CONTEXT + rng.normal(0, 0.02, _SHAPES["places"])).astype(np.float32)
    groups = vocab.noise.sum(axis=1)
    w["group_bias"] = np.log(groups).astype(np.float32)
    w["bias"] = np.log(vocab.noise / groups[:, None]).astype(np.float32).ravel()
    return w


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in _SHAPES])


def shaped(v: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        size = int(np.prod(s))
        out[k] = v[at : at + size].reshape(s).astype(np.float32)
        at += size
    return out


def contexts(units: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(CONTEXT, n): the units before each, UNITS where a text starts.  ends: where texts end."""
    out = np.empty((CONTEXT, len(units)), np.int64)
    first = np.concatenate(([0], ends[:-1]))
    for k in range(1, CONTEXT + 1):
        out[k - 1, k:] = units[:-k]
        for j in range(k):
            at = first + j
            out[k - 1, at[at < len(units)]] = UNITS
            # a text shorter than j + 1 lets the mark fall into the next one, which is
            # within j + 1 of that text's own start and marked there all the same
    return out


def _predicted(w: Weights, ctx: np.ndarray) -> np.ndarray:
    q = w["inputs"][ctx[0]] @ w["places"][0]
    for k in range(1, CONTEXT):
        q += w["inputs"][ctx[k]] @ w["places"][k]
    return q


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps; one sample of noise groups serves a
    batch, and one sample of places serves the units of each group."""

    def __init__(self, w: Weights, noise: np.ndarray) -> None:
        self.w, self.sums = {k: v.copy() for k, v in w.items()}, {k: np.full(s, 0.1, np.float32) for k, s in _SHAPES.items()}
        groups = noise.sum(axis=1)
        self.cdf, self.log_groups = np.cumsum(groups), np.log(groups * NOISE).astype(np.float32)
        self.inside = np.cumsum(noise / groups[:, None], axis=1)
        self.log_inside = np.log(noise / groups[:, None] * INSIDE).astype(np.float32).ravel()
        self.rng, self.seen = np.random.default_rng(SEED), 0

    @np.errstate(over="ignore")
    def step(self, ctx: np.ndarray, target: np.ndarray) -> None:
        order = np.argsort(target, kind="stable")  # the tokens of a unit and of a group stand together
        ctx, target = ctx[:, order], target[order]
        w, n = self.w, len(target)
        root = np.float32(n**-0.5)
        q, group = _predicted(w, ctx), target // SIZE
        g = {}

        other = np.minimum(np.searchsorted(self.cdf, self.rng.random(NOISE)), GROUPS - 1)
        own = np.einsum("nd,nd->n", q, w["groups"][group]) + w["group_bias"][group] - self.log_groups[group]
        rest = q @ w["groups"][other].T + (w["group_bias"][other] - self.log_groups[other])
        d_group, d_rest = (_sigmoid(own) - 1) * root, _sigmoid(rest)
        d_rest *= root
        dq = d_group[:, None] * w["groups"][group] + d_rest @ w["groups"][other]
        g["groups"] = np.zeros(_SHAPES["groups"], np.float32)
        np.add.at(g["groups"], other, d_rest.T @ q)
        g["group_bias"] = (np.bincount(group, d_group, GROUPS) + np.bincount(other, d_rest.sum(axis=0), GROUPS)).astype(np.float32)

        draw = self.rng.random((GROUPS, INSIDE))
        noise = np.stack([np.searchsorted(c, d) for c, d in zip(self.inside, draw, strict=True)])
        noise = np.minimum(noise, SIZE - 1) + np.arange(GROUPS)[:, None] * SIZE  # groups, INSIDE
        vectors_own = w["outputs"][target]
        own = np.einsum("nd,nd->n", q, vectors_own) + w["bias"][target] - self.log_inside[target]
        d_own = (_sigmoid(own) - 1) * root
        dq += d_own[:, None] * vectors_own
        g["outputs"] = _scattered(target, d_own[:, None] * q, UNITS)
        g["bias"] = np.bincount(target, d_own, UNITS).astype(np.float32)
        ends = np.searchsorted(group, np.arange(GROUPS + 1))
        for k in np.flatnonzero(np.diff(ends)):  # the tokens of a group at once
            at, units = slice(ends[k], ends[k + 1]), noise[k]
            vectors, own_q = w["outputs"][units], q[at]
            g["groups"][k] += d_group[at] @ own_q
            d = _sigmoid(own_q @ vectors.T + (w["bias"][units] - self.log_inside[units]))
            d *= root
            dq[at] += d @ vectors
            np.add.at(g["outputs"], units, d.T @ own_q)
            np.add.at(g["bias"], units, d.sum(axis=0))

        g["places"] = np.stack([w["inputs"][ctx[k]].T @ dq for k in range(CONTEXT)])
        g["inputs"] = _scattered(ctx.ravel(), np.concatenate([dq @ w["places"][k].T for k in range(CONTEXT)]), UNITS + 1)
        for k, x in g.items():
            sums = self.sums[k]
            sums += x * x
            x *= RATE
            x /= np.sqrt(sums)
            w[k] -= x
        self.seen += n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; what overflows is 0."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _scattered(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """(size, DIM): the sums of rows by place."""
    cells = (at * DIM)[:, None] + np.arange(DIM)
    return np.bincount(cells.ravel(), rows.ravel(), size * DIM).reshape(size, DIM).astype(np.float32)


def _encoded(texts: list, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    toks = [tokens(t) for t in texts]
    ends = np.cumsum([len(t) for t in toks])
    return (np.concatenate([vocab.numbers(t) for t in toks]) if toks else np.empty(0, np.int64)), ends, toks


def _groups(column: pa.Array, most: int = 1 << 21) -> Iterator[list]:
    """Texts in groups of bounded size, the last one of a group ending it."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py())
        size += len(held[-1] or "")
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(train_docs: DataFrame, vocab: Vocabulary) -> Weights:
    """Weights after ROUNDS rounds over the documents' shards."""
    shards = int(min(MOST_SHARDS, max(1, -(-vocab.n // (SHARD * ROUNDS)))))
    text = F.coalesce(F.col("text"), F.lit(""))
    id_ = F.col("doc_id") if "doc_id" in train_docs.columns else F.lit(None).cast("long")
    dealt = train_docs.select(F.xxhash64(F.lit("shard"), id_, text).alias("key"), text.alias("text"))
    dealt = dealt.withColumn("round", F.pmod("key", F.lit(ROUNDS))).withColumn("shard", F.pmod(F.shiftright("key", 8), F.lit(shards)))
    w = start(vocab)
    for k in range(ROUNDS):
        rows = dealt.where(F.col("round") == k).repartition(shards, "shard").sortWithinPartitions("shard", "key", "text")
        w = _round(rows.select("shard", "text"), vocab, w)
    return w


def _round(rows: DataFrame, vocab: Vocabulary, first: Weights) -> Weights:
    """The average of the shards' weights, each trained from ``first``."""
    names = ["i", "v", "n"]

    def learn(t: Trainer, texts: list) -> None:
        numbers, ends, _ = _encoded(texts, vocab)
        units = vocab.unit[numbers]
        ctx = contexts(units, ends)
        order = t.rng.permutation(len(units))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            t.step(ctx[:, pick], units[pick])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, t, held, size = None, None, [], 0
        total, seen = np.zeros(len(flat(first))), 0.0

        def close() -> None:
            nonlocal total, seen
            if t is not None:
                if held:
                    learn(t, held)
                total += flat(t.w).astype(np.float64) * t.seen
                seen += t.seen

        for b in batches:
            for own, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if own != shard:  # a shard is learnt alone, whatever else is in its partition
                    close()
                    shard, t, held, size = own, Trainer(first, vocab.noise), [], 0
                held.append(x.as_py())
                size += len(held[-1] or "")
                if size > 1 << 20:
                    learn(t, held)
                    held, size = [], 0
        close()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total), pa.array(np.full(len(total), seen))], names)

    # One row a weight, some 140,000 in all, whatever the input.
    got = rows.mapInArrow(run, "i int, v double, n double").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()
    if not got.num_rows:
        return first
    out = np.empty(got.num_rows)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return shaped(out)


def log_probs(w: Weights, units: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Normalised log10 probabilities of units in their contexts."""
    out, ctx = np.empty(len(units), np.float32), contexts(units, ends)
    ones, to = np.ones(GROUPS, np.float32), np.ascontiguousarray(w["groups"].T)
    inside = np.ascontiguousarray(w["outputs"].reshape(GROUPS, SIZE, DIM).transpose(0, 2, 1))
    bias, ones_inside = w["bias"].reshape(GROUPS, SIZE), np.ones(SIZE, np.float32)

    def normalised(s: np.ndarray, at: np.ndarray, one: np.ndarray) -> np.ndarray:
        if (most := float(s.max())) > 80.0:  # no overflow
            s -= most - 80.0
        own = s[np.arange(len(s)), at]
        np.exp(s, out=s)
        return own - np.log(np.maximum(s @ one, 1e-37))

    held = np.empty((16_384, SIZE), np.float32)
    for i in range(0, len(units), 16_384):
        order = np.argsort(units[i : i + 16_384], kind="stable")
        part = units[i : i + 16_384][order]
        q, group = _predicted(w, ctx[:, i : i + 16_384][:, order]), part // SIZE
        found = normalised(q @ to + w["group_bias"], group, ones)
        ends_ = np.searchsorted(group, np.arange(GROUPS + 1))
        for k in np.flatnonzero(np.diff(ends_)):
            for j in range(ends_[k], ends_[k + 1], 512):  # what stays in the cache
                at = slice(j, min(j + 512, ends_[k + 1]))
                s = np.matmul(q[at], inside[k], out=held[: at.stop - j])
                s += bias[k]
                found[at] += normalised(s, part[at] % SIZE, ones_inside)
        out[i + order] = found
    return out.astype(np.float64) / np.log(10)


_SCHEMA = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, score double, tail map<string,long>"


def _scored(docs: DataFrame, vocab: Vocabulary, w: Weights) -> DataFrame:
    """One row a document: sums over head tokens, what units give, and how often each other token stands there."""
    log_all = np.log10(vocab.n + 1.0 * (vocab.v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            at = 0
            for texts in _groups(b.column(2)):
                numbers, ends, toks = _encoded(texts, vocab)
                units = vocab.unit[numbers]
                known = numbers >= 0
                base = np.where(known, vocab.base[np.maximum(numbers, 0)], 0.0)
                # in a class: log10 of count + 1 over the class's sum
                score = log_probs(w, units, ends) + vocab.share[numbers] + np.where(vocab.tail[numbers], base, 0.0)
                starts = np.concatenate(([0], ends[:-1]))
                total = lambda x: pa.array(np.add.reduceat(x, starts))
                lost = np.flatnonzero(~known)
                of = np.searchsorted(ends, lost, side="right")
                tail: list[dict[bytes, int]] = [{} for _ in texts]
                for d, k in zip(of.tolist(), (lost - starts[of]).tolist(), strict=True):
                    tail[d][toks[d][k]] = tail[d].get(toks[d][k], 0) + 1
                counted = [[(t.decode("utf-8", "surrogatepass"), c) for t, c in own.items()] for own in tail]
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + n), pa.int64()), b.column(0).slice(at, n), b.column(1).slice(at, n), pa.array(ends - starts), total(known.astype(np.int64)), total(base - log_all), total(score), pa.array(counted, pa.map_(pa.string(), pa.int64()))],
                    [c.split()[0] for c in _SCHEMA.split(", ")],
                )
                row, at = row + n, at + n

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, _SCHEMA)


def score(docs: DataFrame, train_docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of
    ``docs`` (doc_id, held_out, text), learning from the texts of ``train_docs``."""
    counted = stage(counts(train_docs), "counts")
    vocab = vocabulary(counted)
    rows = stage(_scored(docs, vocab, train(train_docs, vocab)), "scored")
    tail = rows.select("row", F.explode("tail").alias("token", "tf"))
    tail = tail.join(counted, "token").groupBy("row").agg(F.sum("tf").alias("tail_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("tail_log"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.join(tail, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + zero("tail_known")).cast("long").alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_log")).alias("base_score"),
        (F.col("score") + zero("tail_log")).alias("score"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole documents, learning from those outside the held-out fold."""
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(docs, docs.where(~F.col("held_out")))
