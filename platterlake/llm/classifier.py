"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become vectors of ``E``; filters of ``WIDTH`` bytes slide by ``STRIDE``; a chunk's
strongest response to each filter is its feature.  Chunks start every ``CHUNK`` bytes and
overlap by ``WIDTH - STRIDE``, so they cover the whole text.  The mean and the maximum of
the chunks' features feed one logistic unit.

A window lies in its own text: those that would start in a text's padding and reach into
the next text of a batch do not count, so a score depends on its text alone (to the
rounding of single floats).

Training takes every chunk of about ``SAMPLE`` labelled documents of about ``SAMPLE_BYTES``
in all, by hash of their ids; a document is taken whole or not at all.

Defined results: null and empty texts are one chunk of padding and get a score like any
other; without two classes to learn from, every score is the share of label 1 (0.5 with
no label at all); repeated rows get equal scores; labels without a text are not learnt; a
repeated label counts as often as it comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import about, remainder, table

E, WIDTH, STRIDE, FILTERS, CHUNK = 4, 12, 4, 32, 512
SAMPLE, SAMPLE_BYTES, EPOCHS, BATCH, RATE, SEED = 4000, 48 << 20, 10, 64, 0.01, 7
THRESHOLD, FOLDS = 0.3, 5
_PAD, _SPAN, _SLAB = 256, WIDTH // STRIDE, 1 << 20
Params = dict[str, np.ndarray]


def padded(text: str | None) -> np.ndarray:
    """The text's bytes as uint16, padded by WIDTH at least to a multiple of CHUNK."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.full(-(-(len(raw) + WIDTH) // CHUNK) * CHUNK, _PAD, np.uint16)
    out[: len(raw)] = raw
    return out


def start() -> Params:
    rng = np.random.default_rng(SEED)
    scale = (E * WIDTH) ** -0.5
    return {
        "emb": rng.normal(0, 1, (_PAD + 1, E)).astype(np.float32),
        "conv": rng.normal(0, scale, (E * WIDTH, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "head": np.zeros(2 * FILTERS + 1, np.float32),
    }


def responses(p: Params, data: np.ndarray) -> np.ndarray:
    """(chunks, positions, filters) of data whose chunks are of whole padded texts."""
    g = p["emb"][data].reshape(-1, STRIDE * E)
    step = STRIDE * E
    out = g @ p["conv"][:step]
    for k in range(1, _SPAN):
        out[:-k] += g[k:] @ p["conv"][k * step : (k + 1) * step]
    return out.reshape(-1, CHUNK // STRIDE, FILTERS)


def strongest(p: Params, data: np.ndarray, last: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(chunks, filters): the strongest response in each chunk and, if asked for, its position.
    last: the chunks that end a text.  Their last windows would reach into the next text.  A
    slab reaches one chunk into the next for the overlap."""
    best, places = [], []
    for i in range(0, len(data), _SLAB):
        n = min(_SLAB, len(data) - i) // CHUNK
        r = responses(p, data[i : i + _SLAB + CHUNK])[:n]
        r[last[i // CHUNK : i // CHUNK + n], 1 - _SPAN :] = -np.inf
        best.append(r.max(axis=1))
        if where:
            places.append(r.argmax(axis=1))
    return np.concatenate(best), np.concatenate(places) if where else None


def _joined(data: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts put end to end, their first chunks, and which chunks end a text."""
    sizes = np.array([len(d) // CHUNK for d in data])
    ends = np.cumsum(sizes)
    last = np.zeros(ends[-1], bool)
    last[ends - 1] = True
    return np.concatenate(data), ends - sizes, last


def _features(chunks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    counts = np.diff(np.append(starts, len(chunks)))[:, None]
    mean = np.add.reduceat(chunks, starts, axis=0) / counts
    return np.hstack([mean, np.maximum.reduceat(chunks, starts, axis=0), np.ones((len(starts), 1), np.float32)])


def score_texts(p: Params, texts: list[str | None]) -> np.ndarray:
    if not texts:
        return np.empty(0)
    if "share" in p:
        return np.full(len(texts), float(p["share"]))
    whole, starts, last = _joined([padded(t) for t in texts])
    chunks = np.maximum(strongest(p, whole, last)[0] + p["bias"], 0)
    z = _features(chunks, starts) @ p["head"]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def train(texts: list[str | None], labels: np.ndarray) -> Params:
    """Gradient descent (Adam) on the cross entropy; deterministic for the same input."""
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return {"share": np.float64(y.mean() if len(y) else 0.5)}
    p, rng, data = start(), np.random.default_rng(SEED), [padded(t) for t in texts]
    p["head"][-1] = np.log(y.mean() / (1 - y.mean()))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            step += 1
            for k, g in _gradient(p, [data[j] for j in pick], y[pick]).items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def _gradient(p: Params, data: list[np.ndarray], y: np.ndarray) -> Params:
    whole, starts, last = _joined(data)
    sizes = np.diff(np.append(starts, len(last)))
    peak, best = strongest(p, whole, last, where=True)
    chunks = np.maximum(peak + p["bias"], 0)
    x = _features(chunks, starts)
    dz = ((1 / (1 + np.exp(-np.clip(x @ p["head"], -40, 40))) - y) / len(y)).astype(np.float32)
    dx = dz[:, None] * p["head"][None, :]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    top = chunks == x[doc, FILTERS : 2 * FILTERS]
    top = top / np.add.reduceat(top, starts, axis=0, dtype=np.float32)[doc]  # equal chunks share
    dchunk = (dx[doc, :FILTERS] / sizes[doc, None] + top * dx[doc, FILTERS : 2 * FILTERS]) * (chunks > 0)
    at = (np.arange(len(chunks))[:, None] * CHUNK + best * STRIDE)[:, :, None] + np.arange(WIDTH)
    ids = whole[at]  # chunks, filters, width
    window = p["emb"][ids].reshape(*ids.shape[:2], WIDTH * E)
    demb = np.zeros_like(p["emb"])
    back = (dchunk[:, :, None] * p["conv"].T[None]).reshape(-1, E)
    flat = ids.ravel()
    for e in range(E):
        demb[:, e] = np.bincount(flat, back[:, e], _PAD + 1)
    return {"head": (x.T @ dz).astype(np.float32), "bias": dchunk.sum(axis=0), "conv": np.einsum("cf,cfw->wf", dchunk, window, optimize=True), "emb": demb}


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list, np.ndarray]:
    """Texts and labels of about ``most`` labelled documents, of about ``most_bytes`` in all,
    outside the held-out fold."""
    held = remainder(F.col("doc_id"), FOLDS) == 0
    chosen = about(labels.where(F.col("quality").isin(0, 1) & ~held).select("doc_id", "quality"), "doc_id", most)
    if chosen.count() <= 4 * most:  # more only if few ids hold most labels
        chosen = F.broadcast(chosen)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, 2 * most / max(1, n), most_bytes / max(1, size))
    if share < 1:  # long texts or repeated ids: fewer documents, by hash of their ids and texts
        rows = rows.where(F.pmod(F.xxhash64(F.lit("share"), "doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = sorted(rows.select("doc_id", "quality", "text").collect(), key=lambda r: (r[0], r[1], r[2] or ""))
    return [r[2] for r in got], np.array([r[1] for r in got], np.float32)


def scores(docs: DataFrame, params: Params) -> DataFrame:
    """(doc_id, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, texts, size = [], [], 0
            for x in b.column(1):
                texts.append(x.as_py())
                size += len(texts[-1] or "")
                if size > 1 << 22:
                    out.append(score_texts(params, texts))
                    texts, size = [], 0
            out.append(score_texts(params, texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    params = train(*sample(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return scores(docs, params).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
