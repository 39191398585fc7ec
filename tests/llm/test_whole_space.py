"""The latent space is that of every passage of every document, not of a sample."""

import random

import numpy as np
import pytest

import corpus_pipeline
from platterlake.llm import decontamination as d

TERMS = [f"t{k}" for k in range(60)]


def tables():
    rnd = random.Random(4)
    items = [(i, " ".join(rnd.choice(TERMS) for _ in range(40))) for i in range(12)]
    docs = []
    for i in range(1500):  # more than those whose weight documents have together
        near = rnd.randrange(60)
        docs.append((i, " ".join(TERMS[(near + int(rnd.expovariate(0.3))) % 60] if rnd.random() < 0.8 else "other" for _ in range(rnd.choice([20, 64, 90, 200])))))
    return docs, items


def leading(docs, items, rank):
    """The first singular vectors of all passages, one by one."""
    at = {t.encode(): k for k, t in enumerate(sorted(TERMS))}
    n = len(docs)
    df = np.zeros(60)
    for _, t in docs:
        df[[at[w] for w in set(d.words(t)) if w in at]] += 1
    idf = np.log((n + 1) / (df + 1)) + 0.1
    gram = np.zeros((60, 60))
    for rows, weight in ((docs, 1000 / n), (items, d.WEIGHT)):
        for _, t in rows:
            w = d.words(t)
            blocks = max(-(-len(w) // d.BLOCK), d.SPAN)
            for p in range(blocks - d.SPAN + 1):
                ids = [at[x] for x in w[p * d.BLOCK : (p + d.SPAN) * d.BLOCK] if x in at]
                a = np.bincount(ids, minlength=60) * idf
                gram += weight * np.outer(a, a) / max((idf[ids] ** 2).sum(), 1e-9)
    values, vectors = np.linalg.eigh(gram)
    assert values[-rank] > 1.02 * values[-rank - 1]  # the space is well told from the rest
    return vectors[:, -rank:]


@pytest.mark.parametrize("query", ["op8", "pipeline"])
def test_space_is_fitted_on_all_documents(spark, monkeypatch, tmp_path, query):
    docs, items = tables()
    spaces, plain = [], d.Search

    def search(*args):
        spaces.append(args[-1])
        return plain(*args)

    monkeypatch.setattr(d, "Search", search)
    monkeypatch.setattr(d, "MORE", 60)
    monkeypatch.setattr(d, "latent_space", lambda *a, f=d.latent_space: f(*a, rank=5))  # as the sampled form called it
    monkeypatch.setattr(d, "RANK", 5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    if query == "op8":
        assert d.op8_decontamination(spark, str(tmp_path)).count() == len(docs)
    else:
        kept = corpus_pipeline.benchmark(spark, df, str(tmp_path))
        assert kept.columns == ["doc_id", "text"] and 0 < kept.count() <= len(docs)
    want = leading(docs, items, 5)
    (base,) = spaces
    assert np.linalg.norm(base - want @ (want.T @ base)) < 1e-3
