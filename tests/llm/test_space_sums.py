"""Sums of the latent space and the bound before the LCS, against plain ways to the same."""

import numpy as np

from platterlake.llm import decontamination as d


def test_product_equals_dense_sums():
    rng = np.random.default_rng(4)
    n, width, texts = 60, 7, [4, 9, 400, 5, 30]
    # One term in a third of all places, some terms a few times, and unknown words.
    ids = rng.choice(n + 1, (sum(texts), d.BLOCK), p=[1 / 3, *rng.dirichlet(np.full(n - 1, 0.3)) / 3, 1 / 3])
    firsts, weights = np.concatenate(([0], np.cumsum(texts))), rng.random(len(texts))
    idf, by = rng.random(n) + 0.1, rng.normal(size=(n, width)).astype(np.float32)
    got = np.zeros((n, width))
    d._Fit(np.arange(n + 1), idf, by).product(got, ids, firsts, weights)
    want = np.zeros((n, width))
    for s, e, w in zip(firsts, firsts[1:], weights, strict=False):
        for k in range(s, e - d.SPAN + 1):
            a = np.bincount(ids[k : k + d.SPAN].ravel(), minlength=n + 1)[:n] * idf
            # A block counts the length of a passage by its own terms: (sum of squares of each word).
            a2 = (np.append(idf, 0)[ids[k : k + d.SPAN]] ** 2).sum()
            want += w * np.outer(a, a @ by) / max(a2, 1e-9)
    assert np.allclose(got, want, rtol=1e-3, atol=1e-4 * np.abs(want).max())


def test_words_are_counted_only_where_enough_different_ones_are(monkeypatch):
    item = " ".join(f"w{i}" for i in range(20)).split()
    items = d.Items([(7, " ".join(item), None)])
    search = d.Search(items, np.arange(21), np.ones(20), np.eye(20, dtype=np.float32))
    few, many = [*["w1"] * 30, *["x"] * 34], [*item[:15], *["x"] * 49]
    docs = [" ".join(ws).encode().split() for ws in (few, many)]
    numbers = np.array([[items.terms.get(w, 20) for w in ws] for ws in docs]).reshape(-1, d.BLOCK)
    monkeypatch.setattr(d.Search, "near", lambda self, grid, firsts: iter([(0, 0, 0), (1, 0, 0)]))
    counted, whole = [], d.Counter
    monkeypatch.setattr(d, "Counter", lambda ws: counted.append(ws) or whole(ws))
    assert search.look(numbers, np.array([0, 4, 8]), docs.__getitem__) == [{}, {7: 0.75}]
    assert counted == [docs[1]]
