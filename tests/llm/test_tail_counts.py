"""Tokens outside the head of the language model reach the join once a document, with their count."""

import numpy as np

from platterlake.llm import lm


def test_tail_tokens_come_once_a_document(spark):
    vocab = lm.Vocabulary([(b"a", 9), (lm.END, 4)], 13, 2, np.zeros(lm.CLASSES))
    texts = ["a x X y a", None, "y", " ", "z " * 50]
    docs = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string").coalesce(1)
    got = {r.doc_id: (r.n_tokens, r.n_head, r.tail) for r in lm._scored(docs, vocab, lm.start(vocab)).collect()}
    assert got == {0: (6, 3, {"x": 2, "y": 1}), 1: (1, 1, {}), 2: (2, 1, {"y": 1}), 3: (1, 1, {}), 4: (51, 1, {"z": 50})}
