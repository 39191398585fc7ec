"""Lines of few words in line dedup, against brute force over all lines that are not blank."""

import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
from platterlake.llm import line_dedup

SCHEMA = "doc_id long, text string"


def brute(docs):
    seen, want = [], {}
    for i, t in docs:
        kept, own = [], set()
        for x in t.split("\n"):
            w = frozenset(x.split())
            if not w:
                kept.append(x)
            elif x not in own:
                own.add(x)
                if not any(9 * len(w & s) >= 4 * (len(w) + len(s)) for s in seen):
                    kept.append(x)
                seen.append(w)
        want[i] = "\n".join(kept)
    return want


def test_short_lines_equal_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(25)]
    docs = [(i, "\n".join(" ".join(rnd.choices(vocab, k=rnd.choice([0, 1, 2, 3, 4, 5, 6, 7]))) for _ in range(rnd.randrange(1, 6)))) for i in range(150)]
    docs += [(200, "一行没有空格的文字"), (201, "一行没有空格的文字\n\n\nother"), (202, "ha " * 200), (203, "x1 x2\n" + "ha " * 200)]
    df = spark.createDataFrame(docs, SCHEMA)
    want = brute(docs)
    assert {r.doc_id: r.text for r in line_dedup.without_lines(df, least=1).collect()} == want
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_chars for r in line_dedup.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: len(t) for i, t in want.items()}
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, df, "").collect()}
    assert 202 not in {i for i, t in left.items() if not t.strip()} and 200 in left and left[203] == "x1 x2"


def test_documents_equal_brute_force(spark, sf):
    """The query over a whole table, against every earlier line that shares a rare word."""
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    sets = {x: frozenset(x.encode().split()) for _, t in docs for x in t.split("\n")}
    often = Counter(w for s in sets.values() for w in s)
    index, seen, want = defaultdict(list), set(), {}
    for i, t in docs:
        kept, own = [], set()
        for x in t.split("\n"):
            s = sets[x]
            if not s:
                kept.append(x)
            elif x not in own:
                own.add(x)
                rare = sorted(s, key=lambda w: (often[w], w))[: len(s) - (8 * len(s) + 9) // 10 + 1]
                if x not in seen and not any(9 * len(s & o) >= 4 * (len(s) + len(o)) for w in rare for o in index[w]):
                    kept.append(x)
                for w in rare:
                    index[w].append(s)
        seen |= own
        want[i] = hashlib.sha256("\n".join(kept).encode()).hexdigest()
    assert {r.doc_id: r.text_sha256 for r in line_dedup.op3_line_dedup(spark, sf).collect()} == want
