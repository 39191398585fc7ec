"""Tokens of line dedup: one hash for the words of each part, however the parts' starts are found."""

import random

from platterlake.llm import line_dedup as d


def test_parts_are_the_same_by_search_and_by_list(spark, monkeypatch):
    rnd = random.Random(8)
    lines = [" ".join(f"w{rnd.randrange(9000)}" for _ in range(n)) for n in [1, 2, 3, 4, 5, 7, 9, 15, 16, 17, 31, 60, 130, 2000]]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, f"{lines[8]} \n{lines[12]}  new")], "doc_id long, text string")
    got = []
    for most in (0, 64, 1 << 20):
        monkeypatch.setattr(d, "LOOKED", most)
        got.append(sorted(map(tuple, d._sets(df, "text", 1).collect())))
    assert got[0] == got[1] == got[2]

    sets, heads = {}, 0
    for token, h, line, apart, head in got[0]:
        sets.setdefault((h, line), []).append(token)
        heads += head
    assert heads == len(sets) and all(len(set(t)) == len(t) == line & (1 << 20) - 1 for (_, line), t in sets.items())
    # A space changes no set of words; a word more spoils one token of a class at most.
    by = {}
    for (h, line), tokens in sets.items():
        by.setdefault(line >> 20 & (1 << 20) - 1, []).append((line >> 40, set(tokens)))
    n = [len(set(t.split())) for t in lines]
    assert any(a is not b and a[1] == b[1] for p in by.values() for a in p for b in p if a[0] == b[0] == n[8])
    assert any(len(a[1] - b[1]) <= 1 and len(b[1] - a[1]) <= 1 for p in by.values() for a in p for b in p if (a[0], b[0]) == (n[12], n[12] + 1))
