"""Tokens of line dedup: in which classes a line has them, and that lines which match share enough."""

import random

from platterlake.llm import line_dedup as d


def test_lines_that_match_share_tokens_of_few_classes(spark):
    rnd = random.Random(5)
    pairs = []
    for a in [*range(1, 70), 95, 100, 101, 126, 127, 128, 129, 150, 159, 160, 255, 256, 300]:
        for b in {a, 5 * a // 4, min(a + 1, 5 * a // 4)}:
            o = -(-4 * (a + b) // 9)
            words = [f"{a}.{b}.{i}.{rnd.random()}" for i in range(a + b - o)]
            pairs.append((a, b, " ".join(words[:a]), " ".join(words[a - o :])))
    df = spark.createDataFrame([(i, "\n".join(p[2:])) for i, p in enumerate(pairs)], "doc_id long, text string")
    of = {r.line: r.h for r in d._lines(df, "text", 1).select("line", "h").collect()}
    sets = {}
    for token, h, line, apart, _ in d._sets(df, "text", 1).collect():
        sets.setdefault(h, {}).setdefault((line >> 20 & (1 << 20) - 1, apart, line & (1 << 20) - 1), set()).add(token)
    for a, b, x, y in pairs:
        differ = a + b - 2 * -(-4 * (a + b) // 9)
        met = [(s, t, q, r, m, n) for (p, m, q), s in sets[of[x]].items() for (k, n, r), t in sets[of[y]].items() if p == k]
        # In one class at least each spoils a token at most, and none differs in more words than the class allows.
        assert any(len(s & t) >= max(q, r) - differ and differ <= min(m, n) for s, t, q, r, m, n in met), (a, b)
        # Lines meet in the class of the shorter one, so one just under the end of a class has no tokens of the next.
        end = 1 << max(2, a.bit_length())
        assert len(sets[of[x]]) == (2 if a > 4 and 5 * (end // 2 - 1) >= 4 * a else 1), a
