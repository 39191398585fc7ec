"""Each operator against a brute-force form, and on nulls, empty and long texts, ties,
repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from platterlake.llm import chat, classifier, decontamination, line_dedup, lm, mixing, pii, quality_rules, simhash, token_counts
from platterlake.llm.common import stage
from platterlake.llm.graph import components
from platterlake.llm.templates import Template, TemplateError, parse

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, gone long"
LONG = "lorem ipsum dolor sit amet " * 20_000
HARD = [
    (1, None, None, None, None, "x", 1),
    (2, "", "en", "a", 0, "x", 2),
    (3, " \t\n\x0b\x0c\r ", "en", "a", 7, None, None),
    (4, "One line of five words\nOne line of five words\nshort", "en", "b", 1, "x", 3),
    (5, "One line of five words\nand another line of six words", "en", "b", 1, "x", 3),
    (5, "One line of five words\nand another line of six words", "en", "b", 1, "x", 3),
    (6, LONG, "de", None, 1, "x", 4),
    (7, "x" * 200_000, "de", "a", 1, "x", 4),
    (None, "a text without an id, é€ words", "fr", "c", 1, "x", 5),
]
GAP = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in GAP.split(t or "") if w]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "lorem ipsum dolor sit amet"), (2, None), (3, "")], "item_id long, text string")


def test_every_operator_takes_hard_rows(spark, hard, empty, bench):
    conv = lambda df: df.selectExpr("doc_id as conv_id", "n_chars as turn", "source as role", "text", "fp")
    labels = spark.createDataFrame([(1, 1), (4, None), (5, 0), (99, 1)], "doc_id long, quality int")
    for df, n in ((hard, len(HARD)), (empty, 0)):
        assert pii.redact(pii.find_spans(df)).count() == n
        assert simhash.cluster(df).count() == n
        assert line_dedup.without_lines(df).count() == n
        assert line_dedup.dedup(df).columns == df.columns
        params = classifier.train(*classifier.sample(df, labels))
        assert all(0 <= r.score <= 1 for r in classifier.scores(df, params).collect())
        assert chat.read_back(conv(df)).agg({"n_turns": "sum"}).first()[0] == (n or None)
        assert mixing.mix(mixing.sizes(df)).count() == n
        docs = df.selectExpr("doc_id", "false as held_out", "text")
        assert lm.score(docs, docs).count() == n
        assert decontamination.contaminated(df, bench).count() == n
        assert token_counts.token_counts(df).count() == n
        assert quality_rules.verdicts(df).count() == n


def test_pii_equals_brute_force(spark, sf):
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def luhn(d):
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0

    def brute(t):
        out = []
        for k, (kind, p) in enumerate(patterns):
            for m in re.finditer(p, t or ""):
                d = [int(c) for c in m[0] if c.isdigit() and c.isascii()]
                ok = {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
                if ok:
                    out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        return hashlib.sha256(",".join(x[2] for x in sorted(out)).encode()).hexdigest()

    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["a@b.c_d@e.f a@b.c.d@e.f", "1.2.3.4.5.6.7.8 1.2.3.256 01.002.3.4", "1.2.3.4" * 900, "a@" * 5000, "x@y" + ".z" * 9000, "4111 1111 1111 1111 411111111111111112345", "é@ü.de €€ b@c.de +1 (988) 555-2485"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = pii.find_spans(df).selectExpr("doc_id", "sha2(cast(array_join(transform(filter(pii, s -> s.k < 4), s -> concat_ws(':', s.kind, s.start, s.end)), ',') as binary), 256) as h")
    assert {r.doc_id: r.h for r in base.collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_pii_added_kinds_and_redaction(spark):
    text = "my IBAN is DE89 3704 0044 0532 0130 00, not DE89 3704 0044 0532 0130 01; call 555-123-4567; 123-45-6789"
    r = pii.redact(pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert r.text == "my IBAN is <IBAN>, not DE89 3704 0044 0532 0130 01; call <LOCAL_PHONE>; 123-45-6789"


def test_covering_and_forest():
    rnd = random.Random(3)
    masks = [m & (1 << 64) - 1 for m in simhash.masks()]
    for _ in range(3000):
        flips = sum(1 << i for i in rnd.sample(range(64), rnd.randrange(5)))
        assert any(flips & m == 0 for m in masks)
    assert min(m.bit_count() for m in masks) >= 32
    t = "A b  c\td E f"
    w = t.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(3)]
    assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)


@pytest.mark.parametrize("bucket", [20_000, 3])
def test_components_equal_brute_force(spark, bucket):
    rnd = random.Random(bucket)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(300):
        fps.append(rnd.choice(fps) ^ sum(1 << i for i in rnd.sample(range(64), rnd.randrange(1, 6))))
    fps = list(dict.fromkeys(fps))
    root = list(range(len(fps)))
    top = lambda i: i if root[i] == i else top(root[i])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[max(top(i), top(j))] = min(top(i), top(j))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = simhash.links(df, bucket=bucket)
    edges = found.where("v is not null")
    many = found.where("v is null").select("u").distinct()
    assert (many.count() > 0) == (bucket == 3)
    edges = edges.union(simhash._midpoint_links(many, 4))
    got = defaultdict(set)
    for r in components(edges).collect():
        got[r.root].add(r.node)
    want = defaultdict(set)
    for i, s in enumerate(signed):
        want[top(i)].add(s)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    base = [rnd.sample(vocab, rnd.randrange(5, 30)) for _ in range(15)]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(rnd.randrange(6)):
            w = list(rnd.choice(base))
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            lines.append(" ".join(w[: rnd.choice([3, 99, 99, 99])]))
        docs.append((i, "\n".join(lines)))
    seen, want = [], {}
    for i, t in docs:
        kept, own = [], set()
        for x in t.split("\n"):
            w = frozenset(words(x))
            if len(w) < 5:
                kept.append(x)
            elif x not in own:
                own.add(x)
                if not any(9 * len(w & s) >= 4 * (len(w) + len(s)) for s in seen):
                    kept.append(x)
                seen.append(w)
        want[i] = "\n".join(kept)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.without_lines(df).collect()} == want


def test_crowded_words_lose_no_match(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", 3)
    monkeypatch.setattr(line_dedup, "LAST", 1)
    test_line_dedup_equals_brute_force(spark)


def test_classifier_learns(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = classifier.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in got)
    assert right / len(got) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_classifier_equals_brute_force():
    rng = np.random.default_rng(3)
    p = {k: v + rng.normal(0, 0.1, v.shape).astype(np.float32) for k, v in classifier.start().items()}
    texts = ["", None, "short", "x" * 512, "a longer text, é€ " * 200, "z" * 1020, "tail " * 101, "b" * 500]

    def brute(t):
        raw = list((t or "").encode())
        data = raw + [256] * (-(-(len(raw) + classifier.WIDTH) // classifier.CHUNK) * classifier.CHUNK - len(raw))
        chunks = []
        for c in range(0, len(data), classifier.CHUNK):
            windows = [data[i : i + classifier.WIDTH] for i in range(c, c + classifier.CHUNK, classifier.STRIDE)]
            r = [p["emb"][w].astype(np.float64).ravel() @ p["conv"] for w in windows if len(w) == classifier.WIDTH]
            chunks.append(np.maximum(np.max(r, axis=0) + p["bias"], 0))
        z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), [1]]) @ p["head"]
        return 1 / (1 + math.exp(-z))

    want = [brute(t) for t in texts]
    assert np.allclose(classifier.score_texts(p, texts), want, atol=1e-5)
    for order in (texts[::-1], *([t] for t in texts)):  # alone or before any other text
        assert np.allclose(classifier.score_texts(p, order), [want[texts.index(t)] for t in order], atol=1e-5)


def test_classifier_gradient():
    rng = np.random.default_rng(4)
    p = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float64) for k, v in classifier.start().items()}
    texts, y = ["some words " * 90, "", "other text"], np.array([1.0, 0.0, 1.0])
    data = [classifier.padded(t) for t in texts]

    def loss(q):
        s = classifier.score_texts(q, texts)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    found = classifier._gradient(p, data, y)
    for k, at in (("head", (3,)), ("head", (-1,)), ("bias", (2,)), ("conv", (5, 2)), ("conv", (40, 7)), ("emb", (ord("w"), 1)), ("emb", (256, 2))):
        step = np.zeros_like(p[k])
        step[at] = 1e-5
        numeric = (loss(p | {k: p[k] + step}) - loss(p | {k: p[k] - step})) / 2e-5
        assert math.isclose(found[k][at], numeric, rel_tol=1e-3, abs_tol=1e-7)


def test_classifier_scores_stand_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    p = classifier.start()
    p["head"] += np.random.default_rng(5).normal(0, 1, p["head"].shape).astype(np.float32)
    one, many = ({r.doc_id: r.score for r in classifier.scores(docs.repartition(k), p).collect()} for k in (1, 13))
    assert all(math.isclose(one[i], many[i], abs_tol=1e-5) for i in one)


def test_classifier_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 40, "x" * 1000) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert len(classifier.sample(docs, labels, most_bytes=1 << 30)[0]) > 300
    texts, y = classifier.sample(docs, labels, most_bytes=60_000)
    assert len(texts) < 200 and len(texts) == len(y)
    assert (texts, y.tolist()) == (lambda a: (a[0], a[1].tolist()))(classifier.sample(docs.repartition(7), labels, most_bytes=60_000))


def test_templates():
    t = Template("{% for m in messages %}{% if loop.first %}<{% endif %}{% set n = m.text | upper ~ '!' %}{{ n }}{% if not loop.last %},{% else %}>{% endif %}{% endfor %}")
    assert t.render(messages=[{"text": "a"}, {"text": "b"}])[0] == "<A!,B!>"
    assert parse("{{ 1 + 2 * 3 }}{% if false %}x{% elif 1 == 1 %}y{% endif %}") == [("text", "7y")]
    assert Template("a{% generation %}bc{% endgeneration %}{# no #}d").render() == ("abcd", [(1, 3)])
    assert Template("{{ x.__class__ if_ }}" if False else "{{ x.upper }}").render(x="a")[0] == ""
    for bad in ("{{ x.__class__ }}", "{{ f() }}", "{% for %}", "{% if x %}", "{{ x", "{{ 'a' * 9 }}", "{{ x | nothing }}"):
        with pytest.raises(TemplateError):
            Template(bad).render(x=1)


def test_chat_escapes_and_sql(spark, sf):
    rnd = random.Random(1)
    for _ in range(500):
        s = "".join(rnd.choice(["\\", "<", "|", ">", "s", "/", "[", "INST", "]", "a", "SYS", *chat.CONTROL]) for _ in range(12))
        e = chat.escape(s)
        assert chat.unescape(e) == s and not any(c in e for c in chat.CONTROL)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.sql(chat.OP5_SQL)
    got = chat.op5_chat(spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_mixing_sql_and_bounds(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(mixing.OP6_SQL)
    got = mixing.op6_mixing(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert all(r.taken <= 2 * r["size"] for r in got)


def test_mixing_odds_are_those_of_the_sample(spark, monkeypatch):
    """One draw from 400 sources alike in sizes, each with random numbers of its own."""
    rnd, runs = random.Random(9), 400
    made = [int(rnd.lognormvariate(4, 1.2)) + 1 for _ in range(60)] + [5000]
    rows = [(i if i % 3 else None, f"{s:03}", n, f"{s} {i}") for s in range(runs) for i, n in enumerate(made)]
    rows += [(7, f"{s:03}", 50, "same") for s in range(runs) for _ in range(3)]
    monkeypatch.setattr(mixing, "WEIGHTS", (1,))
    monkeypatch.setattr(mixing, "SHARE_PERCENT", 70)
    df = stage(spark.createDataFrame(rows, "doc_id long, source string, size long, digest string"), "mixed")
    got, odds, words = Counter(), {}, Counter()
    for r in mixing.mix(df).collect():
        got[r["size"]] += r.copies
        odds[r["size"]] = r.odds
        words[r.source] += r.taken
        target = r.target
    alike = Counter(made + [50] * 3)
    assert math.isclose(sum(odds[n] * n * k for n, k in alike.items()), target, rel_tol=1e-9)
    assert odds[5000] == 1 and got[5000] == runs  # certain
    for n, k in alike.items():  # within four standard errors, and what the end of a draw may take more or less
        assert abs(got[n] - runs * k * odds[n]) <= 4 * math.sqrt(runs * k * odds[n] * (1 - odds[n])) + 0.04 * runs * k * odds[n], (n, got[n], runs * k * odds[n])
    assert all(abs(w - target) <= max(n for n in made if n < 5000) for w in words.values())


def test_mixing_hard_rows_equal_sql(spark):
    rows = [(1, None, "a"), (1, "x y", "a"), (1, "x y", "a"), (None, "x y", "a"), (None, "x y", "a"), (None, "z " * 30, "a"), (2, "", None), (3, "w " * 9, None), (4, "v " * 70, "b"), (5, "u " * 3, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con, documents = duckdb.connect(), df.toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = con.sql(mixing.OP6_SQL)
    got = mixing.mix(mixing.sizes(df)).select(*want.columns).collect()
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(map(tuple, got), key=key) == sorted(want.fetchall(), key=key)
    assert mixing.mix(mixing.sizes(df.limit(0))).count() == 0


def test_lm_base_and_normalisation(spark, sf):
    rows = {r.doc_id: lm.tokens(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    c = Counter(t for i, ts in rows.items() if not held[i] for t in ts)
    n, v = sum(c.values()), len(c)
    got = lm.op7_lm_scoring(spark, sf).collect()
    for r in got:
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in rows[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(rows[r.doc_id]), sum(c[t] > 0 for t in rows[r.doc_id]), n)
        assert math.isclose(base, r.base_score, rel_tol=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    vocab = lm.Vocabulary([(b"a", 5), (b"b", 2)], 7, 2, np.zeros(lm.CLASSES))
    w = lm.start(vocab)
    every = np.arange(lm.UNITS)
    total = sum(10 ** lm.log_probs(w, np.array([u]), np.array([1]))[0] for u in every)
    assert math.isclose(total, 1, rel_tol=1e-4)


def test_lm_gains_on_most_held_out_documents(spark, sf):
    rows = lm.op7_lm_scoring(spark, sf.replace("0.001", "0.01")).where("held_out").collect()
    perplexity = lambda c: 10 ** (-sum(r[c] for r in rows) / sum(r.n_tokens for r in rows))
    assert sum(r.score > r.base_score for r in rows) > 0.9 * len(rows)
    assert perplexity("score") < 0.92 * perplexity("base_score")


def test_lm_does_not_depend_on_layout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "false as held_out", "text")
    one, many = ({r.doc_id: r.score for r in lm.score(d, d).collect()} for d in (docs.repartition(1), docs.repartition(8)))
    assert all(math.isclose(one[i], many[i], rel_tol=1e-6) for i in one)


def test_lm_contexts_stop_at_texts():
    units, ends = np.array([1, 2, 3, 4, 5, 6]), np.array([1, 2, 6])
    assert lm.contexts(units, ends).tolist() == [[lm.UNITS, lm.UNITS, lm.UNITS, 3, 4, 5], [lm.UNITS, lm.UNITS, lm.UNITS, lm.UNITS, 3, 4]]


def test_decontamination_recall(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rnd = random.Random(2)
    for k, (_, t) in enumerate(items[:20]):  # paraphrases: a tenth of the words changed
        w = [x if rnd.random() > 0.1 else "zz" for x in t.split()]
        docs.append((10_000 + k, "some words before " * 9 + " ".join(w) + " and after" * 9))
    made = decontamination.Items([(i, t, None) for i, t in items])
    want = set()
    for d, t in docs:
        w = decontamination.words(t)
        parts = [w[p : p + 96] for p in range(0, max(1, len(w) - 79), 16)]
        want |= {(d, i) for k, (i, _) in enumerate(items) if any(made.match(k, p) for p in parts)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, h.item_id) for r in got.collect() for h in r.hits}
    assert len(want & found) >= 0.9 * len(want) and {10_000 + k for k in range(20)} <= {d for d, _ in found}
    assert decontamination.lcs(list("abcbdab"), list("bdcaba")) == 4


def test_decontamination_gives_every_row_once(spark, sf, monkeypatch):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(12).collect()]
    items += [(items[0][0], items[0][1] + " and more"), (900, "tiny item"), (901, None), (None, "no id at all here")]
    clean = "words that no item has " * 20
    docs = [(1, f"{clean}{items[0][1]}"), (1, clean), (None, clean), (None, f"{items[3][1]} {clean}"), (2, None), (2, ""), (3, f"x {items[5][1]} {items[7][1]}"), (3, f"x {items[5][1]} {items[7][1]}"), (4, "a tiny item")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, row string, hits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((r.doc_id, [h.item_id for h in r.hits]) for r in decontamination.contaminated(df, bench).collect()), key=key)
    held = lambda *at: sorted(items[i][0] for i in at)
    assert want == sorted([(1, held(0)), (1, []), (None, []), (None, held(3)), (2, []), (2, []), (3, held(5, 7)), (3, held(5, 7)), (4, [900])], key=key)
    left = decontamination.clean_documents(df, bench)
    assert left.columns == df.columns and sorted(map(str, left.select("doc_id").collect())) == ["Row(doc_id=1)", "Row(doc_id=2)", "Row(doc_id=2)", "Row(doc_id=None)"]
    assert decontamination.clean_documents(df.limit(0), bench).count() == 0 and decontamination.clean_documents(df, bench.limit(0)).count() == len(docs)
    monkeypatch.setattr(decontamination, "ITEMS", 5)
    got = decontamination.contaminated(df, bench).collect()
    assert sorted(((r.doc_id, [h.item_id for h in r.hits]) for r in got), key=key) == want
    assert decontamination.clean_documents(df, bench).count() == 4


def test_latent_space_is_a_truncated_svd(spark):
    rnd, n = np.random.default_rng(6), 40
    texts = [" ".join(f"t{k}" for k in (n * rnd.random(60) ** 2).astype(int)) for _ in range(80)]
    terms, idf = {f"t{k}".encode(): k for k in range(n)}, 1 + rnd.random(n)
    rows = []
    for t in texts:  # whole blocks only
        w = [terms[x] for x in decontamination.words(t)]
        a = np.bincount(w, minlength=n) * idf
        rows.append(a / np.sqrt((idf[w] ** 2).sum()))
    values = np.linalg.svd(np.array(rows), compute_uv=False)
    base, got = decontamination.latent_space(spark.createDataFrame([(t, 1.0) for t in texts], "text string, weight double"), terms, idf, rank=12)
    assert base.shape == (n, 12) and np.allclose(base.T @ base, np.eye(12), atol=1e-4)
    assert np.allclose(got, values[:12], rtol=0.05)


def test_token_counts_equal_library(spark, sf):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in token_counts.op9_token_counts(spark, sf).collect():
        assert r.n_tokens == len(lib.encode(texts[r.doc_id])) and r.n_bytes == len(texts[r.doc_id].encode())
    c, rnd = token_counts.counter(), random.Random(4)
    for t in [*["".join(rnd.choice(["a", "th", "e", " ", "  ", "▁", "é", "\n", "字", "<s>", "ing"]) for _ in range(40)) for _ in range(60)], *[t[:90] for t in texts.values()][:40]]:
        counts = [len(lib.encode(t[:i])) for i in range(len(t) + 1)]
        assert c.prefix_counts(t) == counts
        budget = rnd.randrange(1, 30)
        assert c.longest_prefix(t, budget) == max(i for i, n in enumerate(counts) if n <= budget)


def test_stored_prefixes_answer_budgets(spark):
    texts = ["", None, "one two  three", " lead and trail ", "word " * 50, "字é ok\n" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c = token_counts.counter()
    for budget in (0, 1, 3, 7, 1000):
        rows = token_counts.token_counts(df, prefixes=True).withColumn("fit", token_counts.within(budget)).collect()
        for r in rows:
            t = texts[r.doc_id] or ""
            every = c.prefix_counts(t)
            assert r.n_tokens == every[-1] == (r.end_tokens or [0])[-1]
            assert [every[n] for n in r.end_chars if n >= 0] == [k for k, n in zip(r.end_tokens, r.end_chars) if n >= 0]
            assert r.fit == max([0, *(n for k, n in zip(r.end_tokens, r.end_chars) if k <= budget)])
            assert every[r.fit] <= budget or r.fit == 0


def test_quality_verdicts_equal_brute_force(spark):
    rnd = random.Random(12)
    docs = []
    for i in range(400):
        lang, source = rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "a", "b", None])
        w = [("W" if rnd.random() < 0.1 else "w") + rnd.choice("abcde") * rnd.choice([1, 3, 5, 9]) + str(rnd.randrange(999)) for _ in range(rnd.randrange(5, 60))]
        if rnd.random() < 0.1:
            w += rnd.choice([["#"] * 40, ["!!!"] * 60, ["x" * 3000] * 9, ["LOUD" + str(k) for k in range(80)]])
        docs.append((i, " ".join(w), lang, source))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    stats = [dict(zip(quality_rules.STATS, quality_rules.measure(t))) for _, t, *_ in docs]

    def bucket(v):
        return v if v <= 1000 else 1000 + math.floor(100 * math.log2(v / 1000))

    failed = [s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"] for s in stats]
    values = [{m: bucket(k * s[a] // s[b]) if s[b] else 0 for m, (a, b, k, *_) in quality_rules.MEASURES.items()} for s in stats]

    def quartiles(m, keep):
        v = sorted(x[m] for x, f, d in zip(values, failed, docs) if not f and keep(d))
        return len(v), [v[max(0, math.ceil(q * len(v)) - 1)] for q in (0.25, 0.75)]

    def kept(k):
        _, _, lang, source = docs[k]
        for m, (*_, least, below) in quality_rules.MEASURES.items():
            q = quartiles(m, lambda d: True)[1]
            for keep in (lambda d: d[2] == lang, lambda d: d[2:] == (lang, source)):
                n, own = quartiles(m, keep)
                q = [(n * o + 30 * p) / (n + 30) for o, p in zip(own, q)]
            spread = max(q[1] - q[0], least)
            if not (q[0] - 3 * spread if below else 0) <= values[k][m] <= q[1] + 3 * spread:
                return False
        return True

    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.verdicts(df).collect()}
    assert got == {k: (failed[k], not failed[k] and kept(k)) for k in range(len(docs))}
    assert 10 < sum(not f and not g for f, g in got.values()) < 60
    left = quality_rules.kept_documents(df.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "doc_id as t", "doc_id as bad_t"))
    assert {r.t for r in left.collect()} == {k for k, (_, g) in got.items() if g} and left.columns[-1] == "bad_t"


def test_quality_counts_equal_brute_force(spark, sf):
    def brute(t):
        w = words(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in quality_rules.op10_quality_rules(spark, sf).collect():
        n = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.kept and r.base_failed)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(quality_rules.OP10_SQL)
    assert sorted(map(tuple, quality_rules.op10_quality_rules(spark, sf).select(*want.columns).collect())) == sorted(want.fetchall())
    many = [b"%d" % i for i in range(9000)]
    assert quality_rules.repeated_words(many + many[:7]) == 14


def test_pipeline(spark, sf):
    import corpus_pipeline

    assert [len(x) for x in corpus_pipeline.STAGES] == [2] * 5
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() < spark.read.parquet(f"{sf}/documents.parquet").count()
