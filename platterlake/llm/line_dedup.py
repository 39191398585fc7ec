"""Line deduplication by an exact set-similarity join.  DataFrame functions only.

A line is its set of words.  Two lines match if the Jaccard similarity of their sets is
``JACCARD`` or more; equal lines do.  A line is removed if it matches any earlier one, in
order of (doc_id, hash of the text, place in the text), whether or not that one is removed
itself.  Lines of fewer than ``least`` different words are left alone: by default
``LEAST_WORDS``; the query and the pipeline give 1, so that only blank lines are.

The join.  Sets of a and b words that match differ in at most ``(a + b) / 9`` words.  Words
are dealt by hash into parts, and the first ``TAKEN`` words of a line in one part, by hash, are
together a *token*; a word that differs spoils one token only.  Tokens are counted exactly, over
all lines, and ordered by rarity.  By the prefix filter, lines that match share two of their
``d + 2`` rarest tokens, where d words may differ, or one where a line has but d + 1.  Tokens
that no other line has are the rarest, so a line with more than d of them meets nobody.
Length and place bound what is left, and the words themselves are compared.  Lengths go in
classes that double; two lines meet in that of the shorter one, so a line near the class below
has tokens of that class too.  A line whose
words fall into d parts or fewer could share no token with a match that is as thin; thin
lines meet by their rarest words.

No token gives all pairs of its lines.  Where it has up to ``FEW`` lines, each meets the
earlier ones.  Where it has more, each first meets one of the earliest and the ``LAST`` before
it, that of the nearest parities: lines in a crowd of near copies find their match there.  Only
lines without a match so far then meet all earlier lines of such tokens that pass the length,
place and parity filters.

Lines are told apart by 128 bits, words of two lines by 64.

Defined results: null texts stay null; rows equal in id and text are one document, and keep
the same lines; other rows with one id, or without an id (these come first), are documents
of their own; a document whose every line goes is dropped by :func:`dedup` unless it was blank before;
empty tables give no rows; columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, let, stage, table, unstage

LEAST_WORDS = 5
#: Jaccard of 0.8: an overlap o of sets of a and b words needs 9 o >= 4 (a + b).
JACCARD = 0.8
#: Parts of a class are so many times the words that may differ and one more.
SPREAD = 1.1
#: Parts into which words are dealt at most, so that their number has room in a packed column.
PARTS = (1 << 20) - 1
#: Words of a line that are looked through at once; longer lines are cut, so that no row is large.
LOOKED = 1024
#: Words of a part that a token has at most: the first ones, by hash.
TAKEN = 6
#: Tokens are counted in so many passes, which bounds the shuffle files that exist at once.
PASSES = 2
#: Lines of a token that may meet each other at once.
FEW = 64
#: Lines just before a line of a crowded token that it meets besides the earliest.
LAST = 16
#: Hashes sent to every executor at most; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
_BLANKS = " \t\x0b\x0c\r"


def _words(line: Column) -> Column:
    """The different words of a line and perhaps one empty string."""
    for gap in _BLANKS[1:]:
        line = F.replace(line, F.lit(gap), F.lit(" "))
    return F.array_distinct(F.split(line, " ", -1))


def _size(words: Column) -> Column:
    return F.size(words) - F.array_contains(words, "").cast("int")


def _counts(line: Column, least: int) -> Column:
    """Whether the line has ``least`` different words; one word shows at the first character."""
    return F.ltrim(line, F.lit(_BLANKS)) != "" if least <= 1 else _size(_words(line)) >= least


def _lines(docs: DataFrame, text: str, least: int) -> DataFrame:
    """(doc_id, t, at, line, h, g): each different line of a document at its first place; t
    hashes the text, h and g the line."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("t"), F.posexplode(F.array_distinct(F.split(body, "\n", -1))).alias("at", "line"))
    return rows.where(_counts(F.col("line"), least)).select("*", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def _end(n: Column) -> Column:
    """The length at which the class of ``n`` words ends: 4, 8, 16 and so on."""
    return F.call_function("shiftleft", F.lit(2), F.greatest(F.lit(1), F.floor(F.log2(n.cast("double"))).cast("int")))


def _most(n: Column, lower: Column) -> Column:
    """In how many words a line of ``n`` words and a match differ at most: in the class of the
    line, where a match has any length, or in the one below, where the match ends."""
    return F.floor((n + F.when(lower, (_end(n) / 2).cast("int") - 1).otherwise(F.floor(n * 5 / 4))) / 9).cast("int")


def _classes(n: Column) -> Column:
    """(parts, apart) of the classes in which a line of ``n`` words can meet others: into how
    many parts words are dealt, and in how many words a match can differ at most."""
    end = _end(n)

    # The longest two lines that meet in a class have ``last`` words and 5/4 of these.
    def of(last: Column, apart: Column) -> Column:
        parts = F.when(last == 3, 1).otherwise(F.ceil(SPREAD * (1 + F.floor((last + F.floor(last * 5 / 4)) / 9))))
        # Too few parts for a line of millions of words make it a thin one.
        return F.struct(F.least(parts, F.lit(PARTS)).cast("int").alias("parts"), apart.alias("apart"))

    own, last = of(end - 1, _most(n, F.lit(False))), (end / 2 - 1).cast("int")
    return F.when((end > 4) & (5 * last >= 4 * n), F.array(own, of(last, _most(n, F.lit(True))))).otherwise(F.array(own))


def _hashes(line: Column) -> Column:
    """The different words of a line as ordered hashes; an empty string is no word."""
    for gap in _BLANKS[1:]:
        line = F.replace(line, F.lit(gap), F.lit(" "))
    hashes = F.transform(F.split(line, " ", -1), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_distinct(F.array_remove(hashes, F.xxhash64(F.lit("")))))


def _sets(docs: DataFrame, text: str, least: int) -> DataFrame:
    """(token, h, line, apart, head): the tokens of each different line, by class.  The line's length, parts
    and number of tokens q are packed in ``line``; one token of each set is its head."""
    lines = _lines(docs, text, least).select("h", "g", "line")
    # Equal lines are combined before they are dealt by hash, so a hot line is one row a task.
    lines = lines.groupBy("h", "g").agg(F.first("line").alias("line")).select("h", _hashes(F.col("line")).alias("words"))
    lines = lines.select("h", "words", F.size("words").alias("n"))
    lines = lines.select("h", "words", "n", F.explode(_classes(F.col("n"))).alias("c")).select("h", "words", "n", "c.parts", "c.apart")

    # Parts are ranges of hashes, so the words of one stand together, and a row is needed for its first word only.
    # 43 bits of a hash, as a fraction of all of them, times the parts: 63 bits at most.
    def part(w: Column) -> Column:
        return F.shiftright((F.shiftright(w, 21) + F.lit(1 << 42)) * F.col("parts"), 43).cast("int")

    packed = F.expr("shiftleft(cast(n as bigint), 40) | shiftleft(cast(parts as bigint), 20)").bitwiseOR(F.size(F.array_distinct(F.transform("words", part))).cast("long"))
    # A long line is looked through in pieces, each with the word before it and those that its last token may have.
    most = max(1, LOOKED)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most).cast("int")), lambda k: F.slice("words", F.greatest(k * most, F.lit(1)), most + TAKEN + 1))
    lines = lines.select("h", "n", "parts", "apart", packed.alias("line"), F.posexplode(F.when(F.col("n") > most, cut).otherwise(F.array("words"))).alias("k", "words"))
    rows = lines.select("h", "parts", "apart", "line", "words", "k", F.posexplode("words").alias("i", "w"))
    at = F.when(F.col("k") == 0, F.col("i")).otherwise(F.col("i") - 1)
    head = (F.col("k") == 0) & (F.col("i") == 0)
    rows = rows.where((at >= 0) & (at < most) & (head | (part(F.col("w")) != part(F.get("words", F.col("i") - 1)))))
    # Words of other parts are null, which leaves a hash as it is.
    more = [F.when(part(F.get("words", F.col("i") + j)) == part(F.col("w")), F.get("words", F.col("i") + j)) for j in range(1, TAKEN)]
    return rows.select(F.xxhash64("parts", part(F.col("w")), "w", *more).alias("token"), "h", "line", "apart", head.alias("head"))


def _unpacked() -> tuple[Column, Column, Column]:
    """Length, parts and number of tokens of a line."""
    low, line = F.lit((1 << 20) - 1), F.greatest("line", F.bitwise_not("line"))
    return F.shiftright(line, 40).cast("int").alias("n"), F.shiftright(line, 20).bitwiseAND(low).cast("int").alias("parts"), line.bitwiseAND(low).cast("int").alias("q")


def _packed(sets: DataFrame) -> DataFrame:
    """(token, h, line) of ``sets``; ``line`` is inverted where ``apart`` is that of the class below."""
    n = F.shiftright("line", 40).cast("int")
    return sets.select("token", "h", F.when(F.col("apart") == _most(n, F.lit(False)), F.col("line")).otherwise(F.bitwise_not("line")).alias("line"))


def _chosen(postings: DataFrame) -> DataFrame:
    """(token, h, n, q, place, lines) of the postings (token, h, line, lines) of repeated tokens
    that stand among the apart + 2 rarest of a line's q, where enough of them do: lines that match
    share two of these, or as many more than ``apart`` as a line has.  Steps are written, so that
    shuffle files of one at a time exist."""
    n, _, q = _unpacked()
    # From the commonest down, so that tokens of no other line, the rarest, need not be there.
    rank = W.partitionBy("h", "line").orderBy(F.col("lines").desc(), "token")
    rows = postings.select("token", "h", "line", F.row_number().over(rank).alias("down"), F.lead("token").over(rank).isNull().alias("last"))
    rows = rows.select("token", "h", n, q, (q + 1 - F.col("down")).alias("place"), "last", (_most(n, F.col("line") < 0) + 2).alias("most"))
    # The last of a line in the last place is alone, but two are needed where a line has so many tokens.
    rows = stage(rows.where((F.col("place") <= F.col("most")) & ~(F.col("last") & (F.col("place") == F.col("most")))).drop("last", "most"), "placed")
    out = stage(rows.withColumn("lines", F.count("*").over(W.partitionBy("token"))).where("lines > 1"), "chosen")
    unstage(rows)
    return out


def _repeated(sets: DataFrame) -> list[DataFrame]:
    """The postings of tokens that stand in more than one line, in PASSES tables."""
    out = []
    for k in range(PASSES):
        rows = sets.where(F.pmod("token", F.lit(PASSES)) == k).withColumn("lines", F.count("*").over(W.partitionBy("token"))).where("lines > 1")
        out.append(stage(rows, "repeated"))
    return out


def _may_match(a: str, b: str) -> Column:
    """Length and place filters of two postings of one token."""
    c = lambda t, x: F.col(f"{t}.{x}")
    length = 5 * F.least(c(a, "n"), c(b, "n")) >= 4 * F.greatest(c(a, "n"), c(b, "n"))
    return length & (F.greatest(c(a, "place"), c(b, "place")) <= F.floor((c(a, "n") + c(b, "n")) / 9) + 2)


def _parities(hashes: Column) -> Column:
    """128 bits of parity; those of two lines differ in at most as many bits as words do."""

    # The sign picks the half, the last six bits the place in it.
    def bits(half: Callable[[Column], Column]) -> Column:
        one = lambda h: F.shiftrightunsigned(half(h), 63)
        place = lambda h: h.bitwiseAND(F.lit(63)).cast("int")
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", one(h), place(h))))

    return F.struct(bits(lambda h: h).alias("a"), bits(F.bitwise_not).alias("b"))


def _apart(e: Column, l: Column) -> Column:  # noqa: E741
    """Parity bits in which two lines differ."""
    return F.bit_count(e["bits"]["a"].bitwiseXOR(l["bits"]["a"])) + F.bit_count(e["bits"]["b"].bitwiseXOR(l["bits"]["b"]))


def _near(e: Column, l: Column) -> Column:  # noqa: E741
    """Whether line ``e`` is earlier than ``l`` and passes the length, place and parity filters."""
    total = e["n"] + l["n"]
    length = 5 * F.least(e["n"], l["n"]) >= 4 * F.greatest(e["n"], l["n"])
    place = F.greatest(e["place"], l["place"]) <= F.floor(total / 9) + 2
    return (e < l) & length & place & (_apart(e, l) <= total - 2 * F.ceil(total * 4 / 9))


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has few enough rows; else the shuffle joins it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _pairs(postings: DataFrame) -> DataFrame:
    """(u, v) with u < v: lines that share enough of the tokens of ``postings``, each of FEW lines at most."""
    a, b = postings.alias("e"), postings.alias("l")
    met = a.join(b, F.col("e.token") == F.col("l.token")).where((F.col("e.h") < F.col("l.h")) & _may_match("e", "l"))
    need = F.least(F.lit(2), F.greatest("e.q", "l.q") - F.floor((F.col("e.n") + F.col("l.n")) / 9))
    met = met.groupBy(F.col("e.h").alias("u"), F.col("l.h").alias("v")).agg(F.count("*").alias("shared"), F.max(need).alias("need"))
    return met.where("shared >= need").select("u", "v")


def _verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(h, g): the later line of each pair (u, v) whose words match."""
    lines = known.where("words is not null").select("h", "g", "first", "words")
    a, b = lines.alias("a"), lines.alias("b")
    both = pairs.join(a, F.col("u") == F.col("a.h")).join(b, F.col("v") == F.col("b.h"))
    share = 9 * F.size(F.array_intersect("a.words", "b.words")) >= 4 * (F.size("a.words") + F.size("b.words"))
    key = lambda x: F.struct(f"{x}.first", f"{x}.h", f"{x}.g")
    later = F.greatest(key("a"), key("b"))
    return both.where(share & (key("a") != key("b"))).select(later["h"].alias("h"), later["g"].alias("g")).distinct()


def _known(docs: DataFrame, text: str, least: int, wanted: DataFrame) -> DataFrame:
    """(h, g, first, docs, crowded, words) of every line that stands in several documents or
    is ``wanted`` (h, crowded); only the latter has words, as hashes."""
    rows = _lines(docs, text, least).join(_small(wanted), "h", "left")
    rows = rows.select("h", "g", F.struct("doc_id", "t", "at").alias("first"), "crowded", F.when(F.col("crowded").isNotNull(), _hashes(F.col("line"))).alias("words"))
    out = rows.groupBy("h", "g").agg(F.min("first").alias("first"), F.count("*").alias("docs"), F.first("crowded").alias("crowded"), F.first("words").alias("words"))
    return out.where("docs > 1 or words is not null")


def matched_lines(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(h, g, first, docs, near): lines that have equal or earlier near copies.  first is the
    first place of the line, docs how many texts have it, near whether an earlier line matches."""
    # The numbers of a line are one column while rows move.
    sets = stage(_packed(_sets(docs, text, least)), "sets")
    n, parts_of, q = _unpacked()
    thin = stage(sets.where(q <= _most(n, F.col("line") < 0)).select("h", n, parts_of).distinct(), "thin")
    parts = _repeated(sets)
    unstage(sets)
    postings = parts[0]
    for more in parts[1:]:
        postings = postings.union(more)
    chosen = _chosen(postings)
    unstage(*parts)
    pairs = few = stage(_pairs(chosen.where(F.col("lines") <= FEW)), "pairs")
    crowd = chosen.where(F.col("lines") > FEW)
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("h"), F.lit(False).alias("crowded"))
    wanted = wanted.union(crowd.select("h", F.lit(True))).union(thin.select("h", F.lit(True))).groupBy("h").agg(F.max("crowded").alias("crowded"))
    known = stage(_known(docs, text, least, stage(wanted, "wanted")), "known")

    # Thin lines meet by their rarest words, counted among thin lines.
    rare = thin.join(known.where("words is not null"), "h").select("h", "n", "parts", F.floor(F.col("n") / 5).cast("int").alias("apart"), F.col("n").alias("q"), F.explode("words").alias("w"))
    rare = rare.withColumn("token", F.xxhash64(F.lit("thin"), "parts", "w")).drop("w").withColumn("lines", F.count("*").over(W.partitionBy("token"))).where("lines > 1")
    down = F.row_number().over(W.partitionBy("h", "parts").orderBy(F.col("lines").desc(), "token"))
    rare = rare.withColumn("place", F.col("q") + 1 - down).where("place <= apart + 1").select("token", "h", "n", F.lit(0).alias("q"), F.lit(0).alias("place"))
    rare = stage(rare.withColumn("lines", F.count("*").over(W.partitionBy("token"))).where("lines > 1"), "rare")
    pairs = pairs.union(_pairs(rare.where(F.col("lines") <= FEW)))

    # The order comes first, so the least of these structs is the earliest line.
    lines = known.where("crowded").select("h", "g", "first", _parities(F.col("words")).alias("bits"))
    line = F.struct("first.doc_id", "first.t", "first.at", "h", "g", "n", "place", "bits")
    crowd = stage(crowd.union(rare.where(F.col("lines") > FEW)).join(lines, "h").select("token", line.alias("l")), "crowd")
    before = W.partitionBy("token").orderBy("l")
    near = F.array(F.first("l").over(before.rowsBetween(W.unboundedPreceding, 0)), *(F.lag("l", k).over(before) for k in range(1, LAST + 1)))
    # A line tries one neighbour in each of its tokens, so crowds cost rows in proportion to their postings.
    some = crowd.select("l", near.alias("near"))
    fits = F.filter("near", lambda e: _near(e, F.col("l")))
    some = some.select("l", F.array_min(F.transform(fits, lambda e: F.struct(_apart(e, F.col("l")).alias("apart"), e.alias("e"))))["e"].alias("e")).where("e is not null")
    ids = [F.col("e.h").alias("u"), F.col("l.h").alias("v")]
    found = stage(_verified(pairs.union(some.select(*ids)).distinct(), known), "found")

    # Equal words in another order or spacing are near copies too; their hashes differ.
    crowd = crowd.select("token", "l")
    open_ = crowd.join(_small(found), (F.col("l.h") == F.col("h")) & (F.col("l.g") == F.col("g")), "left_anti")
    rest = open_.join(crowd.select("token", F.col("l").alias("e")), "token").where(_near(F.col("e"), F.col("l")))
    found = found.union(_verified(rest.select(*ids).distinct(), known)).distinct().withColumn("near", F.lit(True))
    out = known.select("h", "g", "first", "docs").join(_small(stage(found, "found")), ["h", "g"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    out = stage(out.where("near or docs > 1"), "matched")
    unstage(thin, few, known, rare, crowd)
    return out


def _places(docs: DataFrame, text: str, least: int) -> DataFrame:
    """(doc_id, t, lost): the places, among a document's different lines, of those it loses."""
    bad = matched_lines(docs, text, least).select("h", "g", "first", "near")
    lost = _lines(docs, text, least).drop("line").join(_small(bad), ["h", "g"])
    lost = lost.where(F.col("near") | ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("t") != F.col("first.t")))
    return lost.groupBy("doc_id", "t").agg(F.collect_set("at").alias("lost"))  # lines of one document


def _cleaned(docs: DataFrame, text: str, least: int) -> DataFrame:
    """(row, kept, gone, blank): each row of ``docs`` as a struct, its text without later
    matches, how many lines went and whether there was a word before."""
    lost = stage(_places(docs, text, least), "lost")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("t"), F.col(text).alias("text"))
    lost = _small(lost.select(F.col("doc_id").alias("lost_id"), F.col("t").alias("lost_t"), "lost"))
    rows = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("t") == F.col("lost_t")), "left")

    def kept(every: Column) -> Column:
        """The lines left.  One of enough words is marked alike wherever it stands, so array_except
        drops lines lost and lines repeated in one linear pass; another is marked by its place and stays."""
        once = F.array_distinct(every)
        marked = F.transform(every, lambda x, i: F.when(_counts(x, least), F.concat(F.lit(":"), x)).otherwise(F.concat(i.cast("string"), F.lit(":"), x)))
        gone = F.transform(F.coalesce("lost", F.array().cast("array<int>")), lambda i: F.concat(F.lit(":"), F.get(once, i)))
        left = F.transform(F.array_except(marked, gone), lambda x: F.substr(x, F.instr(x, ":") + 1))
        whole = F.col("lost").isNull() & (F.size(once) == F.size(every))
        joined = let(left, lambda l: F.struct(F.array_join(l, "\n").alias("text"), (F.size(every) - F.size(l)).cast("long").alias("gone")))  # noqa: E741
        return F.when(whole, F.struct(F.col("text").alias("text"), F.lit(0).cast("long").alias("gone"))).otherwise(joined)

    found = let(F.split(F.coalesce("text", F.lit("")), "\n", -1), kept)
    rows = rows.select("row", "text", F.explode(F.array(found)).alias("k"))
    return rows.select("row", F.when(F.col("text").isNotNull(), F.col("k.text")).alias("kept"), F.col("k.gone").alias("gone"), (F.ltrim(F.coalesce("text", F.lit("")), F.lit(_BLANKS + "\n")) == "").alias("blank"))


def _columns(docs: DataFrame, text: str) -> list[Column]:
    return [(F.col("kept") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns]


def without_lines(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS, gone: str = "_lines_gone") -> DataFrame:
    """``docs`` with later matches removed from ``text``, and how many lines went as the column
    ``gone`` (with more underscores in front where the name is taken).  Lines that stay keep
    their order; those under ``least`` words stay as often as they came."""
    return _cleaned(docs, text, least).select(*_columns(docs, text), F.col("gone").alias(fresh(docs, gone)))


def dedup(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """The columns of ``docs`` with later matches removed; documents left without a line go."""
    out = _cleaned(docs, text, least)
    left = F.ltrim(F.coalesce("kept", F.lit("")), F.lit(_BLANKS + "\n")) != ""
    return out.where(F.col("blank") | (F.col("gone") == 0) | left).select(*_columns(docs, text))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication leaves of every document."""
    out = without_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least=1)
    return out.select(
        "doc_id",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        F.col("_lines_gone").alias("n_lines_gone"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
