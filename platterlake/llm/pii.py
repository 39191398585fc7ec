"""Personal data: patterns propose spans, checksums confirm them, context words weigh them.

DataFrame functions only.  Positions come from splitting a text at the pattern and adding
up the lengths of the pieces, so one text costs linear time and never leaves its row.

Defined results: a null text counts as empty and has no span; a repeated row gets its own
equal result; other columns of the input are carried along untouched by
:func:`find_spans`, which adds one column and refuses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

# Possessive forms of the patterns.  Each equals its plain greedy form: nothing behind a
# possessive part could match after giving characters back, and a start inside a run
# succeeds only where the start of the run (or the end of the last match) does.  They
# keep Java's matcher linear and off the stack on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A run of fewer than 14 digits never passes, so the pattern starts at 14.
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"

#: Kinds in the order of the report; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, IBAN, SSN, LOCAL_PHONE), strict=True))
#: A character without which a kind cannot occur; it saves the pattern on most texts.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
CONTEXT = {
    "email": "(?i)mail|contact|write|reach",
    "ip": "(?i)\\bip\\b|address|host|server",
    "card": "(?i)card|visa|credit|payment|debit",
    "phone": "(?i)phone|tel|call|mobile|fax|dial",
    "iban": "(?i)iban|bank|account|transfer",
    "ssn": "(?i)ssn|social|security|tax",
    "local_phone": "(?i)phone|tel\\b|call|mobile|fax|dial",
}
#: Score of a confirmed span without context; context adds BONUS.  Added kinds need LEAST.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "local_phone": 0.4}
BONUS, LEAST = 0.2, 0.6
BEFORE, AFTER, BLOCK = 40, 20, 256


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.ascii(F.substr(digits, F.length(digits) - i, F.lit(1))) - 48
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(digits) - 1, F.lit(0))), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks has remainder 1 by 97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), F.lit(0), step) == 1


def _octet(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(bare) == 0, True).when(F.length(bare) > 3, False).otherwise(bare.cast("int") <= 255)


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), _octet)
    if kind == "card":
        return let(_digits(found), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(found)).between(10, 15)
    if kind == "iban":
        return let(F.replace(found, F.lit(" "), F.lit("")), lambda d: F.when(F.length(d).between(15, 34), mod97(d)).otherwise(False))
    if kind == "ssn":
        return ~found.rlike("^(000|666|9)") & ~found.rlike("-00-|-0000$")
    return F.lit(True)


_SPAN = "array<struct<start:bigint,k:int,end:bigint,kind:string,score:double>>"


def _spans(text: Column, kind: str) -> Column:
    """Confirmed spans of a kind, by start.

    Starts are sums of piece and match lengths.  They are taken per block of 256 matches
    and then inside the block, which keeps a text with many matches far from quadratic.
    """
    pattern, none = PATTERNS[kind], F.array().cast(_SPAN)

    def place(found: Column, pieces: Column) -> Column:
        lengths = F.transform(found, lambda m, i: F.char_length(m).cast("bigint") + F.char_length(F.get(pieces, i)))
        add = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)

        def spans(lengths: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: add(F.slice(lengths, 1, b * BLOCK)))

            def one(blocks: Column, m: Column, i: Column) -> Column:
                b = F.floor(i / BLOCK).cast("int")
                start = F.get(blocks, b) + add(F.slice(lengths, b * BLOCK + 1, i - b * BLOCK)) + F.char_length(F.get(pieces, i))
                near = F.right(F.get(pieces, i), F.lit(BEFORE)).rlike(CONTEXT[kind]) | F.left(F.get(pieces, i + 1), F.lit(AFTER)).rlike(CONTEXT[kind])
                return let(start, lambda s: F.struct(s.alias("start"), F.lit(KINDS.index(kind)).alias("k"), (s + F.char_length(m)).alias("end"), F.lit(kind).alias("kind"), F.least(F.lit(1.0), PRIOR[kind] + F.when(near, BONUS).otherwise(0.0)).alias("score"), m.alias("m")))

            return let(blocks, lambda bs: F.transform(found, lambda m, i: one(bs, m, i)))

        ok = F.filter(let(lengths, spans), lambda s: _valid(kind, s["m"]) & (F.lit(KINDS.index(kind) < 4) | (s["score"] >= LEAST)))
        return F.transform(ok, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score")))

    hits = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda pieces: place(found, pieces))))
    may = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]{2}")
    return F.when(may, hits).otherwise(none)


def find_spans(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: an array of (start, k, end, kind, score), by start and then kind.

    Starts and ends count code points, the end is exclusive.  Base spans always stay;
    an added span stays where it overlaps none of them and scores enough.
    """
    body = F.coalesce(F.col(text), F.lit(""))

    def merged(base: Column) -> Column:
        more = F.concat(*[_spans(body, k) for k in KINDS[4:]])
        free = F.filter(more, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.sort_array(F.concat(base, free))

    found = let(F.concat(*[_spans(body, k) for k in KINDS[:4]]), merged)
    # Texts without a digit or an at sign have no span of any kind.
    return df.withColumn(out, F.when(body.rlike("[0-9@]"), found).otherwise(F.array().cast(_SPAN)))


def redact(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Replace the text inside spans by ``<KIND>``; where spans overlap, the first stays."""
    body, empty = F.coalesce(F.col(text), F.lit("")), F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        tag = F.concat(acc["out"], F.substr(body, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(tag.alias("out"), s["end"].alias("at")))

    return df.withColumn(text, F.aggregate(F.col(spans), empty, step, lambda a: F.concat(a["out"], F.substr(body, a["at"].cast("int") + 1))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    docs = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("pii", lambda s: s["k"] < 4)
    return docs.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
