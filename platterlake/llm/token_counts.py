"""Exact token counts at every prefix of a text, by prefix dynamic programming.

The model's pieces never hold a space mark behind another character, so no merge crosses
the start of a run of marks: a text is cut there into segments whose encodings are
independent.  The count of a prefix that ends with a segment is the count before it plus
the segment's own, which a bounded cache keeps.  Inside a segment the recurrence is over
its characters: an encoding without its last token is the encoding of the rest, so
``count[i] = count[i - len(t)] + 1`` for the one token ``t`` that may follow the last
token of the shorter prefix, which two tokens may if encoding both together gives them back.

Defined results: null and empty texts have 0 tokens and 0 bytes; special strings inside a
text are ordinary text; repeated rows come back as often as they came.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK, CACHED, LONGEST, LIMIT = "▁", 300_000, 48, 4096
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixCounter(dict):
    """Counts for one model file; as a dict it is the bounded cache of segment counts,
    keyed by the segment's characters behind its single mark."""

    def __init__(self, model: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            spec.ParseFromString(f.read())
        n, t = spec.normalizer_spec, spec.trainer_spec
        crosses = any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)
        if n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or t.treat_whitespace_as_suffix or crosses:
            raise ValueError("this model's encodings cannot be cut at space marks")
        n.add_dummy_prefix = False  # segments bring their marks along
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.pieces = {p.piece for p in spec.pieces if p.type == 1}
        self.longest = max(map(len, self.pieces))
        self.follows: dict[tuple[str, str], bool] = {}

    def __missing__(self, rest: str) -> int:
        n = len(self.plain.encode(MARK + rest, num_threads=1))
        if len(rest) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[rest] = n
        return n

    def segments(self, text: str) -> list[str]:
        return _SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []

    def segment_counts(self, text: str) -> list[int]:
        """The token counts of the segments of ``text``, in order."""
        if not text:
            return []
        parts = text.replace(MARK, " ").split(" ")
        if "" in parts:  # runs of marks
            return [self[s[1:]] if s[1:2] != MARK else len(self.plain.encode(s, num_threads=1)) for s in self.segments(text)]
        return [self[p] for p in parts]

    def count(self, text: str | None) -> int:
        return sum(self.segment_counts(text or ""))

    def inside(self, segment: str) -> list[int]:
        """Token counts of the prefixes of one segment, for lengths 0, 1, ... its length."""
        counts: list[int] = [0]
        last: list[str] = [""]
        for i in range(1, len(segment) + 1):
            for size in range(min(i, self.longest), 0, -1):
                t, before = segment[i - size : i], last[i - size]
                single = size == 1 and t not in self.pieces
                if (t in self.pieces or single) and (i == size or self._may_follow(before, t)):
                    if i == size and size > 1 and len(self.plain.encode(t, num_threads=1)) != 1:
                        continue
                    # a character without a piece of its own is spelled in bytes
                    counts.append(counts[i - size] + (len(t.encode()) if single else 1))
                    last.append(t)
                    break
            else:
                raise AssertionError("no token ends here")
        return counts

    def _may_follow(self, a: str, b: str) -> bool:
        if (known := self.follows.get((a, b))) is None:
            size = lambda x: 1 if x in self.pieces else len(x.encode())
            got = self.plain.encode(a + b, out_type=str, num_threads=1)
            known = len(got) == size(a) + size(b) and (a not in self.pieces or got[0] == a) and (b not in self.pieces or got[-1] == b)
            if len(self.follows) >= CACHED:
                self.follows.clear()
            self.follows[a, b] = known
        return known

    def prefix_counts(self, text: str) -> list[int]:
        """Token counts of ``text[:0]``, ``text[:1]``, ... ``text``."""
        out, base = [0], 0
        for k, s in enumerate(self.segments(text)):
            inside = self.inside(s)
            out += [base + c for c in inside[1 + (k == 0) :]]
            base += inside[-1]
        return out if text else [0]

    def ends(self, text: str) -> list[int]:
        """Token counts of the prefixes of ``text`` that end with a segment; the last is its own."""
        return list(accumulate(self.segment_counts(text)))

    def longest_prefix(self, text: str, budget: int, ends: list[int] | None = None) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens.

        Counts at segment ends never fall, so the answer lies at the last end within the
        budget or inside the one segment behind it.
        """
        sums = ends if ends is not None else self.ends(text)
        k = bisect_right(sums, budget)
        if k == len(sums):
            return len(text)
        segments = self.segments(text)
        before = sum(map(len, segments[:k])) - 1  # without the mark that is not in the text
        inside, base = self.inside(segments[k]), sums[k - 1] if k else 0
        return max(0, before + max(i for i, c in enumerate(inside) if base + c <= budget))


_counters: dict[str, PrefixCounter] = {}


def counter(model: str | None = None) -> PrefixCounter:
    """The counter of a model file, one for each Python worker."""
    at = model or default_model()
    if at not in _counters:
        _counters[at] = PrefixCounter(at)
    return _counters[at]


def token_counts(df: DataFrame, text: str = "text", limit: int = LIMIT, model: str | None = None, prefixes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, limit_chars) for every row, all read off the
    counts at its prefixes; limit_chars is the length of the longest prefix of at most
    ``limit`` tokens.  With ``prefixes`` these are stored too: end_tokens and end_chars, the
    tokens and characters of each prefix that ends with a segment, for :func:`within`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for b in batches:
            sizes, tokens, fit, kept, chars = [], [], [], [], []
            for x in b.column(1):
                body = x.as_py() or ""
                ends = c.ends(body)
                sizes.append(len(body.encode()))
                tokens.append(ends[-1] if ends else 0)
                fit.append(len(body) if tokens[-1] <= limit else c.longest_prefix(body, limit, ends))
                if prefixes:
                    kept.append(ends)
                    chars.append([n - 1 for n in accumulate(map(len, c.segments(body)))])  # without the first mark
            out = [b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(fit, pa.int64())]
            if prefixes:
                out += [pa.array(kept, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long" + ", end_tokens array<long>, end_chars array<long>" * prefixes
    names = [c.split()[0] for c in schema.split(", ")]
    return df.select(df["doc_id"].cast("long").alias("doc_id"), df[text].cast("string")).mapInArrow(run, schema)


def within(budget: int) -> Column:
    """Characters of the longest stored prefix of at most ``budget`` tokens, from the columns
    end_tokens and end_chars: no text is read and nothing is encoded again."""
    n = F.size(F.filter("end_tokens", lambda t: t <= budget))
    return F.when(n > 0, F.get("end_chars", n - 1)).otherwise(F.lit(0).cast("long"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of ``documents``."""
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
