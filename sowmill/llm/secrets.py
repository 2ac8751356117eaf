"""Secrets in texts: fixed patterns, and runs of characters of high windowed entropy.

The entropy scan takes candidate strings (long runs of key characters), and for
every character class slides a window over each stretch of that class. The
Shannon entropy of a window follows from that of the one before by two count
changes. Windows at or over the threshold of their class join to spans.
Strings that the allow-list knows as harmless give none.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowmill.llm.common import chunks, keyed

# The patterns of the three base kinds, with the length that a match (assign: its value) needs.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
BASE_KINDS = ["assign", "access", "hex"]
ENTROPY_KIND = "entropy"

# Character classes of the entropy scan, their windows and thresholds in bits.
CLASSES = [("hex", re.compile(r"[0-9a-fA-F]+"), 24, 3.0), ("upper", re.compile(r"[A-Z0-9]+"), 20, 3.6),
           ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 24, 3.9)]

# Harmless strings. Letters alone, digits alone, UUIDs, word-like path or name parts, counted-up alphabets.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ALLOWED = re.compile(
    r"[A-Za-z]+|[0-9]+|[-_=+/]+"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
SEPARATORS, PART = re.compile(r"[-_/+=]+"), re.compile(r"[A-Za-z]?[a-z]*|[A-Z]+|[0-9]{1,8}")
COUNTED = "0123456789abcdefghijklmnopqrstuvwxyz0123456789"
#: A window with this word in it is no secret; the rest of its candidate may be one.
SAMPLE = re.compile("example", re.I)
#: Characters of the shortest candidate, and of the shortest window: a shorter run than a class's window is one window, with the threshold scaled.
SHORTEST = 20

Span = tuple[str, int, int]


def window_entropies(text: str, width: int) -> Iterator[float]:
    """Entropy in bits of each window of ``width`` characters, kept up by counts."""
    term = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    for i, new in enumerate(text):
        c = counts.get(new, 0)
        total += term[c + 1] - term[c] if c < width else 0.0
        counts[new] = c + 1
        if i >= width:
            old = text[i - width]
            c = counts[old]
            total += term[c - 1] - (term[c] if c <= width else term[width])
            counts[old] = c - 1
        if i >= width - 1:
            yield math.log2(width) - total / width


def allowed(candidate: str) -> bool:
    low = candidate.lower()
    # Parts are told one by one: one pattern over all of them takes twice as long with every part when a later one fails.
    return bool(ALLOWED.fullmatch(candidate)) or all(PART.fullmatch(p) for p in SEPARATORS.split(candidate)) or low in COUNTED


def high_windows(part: str, width: int, least: float) -> Iterator[tuple[int, int]]:
    """Windows of a run of one class with high entropy, but for those that hold the sample word."""
    if len(part) < SHORTEST:
        return
    own = min(width, len(part))
    bound = least * math.log2(own) / math.log2(width) - 1e-9
    samples = [m.start() for m in SAMPLE.finditer(part)]
    word, at = len("example"), 0
    for i, bits in enumerate(window_entropies(part, own)):
        while at < len(samples) and samples[at] < i:
            at += 1
        if bits >= bound and not (at < len(samples) and samples[at] + word <= i + own):
            yield i, i + own


def entropy_spans(text: str) -> Iterator[tuple[int, int]]:
    """Merged spans of windows with high entropy, by start."""
    for found in CANDIDATE.finditer(text):
        candidate, base = found.group(), found.start()
        if allowed(candidate):
            continue
        hits = []
        for _, pattern, width, least in CLASSES:
            for run in pattern.finditer(candidate):
                if not allowed(run.group()):
                    first = base + run.start()
                    hits += [(first + a, first + b) for a, b in high_windows(run.group(), width, least)]
        start = end = -1
        for a, b in sorted(hits):
            if a <= end:
                end = max(end, b)
                continue
            if end > start:
                yield start, end
            start, end = a, b
        if end > start:
            yield start, end


def spans_of(text: str | None) -> list[Span]:
    """All spans by start and kind. An entropy span that lies within a base span is left out."""
    if not text:
        return []
    out: list[Span] = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_VALUE]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    starts = sorted(s for _, s, _ in out)
    # The farthest end of the base spans that start at or before each start.
    reach = list(accumulate((e for _, _, e in sorted(out, key=lambda s: s[1])), max))
    for a, b in entropy_spans(text):
        before = bisect_right(starts, a)
        if not before or reach[before - 1] < b:
            out.append((ENTROPY_KIND, a, b))
    order = {k: i for i, k in enumerate([*BASE_KINDS, ENTROPY_KIND])}
    return sorted(out, key=lambda s: (s[1], order[s[0]], s[2]))


def redacted(text: str | None, mask: str) -> str | None:
    """The text with every span, overlapping ones as one, replaced by the mask."""
    spans = spans_of(text)
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``spans`` (kind, start, end in code points, end exclusive) of every row.

    A null or empty text has no spans. Repeated rows and null ids give a row
    each; an empty table gives none. Other columns are ignored.
    """
    source = keyed(docs, id_col, text_col)
    schema = T.StructType([source.schema[id_col], T.StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=schema.names)

    return source.mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with the spans of secrets in the text replaced by ``mask``.

    ``length_col``, where the table has it, is set to the new length in code
    points. Texts without secrets, null and empty texts and all other columns
    stay; repeated rows are masked alike; an empty table gives no rows.
    """
    schema = docs.schema
    at = schema.names.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            texts = pa.array([redacted(t, mask) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1:]], names=schema.names)

    out = docs.mapInArrow(run, schema)
    if length_col in schema.names:
        out = out.withColumn(length_col, F.length(text_col).cast(schema[length_col].dataType))
    return out


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and checksum of the base spans, and all spans as text, in place of the spans."""
    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    base = F.filter("spans", lambda s: s["kind"] != ENTROPY_KIND)
    return found.withColumns({
        "n_assign": of("assign"), "n_access": of("access"), "n_hex": of("hex"),
        "base_sha256": F.sha2(joined(base).cast("binary"), 256), "text_spans": joined(F.col("spans"))}).drop("spans").withColumnRenamed("text_spans", "spans")
