"""Secret scans: known key formats, and sliding-window entropy per character class."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterloom.llm.common import count_of, joined_spans, ship, text_rows

ship(__name__)

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

# The formats asked for.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is one match of [0-9a-f]+ with 16 or more

#: Candidate strings; every hex match lies in one.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: class -> (its maximal runs, window in characters, least bits a character in a window)
CLASSES = {
    "entropy_hex": (re.compile(r"[0-9A-Fa-f]+"), 20, 3.0),
    "entropy_base64": (re.compile(r"[A-Za-z0-9+/_=-]+"), 24, 4.0),
}

#: Strings that look random and are public: the part between / and = that holds one is not searched for windows.
ALLOWED = (
    re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),  # UUID
    re.compile(r"(?i:(?<![a-z])(example|sample|dummy|placeholder|changeme)(?![a-z])|xxxx|(?<![a-z])your[_-])"),
    re.compile(r"(?i:0123456789|abcdefghij|qwertyuiop)"),
    re.compile(r"(?i:^(sha(1|256|384|512)|md5)[-_:=].*)"),  # named digests, to the end
)


def hot_windows(run: str, width: int, least: float) -> list[tuple[int, int]]:
    """Merged windows of ``width`` characters whose Shannon entropy is ``least`` bits or more.

    Counts move by one character at each end, so the cost is linear in the run.
    H = log2(width) - sum(n log2 n) / width over the counts n.
    """
    if len(run) < width:
        return []
    gain = [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    most = (math.log2(width) - least) * width + 1e-9
    counts: dict[str, int] = {}
    total = 0.0
    found: list[tuple[int, int]] = []
    for i, c in enumerate(run):
        if i >= width:
            d = run[i - width]
            n = counts[d]
            total += gain[n - 1] - gain[n]
            counts[d] = n - 1
        n = counts.get(c, 0)
        total += gain[n + 1] - gain[n]
        counts[c] = n + 1
        if i >= width - 1 and total <= most:
            start = i - width + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def open_parts(word: str) -> list[tuple[int, int]]:
    """The stretches of a candidate that are left without its allowed parts."""
    ends = [-1, *(m.start() for m in re.finditer("[/=]", word)), len(word)]
    allowed = [m.span() for a in ALLOWED for m in a.finditer(word)]
    if not allowed:
        return [(0, len(word))]
    shut = sorted((max(x for x in ends if x < s) + 1, min(x for x in ends if x >= e)) for s, e in allowed)
    parts, at = [], 0
    for s, e in shut:
        if s > at:
            parts.append((at, s))
        at = max(at, e)
    return [*parts, (at, len(word))] if at < len(word) else parts


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the three formats, leftmost and not overlapping within a kind."""
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return spans


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """Base spans and added ones, by start, then kind as in KINDS."""
    spans = base_spans(text)
    added = []
    for c in CANDIDATE.finditer(text):
        word = c.group()
        spans += [("hex", c.start() + m.start(), c.start() + m.end()) for m in HEX.finditer(word)]
        # Both a digit and a letter, else it is a number or a word.
        if not re.search("[0-9]", word) or not re.search("[A-Za-z]", word):
            continue
        parts = open_parts(word)
        for kind, (runs, width, least) in CLASSES.items():
            for run in (r for a, b in parts for r in runs.finditer(word, a, b)):
                if run.end() - run.start() < width or not re.search("[0-9]", run.group()) or not re.search("[A-Za-z]", run.group()):
                    continue
                at = c.start() + run.start()
                added += [(kind, at + a, at + b) for a, b in hot_windows(run.group(), width, least)]
    if added:
        # Nothing new is said by a span within one of the base, or of a stricter class before it.
        known = list(spans)
        for span in added:
            if not any(s <= span[1] and span[2] <= e for _, s, e in known):
                known.append(span)
        spans = known
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): array of (kind, start, end) in code points, end exclusive, for every row.

    Null and empty texts have no spans; repeated rows are scanned alike. Whole texts are
    read, in time linear in their length. Map only, no shuffle.
    """
    rows = text_rows(docs, id_col=id_col, text_col=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t)] for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(item))], names=["doc_id", "spans"]
            )

    return rows.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind: string, start: int, end: int>>")


def digest(found: DataFrame, base: tuple[str, ...] = KINDS[:3]) -> DataFrame:
    """Counts per base kind and joined spans of the result of ``secret_spans``."""
    of_base = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select(
        "doc_id",
        *[count_of(k).alias(f"n_{k}") for k in base],
        F.sha2(joined_spans(of_base), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )
