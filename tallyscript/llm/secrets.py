"""Secret scans: fixed patterns, and strings of high Shannon entropy in a sliding window."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyscript.llm.common import per_text, table

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "entropy")

#: Fixed patterns of the base rules. `{16,}` and `{14,}` find what a run of any length does when short runs are dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_MIN = 12
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)

#: Candidates of the entropy rule by character class: whole runs of the class, the window, and the bits a character that a
#: window must reach. Windows drawn evenly from 16, 36 or 64 characters have about 3.2, 3.7 and 4.3 bits; words have less.
CLASSES = (
    ("hex", re.compile(r"(?<![A-Za-z0-9+/_-])(?:[0-9a-f]{16,}|[0-9A-F]{16,})(?![A-Za-z0-9+/_-])"), 16, 2.7),
    ("upper", re.compile(r"(?<![A-Za-z0-9+/_-])[A-Z0-9]{18,}(?![A-Za-z0-9+/_-])"), 18, 3.2),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}"), 24, 4.0),
)
#: What stands before the // of an address, and strings that look random and are no secret: digests that name themselves, hexadecimal UUIDs, plain words.
SCHEME = re.compile(r"https?:$", re.IGNORECASE | re.ASCII)
ALLOWED = re.compile(
    r"^(?:sha(?:1|256|512)-|md5-)|^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[A-Za-z]?[a-z]+(?:[-_/+][A-Za-z]?[a-z]+)*$|^[0-9_/+-]+$"
)


def reaches(string: str, window: int, bits: float) -> bool:
    """Whether any window of the string has that entropy; sums of n*log2(n) follow the window by one count each way."""
    log = [0.0] + [n * math.log2(n) for n in range(1, window + 2)]
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(string):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += log[n + 1] - log[n]
        if i >= window:
            n = counts[gone := string[i - window]]
            counts[gone] = n - 1
            total += log[n - 1] - log[n]
        if i >= window - 1 and math.log2(window) - total / window >= bits - 1e-9:
            return True
    return False


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base patterns, in code points."""
    spans = []
    if KEYWORD.search(text):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def entropy_spans(text: str) -> list[tuple[int, int, int]]:
    """Candidates of high entropy that the allow-list does not know, one span for each, whatever base spans say of it."""
    spans: dict[tuple[int, int], None] = {}
    for _, pattern, window, bits in CLASSES:
        for m in pattern.finditer(text):
            start, end = m.span()
            known = ALLOWED.search(m[0]) or m[0].startswith("//") and SCHEME.search(text[max(0, start - 6) : start])
            if not known and (start, end) not in spans and reaches(m[0], window, bits):
                spans[start, end] = None
    return [(s, 3, e) for s, e in spans]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(texts: list[bytes]) -> list[list]:
    rows = []
    for raw in texts:
        base = base_spans(text := raw.decode(errors="replace"))
        kinds = [k for _, k, _ in base]
        rows.append([kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + entropy_spans(text))])
    return [list(c) for c in zip(*rows, strict=True)]


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans has the base spans and those of the entropy rule, which may overlap: a key that a base pattern finds by its form is
    confirmed by its entropy. docs has doc_id and text; other columns are ignored. A null text is empty and has no span; bytes that are no UTF-8 count as replacement characters; a null doc_id stays null;
    repeated rows give repeated results. Texts are scanned whole, one at a time, without a shuffle.
    """
    fields = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
    return per_text(docs, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", fields, scan)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
