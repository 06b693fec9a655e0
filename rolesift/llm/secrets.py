"""Secret scans: three fixed patterns and a token-efficiency test.

Language costs a byte-pair vocabulary few tokens for its length; random strings
cost many. Runs of key characters are encoded with a tiktoken vocabulary, and a
run with fewer than ``ratio`` characters per token is reported as kind
``token``, unless it is a known digest or identifier: hexadecimal digests of
the usual lengths, UUIDs, plain numbers and dates. Runs of one letter case (or a
capitalised word) without digits say less with each letter, as rare words do:
for them the ratio is ``plain_ratio``. Runs that a fixed pattern has reported are not tested again.

Each text is scanned whole and on its own, in Arrow batches; nothing is
shuffled. Defined results: null and empty texts have no spans; repeated rows are
scanned each; other columns are not read by ``scan`` and kept by ``redacted``.
Spans are in code points, end exclusive.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs that the token-efficiency test looks at.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{12,}={0,2}(?![A-Za-z0-9+/_=-])")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
IDENTIFIER = re.compile(
    r"(?i:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})"  # UUID
    r"|[0-9+/_=-]+"  # numbers, dates, rulers
)
#: One case or a capitalised word, no digit.
PLAIN = re.compile(r"[a-z+/_=-]+|[A-Z+/_=-]+|[A-Z][a-z]+")
#: Characters per token under which a run counts as random, and a plain one.
RATIO, PLAIN_RATIO = 2.0, 1.7


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_run(run: str, path: str, ratio: float = RATIO, plain_ratio: float = PLAIN_RATIO) -> bool:
    """No digest or identifier, and few characters a token."""
    if DIGEST.fullmatch(run) or IDENTIFIER.fullmatch(run):
        return False
    if PLAIN.fullmatch(run):
        ratio = min(ratio, plain_ratio)
    return len(run) < ratio * len(_encoding(path).encode_ordinary(run))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind number and end of the fixed patterns' matches, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str, path: str, ratio: float = RATIO) -> tuple[list, list]:
    """The fixed patterns' spans, and these with the token-efficiency test's."""
    base = base_spans(text)
    more, k, reach = [], 0, 0
    for m in RUN.finditer(text):
        # Both lists are in order: ``reach`` is how far the spans that begin before the run's end go.
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m.start() and random_run(m[0], path, ratio):
            more.append((m.start(), 3, m.end()))
    return base, sorted(base + more) if more else base


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, path: str | None = None, ratio: float = RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_token, base_sha256 and spans of every row."""
    path = path or default_vocabulary()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, spans = [[], [], [], []], [], []
            for value in batch.column(1):
                base, every = all_spans(value.as_py() or "", path, ratio)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in every))
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def masked(text: str, spans: list, mask: str) -> str:
    """The text with every maximal run of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mask: str = "[secret]", path: str | None = None, ratio: float = RATIO) -> DataFrame:
    """All rows and columns, with secrets in ``text`` masked and ``n_chars`` (if there is one) counted anew."""
    path = path or default_vocabulary()

    @F.pandas_udf("string")
    def cover(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            spans = all_spans(t, path, ratio)[1] if t else None
            return masked(t, spans, mask) if spans else t

        return texts.map(one)

    out = docs.withColumn("text", cover("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
