"""Secret scans: three fixed patterns and a token-efficiency test.

A vocabulary of a byte-pair tokenizer spends few tokens on ordinary words and
many on random strings. A run of token characters, of letters alone too, that
gets few characters per token is reported as kind ``token``, unless it is a
digest, a UUID or a plain number or overlaps a span that the patterns report.
Words, dashed or in camel case, need fewer characters per token than others.

Defined results: a null text counts as empty and has no spans; offsets are
code points, the end exclusive; spans of one start stand in the order of
KINDS; repeated rows each get a row; a null doc_id is kept; extra columns are
ignored; an empty table gives no rows. Texts of any length are scanned whole,
in time that grows as their length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fewer characters a token than this is random.
MAX_CHARS_PER_TOKEN = 2.0
#: The same for the shape of words, which some long words of languages unlike the vocabulary's fall below.
MAX_WORD_CHARS_PER_TOKEN = 1.85
KINDS = ("assign", "access", "hex", "token")

_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Digests (MD5, SHA-1, SHA-2), UUIDs, numbers and dates, which are no secrets.
_KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}"
    r"|[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
    r"|[0-9+/_=-]+)"
)
#: Plain, dashed or camel-case words, with short numbers.
_WORDS = re.compile(r"[A-Za-z+/_=-]+|(?:[A-Za-z]+[0-9]{0,4}[/_=-]+)*[A-Za-z]+[0-9]{0,4}")


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def token_spans(text: str, base: list[tuple[int, int, int]], path: str, most: float = MAX_CHARS_PER_TOKEN, most_words: float = MAX_WORD_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """Spans of random strings outside the base spans."""
    found, at, reached = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        # Both are in order of their starts: base spans that begin before this run ends, and the last end among them.
        while at < len(base) and base[at][0] < m.end():
            reached, at = max(reached, base[at][2]), at + 1
        if reached > m.start() or _KNOWN.fullmatch(m[0]):
            continue
        if len(m[0]) < (most_words if _WORDS.fullmatch(m[0]) else most) * len(_encoding(path).encode_ordinary(m[0])):
            found.append((m.start(), 3, m.end()))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, counts by base kind, digest of the base spans, all spans."""
    path = path or public_tokenizers.path(VOCABULARY)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                kinds = [kind for _, kind, _ in base]
                spans = sorted(base + token_spans(text, base, path))
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(spans) - len(base), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            made = list(zip(*rows, strict=True)) or [()] * 6
            longs = [pa.array(x, pa.int64()) for x in made[:4]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *longs, pa.array(made[4], pa.string()), pa.array(made[5], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"])

    ready = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_arrow(ready, scanned, "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    return scan(table(spark, sf_dir, "documents"))
