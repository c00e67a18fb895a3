"""SentencePiece encoding and decoding with a prefix table of last tokens.

Byte-pair encodings have a local property: a sequence of pieces is the
encoding of a text exactly if each adjacent pair of pieces is the encoding of
its own concatenation. So each prefix of a text has one last piece: of the
pieces that an automaton finds to end there, the one that fits the last piece
of the prefix before it. The table is filled from left to right, and the ids
are read from it backwards. Whether two pieces fit is decided by replaying the
merges on the two alone, and remembered.

No piece of the vocabularies in use holds a space mark after another
character, so a text is cut before each run of marks (this is checked when the
vocabulary is loaded), and the parts' ids are remembered.

Defined results: a null or empty text has no ids and decodes to an empty text;
repeated rows each get a row; a null doc_id is kept; extra columns are
ignored; an empty table gives no rows. Of the pieces that end at one place
exactly one fits, so there are no ties.
Texts of any length are encoded whole. A model that normalises texts is an
error.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Bytes of remembered parts (those of late, and as many older ones) and of pairs in one Python worker, and the longest such part.
PARTS, PAIRS, PART_LENGTH = 96 << 20, 160 << 20, 48
#: What an entry takes beside its characters and ids; a pair's pieces are the vocabulary's own strings.
ENTRY, PAIR_ENTRY = 280, 180


class PieceEncoder:
    """Encodes texts as the library does with a BPE model that has byte fallback."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(self.library.get_piece_size()) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        self.ids = {self.library.id_to_piece(i): i for i in normal}
        self.scores = {piece: self.library.get_score(i) for piece, i in self.ids.items()}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        inner = any(MARK in piece.lstrip(MARK) for piece in self.ids)
        breaks = "" if any("\n" in piece for piece in self.ids) else "\n"
        self.parts = re.compile(f".+|{MARK}" if inner else f"{breaks or '(?!)'}|{MARK}*[^{MARK}{breaks}]+|{MARK}+", re.DOTALL)
        self.whole = inner
        probe = "Aﬁ①Å\u3000x\u00a0é\t \u200b  ß½"
        normal = sentencepiece.SentencePieceNormalizer(model_file=path).normalize(probe)
        if normal.lstrip(MARK) != probe.replace(" ", MARK):
            raise ValueError(f"{path} changes texts before it encodes them")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def merged(self, text: str) -> list[str]:
        """The merges replayed on a short text: the best pair first, then the leftmost."""
        symbols, scores = list(text), self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                score = scores.get(symbols[k] + symbols[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def fits(self, left: str, right: str) -> bool:
        """Whether the pair encodes its own concatenation; left may be empty."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= PAIRS // PAIR_ENTRY:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def pieces(self, part: str) -> list[str]:
        """The pieces of a part, by its prefix table."""
        last, filled = [""] * (len(part) + 1), 0
        for end, piece in self.automaton.iter(part):
            if filled <= end:
                for k in range(filled, end):
                    last[k + 1] = last[k + 1] or part[k]
                filled = end + 1
            if not last[end + 1]:
                before = last[filled - len(piece)]
                if (before or filled == len(piece)) and self.fits(before, piece):
                    last[filled] = piece
        for k in range(max(filled - 1, 0), len(part)):
            last[k + 1] = last[k + 1] or part[k]
        out, end = [], len(part)
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def part_ids(self, part: str) -> bytes:
        ids: list[int] = []
        for piece in self.pieces(part):
            found = self.ids.get(piece)
            ids += [found] if found is not None else [self.bytes[b] for b in piece.encode()]
        return array("i", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text."""
        if not text:
            return np.empty(0, dtype="<i4")
        known, out = self.known, []
        for part in self.parts.findall(MARK + text.replace(" ", MARK)):
            ids = known.get(part)
            if ids is None:
                ids = self.older.get(part) or self.part_ids(part)
                if len(part) <= PART_LENGTH:
                    if self.held >= PARTS:
                        self.older, known, self.held = known, {}, 0
                        self.known = known
                    known[part] = ids
                    self.held += len(part) + len(ids) + ENTRY
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist()) if len(ids) else ""


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder a Python worker."""
    return PieceEncoder(path)


def encode_and_decode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: the ids of each text and the text they stand for."""
    path = path or public_tokenizers.path(VOCABULARY)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [codec.encode(text.as_py() or "") for text in batch.column("text")]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array([codec.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    ready = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_arrow(ready, coded, "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 digests of the ids and the decoded text."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    return digests(encode_and_decode(table(spark, sf_dir, "documents")))
