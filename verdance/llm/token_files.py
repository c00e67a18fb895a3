"""Token ids in Arrow files of equal-length sequences.

Documents are sorted by id over range partitions; each partition writes its
ids as one stream cut into sequences of one length, in an Arrow file whose
batches hold fixed-size lists of ids and of mask bits (false for the padding
at the end). The footer gives each batch's place, all sequences have one
length, and nothing is compressed, so any sequence is read in place, without
a copy. A second file holds each document's first position and length.

Files go to the shared folder under names of their partition and attempt, and
are never renamed: the manifest names those of the attempt that Spark took, so
a repeated or speculative task needs nothing of an earlier one's. Files that
the manifest doesn't name are removed.

Defined results: a null or empty text has only the end id; documents of one id
stay next to each other, ordered by a hash of their text; null ids come first;
equal rows each have their ids, and may lie in several files; extra columns
are ignored; an empty table gives no files and no rows. Texts of any length
are encoded whole.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import in_arrow, new_path, remove, table, until_exit

VOCABULARY = "byte_bpe_50k.json"
SEQUENCE, BATCH = 2048, 128
END_ID = 0
#: Bytes of remembered words in one Python worker, and of as many older ones; what a word takes beside its letters and ids.
KNOWN, ENTRY = 96 << 20, 200


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it is printable."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def _plain_words() -> re.Pattern:
    """The vocabulary's pattern, with its classes spelt out for the characters of _PLAIN."""
    kinds = {"L": "", "N": ""}
    for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]):
        kind = unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += re.escape(c)
    pattern = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{kinds['L']}{kinds['N']}]")
    return re.compile(pattern.replace(r"\p{L}", f"[{kinds['L']}]").replace(r"\p{N}", f"[{kinds['N']}]"))


_PLAIN = re.compile("[\n\r\t\x20-\x7e\u00a1-\u024f\u2010-\u2027\u20ac]*")


class WordEncoder(dict):
    """Encodes with the tokenizers library, remembering the ids of words.

    The library cuts a text into words before it merges. A text of common
    characters is cut here by the same pattern and its new words go to the
    library's model; any other text goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.words, self.letters, self.older, self.held = _plain_words(), _byte_letters(), {}, 0
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            letters = word.encode().decode("latin-1").translate(self.letters)
            found = array(self.code, [token.id for token in self.model.tokenize(letters)]).tobytes()
        if self.held >= KNOWN:
            self.older, self.held = dict(self), 0
            self.clear()
        if len(word) <= 256:
            self[word] = found
            self.held += len(word) + len(found) + ENTRY
        return found

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text."""
        if _PLAIN.fullmatch(text) and not any(special in text for special in self.special):
            return np.frombuffer(b"".join(map(self.__getitem__, self.words.findall(text))), dtype=self.dtype)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a Python worker."""
    return WordEncoder(path)


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


_INDEX = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])


class _Sequences:
    """Writes a stream of ids as batches of sequences."""

    def __init__(self, sink: pa.NativeFile, dtype: np.dtype, length: int) -> None:
        self.dtype, self.length, self.held, self.count = dtype, length, [], 0
        self.writer = pa.ipc.new_file(sink, _schema(dtype, length))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.count += len(ids)
        if self.count >= self.length * BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        while len(ids) >= self.length * BATCH or (last and len(ids)):
            now, ids = ids[: self.length * BATCH], ids[self.length * BATCH :]
            rows = -(-len(now) // self.length)
            full = np.zeros(rows * self.length, self.dtype)
            full[: len(now)] = now
            mask = np.arange(rows * self.length) < len(now)
            self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, mask)], schema=self.writer_schema))
        self.held, self.count = [ids], len(ids)

    @property
    def writer_schema(self) -> pa.Schema:
        return _schema(self.dtype, self.length)

    def close(self) -> None:
        self._flush(True)
        self.writer.close()


def write_files(documents: DataFrame, folder: str, path: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """Write the ids of all texts below folder, in ascending doc_id order.

    Returns part, name, n_docs, n_tokens: one row for each pair of files, in
    order of part.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    spark = documents.sparkSession

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = word_encoder(path), TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, docs, total, writers = f"{part:06d}-{uuid.uuid4().hex}", 0, 0, None
        for batch in batches:
            if writers is None:
                sinks = [store.open_output_stream(f"{root}/{kind}-{name}.arrow") for kind in ("ids", "docs")]
                writers = _Sequences(sinks[0], codec.dtype, length), pa.ipc.new_file(sinks[1], _INDEX)
            sizes = np.empty(batch.num_rows, dtype=np.int64)
            for k, text in enumerate(batch.column("text")):
                ids = codec.encode(text.as_py() or "")
                sizes[k] = len(ids) + 1
                writers[0].add(np.append(ids, codec.dtype.type(END_ID)))
            first = total + np.cumsum(sizes) - sizes
            writers[1].write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(first), pa.array(sizes)], schema=_INDEX))
            docs, total = docs + len(sizes), total + int(sizes.sum())
        if writers is not None:
            for writer, sink in zip(writers, sinks, strict=True):
                writer.close()
                sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "name": [name], "n_docs": pa.array([docs], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The last key lets equal rows, however many, part over several files; their order is no one's.
    ready = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("copy"))
    ready = ready.repartitionByRange(parts, "doc_id", "tie", "copy").sortWithinPartitions("doc_id", "tie", "copy").select("doc_id", "text")
    rows = sorted(tuple(r) for r in in_arrow(ready, written, "part long, name string, n_docs long, n_tokens long").collect())
    _remove_others(spark, folder, {name for _, name, _, _ in rows})
    return spark.createDataFrame(rows, "part long, name string, n_docs long, n_tokens long")


def _remove_others(spark: SparkSession, folder: str, names: set[str]) -> None:
    """Remove the files of attempts that Spark didn't take."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(at) if store.exists(at) else ():
        found = re.fullmatch(r"(?:ids|docs)-(\d{6}-[0-9a-f]{32})\.arrow", status.getPath().getName())
        if found and found[1] not in names:
            remove(spark, status.getPath().toString())


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, ids' length and checksum of each document in the files.

    start counts the ids of all documents before it, over all parts.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.select("part", "name", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        local = isinstance(store, fs.LocalFileSystem)
        for batch in batches:
            for own, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                opened = [pa.memory_map(name) if local else store.open_input_file(name) for name in (f"{root}/ids-{own}.arrow", f"{root}/docs-{own}.arrow")]
                ids, docs = map(pa.ipc.open_file, opened)
                length = ids.schema.field("ids").type.list_size
                views: dict[int, np.ndarray] = {}

                def view(k: int, ids=ids, views=views) -> np.ndarray:
                    if k not in views:
                        if len(views) > 4:
                            views.clear()
                        views[k] = ids.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)
                    return views[k]

                for k in range(docs.num_record_batches):
                    index, sums = docs.get_batch(k), []
                    for first, n in zip(index.column("first").to_pylist(), index.column("n_tokens").to_pylist(), strict=True):
                        crc, at = 0, first
                        while at < first + n:
                            number, inside = divmod(at, length * BATCH)
                            taken = view(number)[inside : inside + first + n - at]
                            crc = zlib.crc32(taken.astype("<u4"), crc)
                            at += len(taken)
                        sums.append(crc)
                    start = pa.array(index.column("first").to_numpy() + base)
                    yield pa.RecordBatch.from_arrays([index.column("doc_id"), start, index.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return in_arrow(parts.repartition(tasks, "part"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    folder = new_path(spark, "tokens")
    manifest = write_files(table(spark, sf_dir, "documents"), folder)
    return read_files(manifest, until_exit(spark, folder))
