"""Token ids in Arrow files of equal-length sequences.

All documents, in ascending order of their ids, are one stream of token ids, each document
closed by an end id.  The stream is cut into sequences of one length and written as Arrow IPC
files whose record batches hold

* ``ids``        fixed-size list of unsigned 16- or 32-bit integers, one sequence a row,
* ``mask``       fixed-size list of booleans, false where the last sequence of a file is filled up,
* ``documents``  the documents that begin in the sequence: their key and the place.

Buffers are not compressed, so a mapped file gives any sequence without a copy
(``SequenceFile``).  Files are ranges of ids; a table with one row a file (the manifest) lists
them in order and gives the place of each in the whole stream.

A task writes its file under a name of its own attempt, and only the manifest, which Spark
commits, tells which files count: a task that is run again leaves an unused file and no error.
The folder must be one that all executors reach (``pyarrow.fs`` opens it).

Texts are cut at each space that a character follows: there the vocabulary's own splitting always
cuts, so a word with the space before it is encoded once by the library and remembered.  Texts with
other than Latin letters or with a special token go to the library whole.

Defined cases: a missing or empty text is its end id alone; documents without an id come first;
equal ids and repeated rows are documents of their own, in an order fixed by the input files;
an id that a third of the rows bear is spread over several files; a long text runs over as many
sequences as it needs; an empty table gives an empty manifest and no file; other columns are
not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelens.llm.common import kept, scratch, stored, whole

#: Ids in a sequence, sequences in a record batch.
LENGTH = 2048
BATCH = 256
#: The most files; beyond it files grow.
MOST_FILES = 20_000
#: Words that a task remembers (twice), and the longest of them.
REMEMBERED = 1 << 19
LONGEST = 40
#: Characters that a task encodes at once.
AT_ONCE = 1 << 21
#: Stands for a missing id in the order.
FIRST = -(1 << 63)

#: White space among the characters that are cut here, and the characters that are not.
_SPACE = r"\t-\r\x20\x85\xa0"
_OTHER = r"[^\x00-ɏ‐-‧€]"
_CUT = re.compile(rf" (?=[^{_SPACE}])")
#: Marks that are split off a word which ends in a letter: a piece of their own to the vocabulary.
_MARKS = ".,;:!?)]"


class Encoder:
    """The library's encoder, which remembers the ids of units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        added = self.tokenizer.get_added_tokens_decoder().values()
        marks = [t.content for t in added]
        #: A special token stands alone, so it parts words that are encoded as one text.
        self.mark, self.mark_id = next(
            ((t.content, self.tokenizer.token_to_id(t.content)) for t in added if not (t.lstrip or t.rstrip or t.single_word)),
            (None, None))
        self.apart = re.compile("|".join([_OTHER, *map(re.escape, marks)]))
        self.spaced = re.compile(rf" (?:[{_SPACE}]|$)")
        #: Ids of words with the space before them, those of late and those before.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.type.char, e.ids).tobytes() for e in found]

    def library_words(self, words: list[str], together: int = 500) -> list[bytes]:
        """The ids of words behind a space."""
        if self.mark is None:
            return self.library([" " + w for w in words])
        out = []
        for i in range(0, len(words), together):
            text = " " + f"{self.mark} ".join(words[i:i + together])
            found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.type)
            data, width, begin = found.tobytes(), self.type.itemsize, 0
            for end in [*np.flatnonzero(found == self.mark_id).tolist(), len(found)]:
                out.append(data[begin * width:end * width])
                begin = end + 1
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        whole_texts = {i for i, t in enumerate(texts) if self.apart.search(t)}
        first, words = [], {}
        for i, t in enumerate(texts):
            if i in whole_texts:
                first.append(t)
            else:
                begin, *words[i] = _CUT.split(t) if self.spaced.search(t) else t.split(" ")
                first.append(begin)
        if len(self.known) > REMEMBERED:  # words that are still in use come back from the older ones
            self.known, self.older = {}, self.known
        known, new = self.known, []
        for w in set().union(*words.values()):
            if w not in known:
                if (ids := self.older.get(w)) is not None:
                    known[w] = ids
                else:
                    new.append(w)
        stems = {w: s for w in new if (s := w.rstrip(_MARKS)) != w and s[-1:].isalpha()}
        tails = list({w[len(s):] for w, s in stems.items()})
        tail_ids = dict(zip(tails, self.library(tails), strict=True))
        plain = list({s for s in stems.values() if s not in known}.union(w for w in new if w not in stems))
        known.update(zip(plain, self.library_words(plain), strict=True))
        known.update((w, known[s] + tail_ids[w[len(s):]]) for w, s in stems.items())
        out = self.library(first)
        for i, own in words.items():
            out[i] += b"".join(map(known.__getitem__, own))
        for w in (*new, *plain):
            if len(w) > LONGEST:
                known.pop(w, None)
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, so words are remembered from task to task."""
    return kept(f"encoder of {path}", lambda: Encoder(path))


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _ranges(keys: DataFrame, files: int) -> list[int]:
    """Bounds that cut the keys into ranges of about equal numbers of rows; a key of many rows
    is a bound several times."""
    if files < 2:
        return []
    at = F.percentile_approx("k", [i / files for i in range(1, files)], max(10_000, 20 * files))
    return keys.agg(at.alias("b")).first()["b"] or []


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, key: str = "doc_id",
                      text: str = "text", length: int = LENGTH) -> DataFrame:
    """Write the files below ``folder`` and return their manifest: ``(file_no, path, n_documents,
    n_tokens, n_sequences, start)``, ``start`` being the place of a file's first id in the stream."""
    spark = docs.sparkSession
    named = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(FIRST)).alias("k"),
                        F.monotonically_increasing_id().alias("row"), whole(F.col(text)).alias("t"))
    files = min(MOST_FILES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
    bounds = np.array(_ranges(docs.select(F.coalesce(F.col(key).cast("long"), F.lit(FIRST)).alias("k")), files), dtype=np.int64)

    @F.pandas_udf("file_no int, ids binary")
    def encode(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = encoder(tokenizer)
        end = np.array([end_id], dtype=own.type).tobytes()
        for keys, rows, texts in parts:
            k = keys.to_numpy()
            low, high = np.searchsorted(bounds, k, "left"), np.searchsorted(bounds, k, "right")
            spread = (rows.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            ids = [b + end for part in _slices(texts.tolist()) for b in own.encode(part)]
            yield pd.DataFrame({"file_no": (low + spread % (high - low + 1)).astype(np.int32), "ids": ids})

    made = named.select("k", "row", encode("k", "row", "t").alias("_e")).select("k", "row", "_e.*")
    dealt = made.repartitionById(files, F.col("file_no")).sortWithinPartitions("file_no", "k", "row")
    manifest = stored(dealt.select("file_no", "k", "ids").mapInArrow(
        lambda batches: _write(batches, tokenizer, folder, length),
        "file_no int, path string, n_documents long, n_tokens long, n_sequences long"), "token-manifest")
    # one narrow row a file
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def _write(batches: Iterator[pa.RecordBatch], tokenizer: str, folder: str, length: int) -> Iterator[pa.RecordBatch]:
    kind = encoder(tokenizer).type
    out: _Writer | None = None
    for batch in batches:
        for no, k, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if out is None or out.file_no != no:
                if out is not None:
                    yield out.close()
                out = _Writer(folder, no, kind, length)
            out.add(None if k == FIRST else k, np.frombuffer(ids, dtype=kind))
    if out is not None:
        yield out.close()


def schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([
        ("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(kind), nullable=False), length)),
        ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length)),
        ("documents", pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int32())]))),
    ])


class _Writer:
    """One file: collects ids and writes a record batch whenever one is full."""

    def __init__(self, folder: str, file_no: int, kind: np.dtype, length: int):
        files, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
            pa.fs.LocalFileSystem(), folder)
        files.create_dir(root, recursive=True)
        name = f"part-{file_no:06d}-{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.arrow"
        self.path, self.file_no, self.length = f"{folder.rstrip('/')}/{name}", file_no, length
        self.schema = schema(kind, length)
        self.sink = files.open_output_stream(f"{root.rstrip('/')}/{name}")
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.room = np.zeros((BATCH, length), dtype=kind)
        self.flat = self.room.reshape(-1)
        self.used = self.documents = self.tokens = self.sequences = 0
        self.begins: list[list[dict]] = [[] for _ in range(BATCH)]

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.begins[self.used // self.length].append({"key": key, "place": self.used % self.length})
        self.documents += 1
        self.tokens += len(ids)
        while len(ids):
            some = ids[:len(self.flat) - self.used]
            self.flat[self.used:self.used + len(some)] = some
            self.used += len(some)
            ids = ids[len(some):]
            if self.used == len(self.flat):
                self.flush()

    def flush(self) -> None:
        rows = -(-self.used // self.length)
        if not rows:
            return
        full = rows * self.length
        self.flat[self.used:full] = 0
        mask = np.arange(full) < self.used
        fields = [self.schema.field(i).type for i in range(3)]
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(self.flat[:full].copy()), type=fields[0]),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), type=fields[1]),
            pa.array(self.begins[:rows], type=fields[2]),
        ]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))
        self.sequences += rows
        self.used, self.begins = 0, [[] for _ in range(BATCH)]

    def close(self) -> pa.RecordBatch:
        self.flush()
        self.file.close()
        self.sink.close()
        return pa.RecordBatch.from_pydict({
            "file_no": pa.array([self.file_no], pa.int32()), "path": [self.path], "n_documents": [self.documents],
            "n_tokens": [self.tokens], "n_sequences": [self.sequences]})


class SequenceFile:
    """One file, mapped: ``sequence(i)`` and ``mask(i)`` copy nothing (for a local path)."""

    def __init__(self, path: str):
        if "://" in path or path.startswith("file:"):
            files, inner = pa.fs.FileSystem.from_uri(path)
        else:
            files, inner = pa.fs.LocalFileSystem(), path
        source = pa.memory_map(inner) if isinstance(files, pa.fs.LocalFileSystem) else files.open_input_file(inner)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.batches = self.reader.num_record_batches

    def __len__(self) -> int:
        """Sequences; all batches but the last are full."""
        return (self.batches - 1) * BATCH + self.reader.get_batch(self.batches - 1).num_rows if self.batches else 0

    def sequence(self, i: int) -> np.ndarray:
        ids = self.reader.get_batch(i // BATCH).column(0)
        return ids.values.to_numpy(zero_copy_only=True).reshape(-1, self.length)[i % BATCH]

    def mask(self, i: int) -> pa.BooleanArray:
        return self.reader.get_batch(i // BATCH).column(1)[i % BATCH].values

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """Key, number of ids and CRC-32 of the ids as little-endian 32-bit integers, batch by batch."""
        key, size, crc, open_one = None, 0, 0, False
        for number in range(self.batches):
            batch = self.reader.get_batch(number)
            ids = batch.column(0).values.to_numpy(zero_copy_only=True)
            used = batch.column(1).values.true_count
            listed = batch.column(2)
            begins = (np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy())) * self.length
                      + listed.values.field("place").to_numpy()).tolist()
            at = 0
            for begin, name in zip([*begins, used], [*listed.values.field("key").to_pylist(), None], strict=True):
                crc = zlib.crc32(ids[at:begin].astype("<u4").tobytes(), crc)
                size += begin - at
                at = begin
                if begin < used:
                    if open_one:
                        yield key, size, crc
                    key, size, crc, open_one = name, 0, 0, True
        if open_one:
            yield key, size, crc


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, start in zip(part["path"], part["start"], strict=True):
                rows, at = [], int(start)
                for key, size, crc in SequenceFile(path).documents():
                    rows.append((key, at, size, crc))
                    at += size
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    files = manifest.select("file_no", "path", "start")
    return files.repartition(max(1, manifest.count()), "file_no").mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"], dtype=object)
    return made.astype("Int64")


def token_stream(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents as token files and read them back."""
    spark = docs.sparkSession
    return read_documents(spark, write_token_files(docs, tokenizer, scratch(spark, "token-files")))
