"""Token ids of documents in length-delimited binary records, with an offset index for shuffled reads.

A record file is a sequence of frames:

    length of the payload        8 bytes, little-endian
    masked CRC-32C of these      4 bytes
    payload                      `length` bytes
    masked CRC-32C of it         4 bytes

(a masked sum is the sum turned right by 15 bits plus a constant, so that sums
of data that hold sums don't degenerate). The payload is one document: the
length of its id as text (4 bytes, all ones for null), that text, the number of
bytes of a token id (2 or 4), and the ids. Beside each file stands its index:
for every record, and for the end, its offset in the file and the number of
token ids before it, both 8 bytes. A table of the files (`manifest`) holds
their order, names and totals.

`write_records` deals the documents in ascending order of their ids into ranges
(ties by the text's hash, and by chance among equal rows, so that neither a hot
id nor copies land in one range); each task sorts its range, encodes it and
writes files of at most `FILE_BYTES` and one record. Files bear the task
attempt's number and count only once the manifest, which Spark commits,
names them: a lost or repeated task leaves at most files that nobody reads.
`read_records` reads whole files in order; `read_shuffled` deals the entries of
the indexes in a seeded random order and seeks each record. Both check every
sum and raise ValueError for a damaged record.

Results in special cases:
- a null text is an empty text: its record holds only the end token.
- null ids come first; equal ids are ordered by the hash of their texts.
- repeated rows are records of their own; an empty table gives no files and an
  empty result.
- whole texts are encoded, however long. Strings of added tokens in a text are
  encoded as the tokenizers library does by default, as these tokens.
- columns other than the id's and the text's, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fonolytics.llm.store import _filesystem
from fonolytics.llm.textarrays import ranges, slices
from fonolytics.llm.tokens import PieceEncoder

FILE_BYTES = 128 << 20
# Bytes of records read, and of sums computed, at a time.
READ_BYTES, SUM_BYTES = 8 << 20, 1 << 22
NO_ID = 0xFFFFFFFF
MANIFEST = "part long, seq int, name string, records long, tokens long, bytes long"
# The reflected CRC-32C polynomial and the constant of masked sums.
_POLYNOMIAL, _MASK_DELTA = 0x82F63B78, 0xA282EAD8


# -- checksums -------------------------------------------------------------------

_LEVELS: list[np.ndarray] = []


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def _shift(level: int) -> np.ndarray:
    """[r, k, b]: what byte k of a sum, with value b, becomes behind r * 64^level further zero bytes."""
    while len(_LEVELS) <= level:
        table = _byte_table()
        single = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        if not _LEVELS:
            one = (single >> 8) ^ table[single & 255]  # one zero byte
        else:
            last = _LEVELS[-1]
            one = _apply(last, np.full(single.shape, 63), single)
            one = _apply(last, np.ones(single.shape, int), one)
        steps = [single]
        for _ in range(63):
            steps.append(_apply(one[None], np.zeros(single.shape, int), steps[-1]))
        _LEVELS.append(np.stack(steps))
    return _LEVELS[level]


def _apply(tables: np.ndarray, r: np.ndarray, sums: np.ndarray) -> np.ndarray:
    out = tables[r, 0, sums & 255]
    for k in (1, 2, 3):
        out = out ^ tables[r, k, (sums >> (8 * k)) & 255]
    return out


def crc32c(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32C of each stretch data[offsets[k] : offsets[k + 1]].

    The sum is linear: every byte adds what it becomes behind the bytes that
    follow it. Bytes are added up in units of 64 from the stretch's end, these
    in units of 64 units, and so on.
    """
    sizes = np.diff(offsets)
    units = -(-sizes // 64)
    first = np.cumsum(units) - units
    sums = np.zeros(int(units.sum()), np.uint32)
    table = _shift(0)
    flat = _apply(table, np.arange(64)[:, None], _byte_table()[None, :]).ravel()
    for a in range(int(offsets[0]), int(offsets[-1]), SUM_BYTES):
        b = min(a + SUM_BYTES, int(offsets[-1]))
        lo, hi = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
        edges = np.clip(offsets[lo : hi + 1], a, b)
        count = np.diff(edges)
        behind = np.repeat(offsets[lo + 1 : hi + 1] - 1, count) - np.arange(a, b)
        unit = np.repeat(first[lo:hi], count) + (behind >> 6)
        value = flat[((behind & 63) << 8) | data[a:b]]
        cut = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        sums[unit[cut]] ^= np.bitwise_xor.reduceat(value, cut)
    level = 1
    while len(units) and units.max() > 1:
        count = units
        units = -(-count // 64)
        place = ranges(np.zeros_like(count), count)
        value = _apply(_shift(level), place & 63, sums)
        first = np.cumsum(units) - units
        unit = np.repeat(first, count) + (place >> 6)
        cut = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        sums = np.bitwise_xor.reduceat(value, cut)
        level += 1
    out = np.zeros(len(sizes), np.uint32)
    out[units > 0] = sums
    # the register starts with all ones, which the whole stretch shifts
    start, left, level = np.full(len(sizes), 0xFFFFFFFF, np.uint32), sizes.astype(np.int64), 0
    while left.any():
        start = _apply(_shift(level), left & 63, start)
        left, level = left >> 6, level + 1
    return ~(out ^ start)


def masked(sums: np.ndarray) -> np.ndarray:
    return ((sums >> 15) | (sums << 17)) + np.uint32(_MASK_DELTA)


# -- records ---------------------------------------------------------------------


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def frames(keys: list[str | None], tokens: np.ndarray, offsets: np.ndarray, width: int) -> list[bytes]:
    """The frame of each document; `tokens[offsets[k] : offsets[k + 1]]` are the ids of document k."""
    ids = tokens.astype("<u2" if width == 2 else "<u4").tobytes()
    at = (offsets * width).tolist()
    payloads = []
    for k, key in enumerate(keys):
        name = b"" if key is None else key.encode()
        head = (NO_ID if key is None else len(name)).to_bytes(4, "little")
        payloads.append(b"".join((head, name, bytes((width,)), ids[at[k] : at[k + 1]])))
    data, edges = _joined(payloads)
    lengths = np.diff(edges).astype("<u8").tobytes()
    first = masked(crc32c(np.frombuffer(lengths, np.uint8), np.arange(len(keys) + 1) * 8)).astype("<u4").tobytes()
    last = masked(crc32c(data, edges)).astype("<u4").tobytes()
    return [b"".join((lengths[8 * k : 8 * k + 8], first[4 * k : 4 * k + 4], p, last[4 * k : 4 * k + 4])) for k, p in enumerate(payloads)]


def parsed(data: bytes, offsets: np.ndarray, name: str) -> tuple[list[str | None], list[np.ndarray]]:
    """Ids and token ids of the frames data[offsets[k] : offsets[k + 1]], checked."""
    raw = np.frombuffer(data, np.uint8)
    heads = raw[(offsets[:-1, None] + np.arange(12)).ravel()].reshape(-1, 12) if len(offsets) > 1 else np.zeros((0, 12), np.uint8)
    length = np.ascontiguousarray(heads[:, :8]).view("<u8").ravel().astype(np.int64)
    first = np.ascontiguousarray(heads[:, 8:]).view("<u4").ravel()
    good = masked(crc32c(np.ascontiguousarray(heads[:, :8]).ravel(), np.arange(len(heads) + 1) * 8)) == first
    good &= length + 16 == np.diff(offsets)
    if good.all():
        body = raw[ranges(offsets[:-1] + 12, length)]
        edges = np.concatenate(([0], np.cumsum(length)))
        last = raw[(offsets[1:, None] - 4 + np.arange(4)).ravel()].reshape(-1, 4).copy().view("<u4").ravel()
        good = masked(crc32c(body, edges)) == last
    if not good.all():
        raise ValueError(f"damaged record at byte {int(offsets[int(np.argmin(good))])} read from {name}")
    keys, ids = [], []
    for a, b in zip((offsets[:-1] + 12).tolist(), (offsets[1:] - 4).tolist()):
        size = int.from_bytes(data[a : a + 4], "little")
        after = a + 4 + (0 if size == NO_ID else size)
        keys.append(None if size == NO_ID else data[a + 4 : after].decode())
        ids.append(np.frombuffer(data[after + 1 : b], "<u2" if data[after] == 2 else "<u4").astype("<u4"))
    return keys, ids


# -- writing ---------------------------------------------------------------------


class _Files:
    """The files of one task attempt: frames go to the open one, which is closed with its index when full."""

    def __init__(self, folder: str, part: int, attempt: int, most: int):
        self.files, self.folder = _filesystem(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.part, self.attempt, self.most = part, attempt, most
        self.rows: list[tuple] = []
        self.out = None

    def add(self, made: list[bytes], tokens: np.ndarray) -> None:
        for frame, n in zip(made, tokens.tolist()):
            if self.out is None:
                self.name = f"{self.part:06d}-{self.attempt}-{len(self.rows):04d}"
                self.out, self.index = self.files.open_output_stream(f"{self.folder}/{self.name}.rec"), [(0, 0)]
            self.out.write(frame)
            at, before = self.index[-1]
            self.index.append((at + len(frame), before + n))
            if self.index[-1][0] >= self.most:
                self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        with self.files.open_output_stream(f"{self.folder}/{self.name}.idx") as out:
            out.write(np.array(self.index, "<u8").tobytes())
        size, tokens = self.index[-1]
        self.rows.append((self.part, len(self.rows), self.name, len(self.index) - 1, tokens, size))


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = 0,
    width: int | None = None, partitions: int | None = None, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the texts' token ids and an `end` each in ascending order of ids below `folder`; return the manifest.

    `tokenizer` is the path of a byte-level BPE file, at the same place on every
    machine. `width` is the number of bytes of an id (2 where they fit).
    `partitions` is the number of ranges (default: the session's shuffle partitions).
    """
    spark = docs.sparkSession
    if width is None:
        top = max(PieceEncoder.of(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True), end + 1)
        width = 2 if top <= 1 << 16 else 4
    if partitions is None:
        found = str(spark.conf.get("spark.sql.shuffle.partitions"))
        partitions = int(found) if found.isdigit() else 200

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files = _Files(f"{folder}/files", task.partitionId(), task.taskAttemptId(), file_bytes)
        encoder = PieceEncoder.of(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, offsets = encoder.encode(part.column("text"), end)
                files.add(frames(part.column("key").to_pylist(), tokens, offsets, width), np.diff(offsets))
        files.close()
        if files.rows:
            cols = list(zip(*files.rows))
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["part", "seq", "name", "records", "tokens", "bytes"])

    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = own.select("*", F.xxhash64("text").alias("h"), F.rand(11).alias("r"))
    ranged = own.repartitionByRange(partitions, "id", "h", "r").sortWithinPartitions("id", "h")
    made = ranged.select(F.col("id").cast("string").alias("key"), "text").mapInArrow(write, MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


# -- reading ---------------------------------------------------------------------


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files in order, with the token ids before each (`start`). One row per file: a few thousand per TB."""
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return files.select("*", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("start"))


def _index(files, path: str) -> np.ndarray:
    with files.open_input_file(f"{path}.idx") as src:
        return np.frombuffer(src.read(), "<u8").astype(np.int64).reshape(-1, 2)


def _rows(keys, starts, ids: list[np.ndarray], with_ids: bool) -> pa.RecordBatch:
    cols = [pa.array(keys, pa.string()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
    names = ["key", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        cols.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names)


def _schema(with_ids: bool) -> str:
    return "key string, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids


def read_records(spark: SparkSession, folder: str, doc_id: str = "doc_id", kind: str = "long", ids: bool = False) -> DataFrame:
    """doc_id (cast to `kind`), start (token ids before it), n_tokens, ids_crc32, and the ids where asked for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(f"{folder}/files")
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                at, before = _index(files, f"{base}/{name}").T
                with files.open_input_file(f"{base}/{name}.rec") as src:
                    a = 0
                    while a < len(at) - 1:
                        b = max(a + 1, int(np.searchsorted(at, at[a] + READ_BYTES, "right")) - 1)
                        data = src.read_at(int(at[b] - at[a]), int(at[a]))
                        keys, found = parsed(data, at[a : b + 1] - at[a], name)
                        yield _rows(keys, start + before[a:b], found, ids)
                        a = b

    files = manifest(spark, folder)
    dealt = files.select("name", "start").repartition(max(1, files.count()))
    return _named(dealt.mapInArrow(read, _schema(ids)), doc_id, kind)


def _named(rows: DataFrame, doc_id: str, kind: str) -> DataFrame:
    return rows.select(F.col("key").cast(kind).alias(doc_id), *[c for c in rows.columns if c != "key"])


def read_shuffled(
    spark: SparkSession, folder: str, seed: int = 0, epoch: int = 0, doc_id: str = "doc_id", kind: str = "long", ids: bool = True, partitions: int | None = None
) -> DataFrame:
    """All records in a random order that `seed` and `epoch` fix, read one by one through the offset index.

    Partitions follow each other in that order, as do the rows of each.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(f"{folder}/files")
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                at, before = _index(files, f"{base}/{name}").T
                cols = [pa.array([name] * (len(at) - 1), pa.string()), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(before[:-1] + start)]
                yield pa.RecordBatch.from_arrays(cols, ["name", "at", "size", "start"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(f"{folder}/files")
        opened: OrderedDict = OrderedDict()
        for batch in batches:
            keys, starts, found = [], [], []
            held = 0
            for name, at, size, start in zip(*(batch.column(c).to_pylist() for c in ("name", "at", "size", "start"))):
                if name not in opened:
                    if len(opened) >= 64:
                        opened.popitem(last=False)[1].close()
                    opened[name] = files.open_input_file(f"{base}/{name}.rec")
                opened.move_to_end(name)
                k, x = parsed(opened[name].read_at(size, at), np.array([0, size]), name)
                keys += k
                found += x
                starts.append(start)
                held += size
                if held >= READ_BYTES:
                    yield _rows(keys, starts, found, ids)
                    keys, starts, found, held = [], [], [], 0
            yield _rows(keys, starts, found, ids)

    files = manifest(spark, folder)
    n = max(1, files.count())
    index = files.select("name", "start").repartition(n).mapInArrow(entries, "name string, at long, size long, start long")
    mixed = index.withColumn("turn", F.xxhash64(F.lit(seed), F.lit(epoch), "name", "at"))
    ranged = mixed.repartitionByRange(partitions or n, "turn").sortWithinPartitions("turn")
    return _named(ranged.drop("turn").mapInArrow(read, _schema(ids)), doc_id, kind)
