"""Token ids in patched frame-of-reference blocks.

Texts are encoded, an end id closes each document, and the ids are written in ascending order of ``doc_id`` as segments.
A segment is one binary value with whole documents: header, document ids and lengths, an index with the start of every
block, and the blocks. A block holds up to 128 numbers: their minimum is subtracted, the differences are packed at a
width that most of them fit (a percentile), the few that do not keep their low bits there and their high bits in an
exception list. A block is found by the index and read alone.

Segments are rows of a Parquet table, so that Spark's commit protocol makes the write safe against lost executors and
any store that Spark can write will do. The table is sorted: partition, then segment.

Segment layout, little-endian
-----------------------------
magic ``PFB1``; uint64 number of documents, ids, blocks; int64 start of the segment in its partition; then uint32 byte
lengths of three parts: doc ids (zigzag deltas), doc lengths, tokens. Each part is a PFOR stream: uint64 count, uint32
block starts, blocks. Block: uint64 minimum, uint8 width, uint8 number of exceptions, packed differences, exception
places (uint8 each), exception high parts (uint64 each).

Defined results
---------------
* Null text is empty: only the end id. Null ``doc_id`` comes first and reads back as null.
* Rows with equal ``doc_id`` are in order of a hash of their text; equal rows are equal in any order.
* An empty table writes no segment and reads back empty. Other columns are not written.
* A long text is never split over segments; a segment holds the documents of about
  ``SEGMENT_BYTES`` of text.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rtshop.llm.common import slices
from rtshop.session import shared_dir

END_ID = 1
BLOCK = 128
# Share of a block's numbers that must fit the packed width.
PERCENTILE = 0.9
SEGMENT_BYTES = 3_000_000
CACHED_WORDS = 250_000  # a generation; two are kept
CACHED_LENGTH = 64
# A comma or full stop that might share a token with what is before it. The letter named becomes two characters, the
# second no letter, when it is folded.
NOT_APART = r"(^|[^\pL\pN]|\x{130})[,.]( |$)"
MAGIC = b"PFB1"
HEADER = struct.Struct("<4sQQQqIII")
SEGMENTS = "part int, segment int, start long, n_ids long, n_docs long, payload binary"
DOCS = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"


# --- PFOR streams -------------------------------------------------------------------------------------------------

def pack(values: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """A PFOR stream of unsigned 64-bit numbers."""
    values = np.asarray(values)
    n = len(values)
    n_blocks = -(-n // block)
    # Ids are small; half the width is half the work.
    padded = np.zeros(n_blocks * block, np.uint32 if values.dtype.itemsize <= 4 else np.uint64)
    padded[:n] = values
    grid = padded.reshape(n_blocks, block)
    if n % block:
        grid[-1, n % block:] = grid[-1, n % block - 1]
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    at = min(block - 1, int(np.ceil(percentile * block)) - 1)
    width = bit_length(np.partition(rest, at, axis=1)[:, at].astype(np.uint64))
    bodies: list[bytes] = [b""] * n_blocks
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        most = rest.dtype.type(min(2 ** w - 1, np.iinfo(rest.dtype).max))
        low_bits = rest[rows] & most
        packed = pack_bits(low_bits, w).tobytes() if w else b""
        size = block * w // 8
        outliers = (rest[rows] > most).sum(axis=1).tolist()
        for k, (row, least, n_over) in enumerate(zip(rows.tolist(), low[rows].tolist(), outliers)):
            bodies[row] = struct.pack("<QBB", least, w, n_over) + packed[k * size:(k + 1) * size]
            if n_over:
                over = np.flatnonzero(rest[row] > most)
                high = rest[row][over] >> rest.dtype.type(w)
                bodies[row] += over.astype(np.uint8).tobytes() + high.astype("<u8").tobytes()
    starts = np.cumsum([0] + [len(b) for b in bodies], dtype=np.uint64)
    return struct.pack("<Q", n) + starts.astype("<u4").tobytes() + b"".join(bodies)


def bit_length(values: np.ndarray) -> np.ndarray:
    """Bits that each number needs, 0 for 0."""
    out = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    # Rounding to a float may reach the next power of two.
    out -= (out > 53) & ((values >> (np.maximum(out, 1) - np.uint8(1)).astype(np.uint64)) == 0)
    return out


def pack_bits(rows: np.ndarray, width: int) -> np.ndarray:
    """Each row's numbers at ``width`` bits, lowest bit first, as a row of bytes. A block fills whole 64-bit words."""
    n, block = rows.shape
    words = np.zeros((block * width // 64, n), np.uint64)
    for k, column in enumerate(np.ascontiguousarray(rows.T, np.uint64)):
        word, shift = divmod(k * width, 64)
        words[word] |= column << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= column >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8", copy=False).view(np.uint8)


def unpack_bits(bodies: np.ndarray, width: int, block: int) -> np.ndarray:
    """Reverse of ``pack_bits``, from a matrix of bytes."""
    words = np.ascontiguousarray(bodies.view("<u8").T.astype(np.uint64))
    mask = np.uint64(2 ** width - 1)
    out = np.empty((block, bodies.shape[0]), np.uint64)
    for k in range(block):
        word, shift = divmod(k * width, 64)
        out[k] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            out[k] |= words[word + 1] << np.uint64(64 - shift)
    out &= mask
    return out.T


def unpack(data: bytes | memoryview, first: int = 0, count: int | None = None, block: int = BLOCK) -> np.ndarray:
    """Numbers ``first`` to ``first + count`` of a stream; only their blocks are read."""
    data = memoryview(data)
    n = struct.unpack_from("<Q", data)[0]
    last = n if count is None else min(n, first + count)
    if first >= last:
        return np.empty(0, np.uint64)
    n_blocks = -(-n // block)
    starts = np.frombuffer(data, "<u4", n_blocks + 1, 8)
    base = 8 + 4 * (n_blocks + 1)
    wanted = np.arange(first // block, -(-last // block))
    raw = np.frombuffer(data, np.uint8)
    at = starts[wanted].astype(np.int64) + base
    heads = raw[at[:, None] + np.arange(10)]
    low = np.ascontiguousarray(heads[:, :8]).view("<u8").ravel()
    grid = np.empty((len(wanted), block), np.uint64)
    # Blocks of one width are unpacked together; exceptions are then patched in.
    for width in np.unique(heads[:, 8]).tolist():
        rows = np.flatnonzero(heads[:, 8] == width)
        size = block * width // 8
        grid[rows] = unpack_bits(raw[at[rows, None] + np.arange(10, 10 + size)], width, block) if width else 0
        patched = rows[heads[rows, 9] > 0]
        for k, head, n_over in zip(patched.tolist(), (at[patched] + 10 + size).tolist(), heads[patched, 9].tolist()):
            high = raw[head + n_over:head + 9 * n_over].view("<u8")
            grid[k, raw[head:head + n_over]] |= high << np.uint64(width)
    grid += low[:, None]
    skip = first - int(wanted[0]) * block
    return grid.ravel()[skip:skip + last - first]


def zigzag(values: np.ndarray) -> np.ndarray:
    values = np.asarray(values, np.int64)
    return ((values << 1) ^ (values >> 63)).view(np.uint64)


def unzigzag(values: np.ndarray) -> np.ndarray:
    return ((values >> np.uint64(1)) ^ (np.uint64(0) - (values & np.uint64(1)))).view(np.int64)


# --- Segments -----------------------------------------------------------------------------------------------------

def encode_segment(start: int, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment. A null doc id has a 0 before it in the list of ids, others a 1, all as deltas."""
    known = np.array([0 if d is None else d for d in doc_ids], np.int64)
    with np.errstate(over="ignore"):
        deltas = np.diff(known, prepend=np.int64(0))
    nulls = np.array([d is None for d in doc_ids], np.uint64)
    parts = [pack(np.concatenate([zigzag(deltas), nulls])), pack(lengths), pack(ids)]
    return HEADER.pack(MAGIC, len(doc_ids), len(ids), -(-len(ids) // BLOCK), start, *map(len, parts)) + b"".join(parts)


def decode_segment(payload: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """(start in the partition, doc ids, lengths, ids) of a segment."""
    magic, n_docs, n_ids, _, start, *sizes = HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    data, at, parts = memoryview(payload), HEADER.size, []
    for size in sizes:
        parts.append(data[at:at + size])
        at += size
    first = unpack(parts[0])
    with np.errstate(over="ignore"):
        known = np.cumsum(unzigzag(first[:n_docs])).tolist()
    doc_ids = [None if null else d for d, null in zip(known, first[n_docs:].tolist())]
    return start, doc_ids, unpack(parts[1]).astype(np.int64), unpack(parts[2]).astype("<u4")


class WordEncoder:
    """Encoding of whole texts through a cache of words.

    The vocabulary drops white space and no token crosses it, so a text's ids are those of its stretches between blanks
    and line ends, each encoded by the library. Frequent stretches are encoded once; new ones of a slice of documents go
    to the library in one call, with a mark between them.
    """

    MARK = "\x01"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self._library = Tokenizer.from_file(path)
        self._mark = self._library.encode(self.MARK, add_special_tokens=False).ids
        # Ids that end a word: a stretch of letters is one word, so its ids end with the only such one.
        suffix = getattr(self._library.model, "end_of_word_suffix", None)
        self._ends = np.zeros(self._library.get_vocab_size(with_added_tokens=True), bool)
        if suffix:
            self._ends[[i for token, i in self._library.get_vocab(True).items() if token.endswith(suffix)]] = True
        self._cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _alone(self, word: str) -> bytes:
        return np.array(self._library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        """Add words to the cache. Words of letters go to the library in one call, and others that a mark can be put
        between in another; what is left, or does not come back as sent, goes one by one."""
        plain = [w for w in new if w and self.MARK not in w and "<|" not in w and len(w) <= CACHED_LENGTH]
        letters = [w for w in plain if w.isalpha()]
        self._together(letters, " ", lambda ids: np.flatnonzero(self._ends[ids]) + 1, 0)
        others = [w for w in plain if w not in self._cache]
        if len(self._mark) == 1:
            self._together(others, f" {self.MARK} ", lambda ids: np.flatnonzero(np.append(ids, self._mark) == self._mark[0]), 1)
        for word in new:
            if word not in self._cache:
                self._cache[word] = self._alone(word)

    def _together(self, words: list[str], between: str, ends, skip: int) -> None:
        """Encode ``words`` in one call; ``ends`` finds where each one's ids end, ``skip`` ids before the next's."""
        if not words:
            return
        ids = np.array(self._library.encode_batch_fast([between.join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = ends(ids)
        if len(stops) == len(words):
            raw, stops = ids.tobytes(), stops.tolist()
            self._cache.update((word, raw[4 * start:4 * stop])
                               for word, start, stop in zip(words, [0, *[s + skip for s in stops[:-1]]], stops))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); a null text has none.

        Arrow cuts the texts and finds the distinct stretches; Python sees only those.
        """
        texts = pc.fill_null(texts, "")
        # ASCII capitals fold as in the vocabulary. Texts with what might be a special string are left as they are.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        texts = pc.replace_substring(texts, "\n", " ")
        # A comma or full stop after a letter or digit and before a blank is a token of its own, so it may stand alone.
        apart = pc.replace_substring(pc.replace_substring(texts, ", ", " , "), ". ", " . ")
        texts = pc.if_else(pc.match_substring_regex(texts, NOT_APART), texts, apart)
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self._cache) > CACHED_WORDS:
            self._cache, self._older = {}, self._cache
        known, older = self._cache.get, self._older.get
        pieces = list(map(known, words))
        # What the older generation knows moves to the younger one, so frequent words outlive the change.
        missing = [w for w, ids in zip(words, pieces) if ids is None]
        self._cache.update((w, ids) for w in missing if (ids := older(w)) is not None)
        new = {w for w in missing if w not in self._cache}
        if new:
            self._learn(new)
        if missing:
            pieces = [known(w) if ids is None else ids for w, ids in zip(words, pieces)]
            for word in [w for w in new if len(w) > CACHED_LENGTH]:
                del self._cache[word]
        table = np.frombuffer(b"".join(pieces), "<u4")
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        which = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[which]
        until = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat((np.cumsum(sizes) - sizes)[which] - until[:-1], counts)
        places += np.arange(until[-1])
        ids = table[places]
        offsets = lists.offsets.to_numpy()
        return ids, np.diff(until[offsets - offsets[0]])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID, partitions: int | None = None,
                 segment_bytes: int = SEGMENT_BYTES) -> None:
    """Encode ``docs`` (``doc_id, text``) and write the segments to ``path``. One shuffle: the range order.

    ``partitions`` is by default the session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(vocabulary), TaskContext.get().partitionId()
        start = segment = 0
        for batch in batches:
            keys, texts = batch.columns
            for low, high in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), segment_bytes):
                ids, lengths = own.encode_all(texts[low:high])
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                payload = encode_segment(start, keys[low:high].to_pylist(), lengths + 1, ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in ((part, pa.int32()), (segment, pa.int32()), (start, pa.int64()),
                                                   (len(ids), pa.int64()), (high - low, pa.int64()),
                                                   (payload, pa.binary()))],
                    names=["part", "segment", "start", "n_ids", "n_docs", "payload"])
                start, segment = start + len(ids), segment + 1
        pa.default_memory_pool().release_unused()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The hash orders rows with equal ids and lets them spread over partitions.
    tie = F.xxhash64("text")
    ordered = keyed.repartitionByRange(partitions, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.select("doc_id", "text").mapInArrow(encode, SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents written to ``path``, from the segments' bytes.

    ``start`` counts the ids of all documents before. Sums by partition, as many rows as the write had partitions, give
    each partition's offset; the segments know their own start within it.
    """
    segments = spark.read.parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    offsets, total = [], 0
    for row in totals:
        offsets.append((row["part"], total))
        total += row["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                start, doc_ids, lengths, ids = decode_segment(payload.as_py())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()),
                     pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array(crcs, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])
        pa.default_memory_pool().release_unused()

    rows = segments.select("part", "payload").mapInArrow(decode, DOCS)
    base = spark.createDataFrame(offsets, "part int, base long")
    return (rows.join(F.broadcast(base), "part")
            .select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"))


def store_tokens(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Write and read back; without ``path`` into a new folder of the shared folder."""
    path = path or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, vocabulary, path)
    return read_tokens(docs.sparkSession, path)
