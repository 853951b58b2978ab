"""Token ids as canonical, length-limited Huffman code in shard files with seekable blocks.

The code is made from the counts of all ids (package-merge, lengths up to a limit), so only the lengths need to
be stored. Documents are written in ascending id order. A shard file holds the code lengths and then blocks;
a block can be decoded on its own, and its checkpoints give the bit offset of every 128th id of each
document, so that decoding can start at any of them: all stretches between checkpoints are decoded side by
side with one table lookup an id.

Shard file, little endian: b"AQHUF1", uint32 number of code lengths, the lengths (uint8); then blocks:
uint32 documents, uint32 checkpoints, uint64 payload bytes, then per document int64 id, uint8 "id is null",
uint32 number of ids; per checkpoint uint64 bit offset; the payload, padded to 8 bytes.

Edge cases: a null or empty text is a document of the end id alone; null document ids come first; repeated
rows are written as often as they occur; without rows no shard is written and reading gives no rows.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aquifer.llm.common import as_bytes, freeze, map_batches, shared_folder, slices
from aquifer.llm.tokens import encoder, narrow, widen

MAGIC = b"AQHUF1"
STRIDE = 128  # ids between checkpoints
BLOCK_IDS = 1 << 20  # ids in a block, about


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than `limit` (package-merge); 0: no code."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes longer than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    merged, leaf_masks = weights, [np.ones(len(weights), bool)]
    for _ in range(limit - 1):
        pairs = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        leaf_masks.append(rank < len(weights))
    take, depth = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for mask in reversed(leaf_masks):
        leaves = int(mask[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol); symbols without a code get 0."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        bits = lengths[order].astype(np.int64)
        top = int(bits[-1])
        start = np.concatenate([[0], np.cumsum(1 << (top - bits))[:-1]])
        codes[order] = (start >> (top - bits)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits looked at, symbol, length) by the next bits of the stream."""
    top = max(1, int(lengths.max(initial=1)))
    codes = canonical_codes(lengths)
    order = np.lexsort((codes, lengths))
    order = order[lengths[order] > 0]
    span = 1 << (top - lengths[order].astype(np.int64))
    symbols = np.zeros(1 << top, np.uint32)
    sizes = np.ones(1 << top, np.int64)
    filled = int(span.sum())
    symbols[:filled] = np.repeat(order.astype(np.uint32), span)
    sizes[:filled] = np.repeat(lengths[order].astype(np.int64), span)
    return top, symbols, sizes


def encode_block(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray
                 ) -> tuple[bytes, np.ndarray]:
    """Bits of the ids of consecutive documents (`counts` ids each), and the checkpoints' bit offsets."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    begins = ends - bits
    words = np.zeros(int(ends[-1] if len(ends) else 0) // 64 + 2, np.uint64)
    if len(ids):
        word, room = begins >> 6, 64 - (begins & 63) - bits
        value = codes[ids]
        head = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64),
                        value >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(head, first)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes(), begins[checkpoint_places(counts)[0]]


def checkpoint_places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a block's ids where a checkpoint lies, and how many ids follow up to the next one."""
    marks = -(-counts // STRIDE)
    start = np.repeat(np.cumsum(counts) - counts, marks)
    nth = np.arange(int(marks.sum())) - np.repeat(np.cumsum(marks) - marks, marks)
    return start + nth * STRIDE, np.minimum(np.repeat(counts, marks) - nth * STRIDE, STRIDE)


def decode_block(payload: bytes, counts: np.ndarray, offsets: np.ndarray, table: tuple[int, np.ndarray, np.ndarray]
                 ) -> np.ndarray:
    """The ids of a block; all stretches between checkpoints advance together, one id a step."""
    top, symbols, sizes = table
    raw = np.frombuffer(payload + b"\0" * 4, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    places, left = checkpoint_places(counts)
    out = np.empty(int(counts.sum()), np.uint32)
    longest_first = np.argsort(-left, kind="stable")
    at, place, left = offsets[longest_first].astype(np.int64), places[longest_first], left[longest_first]
    for step in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left, -step, side="left"))  # stretches with more than `step` ids
        now = at[:n]
        look = (window[now >> 3] << (now & 7).astype(np.uint32)) >> np.uint32(32 - top)
        out[place[:n] + step] = symbols[look]
        at[:n] = now + sizes[look]
    return out


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def encoded(docs: DataFrame, tokenizer: str, end_id: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, frozen; ids are `tokens.narrow` bytes with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, drops_space=False)
        end = np.array([end_id], np.uint32).tobytes()
        for b in (s for batch in batches for s in slices(batch, "text")):
            ids = [np.frombuffer(x + end, np.uint32) for x in coder.encode(as_bytes(b, "text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([narrow(x) for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return freeze(map_batches(rows, run, "doc_id long, n_tokens long, ids binary"), "huffman-ids")


def id_counts(rows: DataFrame) -> np.ndarray:
    """How often each id occurs in the whole table; the result is as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            if b.num_rows == 0:
                continue
            got = np.bincount(np.concatenate([widen(x) for x in b.column("ids").to_pylist()]))
            if len(got) > len(total):
                total, got = got, total
            total[:len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    summed = map_batches(rows.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = summed.toPandas()  # one row per id of the vocabulary
    counts = np.zeros(int(got["id"].max()) + 1 if len(got) else 1, np.int64)
    counts[got["id"].to_numpy()] = got["n"].to_numpy()
    return counts


def write(rows: DataFrame, lengths: np.ndarray, folder: str, parts: int) -> DataFrame:
    """Write shard files in ascending doc_id order; the manifest: part, path, documents, ids."""
    ordered = (rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
               .withColumn("part", F.spark_partition_id()))
    codes = canonical_codes(lengths)
    schema = "part int, path string, documents long, ids long"

    def block(group: list[tuple]) -> bytes:
        ids = [widen(x) for _, x in group]
        counts = np.array([len(x) for x in ids], np.int64)
        payload, offsets = encode_block(np.concatenate(ids), counts, lengths, codes)
        return b"".join([
            struct.pack("<IIQ", len(group), len(offsets), len(payload)),
            np.array([i or 0 for i, _ in group], "<i8").tobytes(),
            np.array([i is None for i, _ in group], np.uint8).tobytes(),
            counts.astype("<u4").tobytes(), offsets.astype("<u8").tobytes(), payload])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        out = path = None
        part, documents, total, group, held = 0, 0, 0, [], 0
        for b in batches:
            for number, doc, n, ids in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "ids"))):
                if out is None:
                    part, path = number, f"{base}/shard-{number:06d}.huf"
                    draft = f"{path}.{uuid.uuid4().hex[:8]}"
                    out = store.open_output_stream(draft)
                    out.write(MAGIC + struct.pack("<I", len(lengths)) + lengths.tobytes())
                group.append((doc, ids))
                documents, total, held = documents + 1, total + n, held + n
                if held >= BLOCK_IDS:
                    out.write(block(group))
                    group, held = [], 0
        if out is not None:
            if group:
                out.write(block(group))
            out.close()
            store.move(draft, path)  # a repeated attempt replaces the file as a whole
            yield pa.RecordBatch.from_pylist([dict(part=part, path=path, documents=documents, ids=total)], pa.schema(
                [("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    return freeze(map_batches(ordered.select("part", "doc_id", "n_tokens", "ids"), run, schema), "huffman-manifest")


def read_blocks(stream: io.IOBase) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, null flags, counts, ids) of a shard file's blocks, one at a time."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a shard of this format")
    (n,) = struct.unpack("<I", stream.read(4))
    table = decode_table(np.frombuffer(stream.read(n), np.uint8))
    while head := stream.read(16):
        documents, marks, size = struct.unpack("<IIQ", head)
        docs = np.frombuffer(stream.read(8 * documents), "<i8")
        nulls = np.frombuffer(stream.read(documents), np.uint8).astype(bool)
        counts = np.frombuffer(stream.read(4 * documents), "<u4").astype(np.int64)
        offsets = np.frombuffer(stream.read(8 * marks), "<u8")
        yield docs, nulls, counts, decode_block(stream.read(size), counts, offsets, table)


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard file
    shards = manifest.withColumn("base", F.coalesce(F.sum("ids").over(upto), F.lit(0)))
    shards = freeze(shards, "huffman-shards")
    parts = max(1, shards.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                with store.open_input_stream(path) as stream:
                    for docs, nulls, counts, ids in read_blocks(stream):
                        ends = np.cumsum(counts)
                        crc = [zlib.crc32(ids[e - n:e].astype("<u4").tobytes()) for e, n in zip(ends, counts)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(docs, mask=nulls), pa.array(start + ends - counts), pa.array(counts),
                             pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(ends[-1])

    numbered = shards.withColumn("n", (F.row_number().over(Window.orderBy("part")) - 1).cast("int"))
    spread = numbered.repartitionById(parts, "n").select("path", "base")
    return map_batches(spread, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, text: str = "text", doc_id: str = "doc_id",
               ids_per_shard: int = 8_000_000) -> DataFrame:
    """Encode every text, write the shard files in the shared folder and read them back."""
    spark = docs.sparkSession
    rows = encoded(docs, tokenizer, end_id, text, doc_id)
    counts = id_counts(rows)
    limit = max(16, int(np.count_nonzero(counts)).bit_length() + 1)
    folder = shared_folder(spark, "huffman-shards")
    manifest = write(rows, code_lengths(counts, limit), folder, max(1, -(-int(counts.sum()) // ids_per_shard)))
    return read(spark, manifest, folder)
