"""Interpolated modified Kneser-Ney language model, counted in Spark, scored from memory-mapped hash arrays.

Counting. Every training text's tokens are words (A-Z lower-cased) and one end token, behind order - 1 start marks.
Tasks count the n-grams of what they read and deal them out, as sorted and packed arrays, by the words between the
first and the last (two words: by the first). So a shard holds whole what follows from its n-grams: counts, distinct
followers and their share with one, two and more occurrences of each context, and the number of different words before
each suffix (the continuation counts of the order below). It writes n-grams and contexts as arrays sorted by hash to the
shared folder. A suffix of two words of a trigram stays in its shard; others, and one-word contexts, are dealt out again.
So order after order follows, and one pass over the texts is all; nothing but a line per file reaches the driver.

Frequent words. n-grams whose dealing words are all frequent (over half a shard's share of the tokens, by a sample) are
dealt by all words but the last, or two-word ones by both, and their suffixes and contexts are added up in another round.
Packed blocks name words by their places among the sample's commonest words, which all tasks know, or else in the block's
own list. The sample decides only where n-grams are added up and how blocks name words, never what is counted.

Probabilities. p_k(w | h) = max(c(hw) - D(c), 0) / C(h) + g(h) p_(k-1)(w | shorter h), where c counts occurrences
for the highest order and distinct left neighbours below; D1, D2, D3+ of each order follow from its counts of
counts, g(h) gives back what was taken; below one word stands the uniform 1 / (V + 1). An unknown context passes
on to the shorter one.

Scoring. Workers map the shards' files into memory and look up the distinct n-grams of a batch in hash order. A
shared folder that can't be mapped (not a file path) is copied by each worker to its own disk, file by file.

Edge cases: a null or empty text is the end token alone; repeated rows count and are scored each; without training
rows every token has 1 / (V + 1) = 1; a null id is a training row. Word hashes have 64 bits; keys in files have 56, and
few share a file.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquifer.llm.common import as_bytes, fold, freeze, map_batches, mix64, shared_folder

START, END = np.uint64(0x5BD1E995A3C59AC3), np.uint64(0x2545F4914F6CDD1D)
CONTEXTS = 0  # kind of a block of one-word contexts; n-grams of k words are of kind k, lines of statistics of none
BLOCK_BYTES = 24_000_000
BATCH_BYTES = 6_000_000
SAMPLE = 5000  # texts, about, from which frequent and common words are known
COMMON = 1 << 16  # common words
BLOCK_SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary()), ("stats", pa.binary())])
BLOCKS = "shard int, kind int, payload binary, stats binary"


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equally many numbers; the first is sorted and stored as differences. Bytes of equal weight lie
    together, so that small and similar numbers pack well; those that are 0 in the whole column are left out."""
    out = [struct.pack("<II", len(columns), len(columns[0]))]
    for k, c in enumerate(columns):
        c = c.astype(np.uint64)
        if k == 0:
            c = np.diff(c, prepend=np.uint64(0))
        width = -(-int(c.max()).bit_length() // 8) if len(c) else 0
        squeezed = pa.compress(c.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), codec="zstd", asbytes=True)
        out.append(struct.pack("<BI", width, len(squeezed)) + squeezed)
    return b"".join(out)


def unpack(payload: bytes, at: int = 0) -> list[np.ndarray]:
    n_columns, n = struct.unpack_from("<II", payload, at)
    at, columns = at + 8, []
    for k in range(n_columns):
        width, size = struct.unpack_from("<BI", payload, at)
        raw = pa.decompress(payload[at + 5:at + 5 + size], decompressed_size=width * n, codec="zstd", asbytes=True)
        at += 5 + size
        c = np.zeros((n, 8), np.uint8)
        c[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
        c = c.view(np.uint64).ravel()
        columns.append(np.cumsum(c, dtype=np.uint64) if k == 0 else c)
    return columns


def in_order(columns: list[np.ndarray]) -> np.ndarray:
    """The rows' order by the first column, then the next; as one number a row where that fits."""
    bits = max(int(c.max(initial=0)).bit_length() for c in columns)
    if bits * len(columns) > 64:
        return np.lexsort(columns[::-1])
    return np.argsort(one_number(columns, bits))


def one_number(columns: list[np.ndarray], bits: int) -> np.ndarray:
    key = columns[0].astype(np.uint64)
    for c in columns[1:]:
        key = (key << np.uint64(bits)) | c.astype(np.uint64)
    return key


def dealing_first(columns: list) -> list:
    """The words between the first and the last, then these; restored by `dealing_last`."""
    return [*columns[1:-1], columns[0], *columns[1:][-1:]] if len(columns) > 2 else columns


def dealing_last(columns: list) -> list:
    return [columns[-2], *columns[:-2], columns[-1]] if len(columns) > 2 else columns


class Words:
    """What a sample tells of words: the hashes of frequent ones, sorted, and of common ones, the commonest first."""

    def __init__(self, frequent: np.ndarray, common: np.ndarray):
        self.frequent, self.common = frequent, common
        self.rank = np.argsort(common)
        self.sorted = common[self.rank]

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """The words' places among the common ones; -1 for others."""
        if not len(self.common):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.rank[at], -1)


def pack_places(own: np.ndarray, ranks: np.ndarray, known: int, words: list[np.ndarray], sums: list[np.ndarray]) -> bytes:
    """n-grams, given by places in a list of words that is sorted by hash, with their sums. Of the list only what occurs
    and is not among the `known` common words is packed, frequent words first, so that most places are small."""
    n = np.bincount(np.concatenate(words), minlength=len(own))
    used = np.flatnonzero((n > 0) & (ranks < 0))
    used = used[np.argsort(-np.frexp(n[used])[1], kind="stable")]
    place = ranks.copy()
    place[used] = known + np.arange(len(used))
    columns = dealing_first([place[w] for w in words])
    order = in_order(columns)
    listed = pack([own[used]])
    return struct.pack("<I", len(listed)) + listed + pack([c[order] for c in (*columns, *sums)])


def pack_grams(words: list[np.ndarray], sums: list[np.ndarray], sample: Words) -> bytes:
    """n-grams, given by the words' hashes, with their sums."""
    own, places = np.unique(np.concatenate(words), return_inverse=True)
    return pack_places(own, sample.ranks(own), len(sample.common), list(places.reshape(len(words), -1)), sums)


def unpack_grams(payload: bytes, k: int, sample: Words) -> list[np.ndarray]:
    (size,) = struct.unpack_from("<I", payload)
    own = np.concatenate([sample.common, *unpack(payload, 4)])
    columns = unpack(payload, 4 + size)
    return dealing_last([own[c] for c in columns[:k]]) + columns[k:]


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so that sorted hashes are sorted by shard."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def add_up(hashes: np.ndarray, sums: list[np.ndarray], carried: list[np.ndarray]
           ) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct hashes in order, with the sums of their rows; `carried` columns are the same in all of them."""
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.empty(0, np.int64)
    return (sorted_[first], [np.add.reduceat(s[order], first) if len(first) else s for s in sums],
            [c[order[first]] for c in carried])


def frequent(words: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Which hashes are among the sorted ones of frequent words."""
    if not len(heavy):
        return np.zeros(len(words), bool)
    return heavy[np.minimum(np.searchsorted(heavy, words), len(heavy) - 1)] == words


def join_words(words: list[np.ndarray]) -> np.ndarray:
    """n-gram hashes from columns of word hashes; the same as ngram_hashes over consecutive words."""
    factors = mix64(np.arange(len(words) * 100, len(words) * 101, dtype=np.uint64)) | np.uint64(1)
    h = words[0] * factors[0]
    for w, f in zip(words[1:], factors[1:]):
        h += w * f
    return mix64(h)


def dealt_to(words: list[np.ndarray], heavy: np.ndarray, shards: int) -> np.ndarray:
    """The shards to which n-grams are dealt."""
    by = words[1:-1] if len(words) > 2 else words[:1]
    shard = shard_of(join_words(by), shards)
    if len(words) > 1:
        often = np.flatnonzero(np.logical_and.reduce([frequent(w, heavy) for w in by]))
        whole = words[:-1] if len(words) > 2 else words
        shard[often] = shard_of(join_words([w[often] for w in whole]), shards)
    return shard


def parted(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each shard, in order."""
    order = np.argsort(shard.astype(np.uint16) if int(shard.max(initial=0)) < 1 << 16 else shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for lo, hi in zip(edges, np.append(edges[1:], len(order))):
        yield int(shard[order[lo]]), order[lo:hi]


def deal(kind: int, words: list[np.ndarray], sums: list[np.ndarray], sample: Words, shards: int) -> Iterator[dict]:
    """n-grams or one-word contexts as one packed block a shard."""
    for shard, rows in parted(dealt_to(words, sample.frequent, shards)):
        payload = pack_grams([w[rows] for w in words], [c[rows] for c in sums], sample)
        yield {"shard": shard, "kind": kind, "payload": payload, "stats": None}


class WordPlaces(dict):
    """A word -> its place in the list of words, in order of appearance; the start mark and the end come first."""

    def __init__(self):
        super().__init__({None: 0, True: 1})

    def __missing__(self, word: bytes) -> int:
        p = self[word] = len(self)
        return p

    def listed(self) -> np.ndarray:
        """The words' hashes, by place."""
        some = iter(self)
        next(some), next(some)
        return np.concatenate([[START, END], np.fromiter(map(xxhash.xxh3_64_intdigest, some), np.uint64, len(self) - 2)])


def token_places(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' tokens behind one another as places in a list of words, order - 1 start marks before each; the places
    of the tokens; the list, sorted by hash."""
    known = WordPlaces()
    parts, sizes = [], []
    marks, end = np.zeros(order - 1, np.int32), np.ones(1, np.int32)
    for t in texts:
        words = t.lower().split()
        parts += [marks, np.fromiter(map(known.__getitem__, words), np.int32, len(words)), end]
        sizes.append(len(words) + 1)
    sizes = np.array(sizes, np.int64)
    at = np.arange(int(sizes.sum())) + np.repeat((order - 1) * np.arange(1, len(sizes) + 1), sizes)
    own = known.listed()
    by_hash = np.argsort(own)
    place = np.empty(len(own), np.int32)
    place[by_hash] = np.arange(len(own), dtype=np.int32)
    return place[np.concatenate(parts)], at, own[by_hash]


def distinct_rows(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows, and how often each occurs."""
    bits = max(int(c.max(initial=0)).bit_length() for c in columns)
    if bits * len(columns) <= 64:
        key = np.sort(one_number(columns, bits))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        own, mask = key[first], np.uint64((1 << bits) - 1)
        rows = [((own >> np.uint64(bits * j)) & mask).astype(np.int32) for j in reversed(range(len(columns)))]
    else:
        order = in_order(columns)
        columns = [c[order] for c in columns]
        first = np.flatnonzero(np.logical_or.reduce([np.diff(c, prepend=-1) != 0 for c in columns]))
        rows = [c[first] for c in columns]
    return rows, np.diff(first, append=len(columns[0])).astype(np.uint64)


def counted(docs: DataFrame, order: int, shards: int, sample: Words) -> DataFrame:
    """Packed blocks of the highest order's n-grams: columns are the words and the occurrences."""

    def blocks(texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        flat, at, own = token_places(texts, order)
        words, n = distinct_rows([flat[at - order + 1 + j] for j in range(order)])
        ranks, known, out = sample.ranks(own), len(sample.common), []
        for shard, rows in parted(dealt_to([own[w] for w in words], sample.frequent, shards)):
            payload = pack_places(own, ranks, known, [w[rows] for w in words], [n[rows]])
            out.append({"shard": shard, "kind": order, "payload": payload, "stats": None})
        yield pa.RecordBatch.from_pylist(out, BLOCK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for b in batches:
            for t in as_bytes(b, "text"):
                held.append(t)
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield from blocks(held)
                    held, size = [], 0
        if held:
            yield from blocks(held)

    return map_batches(docs, run, BLOCKS)


def sampled(docs: DataFrame, shards: int) -> Words:
    """Frequent words are over half a shard's share of a sample's tokens: 2 a shard at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat, _, own = token_places(as_bytes(b, "text"), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.view(np.int64)), pa.array(np.bincount(flat, minlength=len(own)))], names=["word", "n"])

    share = min(1.0, SAMPLE / max(1, docs.count()))
    counts = map_batches(docs.sample(share, seed=1), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    held = freeze(counts, "kneser-ney-sample")
    least = (held.agg(F.sum("n")).first()[0] or 0) / (2 * shards)
    hashes = lambda df: np.array([r["word"] for r in df.collect()], np.int64).view(np.uint64)
    return Words(np.sort(hashes(held.where(F.col("n") > least))), hashes(held.orderBy(F.desc("n"), "word").limit(COMMON)))


def level(rows: DataFrame, k: int, order: int, folder: str, shards: int, sample: Words) -> DataFrame:
    """Add up order k's n-grams shard by shard, write them and their contexts, and deal out what follows.

    Blocks for lower orders are passed on, and so are lines of statistics, of which every written file has one.
    """

    def settle(j: int, words: list[np.ndarray], n: np.ndarray, raw: np.ndarray, shard: int) -> Iterator[dict]:
        """Write whole n-grams of j words, with what follows from them."""
        write_arrays(f"{folder}/grams-{j}-{k}-{shard:06d}", join_words(words), [n, raw] if j == 1 else [n])
        stats = [j, len(n), int(n.sum()), int(raw.sum()), *[int((n == c).sum()) for c in (1, 2, 3, 4)]]
        yield {"shard": 0, "kind": None, "payload": None, "stats": np.array(stats, np.int64).tobytes()}
        if j == 1:
            return
        ones = [(n == 1).astype(np.uint64), (n == 2).astype(np.uint64), (n >= 3).astype(np.uint64)]
        keys, sums, head = add_up(join_words(words[:-1]), [n, *ones], words[:-1])
        if j > 2:
            write_arrays(f"{folder}/contexts-{j}-{shard:06d}", keys, sums)
        else:
            yield from deal(CONTEXTS, head, sums, sample, shards)
        _, sums, tail = add_up(join_words(words[1:]), [np.ones(len(n), np.uint64), raw], words[1:])
        here = ~frequent(tail[0], sample.frequent) if j == 3 else np.zeros(len(tail[0]), bool)
        if here.any():
            yield from settle(j - 1, [w[here] for w in tail], *[c[here] for c in sums], shard)
        yield from deal(j - 1, [w[~here] for w in tail], [c[~here] for c in sums], sample, shards)

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        here = pc.fill_null(pc.is_in(table.column("kind"), pa.array([k, CONTEXTS] if k == 1 else [k], pa.int32())), False)
        out = table.filter(pc.invert(here)).to_pylist()
        for kind in (k, CONTEXTS):
            blocks = table.filter(pc.and_(here, pc.fill_null(pc.equal(table.column("kind"), kind), False))).column("payload").to_pylist()
            if not blocks:
                continue
            size = max(1, kind)
            columns = [np.concatenate(c) for c in zip(*[unpack_grams(x, size, sample) for x in blocks])]
            keys, sums, words = add_up(join_words(columns[:size]), columns[size:], columns[:size])
            if kind == CONTEXTS:
                write_arrays(f"{folder}/contexts-2-{shard:06d}", keys, sums)
            else:
                out += settle(k, words, sums[0], sums[-1], shard)
        return pa.Table.from_pylist(out, BLOCK_SCHEMA)

    return rows.groupBy("shard").applyInArrow(run, BLOCKS)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


KEY_BITS, TOP_BITS = 56, 16  # bits of a key's hash in a file, and those of them by which the file is indexed


def write_arrays(uri: str, keys: np.ndarray, columns: list[np.ndarray]) -> None:
    """One file: sizes; the commonest rows of values; place and values of rows that are not among them; then, for the keys
    sorted by 56 bits of their hash, where those of each upper 16 bits begin, the next 32 bits, the lowest 8, and a byte
    that tells the row of values (255: not a common one). Few keys share a file, so 56 bits tell them apart.

    The file gets its name when it is whole, so a repeated task replaces it by the same one.
    """
    store, path = filesystem(uri)
    draft = f"{path}.{uuid.uuid4().hex[:8]}"
    keys = keys.astype(np.uint64) & np.uint64((1 << KEY_BITS) - 1)
    order = np.argsort(keys)
    keys, columns = keys[order], [c.astype(np.uint64)[order] for c in columns]
    bits = 64 // len(columns)
    small = np.flatnonzero(np.logical_and.reduce([c >> np.uint64(bits - 1) == 0 for c in columns]))
    row = np.zeros(len(small), np.uint64)
    for j, c in enumerate(columns):
        row |= c[small] << np.uint64(j * bits)
    rows, back, n = np.unique(row, return_inverse=True, return_counts=True)
    common = np.argsort(-n, kind="stable")[:255]
    number = np.full(len(rows), 255, np.uint8)
    number[common] = np.arange(len(common))
    code = np.full(len(keys), 255, np.uint8)
    code[small] = number[back]
    rest = np.flatnonzero(code == 255)
    palette = np.stack([(rows[common] >> np.uint64(j * bits)) & np.uint64((1 << bits - 1) - 1) for j in range(len(columns))])
    begins = np.searchsorted(keys, np.arange((1 << TOP_BITS) + 1, dtype=np.uint64) << np.uint64(KEY_BITS - TOP_BITS))
    with store.open_output_stream(draft) as out:
        out.write(np.array([len(keys), len(columns), len(common), len(rest)], np.uint64).tobytes())
        for numbers in (palette, rest, *[c[rest] for c in columns]):
            out.write(numbers.astype(np.uint64).tobytes())
        out.write(begins.astype(np.uint64).tobytes() if len(keys) >> 32 else begins.astype(np.uint32).tobytes())
        out.write((keys >> np.uint64(8)).astype(np.uint32).tobytes())
        out.write(keys.astype(np.uint8).tobytes())
        out.write(code.tobytes())
    store.move(draft, path)


class Arrays:
    """A written file, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, mode="r")
        at = 0

        def column(kind: type, n: int) -> np.ndarray:
            nonlocal at
            at += n * np.dtype(kind).itemsize
            return raw[at - n * np.dtype(kind).itemsize:at].view(kind)

        self.n, m, common, rest = (int(x) for x in column(np.uint64, 4))
        self.palette = np.zeros((m, 256))
        self.palette[:, :common] = column(np.uint64, m * common).reshape(m, common)
        self.rest = column(np.uint64, rest)
        self.rest_values = column(np.uint64, m * rest).reshape(m, rest)
        self.begins = column(np.uint64 if self.n >> 32 else np.uint32, (1 << TOP_BITS) + 1)
        self.middle, self.low, self.code = column(np.uint32, self.n), column(np.uint8, self.n), column(np.uint8, self.n)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are there, and their places."""
        top = ((keys >> np.uint64(KEY_BITS - TOP_BITS)) & np.uint64((1 << TOP_BITS) - 1)).astype(np.int64)
        middle, low = (keys >> np.uint64(8)).astype(np.uint32), keys.astype(np.uint8)
        at, end = self.begins[top].astype(np.int64), self.begins[top + 1].astype(np.int64)
        size, last = end - at, self.n - 1
        while (most := int(size.max(initial=0))) > 0:  # halve all stretches: the first place that is not below the key
            half = size >> 1
            mid = at + half
            below = (size > 0) & (self.middle[np.minimum(mid, last)] < middle)
            at = np.where(below, mid + 1, at)
            size = np.where(below, size - half - 1, half)
            if most == 1:
                break
        open_ = np.flatnonzero((at < end) & (self.middle[np.minimum(at, last)] == middle)) if self.n else np.empty(0, np.int64)
        found = []
        while len(open_):  # few keys agree in all but the lowest bits
            found.append(open_[self.low[at[open_]] == low[open_]])
            open_ = open_[self.low[at[open_]] < low[open_]]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
            open_ = open_[self.middle[at[open_]] == middle[open_]]
        there = np.concatenate(found) if found else np.empty(0, np.int64)
        return there, at[there]

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """(column, key) -> value as double; 0 for keys that are not there."""
        out = np.zeros((len(self.palette), len(keys)))
        there, at = self.find(keys)
        code = self.code[at]
        values = self.palette[:, code]
        more = np.flatnonzero(code == 255)
        values[:, more] = self.rest_values[:, np.searchsorted(self.rest, at[more].astype(np.uint64))]
        out[:, there] = values
        return out


class Model:
    """What the driver knows of a model: where its files are, and the discounts. Sent to the workers."""

    def __init__(self, order: int, folder: str, shards: int, stats: np.ndarray, heavy: np.ndarray):
        self.order, self.folder, self.shards, self.heavy = order, folder, shards, heavy
        sums = {k: stats[stats[:, 0] == k][:, 1:].sum(axis=0) for k in range(1, order + 1)}
        self.known, self.total, self.tokens = (int(x) for x in sums[1][:3])
        self.discounts = {k: discounts(s[3:].astype(np.float64)) for k, s in sums.items()}
        one = sums[1][3:].astype(np.float64)
        self.empty_context = [float(self.total), one[0], one[1], self.known - one[0] - one[1]]

    def table(self, name: str, columns: int) -> "Table":
        return Table(self, name, columns)


def discounts(n: np.ndarray) -> list[float]:
    """D1, D2, D3+ from the number of n-grams that occur once to four times; kept within 0 and the count."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [c - (c + 1) * y * after / own if own else 0.5 * c for c, own, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.05), c - 0.05) for c, d in zip((1, 2, 3), raw)]


class Table:
    """All shards of one kind of file; shards are mapped when they are first asked for."""

    def __init__(self, model: Model, name: str, columns: int):
        self.model, self.name, self.columns = model, name, columns
        self.open: dict[int, Arrays | None] = {}

    def shard(self, s: int) -> Arrays | None:
        if s not in self.open:
            store, base = filesystem(self.model.folder)
            path = f"{base}/{self.name}-{s:06d}"
            if store.get_file_info(path).type != fs.FileType.File:
                self.open[s] = None
            elif isinstance(store, fs.LocalFileSystem):
                self.open[s] = Arrays(path)
            else:
                local = os.path.join(tempfile.mkdtemp(prefix="kneser-ney-"), os.path.basename(path))
                fs.copy_files(path, local, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
                self.open[s] = Arrays(local)
        return self.open[s]

    def look_up(self, keys: np.ndarray, parts: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """(column, key) -> value; parts: the keys of each shard that are to be looked up."""
        out = np.zeros((self.columns, len(keys)))
        for shard, rows in parts:
            arrays = self.shard(shard)
            if arrays is not None:
                out[:, rows] = arrays.look_up(keys[rows])
        return out


def train(docs: DataFrame, order: int = 3, text: str = "text", shards: int | None = None) -> Model:
    """Count the n-grams of every text and write the model to the shared folder."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_folder(spark, "kneser-ney")
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    texts = docs.select(F.col(text).alias("text"))
    sample = sampled(texts, shards)
    rows = counted(texts, order, shards, sample)
    for k in range(order, 0, -1):
        rows = level(rows, k, order, folder, shards, sample)
    # the last order's contexts are the empty one, known from the statistics
    lines = freeze(rows.where("stats is not null").select("stats"), "kneser-ney-stats").collect()  # a row per file
    stats = np.array([np.frombuffer(r["stats"], np.int64) for r in lines], np.int64).reshape(-1, 8)
    return Model(order, folder, shards, stats, sample.frequent)


class Scorer:
    """Scores batches of texts in a worker."""

    def __init__(self, model: Model):
        self.model = model
        orders = range(1, model.order + 1)
        self.grams = {k: model.table(f"grams-{k}-{k}", 1 + (k == 1)) for k in orders}
        self.stayed = model.table("grams-2-3", 1)  # two-word n-grams that stayed in their trigrams' shard
        self.contexts = {k: model.table(f"contexts-{k}", 4) for k in orders if k > 1}

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, base score, score."""
        m = self.model
        flat, places, own = token_places(texts, m.order)
        flat = own[flat]
        tokens = np.array([len(t.split()) + 1 for t in texts], np.int64)
        p = np.full(len(places), 1.0 / (m.known + 1))
        raw = np.zeros(len(places))
        for k in range(1, m.order + 1):
            words = [flat[places - k + 1 + j] for j in range(k)]
            keys = join_words(words)
            parts = list(parted(dealt_to(words, m.heavy, m.shards)))
            if k == 2 and m.order > 2:
                often = frequent(words[0], m.heavy)
                n = np.where(often, self.grams[2].look_up(keys, [(s, r[often[r]]) for s, r in parts]),
                             self.stayed.look_up(keys, [(s, r[~often[r]]) for s, r in parts]))[0]
            else:
                got = self.grams[k].look_up(keys, parts)
                n = got[0]
            if k == 1:
                raw = got[1]
                total, one, two, more = (np.full(len(places), x) for x in m.empty_context)
            else:
                at = list(parted(dealt_to(words[:1], m.heavy, m.shards))) if k == 2 else parts
                total, one, two, more = self.contexts[k].look_up(join_words(words[:-1]), at)
            d1, d2, d3 = m.discounts[k]
            taken = np.where(n >= 3, d3, np.where(n == 2, d2, np.where(n == 1, d1, 0.0)))
            seen = total > 0
            safe = np.where(seen, total, 1.0)
            p = np.where(seen, (n - taken) / safe + (d1 * one + d2 * two + d3 * more) / safe * p, p)
        base = np.log10((raw + 0.5) / (m.tokens + 0.5 * (m.known + 1)))
        begin = np.cumsum(tokens) - tokens
        add = lambda x: np.add.reduceat(x, begin)  # noqa: E731  every text has a token
        return tokens, add((raw > 0).astype(np.int64)), add(base), add(np.log10(p))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns of every row, n_tokens, n_known, base_score and score."""
    narrow = docs.select(*keep, F.col(text).alias("__text"))
    kept = [f for f in narrow.schema.fields if f.name != "__text"]
    names = ["n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            texts, at = as_bytes(b, "__text"), 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= BATCH_BYTES):
                    held += len(texts[end])
                    end += 1
                got = scorer(texts[at:end])
                some = b.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [some.column(f.name) for f in kept] + [pa.array(x) for x in got], names=[*(f.name for f in kept), *names])
                at = end

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
                       + ["n_tokens long, n_known long, base_score double, score double"])
    return map_batches(narrow, run, schema)


def held_out_scores(docs: DataFrame, order: int = 3, text: str = "text", doc_id: str = "doc_id",
                    held_out: int = 1) -> DataFrame:
    """Train on the rows outside the held-out fold and score every row."""
    model = train(docs.where(fold(F.col(doc_id)) != held_out), order, text)
    return score(docs, model, [doc_id], text).select(
        doc_id, (fold(F.col(doc_id)) == held_out).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
