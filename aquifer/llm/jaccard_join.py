"""Exact near-duplicate join on word shingles, filtered by prefixes under several global token orders.

A text's set is its distinct five-word shingles. If two sets reach the Jaccard threshold t, they share a shingle
among the first |x| - ceil(t |x|) + 1 of each, under any order of all shingles. The first order puts rare
shingles first (by a count sketch of the whole corpus, then by hash); only its prefixes are dealt out by
shingle and meet there. The other orders are random: a pair that met must also share a prefix shingle under
each of them, and have sizes that allow t, before the sets are compared.

Texts with equal sets form one class and are handled once. Within a shingle's list not all pairs are made:
1. each class is compared with one list-mate: of the classes that are in most lists (an original is in more
   than its altered copies), the one it shares most lists with; what is linked is joined into components;
2. the same once more for the classes outside the largest component of a list, with a centre inside it;
3. only lists that still hold several components are taken up again: all pairs of different components, each
   formed by a member outside the list's largest component. Pairs inside a component need no comparison,
   since only the components are asked for.
No link between different components can be missed: a pair that reaches t shares a list, at places early
enough in both prefixes (the positional filter).

Lists are never gathered: they arrive sorted and are read as a stream. Sets are 64-bit shingle hashes, and
classes 64-bit set fingerprints. Pairs get their classes' texts, compressed, and make the sets from them.

Edge cases: null and empty texts have size 0 and are linked with nothing; texts under five words have one
shingle, the whole; repeated rows and equal texts are linked; a row with a null key is only linked
by a set equal to another row's, and has no component otherwise; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquifer.llm.common import WordHashes, as_bytes, freeze, map_batches, mix64, ngram_hashes, sent, slices
from aquifer.llm.graph import components

SHINGLE = 5
CELLS = 1 << 22  # of the count sketch
SLICES = 64


def shingle_sets(texts: list[bytes], hashes: WordHashes) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; A-Z are lower-cased."""
    for lo in range(0, len(texts), 256):
        words = [hashes.of(t.lower().split()) for t in texts[lo:lo + 256]]
        grams = ngram_hashes(np.concatenate(words), SHINGLE)
        at = 0
        for w in words:
            if len(w) >= SHINGLE:
                s = np.sort(grams[at:at + len(w) - SHINGLE + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            else:
                yield ngram_hashes(w, len(w)) if len(w) else w
            at += len(w)


def fingerprint(shingles: np.ndarray) -> int:
    """64 bits of a set; 0 only for the empty set. Shingle hashes are well mixed, so their sum and xor are too."""
    if not len(shingles):
        return 0
    total = shingles.sum(dtype=np.uint64, keepdims=True) + mix64(np.bitwise_xor.reduce(shingles, keepdims=True))
    return int(mix64(total + np.uint64(len(shingles))).view(np.int64)[0]) or 1


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def order_by(shingles: np.ndarray, order: int) -> np.ndarray:
    """Ranks of shingles in the random global order of that number."""
    return mix64(shingles ^ np.uint64(0xD6E8FEB86659FD93 * (2 * order + 1) % 2**64))


def first_of(shingles: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """The n shingles of lowest rank, in order of rank."""
    some = np.argpartition(rank, n - 1)[:n] if n < len(shingles) else np.arange(len(shingles))
    return shingles[some[np.argsort(rank[some])]]


def profile(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """(key, n, cls) of every row, frozen; and how many rows hold shingles of each sketch cell."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total, key_type = WordHashes(), np.zeros(CELLS, np.uint32), None
        for b in (s for batch in batches for s in slices(batch, "text", 2_000_000)):
            key_type = b.column("key").type
            n, cls, held, waiting = [], [], [], 0
            for s in shingle_sets(as_bytes(b, "text"), hashes):
                n.append(len(s))
                cls.append(fingerprint(s))
                held.append(s)
                waiting += len(s)
                if waiting >= 2_000_000:
                    total += cell_counts(held)
                    held, waiting = [], 0
            total += cell_counts(held)
            empty = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()),
                 pa.nulls(b.num_rows, pa.int32()), empty], names=["key", "n", "cls", "slice", "counts"])
        if key_type is not None:
            parts = [zlib.compress(p.tobytes(), 1) for p in total.reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SLICES, key_type), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()),
                 pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())],
                names=["key", "n", "cls", "slice", "counts"])

    both = freeze(map_batches(rows, run, f"key {kind}, n long, cls long, slice int, counts binary"), "jaccard-sets")

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in part.column("counts").to_pylist())
        return pa.table({"slice": [part.column("slice")[0].as_py()],
                         "counts": [np.minimum(total, 65535).astype(np.uint16).tobytes()]},
                        schema=pa.schema([("slice", pa.int32()), ("counts", pa.binary())]))

    merged = both.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(
        add, "slice int, counts binary").collect()  # CELLS numbers in all
    sketch = np.zeros((SLICES, CELLS // SLICES), np.uint16)
    for r in merged:
        sketch[r["slice"]] = np.frombuffer(r["counts"], np.uint16)
    return both.where("slice is null").select("key", "n", "cls"), sketch.ravel()


def cell_counts(sets: list[np.ndarray]) -> np.ndarray:
    cells = np.concatenate([np.empty(0, np.uint64), *sets]) % np.uint64(CELLS)
    return np.bincount(cells.astype(np.int64), minlength=CELLS).astype(np.uint32)


def postings(docs: DataFrame, text: str, sketch: np.ndarray, percent: int) -> DataFrame:
    """(token, cls, n, pos): each class under the shingles of its prefix in the rare-first order."""
    counts = docs.sparkSession.sparkContext.broadcast(sketch)  # CELLS numbers of 16 bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, often = WordHashes(), set(), counts.value.astype(np.uint64) << np.uint64(48)
        for b in (s for batch in batches for s in slices(batch, "text", 2_000_000)):
            token, cls, size = [], [], []
            for s in shingle_sets(as_bytes(b, "text"), hashes):
                f = fingerprint(s)
                if not len(s) or f in seen:
                    continue
                seen.add(f)
                rank = often[(s % np.uint64(CELLS)).astype(np.int64)] | s >> np.uint64(16)
                token.append(first_of(s, rank, prefix_size(len(s), percent)))
                cls.append(f)
                size.append(len(s))
            if token:
                again = [len(x) for x in token]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(token).view(np.int64)), pa.array(np.repeat(cls, again)),
                     pa.array(np.repeat(size, again).astype(np.int32)),
                     pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in again]))],
                    names=["token", "cls", "n", "pos"])

    return map_batches(docs.select(F.col(text).alias("text")), run, "token long, cls long, n int, pos int")


def shared_lists(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of the lists (by token) with a list-mate of fitting size, each class once; frozen.

    The rows of a list arrive by size, so a row has such a mate if one of its neighbours is one.
    """
    columns = ["token", "cls", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, False  # the row before this batch, and whether it has been written
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(c).to_numpy() for c in columns]
            if last is not None:
                now = [np.append(x, y) for x, y in zip(last, now)]
            token, cls = now[:2]
            fresh = np.append(True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]))
            now = [x[fresh] for x in now]
            shared = has_mate(now[0], now[2], percent)
            end_kept = bool(shared[-1]) or (len(shared) == 1 and kept)
            if kept:
                shared[0] = False
            shared &= early_enough(*now[:1], *now[2:], percent)
            yield pa.RecordBatch.from_arrays([pa.array(x[shared]) for x in now], names=columns)
            last, kept = [x[-1:] for x in now], end_kept

    ordered = rows.repartition("token").sortWithinPartitions("token", "n", "cls")
    return freeze(map_batches(ordered, run, "token long, cls long, n int, pos int"), "jaccard-lists")


def has_mate(token: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Rows, sorted by token and size, beside which a row of the same token has a fitting size."""
    size = n.astype(np.int64)
    alike = (token[1:] == token[:-1]) & (100 * size[:-1] >= percent * size[1:])
    return np.append(False, alike) | np.append(alike, False)


def early_enough(token: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Rows that may hold the first common shingle with their smallest fitting mate, which allows the latest
    place. Lists at the ends of the batch may go on, and pass."""
    size = n.astype(np.int64)
    run = np.cumsum(np.append(True, token[1:] != token[:-1])) - 1
    wide = int(size.max()) + 1
    mate = np.searchsorted(run * wide + size, run * wide - (-percent * size // 100), side="left")
    mate = np.minimum(mate + (mate == np.arange(len(run))), len(run) - 1)
    fits = (run[mate] == run) & (100 * np.minimum(size, size[mate]) >= percent * np.maximum(size, size[mate]))
    last_place = size - -(-percent * (size + size[mate]) // (100 + percent))
    return (fits & (pos <= last_place)) | (run == 0) | (run == run[-1])


def may_link(percent: int, a: str, b: str) -> Column:
    """Sizes and places that allow a pair, whose first common shingle this is, to reach the threshold: overlap
    must be at least percent / (100 + percent) of the sizes' sum, and neither side has that many left before it."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    overlap = F.ceil(percent * (na + nb) / (100 + percent) - 1e-9)
    return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb))
            & (F.col(f"{a}.pos") <= na - overlap) & (F.col(f"{b}.pos") <= nb - overlap))


def best_partners(members: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member with the centre that it shares most lists with."""
    votes = (members.alias("x").join(centres.alias("y"), "token")
             .where((F.col("x.cls") != F.col("y.cls")) & may_link(percent, "x", "y"))
             .groupBy(F.col("x.cls").alias("cls"), F.col("y.cls").alias("mate")).count())
    best = votes.groupBy("cls").agg(F.max_by("mate", F.struct("count", "mate")).alias("mate"))
    return freeze(best.select(F.least("cls", "mate").alias("a"), F.greatest("cls", "mate").alias("b")).distinct(),
                  "jaccard-pairs")


def sets_of(docs: DataFrame, key: str, text: str, pairs: DataFrame, classes: DataFrame, percent: int,
            orders: int) -> DataFrame:
    """(cls, packed, prefixes) of the classes in `pairs`: a text of each, compressed, and the other orders' prefixes.

    A text packs to a quarter of its shingles' hashes, so texts are stored and dealt to the pairs, not sets.
    """
    members = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    keys = freeze(classes.join(members, "cls").where(F.col("named").isNotNull())
                  .select(F.col("named").alias("key")).distinct(), "jaccard-keys")
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(sent(keys), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in (s for batch in batches for s in slices(batch, "text", 2_000_000)):
            texts = as_bytes(b, "text")
            sets = list(shingle_sets(texts, hashes))
            firsts = [b"".join(np.sort(first_of(s, order_by(s, k), prefix_size(len(s), percent))
                                       >> np.uint64(32)).astype("<u4").tobytes() for k in range(orders)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([fingerprint(s) for s in sets], pa.int64()),
                 pa.array([zlib.compress(t.lower(), 1) for t in texts], pa.binary()), pa.array(firsts, pa.binary())],
                names=["cls", "packed", "prefixes"])

    made = map_batches(chosen.select("text"), run, "cls long, packed binary, prefixes binary")
    made = freeze(made, "jaccard-chosen")
    if made.count() == made.select("cls").distinct().count():
        return made
    # a key that several rows have
    return freeze(made.groupBy("cls").agg(F.first("packed").alias("packed"), F.first("prefixes").alias("prefixes")),
                  "jaccard-chosen")


def linked(pairs: DataFrame, sets: DataFrame, percent: int, orders: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold. Prefixes under the other orders are looked at first."""

    def sides(column: str) -> DataFrame:
        """pairs with `column` of both classes."""
        left = sets.select(F.col("cls").alias("a"), F.col(column).alias("x"))
        right = sets.select(F.col("cls").alias("b"), F.col(column).alias("y"))
        return left, right

    def keep(test):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in (batch.slice(lo, 256) for batch in batches for lo in range(0, batch.num_rows, 256)):
                good = test(b.column("x").to_pylist(), b.column("y").to_pylist(), hashes)
                yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        return run

    def share(xs: list[bytes], ys: list[bytes], _: WordHashes) -> list[bool]:
        good = []
        for x, y in zip(xs, ys):
            x_, y_ = (np.frombuffer(s, "<u4").reshape(orders, -1) for s in (x, y))
            good.append(all(np.isin(x_[k], y_[k]).any() for k in range(orders)))
        return good

    def reach(xs: list[bytes], ys: list[bytes], hashes: WordHashes) -> list[bool]:
        different = list(dict.fromkeys(xs + ys))
        sets = dict(zip(different, shingle_sets([zlib.decompress(p) for p in different], hashes)))
        good = []
        for x_, y_ in ((sets[x], sets[y]) for x, y in zip(xs, ys)):
            both = len(np.intersect1d(x_, y_, assume_unique=True))
            good.append(100 * both >= percent * (len(x_) + len(y_) - both))
        return good

    for column, test in (("prefixes", share), ("packed", reach)):
        left, right = sides(column)
        pairs = map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), keep(test), "a long, b long")
    return freeze(pairs, "jaccard-links")


def still_split(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of the lists that hold several components, with each row's component `c` and the list's `most`."""
    found = components(links).select(F.col("v").alias("cls"), "c")
    labelled = lists.join(sent(found), "cls", "left").withColumn("c", F.coalesce("c", "cls")).repartition("token")
    sizes = labelled.groupBy("token", "c").count()
    split = sizes.groupBy("token").agg(
        F.count(F.lit(1)).alias("several"), F.max_by("c", F.struct("count", "c")).alias("most")).where("several > 1")
    return freeze(labelled.join(split.select("token", "most"), "token"), "jaccard-mixed")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, orders: int = 2) -> DataFrame:
    """(key, n_shingles, component_id) of every row; the component is named by its smallest key."""
    rows, sketch = profile(docs, key, text)
    classes = freeze(rows.where("n > 0").groupBy("cls").agg(F.min("key").alias("named")), "jaccard-classes")
    lists = shared_lists(postings(docs, text, sketch, percent), percent)
    degree = freeze(lists.groupBy("cls").agg(F.count(F.lit(1)).alias("lists")), "jaccard-degrees")
    lists = lists.join(sent(degree), "cls")
    member = F.struct("cls", "n", "pos")
    check = lambda pairs: linked(pairs, sets_of(docs, key, text, pairs, classes, percent, orders), percent, orders)

    by_token = lists.repartition("token")
    centres = by_token.groupBy("token").agg(F.max_by(member, F.struct("lists", "cls")).alias("m")).select("token", "m.*")
    tried = best_partners(by_token, centres, percent)
    links = check(tried)
    mixed = still_split(lists, links)
    inner = mixed.where("c = most").groupBy("token").agg(
        F.max_by(member, F.struct("lists", "cls")).alias("m")).select("token", "m.*")
    again = best_partners(mixed.where("c <> most"), inner, percent)
    links = links.unionByName(check(again))
    tried = tried.unionByName(again)
    mixed = still_split(lists, links)
    x, y = mixed.where("c <> most").alias("x"), mixed.alias("y")
    rest = (x.join(y, "token")
            .where((F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.most")) | (F.col("x.cls") < F.col("y.cls")))
                   & may_link(percent, "x", "y"))
            .select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
            .join(tried, ["a", "b"], "left_anti"))
    found = components(links.unionByName(check(freeze(rest, "jaccard-pairs"))))
    named = classes.join(found.select(F.col("v").alias("cls"), "c"), "cls", "left").withColumn("c", F.coalesce("c", "cls"))
    names = named.groupBy("c").agg(F.min("named").alias("component_id"))
    of_class = freeze(named.join(names, "c").select("cls", "component_id"), "jaccard-names")
    return rows.join(of_class, "cls", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))
