"""SimHash near duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into segments of `width` bits and becomes the vector of its segments' bit counts. A vector's
Manhattan distance to another is a lower bound of the fingerprints' Hamming distance, and Manhattan space has a grid.
Vectors are written as thermometer codes: within a segment the one-bits sink to its low end, so that a code is 64 bits
again, a step of one unit on the grid flips one bit, and Manhattan distance is the bit count of two codes' difference.

The range join: two vectors at distance two or less have a grid point at one or less from both. So each fingerprint goes
to its own grid point and to those a unit away (up to 65, about 49 at two bits a segment), and pairs meet there. What meets
is then compared exactly. A grid point where many fingerprints meet is not compared pair by pair: its fingerprints are
embedded again with one bit a segment, where the lower bound is the distance itself, a grid point can hold no more than 65
fingerprints, and all that meet there are within two bits, so a star of links says all. Every stage is linear in the number of
different fingerprints; equal fingerprints are one row from the start, so copies cost nothing.

Defined cases: a null or empty text and one without words have no shingle and fingerprint zero, which links like any other.
Fewer words than a shingle takes: the whole sequence is the only shingle. A bit that is set in exactly half of the hashes
is 0. Texts of any length are hashed whole, a block of shingles at a time. Repeated rows give repeated rows. Rows with a
null id take part in links; a class without any id has a null component id. An empty table gives an empty table. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquifer.llm.common import SPACES, as_bytes, freeze, map_batches, slices
from aquifer.llm.graph import components

SEED = 42
_LOW = 0x5555555555555555  # the low bit of each pair
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z to a-z, other bytes as they are
PER_TASK = 10_000  # fingerprints a task sends to their grid points, about 49 rows each
_BLOCK = 1 << 16  # shingles whose bits are counted at once


def shingle_hashes(text: bytes, words: int = 3, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `words` lower-cased words, joined by one space, repeats included."""
    found = text.translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[:len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1:].tolist())), np.uint64,
                       len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is one where over half of the hashes have it set."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at:at + _BLOCK].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as the 64 bits of a long. One pass over the rows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                fps = np.array([fingerprint(shingle_hashes(t, words)) for t in as_bytes(batch, "text")], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(rows, run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp long")


def embed(fp: Column, width: int) -> Column:
    """The segments' bit counts as a thermometer code; width 1 or 2 bits a segment."""
    if width == 1:
        return fp
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(F.lit(_LOW)).bitwiseOR(
        F.shiftleft(fp.bitwiseAND(high).bitwiseAND(F.lit(_LOW)), 1))


def grid_points(code: Column, width: int) -> Column:
    """The code's own grid point and all that are a unit away."""
    near = F.transform(F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)]), lambda bit: code.bitwiseXOR(bit))
    if width == 2:  # a pair's high bit needs its low bit
        near = F.filter(near, lambda p: F.shiftrightunsigned(p, 1).bitwiseAND(F.bitwise_not(p)).bitwiseAND(F.lit(_LOW)) == 0)
    return F.concat(F.array(code), near)


def links(distinct: DataFrame, bits: int = 2, crowd: int = 32) -> DataFrame:
    """(a, b), a < b: links between different fingerprints `fp` that connect all fingerprints at `bits` or fewer differing
    bits, and only those. At grid points of up to `crowd` fingerprints these are all links, elsewhere a star for each
    grid point of the one-bit embedding."""
    if bits != 2:
        raise ValueError("the grid's steps are made for two bits")
    met = distinct.select("fp", F.explode(grid_points(embed(F.col("fp"), 2), 2)).alias("point"))
    points = freeze(met.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                    .where(F.col("n") > 1), "points")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    twos = points.where(F.col("n") == 2).where(near).select("a", "b")
    few = points.where((F.col("n") > 2) & (F.col("n") <= crowd)).select("point")
    some = met.join(few, "point").groupBy("point").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # up to `crowd`
    some = some.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).where(
        F.col("a") < F.col("b")).where(near)
    crowds = points.where(F.col("n") > crowd).select("point")
    crowded = met.join(crowds, "point", "left_semi").select("fp").distinct()
    stars = crowded.select("fp", F.explode(grid_points(F.col("fp"), 1)).alias("point")).groupBy("point").agg(
        F.sort_array(F.collect_list("fp")).alias("fps"))  # up to 65: the point itself and those a bit away
    stars = stars.where(F.size("fps") > 1).select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 65)).alias("b"))
    return twos.unionByName(some).unionByName(stars).distinct()


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, crowd: int = 32) -> DataFrame:
    """Every row's (doc_id, fingerprint as 16 hex digits, component_id: the smallest id that links reach, its own included)."""
    rows = freeze(fingerprints(docs, doc_id, text, words), "fingerprints")
    distinct = freeze(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    tasks = 1 + distinct.count() // PER_TASK
    member = components(links(distinct.repartition(tasks, "fp"), crowd=crowd)).select(F.col("v").alias("fp"), "c")
    classes = distinct.join(member, "fp", "left").select("fp", "least", F.coalesce("c", "fp").alias("c"))
    least = classes.groupBy("c").agg(F.min("least").alias("component_id"))
    named = freeze(classes.join(least, "c").select("fp", "component_id"), "classes")
    return rows.join(named, "fp").select(
        F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
