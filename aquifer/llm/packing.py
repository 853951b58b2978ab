"""Mixture-controlled packing of whole documents into sequences of a fixed length.

Every source is a queue of tokens. The queues are served by deficit round-robin: in each round of `length`
tokens a queue's deficit grows by its share of the round, it hands out the whole tokens that the deficit
covers, and the fraction is carried to the next round; an empty queue's share goes to the others. The rounds
behind one another are cut into sequences of exactly `length` tokens, so every sequence holds the target
proportions to within a token a source. By default the targets are the sources' shares of all tokens; then
all queues run dry together and the mixture holds up to the last window.

What a queue has handed out after r rounds is a closed form of r (floor of weight times the common level),
so no task has to replay another's rounds: a document's place in its queue says which rounds it
is dealt to, and the sums over all queues say where in the sequences. The place is the count of tokens before it
in its partition, plus those of the partitions before it; deficits thus carry over windows and partitions.
The last, partial sequence is split into lengths that are powers of two, so nothing is padded.

Edge cases: a null or empty text is the end id alone; null is a source of its own; repeated rows are packed
each; an empty table gives no pieces; other columns play no part. More sources than `most_queues`
share queues by hash; all their documents are packed, and the mixture holds for the queues.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aquifer.llm.common import as_bytes, freeze, map_batches, slices
from aquifer.llm.tokens import encoder, narrow, widen

PIECES = ("doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


class Schedule:
    """Deficit round-robin over queues with known totals, as closed forms of the round."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, length: int):
        self.totals = totals.astype(np.int64)
        self.weights = weights.astype(np.float64)
        self.length = length
        self.total = int(self.totals.sum())
        self.rounds = -(-self.total // length)
        levels = np.unique(np.concatenate([[0.0], self.totals / self.weights]))
        served = [np.minimum(self.totals, self.weights * level).sum() for level in levels]
        self.levels, self.served = levels, np.array(served)
        tail = self.total % length
        powers = [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]
        self.full = self.total // length
        self.tail_ends = np.cumsum(powers, dtype=np.int64) if powers else np.empty(0, np.int64)

    def handed_out(self, rounds: np.ndarray) -> np.ndarray:
        """(round, queue) -> tokens that the queue has handed out before that round."""
        level = np.interp(rounds * float(self.length), self.served, self.levels)
        out = np.floor(np.minimum(self.totals, np.outer(level, self.weights))).astype(np.int64)
        out[rounds >= self.rounds] = self.totals
        return out

    def places(self, queue: int, start: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of the queue's tokens start .. start + n: (first token, tokens, sequence, offset)."""
        near = np.interp([start / self.weights[queue], (start + n) / self.weights[queue]], self.levels, self.served)
        low = max(0, int(near[0] // self.length) - 1)
        high = min(self.rounds, int(near[1] // self.length) + 3)
        rounds = np.arange(low, high + 1)
        handed = self.handed_out(rounds)
        own = handed[:, queue]
        first = np.maximum(own[:-1], start)
        last = np.minimum(own[1:], start + n)
        some = np.flatnonzero(last > first)
        dealt = np.diff(handed[:, :queue], axis=0).sum(axis=1)
        rank = handed[:-1].sum(axis=1) + dealt + first - own[:-1]
        first, size, rank = first[some], (last - first)[some], rank[some]
        head, end = self.sequence(rank), self.sequence(rank + size - 1)
        again = end - head + 1
        seq = np.repeat(head, again) + np.arange(int(again.sum())) - np.repeat(np.cumsum(again) - again, again)
        rank_of, size_of, first_of = np.repeat(rank, again), np.repeat(size, again), np.repeat(first, again)
        begin = np.maximum(rank_of, self.sequence_start(seq))
        stop = np.minimum(rank_of + size_of, self.sequence_start(seq + 1))
        return first_of + begin - rank_of, stop - begin, seq, begin - self.sequence_start(seq)

    def sequence(self, rank: np.ndarray) -> np.ndarray:
        """The sequence that holds the token of a rank."""
        in_tail = rank - self.full * self.length
        return np.where(in_tail < 0, rank // self.length,
                        self.full + np.searchsorted(self.tail_ends, in_tail, side="right"))

    def sequence_start(self, sequence: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0], self.tail_ends])
        nth = np.clip(sequence - self.full, 0, len(ends) - 1)
        return np.where(sequence <= self.full, sequence * self.length, self.full * self.length + ends[nth])


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, text: str, doc_id: str, source: str,
              most_queues: int) -> DataFrame:
    """(doc_id, source, queue, part, place, n, ids), frozen; place: tokens of the queue before it in its part."""
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    if docs.select(name).distinct().count() > most_queues:
        name = F.pmod(F.xxhash64(name), F.lit(most_queues)).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, drops_space=True)
        end = np.array([end_id], np.uint32).tobytes()
        part = TaskContext.get().partitionId()
        before: dict[str, int] = {}
        for b in (s for batch in batches for s in slices(batch, "text")):
            places, sizes, stored = [], [], []
            for queue, ids in zip(b.column("queue").to_pylist(), coder.encode(as_bytes(b, "text"))):
                got = np.frombuffer(ids + end, np.uint32)
                places.append(before.get(queue, 0))
                before[queue] = places[-1] + len(got)
                sizes.append(len(got))
                stored.append(narrow(got))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), b.column("queue"), pa.array([part] * b.num_rows, pa.int32()),
                 pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(stored, pa.binary())],
                names=["doc_id", "source", "queue", "part", "place", "n", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                       name.alias("queue"), F.col(text).alias("text"))
    return freeze(map_batches(rows, run, "doc_id long, source string, queue string, part int, place long, n long, "
                                         "ids binary"), "packing-ids")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048,
         weights: dict[str | None, float] | None = None, text: str = "text", doc_id: str = "doc_id",
         source: str = "source", most_queues: int = 1024) -> DataFrame:
    """A row per piece of a document in a sequence.

    weights: target share of each source, by name; None, or a source not named: its share of all tokens.
    """
    spark = docs.sparkSession
    rows = tokenized(docs, tokenizer, end_id, text, doc_id, source, most_queues)
    parts = freeze(rows.groupBy("queue", "part").agg(F.sum("n").alias("n")), "packing-parts")
    totals = parts.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()  # most_queues rows at most
    if not totals:
        return spark.createDataFrame([], PIECES)
    amounts = np.array([r["n"] for r in totals], np.int64)
    named = {"null" if k is None else f"={k}": v for k, v in (weights or {}).items()}
    shares = np.array([named.get(r["queue"], r["n"] / amounts.sum()) for r in totals])
    plan = Schedule(amounts, shares, length)
    number = {r["queue"]: k for k, r in enumerate(totals)}
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], pa.string() if "string" in f else pa.int64()) for f in PIECES.split(", ")])
        for b in batches:
            docs_, sources, queues, places, bases_, sizes, stored = (b.column(c).to_pylist() for c in (
                "doc_id", "source", "queue", "place", "base", "n", "ids"))
            for lo in range(0, b.num_rows, 500):
                cut = [plan.places(number[queues[k]], bases_[k] + places[k], sizes[k])
                       for k in range(lo, min(lo + 500, b.num_rows))]
                again = [len(c[0]) for c in cut]
                rows_ = np.repeat(np.arange(lo, lo + len(cut)), again)
                first, size, seq, offset = (np.concatenate([c[k] for c in cut]) for k in range(4))
                start = first - np.repeat([bases_[k] + places[k] for k in range(lo, lo + len(cut))], again)
                crc, at = [], 0
                for k, n in zip(range(lo, lo + len(cut)), again):
                    raw = memoryview(widen(stored[k]).tobytes())
                    crc += [zlib.crc32(raw[4 * s:4 * (s + z)])
                            for s, z in zip(start[at:at + n].tolist(), size[at:at + n].tolist())]
                    at += n
                pick = rows_.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([docs_[k] for k in pick], pa.int64()), pa.array([sources[k] for k in pick], pa.string()),
                     pa.array(start), pa.array(size), pa.array(crc, pa.int64()),
                     pa.array([sizes[k] for k in pick], pa.int64()), pa.array(seq), pa.array(offset)], schema=schema)

    placed = rows.join(bases, ["queue", "part"]).select("doc_id", "source", "queue", "place", "base", "n", "ids")
    return map_batches(placed, run, PIECES)
