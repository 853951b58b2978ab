"""Fill-in-middle rewriting with a piece table.

A document's text is an immutable UTF-8 buffer and the sentinels are another. A document is a list of descriptors
(buffer, start, length) over the two. Cutting splits a descriptor, an arrangement permutes the three pieces and puts the
sentinels' descriptors before them, and the inverse permutation puts the pieces back. Texts are only gathered when
somebody asks for the output; digests stream the descriptors' bytes.

Lines (`[^\\n]*\\n|[^\\n]+`) are the units of cutting. Where the cuts lie and which form a document takes follows from
the hash of the seed and its id alone, so reruns and other partitionings agree.

Defined cases: a null text counts as empty, and an empty text or one that holds a sentinel is plain (output = text,
no piece lengths). A null id hashes as an empty id. Repeated rows give repeated rows, each by itself, equal where id and
text are equal. Texts of any length are taken whole; a worker holds one slice of a batch (about a megabyte of text, or one
longer text) at a time. An empty table gives an empty table. Other columns are ignored unless named in `keep`; a kept
column may not bear the name of an output column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquifer.llm.common import as_bytes, map_batches, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
TEXT, SENTINEL = 0, 1  # buffers
SENTINELS = PREFIX + SUFFIX + MIDDLE
_START = {PREFIX: 0, SUFFIX: 3, MIDDLE: 6}

#: form -> the pieces' order (0 prefix, 1 middle, 2 suffix) and the sentinel before each of them
FORMS = {
    "psm": ((0, 2, 1), (PREFIX, SUFFIX, MIDDLE)),
    "spm": ((2, 0, 1), (SUFFIX, PREFIX, MIDDLE)),
}


class PieceTable:
    """Descriptors over an immutable text buffer and the sentinels' buffer."""

    __slots__ = ("buffers", "pieces")

    def __init__(self, text: bytes, pieces: list[tuple[int, int, int]] | None = None):
        self.buffers = (memoryview(text), memoryview(SENTINELS))
        self.pieces = [(TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, *at: int) -> PieceTable:
        """The only descriptor split at rising byte positions of its text; empty pieces stay."""
        (buffer, start, length), = self.pieces
        ends = [*at, length]
        starts = [0, *at]
        return self.over([(buffer, start + a, b - a) for a, b in zip(starts, ends)])

    def over(self, pieces: list[tuple[int, int, int]]) -> PieceTable:
        table = PieceTable.__new__(PieceTable)
        table.buffers, table.pieces = self.buffers, pieces
        return table

    def permute(self, order: tuple[int, ...]) -> PieceTable:
        return self.over([self.pieces[k] for k in order])

    def inverse(self, order: tuple[int, ...]) -> PieceTable:
        back = sorted(range(len(order)), key=order.__getitem__)
        return self.permute(tuple(back))

    def marked(self, sentinels: tuple[bytes, ...]) -> PieceTable:
        """A sentinel's descriptor before each piece."""
        return self.over([d for s, piece in zip(sentinels, self.pieces) for d in ((SENTINEL, _START[s], len(s)), piece)])

    def views(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start:start + length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()

    def gather(self) -> bytes:
        return b"".join(self.views())


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12))


def line_ends(text: bytes) -> np.ndarray:
    """The byte position behind each line."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    if text and (not len(ends) or ends[-1] != len(text)):
        ends = np.append(ends, len(text))
    return ends


def code_points(view: memoryview) -> int:
    """Bytes that do not continue a UTF-8 sequence."""
    return int(np.count_nonzero((np.frombuffer(view, np.uint8) & 0xC0) != 0x80))


def arranged(text: bytes, doc_id: int | None, seed: int, fim_percent: int, spm_percent: int) -> tuple:
    """(number of lines, form, code points of prefix and middle or None, the output's piece table)."""
    h1, h2, h3, h4 = draws(seed, doc_id)
    ends = line_ends(text)
    n, table = len(ends), PieceTable(text)
    if not text or h3 % 100 >= fim_percent or any(s in text for s in FORMS["psm"][1]):
        return n, "plain", None, None, table
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    byte_at = [int(ends[k - 1]) if k else 0 for k in (low, high)]
    parts = table.cut(*byte_at)
    prefix, middle, _ = parts.views()
    form = "spm" if h4 % 100 < spm_percent else "psm"
    order, sentinels = FORMS[form]
    return n, form, code_points(prefix), code_points(middle), parts.permute(order).marked(sentinels)


def restored(output: bytes, form: str | None) -> PieceTable:
    """The text's piece table, over an output and its form alone: cut at the sentinels, drop them, permute back.

    A sentinel is never part of a text in a form other than plain, and no sentinel begins as another ends, so the first
    find of each behind the one before is the sentinel itself."""
    table = PieceTable(output)
    if form not in FORMS:
        return table
    order, sentinels = FORMS[form]
    starts, at = [], 0
    for s in sentinels:
        at = output.index(s, at)
        starts.append(at)
        at += len(s)
    ends = [*starts[1:], len(output)]
    pieces = [(TEXT, a + len(s), b - a - len(s)) for s, a, b in zip(sentinels, starts, ends)]
    return table.over(pieces).inverse(order)


def _with_kept(df: DataFrame, keep: list[str], made: list[str]) -> str:
    clash = set(keep) & set(made)
    if clash:
        raise ValueError(f"kept columns bear names of output columns: {sorted(clash)}")
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for k in keep for f in df.schema.fields if f.name == k)


def rearrange(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7, fim_percent: int = 100,
              spm_percent: int = 50, keep: list[str] | None = None) -> DataFrame:
    """Kept columns (the id alone by default) with n, form, prefix_chars, middle_chars, output (the rewritten text) and
    output_sha256. One pass over the rows, no shuffle."""
    keep = [doc_id] if keep is None else keep
    made = ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    schema = _with_kept(docs, keep, made) + ("n long, form string, prefix_chars long, middle_chars long, output string, "
                                             "output_sha256 string")
    rows = docs.select(*[F.col(k) for k in keep], F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                ids = batch.column("__id").to_pylist()
                out = [arranged(t, i, seed, fim_percent, spm_percent) for i, t in zip(ids, as_bytes(batch, "__text"))]
                n, form, prefix, middle, tables = zip(*out)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k) for k in range(len(keep))), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                    pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                    pa.array([t.gather() for t in tables], pa.binary()).cast(pa.string()),
                    pa.array([t.sha256() for t in tables], pa.string())], names=[*keep, *made])

    return map_batches(rows, run, schema)


def restore(outputs: DataFrame, output: str = "output", form: str = "form", keep: list[str] | None = None,
            texts: bool = True) -> DataFrame:
    """Kept columns (all but the output by default) with restored_sha256 and, unless `texts` is false, restored_text:
    the exact text, rebuilt from the output and its form alone. An unknown or null form counts as plain."""
    keep = [c for c in outputs.columns if c != output] if keep is None else keep
    made = ["restored_text", "restored_sha256"] if texts else ["restored_sha256"]
    schema = _with_kept(outputs, keep, made) + ", ".join(f"{c} string" for c in made)
    rows = outputs.select(*[F.col(k) for k in keep], F.col(form).alias("__form"), F.col(output).alias("__output"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__output"):
                tables = [restored(t, f) for t, f in zip(as_bytes(batch, "__output"), batch.column("__form").to_pylist())]
                columns = [pa.array([t.gather() for t in tables], pa.binary()).cast(pa.string())] if texts else []
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k) for k in range(len(keep))), *columns,
                    pa.array([t.sha256() for t in tables], pa.string())], names=[*keep, *made])

    return map_batches(rows, run, schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """The rewritten documents' digests beside those of the texts restored from them."""
    return restore(rearrange(docs), texts=False)
