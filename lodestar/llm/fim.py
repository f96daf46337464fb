"""Fill-in-middle transformation with a piece table.

A document is a list of descriptors (buffer, start, length) over two immutable
buffers: 0 is its text, 1 holds the sentinels ``<P>``, ``<S>`` and ``<M>``. All
steps work on descriptors; the text is never copied or changed:

- a cut splits the descriptor that holds the place into two;
- an arrangement adds the sentinels' descriptors and permutes the pieces: psm
  is P prefix S suffix M middle, spm is S suffix P prefix M middle;
- the output is read by streaming the descriptors, as is its hash;
- restoring cuts an output at its sentinels, drops their descriptors, applies
  the inverse permutation and streams what is left.

Cuts fall between units: a run of ASCII letters, or any other single code
point. Where they fall and which form a document takes depends on a hash of
its key alone, so reruns and other partitionings agree. A text that is empty or
holds a sentinel stays plain, as does the share ``1 - FIM_PERCENT``.

Defined results: NULL texts count as empty; a NULL key hashes as the word
``null``; repeated rows are transformed alike; an empty table gives no rows.
Columns of other names are carried in ``row`` or not read. A text is one row,
so memory is bounded by the Arrow batch and the longest text.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
TEXT, MARKS = 0, 1
PLAIN, PSM, SPM = "plain", "psm", "spm"
# Order of the pieces prefix (0), middle (1), suffix (2) in each form.
ORDER = {PSM: (0, 2, 1), SPM: (2, 0, 1)}
MARK_OF = (PREFIX, MIDDLE, SUFFIX)
FIM_PERCENT = 90
SPM_PERCENT = 20
SEED = 1
BLOCK = 1 << 16  # code points that are encoded at once

Piece = tuple[int, int, int]
PIECES = T.ArrayType(
    T.StructType([T.StructField(n, T.IntegerType()) for n in ("buffer", "start", "length")])
)
_PA_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int32()), ("length", pa.int32())]))


class PieceTable:
    """Descriptors over the text buffer and the sentinel buffer."""

    __slots__ = ("buffers", "pieces")

    def __init__(self, text: str, pieces: list[Piece] | None = None) -> None:
        self.buffers = (text, SENTINELS)
        self.pieces = [(TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, at: int) -> None:
        """Split the descriptor that holds offset ``at`` of the document; at a
        border an empty piece comes to be, so n cuts always give n more pieces."""
        for i, (buffer, start, length) in enumerate(self.pieces):
            if at <= length:
                self.pieces[i : i + 1] = [(buffer, start, at), (buffer, start + at, length - at)]
                return
            at -= length
        raise ValueError("cut beyond the end")

    def arrange(self, order: tuple[int, ...]) -> None:
        self.pieces = [self.pieces[i] for i in order]

    def mark(self, names: list[str]) -> None:
        """A sentinel's descriptor before each piece."""
        marked = [(MARKS, SENTINELS.index(n), len(n)) for n in names]
        self.pieces = [p for pair in zip(marked, self.pieces) for p in pair]

    def blocks(self) -> Iterator[str]:
        for buffer, start, length in self.pieces:
            for at in range(start, start + length, BLOCK):
                yield self.buffers[buffer][at : min(at + BLOCK, start + length)]

    def text(self) -> str:
        return "".join(self.buffers[b][s : s + n] for b, s, n in self.pieces)

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for block in self.blocks():
            digest.update(block.encode())
        return digest.hexdigest()


def unit_starts(text: str) -> np.ndarray:
    """Offsets of the units: runs of ASCII letters, other code points one by one."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = ((points | 32) - 97) < 26  # unsigned: below "a" wraps around
    starts = ~letter
    starts[1:] |= ~letter[:-1]
    starts[:1] = True
    return np.flatnonzero(starts)


def draws(key: str, seed: int) -> list[int]:
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(
    text: str, key: str, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT
) -> tuple[PieceTable, str, int, int | None, int | None]:
    """The arranged table, form, number of units, code points of prefix and middle."""
    table = PieceTable(text)
    starts = unit_starts(text)
    n = len(starts)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or any(s in text for s in MARK_OF) or h3 % 100 >= fim_percent:
        return table, PLAIN, n, None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = [int(starts[i]) if i < n else len(text) for i in (first, second)]
    table.cut(at[0])
    table.cut(at[1])
    form = SPM if h4 % 100 < spm_percent else PSM
    table.arrange(ORDER[form])
    table.mark([MARK_OF[i] for i in ORDER[form]])
    return table, form, n, at[0], at[1] - at[0]


def restored(output: str, form: str) -> PieceTable:
    """The document's pieces, in order, as descriptors over the output."""
    table = PieceTable(output)
    if form == PLAIN:
        return table
    for i in ORDER[form]:  # a sentinel occurs once: such texts stay plain
        at = output.index(MARK_OF[i])
        table.cut(at)
        table.cut(at + len(MARK_OF[i]))
    # empty head, then sentinel and piece in turn
    table.pieces = table.pieces[2::2]
    inverse = sorted(range(3), key=ORDER[form].__getitem__)
    table.arrange(tuple(inverse))
    return table


def transform(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    carry: list[str] | None = None,
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """``row`` (the carried columns, all by default), n_units, form, prefix_chars,
    middle_chars, pieces (the output's descriptors), output, output_sha256."""
    carry = docs.columns if carry is None else carry
    slim = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")).alias("k"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"),
    )
    schema = T.StructType(
        [
            slim.schema["row"],
            T.StructField("n_units", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            T.StructField("pieces", PIECES),
            T.StructField("output", T.StringType()),
            T.StructField("output_sha256", T.StringType()),
        ]
    )
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), _PA_PIECES, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                made = []
                for k, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    table, form, n, p, m = transformed(t, k, seed, fim_percent, spm_percent)
                    pieces = [dict(zip(("buffer", "start", "length"), x)) for x in table.pieces]
                    made.append((n, form, p, m, pieces, table.text(), table.sha256()))
                cols = [pa.array(c, kind) for c, kind in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], schema.names)

    return slim.mapInArrow(run, schema)


def restore(made: DataFrame, output: str = "output", form: str = "form", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the carried columns, all by default), restored (the document's
    text, from output and form alone), restored_sha256."""
    carry = made.columns if carry is None else carry
    slim = made.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.coalesce(F.col(f"`{output}`"), F.lit("")).alias("o"),
        F.col(f"`{form}`").alias("f"),
    )
    schema = T.StructType(
        [slim.schema["row"], T.StructField("restored", T.StringType()), T.StructField("restored_sha256", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                tables = [restored(o, f) for o, f in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                cols = [pa.array([t.text() for t in tables], pa.string()), pa.array([t.sha256() for t in tables], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], schema.names)

    return slim.mapInArrow(run, schema)
