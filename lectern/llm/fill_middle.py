"""Fill-in-the-middle: texts cut at two seeded places, and the parts put in another order between marks.

Cuts are counted in code points, texts lie in UTF-8, so a cut needs the byte at which its code point starts. The distinct-text index
holds these boundaries once for each text that stands more than once:

1. Hashes of all texts are counted, narrow; a text whose hash stands once has no equal and needs no partner.
2. The others are grouped by hash and text, so that equal hashes of unlike texts are told apart. Copies meet before they shuffle.
3. One task makes the boundary list of each distinct text, in Elias-Fano form: about two bits and a fraction per code point.
4. Documents join their text's list by hash and text, from a written table of one row per text: Spark splits the rows of a text that
   many documents share. Texts without an equal are listed where they lie. Select gives the byte of each cut.

Cuts and order depend on the seed and the document's id alone, so copies of a text are cut at places of their own.

Defined cases: a null text is empty; empty texts, and those that hold a mark, stay as they are (plain); a null id is seeded as an
empty one; repeated rows are cut alike; texts of any length are read whole; an empty table gives an empty result; other columns
are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, so many stay plain, and so many of the others have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20


@dataclass(frozen=True)
class Boundaries:
    """A rising list of numbers in Elias-Fano form: ``low`` bits of each as they are, the rest as gaps in unary (``high``)."""

    size: int
    width: int
    low: bytes
    high: bytes

    @staticmethod
    def of(values: np.ndarray) -> Boundaries:
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        ones = (values >> width) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        low = (values[:, None] >> np.arange(width - 1, -1, -1)) & 1
        return Boundaries(n, width, np.packbits(low.astype(np.uint8).ravel()).tobytes(), np.packbits(bits).tobytes())

    def select(self, places: list[int]) -> list[int]:
        """The numbers at ``places``."""
        octets = np.frombuffer(self.high, np.uint8)
        upto = np.cumsum(np.bitwise_count(octets), dtype=np.int64)
        out = []
        for k in places:
            at = int(np.searchsorted(upto, k + 1))
            inside = k - (int(upto[at - 1]) if at else 0)
            bit = int(np.flatnonzero(np.unpackbits(octets[at : at + 1]))[inside])
            value = at * 8 + bit - k
            if self.width:
                first = k * self.width
                held = int.from_bytes(self.low[first // 8 : (first + self.width + 7) // 8], "big")
                spare = -(first + self.width) % 8
                value = (value << self.width) | ((held >> spare) & ((1 << self.width) - 1))
            out.append(value)
        return out

    @staticmethod
    def in_utf8(text: bytes) -> Boundaries:
        """Where each code point of a text starts, and where the text ends."""
        octets = np.frombuffer(text, np.uint8)
        starts = np.flatnonzero((octets & 0xC0) != 0x80)
        return Boundaries.of(np.append(starts, len(octets)).astype(np.int64))


_LIST = pa.struct([("size", pa.int32()), ("width", pa.int32()), ("low", pa.binary()), ("high", pa.binary())])
_LIST_SQL = "struct<size:int,width:int,low:binary,high:binary>"


def seeded(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits from the seed and an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def cut(text: bytes, bounds: Boundaries, numbers: list[int]) -> tuple[str, int | None, int | None, bytes]:
    """(form, code points of the prefix, of the middle, output) of a text."""
    n = bounds.size - 1
    if n == 0 or numbers[2] % 100 >= 100 - PLAIN or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    first, last = sorted(h % (n + 1) for h in numbers[:2])
    a, z = bounds.select([first, last])
    parts = {PREFIX: text[:a], MIDDLE: text[a:z], SUFFIX: text[z:]}
    form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if numbers[3] % 100 < SUFFIX_FIRST else ("psm", (PREFIX, SUFFIX, MIDDLE))
    return form, first, last - first, b"".join(m.encode() + parts[m] for m in order)


def _indexed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) with the text's boundary list."""
    for part in slices(parts):
        lists = [Boundaries.in_utf8(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
        held = pa.array([vars(b) for b in lists], _LIST)
        yield pa.RecordBatch.from_arrays([part.column("key"), part.column("text"), held], ["key", "text", "bounds"])


def text_index(texts: DataFrame) -> DataFrame:
    """(key, text, bounds): each distinct text of ``texts`` (key, text) once. ``key`` only deals them out: rows group by text."""
    return texts.groupBy("key", "text").agg(F.lit(1)).select("key", "text").mapInArrow(_indexed, f"key long, text string, bounds {_LIST_SQL}")


def _cut(seed: int, rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, bounds, or null where the text has no list yet) as what :func:`fill_middle` returns."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            texts, lists = part.column("text").cast(pa.binary()).to_pylist(), part.column("bounds").to_pylist()
            lists = [Boundaries(**b) if b else Boundaries.in_utf8(t) for b, t in zip(lists, texts, strict=True)]
            made = [cut(t, b, seeded(seed, i)) for i, t, b in zip(part.column("doc_id").to_pylist(), texts, lists, strict=True)]
            form, prefix, middle, output = zip(*made, strict=True) if made else ((), (), (), ())
            n = pa.array([b.size - 1 for b in lists], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), n, pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return rows.mapInArrow(batches, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def fill_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document; ``form`` is plain, psm or spm."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    repeated = rows.groupBy("key").count().where("count > 1").select("key")
    repeated = materialise(repeated, "fim-repeated")  # a number for each repeated text; Spark broadcasts it below its limit
    copies = rows.join(repeated, "key", "left_semi")
    index = materialise(text_index(copies.select("key", "text")), "fim-index").withColumnRenamed("text", "known")
    met = copies.join(index.hint("merge"), (copies.key == index.key) & (copies.text == index.known)).select("doc_id", "text", "bounds")
    alone = rows.join(repeated, "key", "left_anti").select("doc_id", "text", F.lit(None).cast(_LIST_SQL).alias("bounds"))
    return _cut(seed, met.unionByName(alone))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Parts hold no mark, and marks don't overlap, so each is where it is found first."""

    def between(a: str, z: str | None) -> Column:
        start = F.locate(a, output) + len(a)
        return F.substring(output, start, (F.locate(z, output) - start) if z else F.length(output))

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
