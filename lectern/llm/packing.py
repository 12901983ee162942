"""Packing token sequences: bounded-space online best fit.

Each task tokenises its partition's documents in order and holds at most ``space`` open windows. A document's whole windows are
emitted full; its remainder goes where it fits best (the window that it leaves least room in). When none fits and no window may
be opened, the fullest is topped up with the head of the remainder, which is cut there, and emitted without padding. At the end
of a partition the open windows are merged by cutting again, so all but one are full; that last one is emitted as pieces of
power-of-two length buckets, which need no padding either. Memory is bounded by the open windows and one Arrow batch.

A document is its token ids and then ``end_id``; each id lies in exactly one piece. Sequence ids hold the partition's number in
their high bits, so no task needs to know of another and a task that runs again gives the same ids.

Defined cases: null and empty texts are the single id ``end_id``; a null id is kept; repeated rows are packed again; texts of
any length are cut into windows; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_bpe(json_path: str, ranks_path: str | None = None) -> Callable[[str], np.ndarray]:
    """Text to ids of the byte-level BPE in ``json_path``, without special tokens being added.

    ``ranks_path`` may name the same vocabulary as ranks. Pieces between spaces then go through the faster of two libraries;
    texts with runs of white space or with a special token's string go through the JSON file's own tokenizer.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(json_path)

    def plain(text: str) -> np.ndarray:
        return np.array(own.encode(text, add_special_tokens=False).ids, "<u4")

    if ranks_path is None:
        return plain
    import re

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    # without runs of white space the split needs no look-ahead
    split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
    quick = tiktoken.Encoding("plain", pat_str=split, mergeable_ranks=ranks, special_tokens={})
    other = re.compile(r"\s\s|" + "|".join(map(re.escape, [t.content for t in own.get_added_tokens_decoder().values()]) or ["(?!)"]))

    def encode(text: str) -> np.ndarray:
        return plain(text) if other.search(text) else np.array(quick.encode_ordinary(text), "<u4")

    return encode


def public_byte_bpe() -> Callable[[str], np.ndarray]:
    """The public byte-level BPE of 50k ids, from where its package keeps it on each machine."""
    import public_tokenizers

    return byte_bpe(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


class Packer:
    """Open windows of one partition. ``out`` gets (doc_id, start, ids, doc_tokens, sequence_id, offset) of closed windows."""

    def __init__(self, width: int, space: int, first_id: int):
        self.width, self.space, self.next_id = width, space, first_id
        self.open: list[list] = []  # [filled, pieces]
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, ids, total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def _place(self, piece: tuple) -> None:
        doc_id, start, ids, total = piece
        fits = [w for w in self.open if w[0] + len(ids) <= self.width]
        if fits:
            best = max(fits, key=lambda w: w[0])
        elif len(self.open) < self.space:
            best = [0, []]
            self.open.append(best)
        else:
            best = max(self.open, key=lambda w: w[0])
            room = self.width - best[0]
            best[1].append((doc_id, start, ids[:room], total))
            self._close(best[1])
            best[0], best[1] = 0, []
            start, ids = start + room, ids[room:]
        best[1].append((doc_id, start, ids, total))
        best[0] += len(ids)
        if best[0] == self.width:
            self.open.remove(best)
            self._close(best[1])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.width * self.width
        for start in range(0, whole, self.width):
            self._close([(doc_id, start, ids[start : start + self.width], len(ids))])
        if whole < len(ids):
            self._place((doc_id, whole, ids[whole:], len(ids)))

    def finish(self) -> None:
        """Merge the open windows into full ones; the rest goes out in length buckets, largest first."""
        left = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open = []
        total = sum(len(p[2]) for p in left)
        sizes = [self.width] * (total // self.width)
        sizes += [1 << b for b in reversed(range(self.width.bit_length())) if (total % self.width) >> b & 1]
        for size in sizes:
            pieces = []
            while size:
                doc_id, start, ids, n = left.pop(0)
                pieces.append((doc_id, start, ids[:size], n))
                if len(ids) > size:
                    left.insert(0, (doc_id, start + size, ids[size:], n))
                size -= len(pieces[-1][2])
            self._close(pieces)

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(
    docs: DataFrame,
    tokenizer: Callable[[], Callable[[str], np.ndarray]],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 1024,
    space: int = 32,
    end_id: int = 0,
) -> DataFrame:
    """One row per piece, see ``SCHEMA``. ``tokenizer`` is called once per task and returns a function from text to ids."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = tokenizer(), TaskContext.get()
        packer = Packer(width, space, (context.partitionId() if context else 0) << 40)
        end = np.array([end_id], "<u4")

        def closed() -> pa.RecordBatch:
            rows = packer.take()
            columns = [
                [r[0] for r in rows],
                [r[1] for r in rows],
                [len(r[2]) for r in rows],
                [zlib.crc32(r[2].tobytes()) for r in rows],
                [r[3] for r in rows],
                [r[4] for r in rows],
                [r[5] for r in rows],
            ]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                packer.add(doc_id, np.concatenate((encode(text), end)) if text else end)
            yield closed()
        packer.finish()
        yield closed()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(batches, SCHEMA)
