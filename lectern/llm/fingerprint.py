"""SimHash fingerprints of whole texts over word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bit k of a byte, most significant first
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = (np.arange(8) * 256)[None, :]


def simhash64(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The signed 64-bit SimHash of a text; 0 when it has no word.

    A bit is 1 if it is set in more than half of the shingles' XXH64 values. Shingles are ``width`` words of the text with
    A-Z in lower case, joined by one space, repeats included; a shorter text is one shingle.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        digests = xxhash.xxh64_digest(joined, seed)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-width] + 1))
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)])
    octets = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (2 * counts.ravel() > len(octets)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(doc_id, fp): a document's id and its SimHash as a signed 64-bit integer; then the long columns ``more``. Narrow: nothing is shuffled."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = pa.array([simhash64(t) for t in part.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), fps, *part.columns[2:]], ["doc_id", "fp", *more])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return slim.mapInArrow(batches, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))
