"""Vector functions, and matrix products of blocks of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector over its length, as doubles; unit vectors make cosine one dot product. Of a vector of zeros all stay 0."""
    return let(F.sqrt(dot(v, v)), lambda length: F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is all zeros."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def parse(text: Column) -> Column:
    """[1,2,3] as array<float>."""
    return F.from_json(text, "array<float>")


def render(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def hashed(tokens: Column, width: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed feature hashing of tokens into ``width`` places. Hashes are built-in;
    the places of a batch of rows are summed at once."""
    places = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(width)).cast("int"))
    signs = F.transform(tokens, lambda t: F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1).otherwise(-1))

    @F.pandas_udf("array<double>")
    def summed(at: pd.Series, sign: pd.Series) -> pd.Series:
        known = at.notna().to_numpy()
        sizes = [len(x) if ok else 0 for x, ok in zip(at, known, strict=True)]
        flat = np.concatenate([np.zeros(0, np.int64), *at[known]]).astype(np.int64)
        weights = np.concatenate([np.zeros(0), *sign[known]]).astype(float)
        row = np.repeat(np.arange(len(at)), sizes)
        out = np.bincount(row * width + flat, weights=weights, minlength=len(at) * width).reshape(len(at), width)
        return pd.Series([v if ok else None for v, ok in zip(out, known, strict=True)])

    return summed(places, signs)


#: Scores that are looked through at once.
SCORES = 1 << 19
#: Columns of a block: how many vectors, their ids, and their unit vectors as one matrix.
PACKED = ("n", "ids", "matrix")


def packed(rows: DataFrame, most: int | None = None) -> DataFrame:
    """rows (id, v: array<float>) as blocks (n, ids, matrix of float64), each of an Arrow batch or of at most ``most`` rows of it.
    Narrow: nothing is shuffled."""
    kind = rows.schema["id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for a in range(0, whole.num_rows, most or max(1, whole.num_rows)):
                part = whole.slice(a, most or whole.num_rows)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                length = np.sqrt((v * v).sum(1, keepdims=True))
                v = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), ids, pa.array([v.tobytes()], pa.binary())], list(PACKED))

    return rows.mapInArrow(batches, f"n int, ids array<{kind}>, matrix binary")


class Leading:
    """The ``k`` best of each of ``n`` queries among what was added: by score rounded to six digits, ties by id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = max(1, k), np.zeros((0, max(1, k))), np.zeros((0, max(1, k)), np.int64)
        self.seen = False
        self.grow(n)

    def grow(self, n: int) -> None:
        more = n - len(self.scores)
        if more > 0:
            self.scores = np.concatenate((self.scores, np.full((more, self.k), -np.inf)))
            self.ids = np.concatenate((self.ids, np.zeros((more, self.k), self.ids.dtype)))

    def least(self) -> np.ndarray:
        """The k-th score of each query so far; -inf where there are fewer."""
        return self.scores[:, -1]

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of distinct ``queries`` (rows) for ``ids`` (columns); -inf where there is none."""
        k = self.k
        least = self.least()[queries]
        hit = scores > np.where(np.isinf(least), -np.finfo(float).max, least - 2e-6)[:, None]
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 2 * k)
        if len(many):  # of these none below the k-th of its row can stay
            keys = np.round(scores[many], 6)
            hit[many] &= keys >= np.partition(keys, keys.shape[1] - k, axis=1)[:, -k, None]
        row, column = np.nonzero(hit)
        if not len(row):
            return
        touched, row = np.unique(row, return_inverse=True)
        mine = queries[touched]
        held = np.isfinite(self.scores[mine])
        kept = np.nonzero(held)[0]
        kind = np.promote_types(self.ids.dtype, ids.dtype) if self.seen else ids.dtype
        self.seen = True
        if kind != self.ids.dtype:
            self.ids = self.ids.astype(kind)
        every = np.concatenate((kept, row))
        value = np.concatenate((self.scores[mine][held], scores[touched[row], column]))
        name = np.concatenate((self.ids[mine][held], ids[column]))
        order = np.lexsort((name, -np.round(value, 6), every))
        every, value, name = every[order], value[order], name[order]
        place = np.arange(len(every)) - np.flatnonzero(np.diff(every, prepend=-1))[every]
        first = place < k
        new, named = np.full((len(mine), k), -np.inf), np.zeros((len(mine), k), self.ids.dtype)
        new[every[first], place[first]], named[every[first], place[first]] = value[first], name[first]
        self.scores[mine], self.ids[mine] = new, named

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id) of all that lead, best first."""
        query, place = np.nonzero(np.isfinite(self.scores))
        return query, self.scores[query, place], self.ids[query, place]


def nearest(pairs: DataFrame, k: int, query_type: str, id_type: str, held: int = 64) -> DataFrame:
    """(query_id, id, score): for each pair of blocks (row_*, query_*) the ``k`` best rows of each query. A task keeps the best of up to
    ``held`` blocks of queries while rows go by, and gives them when it has more, or ends."""
    schema = f"query_id {query_type}, id {id_type}, score double"

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, Leading] = {}

        def given(key: tuple) -> pa.RecordBatch:
            place, scores, ids = best.pop(key).rows()
            queries = [key[i] for i in place.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(queries, query_arrow), pa.array(ids.tolist(), id_arrow), pa.array(scores, pa.float64())], ["query_id", "id", "score"])

        query_arrow = id_arrow = pa.int64()
        for part in parts:
            query_arrow, id_arrow = (part.schema.field(c).type.value_type for c in ("query_ids", "row_ids"))
            for r in part.to_pylist():
                rows, asked = (np.frombuffer(r[f"{x}_matrix"]).reshape(r[f"{x}_n"], -1) for x in ("row", "query"))
                key, ids = tuple(r["query_ids"]), np.array(r["row_ids"])
                if key not in best:
                    if len(best) >= held:
                        yield given(next(iter(best)))
                    best[key] = Leading(len(key), k)
                step = max(1, SCORES // max(1, len(rows)))
                for a in range(0, len(key), step):
                    some = np.arange(a, min(a + step, len(key)))
                    best[key].add(some, asked[some] @ rows.T, ids)
        for key in list(best):
            yield given(key)

    return pairs.mapInArrow(batches, schema)
