"""Postings by term and block of documents, and their scoring against blocks of queries.

A block holds the documents of one hash of their ids. It is tokenised and counted in one go, so what is shuffled are texts, and at most
one row per term and block; a token is never a row. Blocks of documents meet blocks of queries, and a task keeps the best of each query:
what is shuffled then are ``k`` rows per query and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from ..functions import vectors as V

K1, B = 1.2, 0.75
#: Documents per block, about; queries per block; queries that are scored at once; the share of a block's documents, one in so many, that
#: makes a term a row of a dense matrix.
BLOCK, QUERY_BLOCK, AT_ONCE, OFTEN = 512, 1024, 256, 8
#: Bits of the sketch of the terms that are asked for: more terms let more of the others pass, which costs space alone.
BITS = 1 << 23
#: Groups that buckets of terms are shuffled by.
GROUPS = 64
#: Scores are rounded to six digits before they rank.
SLACK = 2e-6
#: Columns of a term's row in a block.
HELD = ("term", "ids", "tfs", "lengths", "max_tf", "min_length")


def block_of(ids: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(blocks)).cast("int")


def _postings(rows: pa.Table, asked: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, list[pa.Array]]:
    """(ids, lengths, columns ``HELD``) of one block's documents (id, tokens): all postings, or those of the terms in :func:`sketch`."""
    ids, tokens = rows.column("id").combine_chunks(), rows.column("tokens").combine_chunks()
    lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    # rows of one id and length are one document, as where postings are grouped by both
    known = ids.dictionary_encode(null_encoding="encode")
    place = np.empty(len(known.dictionary), np.int64)
    place[pc.sort_indices(known.dictionary).to_numpy()] = np.arange(len(place))
    both, first, doc = np.unique(place[known.indices.to_numpy()] * (lengths.max() + 1) + lengths, return_index=True, return_inverse=True)
    words = tokens.flatten().dictionary_encode()
    term, doc = words.indices.to_numpy().astype(np.int64), np.repeat(doc, lengths)
    if asked is not None:
        hashes = np.fromiter((xxhash.xxh64_intdigest(t, 42) & (BITS - 1) for t in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        held = (asked[hashes >> 3] >> (hashes & 7) & 1).astype(bool)[term]
        term, doc = term[held], doc[held]
    keys, tfs = np.unique(term * len(both) + doc, return_counts=True)
    term, at = np.divmod(keys, len(both))
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    row, length, tfs = first[at], lengths[first[at]].astype(np.int32), tfs.astype(np.int32)
    most, least = (np.maximum.reduceat(tfs, starts), np.minimum.reduceat(length, starts)) if len(starts) else (tfs, length)
    offsets = pa.array(np.append(starts, len(keys)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (ids.take(pa.array(row)), pa.array(tfs), pa.array(length))]
    return ids, lengths, [words.dictionary.take(pa.array(term[starts])).cast(pa.string()), *lists, pa.array(most), pa.array(least)]


def _packed(columns: list[pa.Array], names: list[str]) -> bytes:
    """Columns as bytes of Arrow: a block that meets many others is then copied, not written anew by its elements."""
    batch, sink = pa.RecordBatch.from_arrays(columns, names), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def packed(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """(by, ..., name): the rows of each group as bytes; for groups of bounded size."""
    columns = [c for c in rows.columns if c not in by]
    keys = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)

    def pack(group: pa.Table) -> pa.Table:
        data = _packed([group.column(c).combine_chunks() for c in columns], columns)
        return pa.table([*(group.column(c).slice(0, 1) for c in by), pa.array([data], pa.binary())], names=[*by, name])

    return rows.groupBy(*by).applyInArrow(pack, f"{keys}, {name} binary")


def _gathered(asked: np.ndarray, rows: pa.Table) -> pa.Table:
    """One block's rows (block, id, tokens) as one row."""
    ids, lengths, held = _postings(rows, asked)
    sizes = [pa.array([int(x)], pa.int64()) for x in (len(ids), (lengths > 0).sum(), lengths.sum())]
    whole, counts = pa.array([0, len(held[0])], pa.int32()), pc.list_value_length(held[1]).cast(pa.int32())
    columns = [pa.array([rows.column("block")[0].as_py()], pa.int32()), *sizes, pa.ListArray.from_arrays(whole, held[0]), pa.ListArray.from_arrays(whole, counts), pa.array([_packed(held, list(HELD))], pa.binary())]
    return pa.table(columns, names=["block", "docs", "filled", "length", "terms", "counts", "held"])


def _counted(groups: int, buckets: int, rows: pa.Table) -> pa.Table:
    """One block's rows (block, id, tokens) as its postings, packed by group of buckets, and packed too a row without a term that lists
    its documents."""
    ids, lengths, held = _postings(rows)
    whole, none = pa.array([0, len(ids)], pa.int32()), pa.array([None], pa.int32())
    listed = [pa.array([None], pa.string()), pa.ListArray.from_arrays(whole, ids), pa.array([[]], pa.list_(pa.int32())), pa.ListArray.from_arrays(whole, pa.array(lengths.astype(np.int32))), none, none]
    hashes = np.array([xxhash.xxh64_intdigest(t, 42) for t in held[0].to_pylist()], np.uint64).view(np.int64)
    group = hashes % buckets % groups
    order = np.argsort(group, kind="stable")
    columns, ends = [c.take(pa.array(order)) for c in held], np.cumsum(np.bincount(group, minlength=groups)).tolist()
    data = [(g, _packed([c.slice(a, b - a) for c in columns], list(HELD))) for g, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if b > a]
    data.append((0, _packed(listed, list(HELD))))
    block = pa.array(np.full(len(data), rows.column("block")[0].as_py(), np.int32))
    return pa.table([block, pa.array([g for g, _ in data], pa.int32()), pa.array([d for _, d in data], pa.binary())], names=["block", "group", "data"])


def _opened(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, data) as (block, ...) of what is packed."""
    for part in parts:
        for block, data in zip(part.column("block").to_pylist(), part.column("data"), strict=True):
            rows = _unpacked(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), block, np.int32)), *rows.columns], ["block", *HELD])


def _dealt(docs: DataFrame, tokens: Column, blocks: int) -> GroupedData:
    """docs (id, text), shuffled as texts, as (block, id, tokens) by block."""
    dealt = docs.select(block_of(F.col("id"), blocks).alias("block"), "id", "text").repartition("block")
    return dealt.select("block", "id", tokens.alias("tokens")).groupBy("block")


def _held(docs: DataFrame) -> str:
    return f"ids array<{docs.schema['id'].dataType.simpleString()}>, tfs array<int>, lengths array<int>, max_tf int, min_length int"


def term_blocks(docs: DataFrame, tokens: Column, blocks: int, buckets: int) -> DataFrame:
    """(block, term, ids, tfs, lengths, max_tf, min_length) of docs (id, text), of which ``tokens`` are the tokens; and per block a row
    without a term: its documents, with their lengths. A bucket's rows, by the term's hash, lie together, in up to 16 tasks. What is
    shuffled are texts, then packed rows."""
    groups = min(buckets, GROUPS)

    def counted(rows: pa.Table) -> pa.Table:
        return _counted(groups, buckets, rows)

    rows = _dealt(docs, tokens, blocks).applyInArrow(counted, "block int, group int, data binary")
    dealt = rows.withColumn("part", F.col("block") % 16).repartition("group", "part").select("block", "data")
    return dealt.mapInArrow(_opened, f"block int, term string, {_held(docs)}")


def sketch(terms: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of ``terms`` (term), by their hashes: terms that it doesn't hold are none of them."""
    place = F.pmod(F.xxhash64("term"), F.lit(BITS)) + 1
    found = terms.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in found:
        part = np.frombuffer(r.bits, np.uint8)
        out[(r.part - 1) * len(part) :][: len(part)] = part
    return out


def sketched(rows: DataFrame, asked: np.ndarray, size: int = 512) -> DataFrame:
    """``rows`` (term, ...) of the terms that the :func:`sketch` ``asked`` holds, before they are shuffled; its parts of ``size`` bytes are a
    small table, of a fixed number of rows."""
    parts = rows.sparkSession.createDataFrame(pa.table({"sketch_part": pa.array(np.arange(len(asked) // size)), "bits": pa.array([asked[i : i + size].tobytes() for i in range(0, len(asked), size)], pa.binary())}))
    place = F.pmod(F.xxhash64("term"), F.lit(BITS))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) % size + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (place % 8).cast("int"))) != 0
    return rows.join(parts, (F.floor(place / (8 * size)) == parts.sketch_part) & held).select(*rows.columns)


def gathered_blocks(docs: DataFrame, tokens: Column, blocks: int, asked: np.ndarray) -> DataFrame:
    """(block, docs, filled, length, terms, counts, held): a row per block of docs (id, text) with its numbers of documents, of those that
    aren't empty and of words, and the postings of the terms that the :func:`sketch` ``asked`` holds: none is shuffled."""

    def gathered(rows: pa.Table) -> pa.Table:
        return _gathered(asked, rows)

    return _dealt(docs, tokens, blocks).applyInArrow(gathered, "block int, docs long, filled long, length long, terms array<string>, counts array<int>, held binary")


def listed(rows: DataFrame) -> DataFrame:
    """(id, length) of the documents, of :func:`term_blocks`."""
    return rows.where("term IS NULL").select(F.explode(F.arrays_zip("ids", "lengths")).alias("d")).select(F.col("d.ids").alias("id"), F.col("d.lengths").alias("length"))


class Block:
    """A block's rows (term, ids, tfs, lengths, max_tf, min_length)."""

    def __init__(self, held: pa.StructArray, average: float):
        names, lists = held.field("term").to_pylist(), held.field("ids")
        self.place = {t: i for i, t in enumerate(names)}
        values, self.sizes = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids, doc = np.unique(np.array(values.to_pylist()) if pa.types.is_string(values.type) else values.to_numpy(), return_inverse=True)
        self.doc = doc.astype(np.int64)
        self.weights = _saturated(*(held.field(c).flatten().to_numpy() for c in ("tfs", "lengths")), average)
        # terms of many documents as a dense matrix, beside which the others' matches are few
        often = np.flatnonzero(self.sizes >= max(8, len(self.ids) // OFTEN))
        self.dense = np.full(len(names), -1)
        self.dense[often] = np.arange(len(often))
        term = np.repeat(self.dense, self.sizes)
        self.matrix = np.zeros((len(often), len(self.ids)))
        np.add.at(self.matrix, (term[term >= 0], self.doc[term >= 0]), self.weights[term >= 0])
        self.most = _saturated(held.field("max_tf").to_numpy(), held.field("min_length").to_numpy(), average)


def _saturated(tf: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


class Best:
    """The ``k`` best documents of each query among the blocks seen so far."""

    def __init__(self, k: int, avg_length: float):
        self.k, self.average = k, avg_length if avg_length > 0 else 1.0
        self.places: dict = {}
        self.leading = V.Leading(0, k)
        self.asked: dict | None = None
        #: Pairs of a query and a block: how many there were, and in how many scores were computed.
        self.met = self.opened = 0

    def weights(self, tf: np.ndarray, length: np.ndarray, idf: np.ndarray) -> np.ndarray:
        return idf * _saturated(tf, length, self.average)

    def _take(self, asked: dict, idfs: dict[str, float]) -> None:
        """The terms of ``asked``: distinct ones, and for each query and term that one's place, the query's and the idf."""
        self.asked, known = asked, {}
        place = [known.setdefault(t, len(known)) for terms in asked.values() for t in terms]
        query = [self.places.setdefault(q, len(self.places)) for q, terms in asked.items() for _ in terms]
        self.terms, self.of, self.query = list(known), np.array(place, np.int64), np.array(query, np.int64)
        self.idf = np.array([idfs.get(t, 0.0) for t in self.terms])[self.of] if known else np.zeros(0)
        self.leading.grow(len(self.places))

    def add(self, held: pa.StructArray | Block, asked: dict, idfs: dict[str, float], gone: list | None = None, scope: list | None = None) -> None:
        """Score a block: ``held`` has a row (term, ids, tfs, lengths, max_tf, min_length) per term, ``asked`` the terms of each query.

        A query whose terms' largest weights in the block don't add up to its k-th score so far is passed over.
        """
        block = held if isinstance(held, Block) else Block(held, self.average)
        if asked is not self.asked:
            self._take(asked, idfs)
        at = np.fromiter(map(block.place.get, self.terms, repeat(-1)), np.int64, len(self.terms))[self.of] if self.terms else self.of
        query, idf, at = self.query[at >= 0], self.idf[at >= 0], at[at >= 0]
        n = len(self.places)
        met = np.bincount(query, minlength=n) > 0
        wanted = met & (np.bincount(query, block.most[at] * idf, minlength=n) >= self.leading.least() - SLACK)
        self.met += int(met.sum())
        self.opened += int(wanted.sum())
        query, idf, at = (x[wanted[query]] for x in (query, idf, at))
        if not len(query):
            return
        shut = np.zeros(len(block.ids), bool)
        if gone:
            shut |= np.isin(block.ids, np.array(gone, block.ids.dtype))
        if scope is not None:
            shut |= ~np.isin(block.ids, np.array(scope, block.ids.dtype if len(scope) == 0 else None))
        # a few queries at once, in the order of their places
        order = np.argsort(query, kind="stable")
        query, idf, at = query[order], idf[order], at[order]
        cuts = np.flatnonzero(np.diff(query, prepend=-1))[::AT_ONCE].tolist()
        for a, b in zip(cuts, [*cuts[1:], len(query)], strict=True):
            self._score(block, query[a:b], idf[a:b], at[a:b], shut)

    def _score(self, block: Block, query: np.ndarray, idf: np.ndarray, at: np.ndarray, shut: np.ndarray) -> None:
        queries, row = np.unique(query, return_inverse=True)
        width, place = len(block.ids), block.dense[at]
        wide, few = place >= 0, place < 0
        asked = np.zeros((len(queries), len(block.matrix)))
        asked[row[wide], place[wide]] = idf[wide]
        scores = asked @ block.matrix
        if few.any():
            row, idf, at = row[few], idf[few], at[few]
            sizes = block.sizes[at]
            before = np.cumsum(sizes) - sizes
            match = np.arange(before[-1] + sizes[-1]) + np.repeat(block.starts[at] - before, sizes)
            cell = np.repeat(row * width, sizes) + block.doc[match]
            scores += np.bincount(cell, block.weights[match] * np.repeat(idf, sizes), minlength=scores.size).reshape(scores.shape)
        scores[scores <= 0] = -np.inf
        scores[:, shut] = -np.inf
        self.leading.add(queries, scores, block.ids)

    def rows(self) -> tuple[list, np.ndarray, np.ndarray]:
        place, scores, ids = self.leading.rows()
        names = list(self.places)
        return [names[i] for i in place.tolist()], scores, ids


def _scored(k: int, avg_length: float, parts: Iterator[pa.RecordBatch], held: int = 16) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks (of, part, asked, held, gone, scope) as (query_id, id, score): the ``k`` best of each query. A task keeps the best of
    up to ``held`` blocks of queries while documents go by; ``of`` tells which block of documents it is."""
    known: dict[int, tuple[dict, dict, Best]] = {}
    types: list[pa.DataType] = [pa.int64(), pa.int64()]
    of, block = None, None

    def given(part: int) -> pa.RecordBatch:
        queries, scores, ids = known.pop(part)[2].rows()
        return pa.RecordBatch.from_arrays([pa.array(queries, types[0]), pa.array(ids.tolist(), types[1]), pa.array(scores, pa.float64())], ["query_id", "id", "score"])

    for batch in parts:
        for i, part in enumerate(batch.column("part").to_pylist()):
            now = batch.column("of")[i].as_py()
            if block is None or now != of:
                held_there = _unpacked(batch.column("held")[i].as_py())
                of, block = now, Block(held_there.to_struct_array(), avg_length if avg_length > 0 else 1.0)
                types[1] = held_there.schema.field("ids").type.value_type
            if part not in known:
                if len(known) >= held:
                    yield given(next(iter(known)))
                rows = _unpacked(batch.column("asked")[i].as_py())
                types[0] = rows.schema.field("query_id").type
                asked, idfs = {}, {}
                for query, term, idf in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    asked.setdefault(query, []).append(term)
                    idfs[term] = idf
                known[part] = asked, idfs, Best(k, avg_length)
            asked, idfs, best = known[part]
            masks = [batch.column(c)[i].as_py() if c in batch.schema.names else None for c in ("gone", "scope")]
            best.add(block, asked, idfs, *masks)
    for part in list(known):
        yield given(part)


def scored(rows: DataFrame, known: DataFrame, k: int, avg_length: float, id_type: str) -> DataFrame:
    """(query_id, id, score): for blocks of documents (of, held: packed, gone, scope; ``of`` names a block) and terms asked for (query_id, term,
    idf) at least the ``k`` best of each query."""
    n = known.select("query_id").distinct().count()
    part = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // QUERY_BLOCK)))).alias("part")
    asked = packed(known.select(part, "query_id", "term", "idf"), "asked", "part")
    # Spark broadcasts the blocks of queries if they are small, else it takes the two sides' partitions pair by pair
    pairs = rows.crossJoin(asked).select("of", "part", "asked", "held", *[c for c in ("gone", "scope") if c in rows.columns])
    return pairs.mapInArrow(partial(_scored, k, avg_length), f"query_id {known.schema['query_id'].dataType.simpleString()}, id {id_type}, score double")
