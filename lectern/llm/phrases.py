"""Phrase collocations: word runs that stand together more often than their parts let expect, counted exactly.

1. Tasks read texts once, in chunks of bounded size: words are numbered within the chunk, and the chunk's vocabulary with its counts
   and the texts as numbers (0 where a piece ends) are written to the shared folder.
2. Vocabularies are summed. Words that stand ``least`` times or more in a language make its dictionary: no part of a frequent phrase
   is rarer. Ids are places in the order of (language, word), so an id tells the language too. The dictionary is never broadcast: it
   is joined to the vocabularies, and each chunk gets the ids of its own words.
3. Chunks turn numbers into ids and break pieces at other words. The ids of each place and the three after it, of fixed width, are
   one binary key; a chunk sorts its keys by radix and counts runs of equal ones before anything is shuffled.
4. Keys are range-partitioned at quantiles drawn from some chunks: a chunk sends each partition its part of the sorted keys, packed. A
   partition sorts them by radix; runs of equal beginnings of two, three and four ids are the phrases. A run inside a partition is
   whole; the first and the last may go on in the next one, and are summed with it.
5. Phrases join the counts of their parts; scores are compared as exact integers.

Defined cases: null texts are empty; a null language is ``und``; repeated rows count as often as they stand; texts of any length are
read whole; an empty table gives an empty result; ids and other columns don't matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .line_dedup import sorted_ranks

#: Words of the longest phrase, occurrences of the rarest, and length of each language's list.
LONGEST, LEAST, FIRST = 4, 30, 2000
UNKNOWN = "und"
#: Words, and distinct words, at which a chunk is written; words behind a range partition, about.
CHUNK, VOCABULARY, PART = 1 << 21, 1 << 19, 1 << 22
#: Chunks from which the partitions' bounds are drawn, about, and the place of one key drawn to the next.
SAMPLED, EVERY = 16, 2048
#: A-Z in lower case, and what ends a piece as a full stop, which no word holds.
_LOWER = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


_ZSTD = pa.Codec("zstd", compression_level=1)


def _packed(values: np.ndarray) -> bytes:
    return _ZSTD.compress(np.ascontiguousarray(values).tobytes(), asbytes=True)


def _unpacked(data: bytes, size: int, kind: type) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(data, size * np.dtype(kind).itemsize, asbytes=True), kind)


class Chunk:
    """Texts of one language as numbers of words; 0 ends a piece."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[b"."]
        self.texts: list[np.ndarray] = []
        self.words = 0

    def add(self, text: bytes) -> None:
        words = text.translate(_LOWER).replace(b".", b" . ").split()
        words.append(b".")
        self.texts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.words += len(words)

    @property
    def full(self) -> bool:
        return self.words >= CHUNK or len(self.numbers) >= VOCABULARY

    def row(self, lang: str, chunk: int) -> dict:
        """The vocabulary (word k has number k + 1), its counts, and the texts as ``size`` numbers, compressed."""
        codes = np.concatenate(self.texts)
        counts = np.bincount(codes, minlength=len(self.numbers))[1:]
        words = [w.decode() for w in self.numbers][1:]
        return {"chunk": chunk, "lang": lang, "words": words, "counts": counts.tolist(), "size": len(codes), "codes": _packed(codes)}


_CODED = "chunk long, lang string, words array<string>, counts array<long>, size long, codes binary"
_CODED_ARROW = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("size", pa.int64()), ("codes", pa.binary())])


def _coded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_: dict[str, Chunk] = {}
    task = TaskContext.get()
    # a task that runs again gives its chunks the same names
    names = count((task.partitionId() if task else 0) << 24)

    def written(lang: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([open_.pop(lang).row(lang, next(names))], _CODED_ARROW)

    for part in parts:
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()), strict=True):
            chunk = open_.setdefault(lang, Chunk())
            chunk.add(text.as_py())
            if chunk.full:
                yield written(lang)
            elif sum(c.words for c in open_.values()) >= 2 * CHUNK:  # one limit for all languages together, however many
                yield written(max(open_, key=lambda k: open_[k].words))
    for lang in list(open_):
        yield written(lang)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of the rows of ``keys`` (rows, bytes) as unsigned big-endian numbers: least significant two bytes first, each pass
    stable."""
    digits = np.ascontiguousarray(keys).view(">u2").astype(np.uint16)
    order = np.arange(len(keys))
    for k in range(digits.shape[1] - 1, -1, -1):
        column = digits[:, k]
        if len(column) and column.min() != column.max():
            order = order[np.argsort(column[order], kind="stable")]
    return order


def runs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal rows of sorted ``keys`` start, and the sums of their counts."""
    starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))) if len(keys) else np.zeros(0, np.int64)
    return starts, np.add.reduceat(counts, starts) if len(starts) else counts[:0]


def id_bytes(ids: np.ndarray, width: int) -> np.ndarray:
    """(ids, width): each id as ``width`` bytes, the most significant first."""
    return ids.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]


def keys_of(ids: np.ndarray, width: int, longest: int = LONGEST) -> np.ndarray:
    """(places, longest * width): for each place with an id after it, its id and those of the next places, zeros from where the
    piece ends. ``ids`` has 0 wherever a piece breaks."""
    padded = np.concatenate((ids, np.zeros(longest, ids.dtype)))
    after = [padded[k : k + len(ids)] for k in range(longest)]
    for k in range(1, longest):
        after[k] = np.where(after[k - 1] == 0, 0, after[k])
    kept = np.flatnonzero(after[1])
    return np.concatenate([id_bytes(a[kept], width) for a in after], 1)


def _counted_keys(codes: pa.Table, known: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's keys in order, each once, and how often it stands there; from its row and the ids of its words (at, id)."""
    size = codes.column("size")[0].as_py()
    numbers = _unpacked(codes.column("codes")[0].as_py(), size, np.int32)
    ids = np.zeros(int(numbers.max()) + 1, np.int64)
    ids[known.column("at").to_numpy()] = known.column("id").to_numpy()
    keys = keys_of(ids[numbers], width)
    keys = keys[radix_order(keys)]
    starts, sums = runs(keys, np.ones(len(keys), np.int64))
    return keys[starts], sums


def _as_bytes(keys: np.ndarray) -> np.ndarray:
    """Rows as values that numpy compares byte by byte."""
    return np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel()


def _cuts(chunks: DataFrame, ids: DataFrame, totals: DataFrame, width: int) -> np.ndarray:
    """The keys at which range partitions start, but the first: quantiles of the keys of some chunks of each language.

    A language's chunks that are looked at are its first by name, and of the rest those by hash, ``SAMPLED`` in all about. Only how
    even the partitions are depends on it. Every ``EVERY``-th key comes to the driver.
    """
    n = chunks.count()
    first = chunks.groupBy("lang").agg(F.min("chunk").alias("first"))
    some = chunks.join(first, "lang").where((F.col("chunk") == F.col("first")) | (F.pmod(F.xxhash64("chunk"), F.lit(max(1, n // SAMPLED))) == 0)).drop("first")

    def sampled(codes: pa.Table, known: pa.Table) -> pa.Table:
        if not codes.num_rows or not known.num_rows:
            return pa.table({"lang": pa.array([], pa.string()), "key": pa.array([], pa.binary())})
        keys, counts = _counted_keys(codes, known, width)
        at = np.searchsorted(np.cumsum(counts), np.arange(EVERY // 2, counts.sum(), EVERY)) if len(keys) else []
        return pa.table({"lang": pa.array([codes.column("lang")[0].as_py()] * len(at), pa.string()), "key": pa.array([keys[i].tobytes() for i in at], pa.binary())})

    wanted = ids.join(some.select("chunk"), "chunk", "left_semi")
    drawn = some.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(sampled, "lang string, key binary").collect()
    weight = {r.lang: r.total for r in totals.join(some.select("lang").distinct(), "lang", "left_semi").collect()}
    per = Counter(r.lang for r in drawn)
    drawn = sorted((bytes(r.key), weight[r.lang] / per[r.lang]) for r in drawn)
    upto = np.cumsum([w for _, w in drawn])
    parts = int(upto[-1] // PART) + 1 if len(upto) else 1
    at = np.searchsorted(upto, np.arange(1, parts) * (upto[-1] / parts)) if parts > 1 else []
    return np.array(sorted({drawn[i][0] for i in at}), f"S{LONGEST * width}")


def _dealt(chunks: DataFrame, ids: DataFrame, cuts: np.ndarray, width: int) -> DataFrame:
    """(part, size, keys, counts): each chunk's keys in order, cut at ``cuts``; column by column, compressed."""

    def batches(codes: pa.Table, known: pa.Table) -> pa.Table:
        rows = []
        if codes.num_rows and known.num_rows:
            keys, counts = _counted_keys(codes, known, width)
            edges = [0, *np.searchsorted(_as_bytes(keys), cuts).tolist(), len(keys)]
            for part, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                if z > a:
                    rows.append({"part": part, "size": z - a, "keys": _packed(keys[a:z].T), "counts": _packed(counts[a:z].astype(np.int32))})
        return pa.Table.from_pylist(rows, pa.schema([("part", pa.int32()), ("size", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return chunks.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(batches, "part int, size long, keys binary, counts binary")


def _phrase_runs(dealt: DataFrame, width: int, least: int) -> DataFrame:
    """(key, n) of the range partitions: phrases that stand ``least`` times in their partition, and those at its ends, with counts."""

    def batches(part: pa.Table) -> pa.Table:
        rows = part.select(["size", "keys", "counts"]).to_pylist()
        keys = np.concatenate([_unpacked(r["keys"], r["size"] * LONGEST * width, np.uint8).reshape(-1, r["size"]).T for r in rows])
        counts = np.concatenate([_unpacked(r["counts"], r["size"], np.int32) for r in rows]).astype(np.int64)
        del rows
        order = radix_order(keys)
        keys, counts = keys[order], counts[order]
        found, sums = [], []
        for words in range(2, LONGEST + 1):
            starts, n = runs(keys[:, : words * width], counts)
            ends = (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)
            full = keys[starts, (words - 1) * width : words * width].any(1)
            kept = np.flatnonzero(full & (ends | (n >= least)))
            found += [keys[i, : words * width].tobytes() for i in starts[kept]]
            sums.append(n[kept])
        return pa.table({"key": pa.array(found, pa.binary()), "n": pa.array(np.concatenate(sums), pa.int64())})

    return dealt.groupBy("part").applyInArrow(batches, "key binary, n long")


def frequent_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(words, phrases, totals, width): the dictionary (lang, word, n, rank, key), phrases of two to four words (key, n), and the
    occurrences of all words per language (lang, total); keys hold ``width`` bytes per word."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    texts = docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("text")).where("text != ''")
    coded = materialise(texts.mapInArrow(_coded, _CODED), "phrase-codes")
    listed = coded.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    listed = listed.select("chunk", "lang", (F.col("at") + 1).cast("int").alias("at"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    counts = materialise(listed.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrase-words")
    totals = coded.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total"))
    width = max(1, (counts.count().bit_length() + 7) // 8)
    ranked = sorted_ranks(counts.select("lang", "word"), ["lang", "word"])
    key = F.substring(F.unhex(F.lpad(F.hex("rank"), 16, "0")), 9 - width, width)
    words = counts.join(ranked, ["lang", "word"]).select("lang", "word", "n", F.col("rank").cast("long").alias("rank"), key.alias("key"))
    words = materialise(words, "phrase-dictionary")
    ids = listed.join(words.select("lang", "word", "rank"), ["lang", "word"]).select("chunk", "at", F.col("rank").alias("id"))
    ids = materialise(ids, "phrase-ids")
    chunks = coded.select("chunk", "lang", "size", "codes")
    cuts = _cuts(chunks, ids, totals, width)
    phrases = _phrase_runs(_dealt(chunks, ids, cuts, width), width, least).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return words, materialise(phrases, "phrases"), totals, width


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, first: int = FIRST, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases by score, of those that no longer phrase with at
    least ``share`` hundredths of their occurrences holds."""
    words, phrases, totals, width = frequent_phrases(docs, text_col=text_col, lang_col=lang_col, least=least)
    size = F.floor(F.octet_length("key") / width).cast("int")
    some = words.select("key", "n").unionByName(phrases)
    # the longest count of a phrase that holds each
    inner = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(0), size - k), lambda i: F.substring(F.col("key"), i * width + 1, k * width)))),
        lambda x: x.isNotNull(),
    )
    held = phrases.where(size > 2).select(F.explode(inner).alias("key"), "n").groupBy("key").agg(F.max("n").alias("longer"))
    exact = "decimal(38,0)"
    free = F.col("longer").isNull() | (F.col("longer").cast(exact) * 100 < F.col("a").cast(exact) * share)
    kept = phrases.withColumnRenamed("n", "a").join(held, "key", "left").where(free).select("key", "a")
    cut = kept.select("key", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("key", "a", "k", F.substring("key", F.lit(1), F.col("k") * width).alias("left"), F.substring(F.col("key"), F.col("k") * width + 1, F.octet_length("key")).alias("right"))
    cut = cut.join(some.select(F.col("key").alias("left"), F.col("n").alias("l")), "left").join(some.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
    score = F.expr(f"CAST(a AS {exact}) * 2000000 DIV (CAST(l AS {exact}) + CAST(r AS {exact}))")
    best = cut.groupBy("key", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    best = materialise(best.select("key", "a", "best.l", "best.r", "best.score"), "phrase-scores")
    spelt = best.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(F.col("key"), i * width + 1, F.lit(width)))).alias("at", "word_key"))
    spelt = spelt.join(words.select(F.col("key").alias("word_key"), "lang", "word"), "word_key").groupBy("key")
    spelt = spelt.agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    # the first of each of a language's parts, then of these
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(64))], ["lang"]):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = (best.join(spelt, "key") if len(by) > 1 else ranked).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    ranked = ranked.join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))
