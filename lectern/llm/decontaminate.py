"""Benchmark decontamination by a generalised suffix automaton over the words of test items.

A window is ``WINDOW`` consecutive words of an item, or all words of a shorter one. Words of a document that lie in an occurrence of
a window are hit.

1. Items are cut into pieces that overlap by a window less one word, so that pieces are short and no window is lost, and dealt by
   hash into blocks of about ``BLOCK`` words: a benchmark of any size is taken block by block, each of bounded size. One block
   holds all of the usual benchmarks.
2. A block's pieces make one suffix automaton over word numbers. Each of its states stands for runs of words with the same ends.
   States whose runs include one of exactly a window's length list the items that hold it; states of whole short items list those.
3. Documents stream through it where they lie: after each word the state and length of the longest run that ends there and stands in
   an item. A word that no item holds starts anew, so stretches of known words that are shorter than any window are passed over.
   A length of a window or more hits that many words; suffix links find short items and the window's own state.
4. Of several blocks, a document's spans and items are united.

Limits of length and coverage say which spans go and which documents are given up: :func:`decontaminate`.

Defined cases: null texts have no word; an item without words has no window; items that share an id are one in counts and lists, a
null id is no item's name but its windows hit; a null document id keeps its row; repeated rows get the same result; no item, or an
empty table, gives no hit, or an empty result; other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .license_scan import cleaned

WINDOW = 10
#: Words per block of items, about, and per piece of an item.
BLOCK, PIECE = 1 << 20, 1 << 12
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass
class Automaton:
    """Suffix automaton of several sequences; state 0 is the empty run."""

    window: int = WINDOW
    words: dict[bytes, int] = field(default_factory=dict)
    nexts: list[dict[int, int]] = field(default_factory=lambda: [{}])
    links: list[int] = field(default_factory=lambda: [-1])
    lengths: list[int] = field(default_factory=lambda: [0])
    #: state -> items whose window, or whose whole words, is the run of ``window`` words, or the longest, of that state
    windows: dict[int, set[str]] = field(default_factory=dict)
    shorts: dict[int, set[str]] = field(default_factory=dict)
    #: state -> nearest state with a short item along the suffix links, itself included; 0 for none
    short_above: list[int] = field(default_factory=list)
    least: int = WINDOW
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @staticmethod
    def of(pieces: list[tuple[str | None, bytes]], window: int = WINDOW) -> Automaton:
        """From pieces (item id, words parted by spaces)."""
        made = Automaton(window)
        runs = [(item, [made.words.setdefault(w, len(made.words)) for w in text.split()]) for item, text in pieces]
        runs = [(item, run) for item, run in runs if run]
        for _, run in runs:
            last = 0
            for word in run:
                last = made._grown(last, word)
        made._name(runs)
        size = max(1, len(made.words))
        made.pairs = np.unique(np.array([a * size + b for _, run in runs for a, b in zip(run, run[1:], strict=False)], np.int64))
        return made

    def _state(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.nexts.append(nexts)
        self.lengths.append(length)
        self.links.append(link)
        return len(self.links) - 1

    def _split(self, at: int, word: int) -> int:
        """The state of the run of ``at`` and ``word``, apart from those of longer runs."""
        there, length = self.nexts[at][word], self.lengths[at] + 1
        if self.lengths[there] == length:
            return there
        apart = self._state(length, dict(self.nexts[there]), self.links[there])
        self.links[there] = apart
        while at != -1 and self.nexts[at].get(word) == there:
            self.nexts[at][word] = apart
            at = self.links[at]
        return apart

    def _grown(self, last: int, word: int) -> int:
        """One more word after the run of state ``last``; the state of the longer run."""
        if word in self.nexts[last]:
            return self._split(last, word)
        made, at = self._state(self.lengths[last] + 1, {}, 0), last
        while at != -1 and word not in self.nexts[at]:
            self.nexts[at][word] = made
            at = self.links[at]
        if at != -1:
            self.links[made] = self._split(at, word)
        return made

    def _name(self, runs: list[tuple[str | None, list[int]]]) -> None:
        for item, run in runs:
            at = 0
            for n, word in enumerate(run, 1):
                at = self.nexts[at][word]
                if n >= self.window:
                    self.windows.setdefault(self._windowed(at), set()).update([] if item is None else [item])
            if len(run) < self.window:
                self.shorts.setdefault(at, set()).update([] if item is None else [item])
        self.least = min([self.window, *(self.lengths[s] for s in self.shorts)])
        self.short_above = [0] * len(self.links)
        for s in sorted(range(1, len(self.links)), key=self.lengths.__getitem__):
            self.short_above[s] = s if s in self.shorts else self.short_above[self.links[s]]

    def _windowed(self, state: int) -> int:
        """The state, along the suffix links, whose runs include one of a window's length."""
        while self.lengths[self.links[state]] >= self.window:
            state = self.links[state]
        return state

    def _neighbours(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each of ``pairs`` stands in some item."""
        if not len(self.pairs):
            return np.zeros(len(pairs), bool)
        return self.pairs[np.searchsorted(self.pairs, pairs).clip(max=len(self.pairs) - 1)] == pairs

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Where a window may stand: known words, each pair of neighbours in some item, of the shortest window's length at least."""
        known = ids >= 0
        if self.least > 1:
            pair = ids[:-1].astype(np.int64) * max(1, len(self.words)) + ids[1:]
            joined = known[:-1] & known[1:]
            at = np.flatnonzero(joined)
            joined[at] = self._neighbours(pair[at])
            edges = np.flatnonzero(np.diff(np.concatenate(([0], joined.astype(np.int8), [0]))))
            spans = [(a, z + 1) for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        else:
            edges = np.flatnonzero(np.diff(np.concatenate(([0], known.astype(np.int8), [0]))))
            spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        return [(a, z) for a, z in spans if z - a >= self.least]

    def spans(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (start, end), apart from each other, and the items whose windows occur."""
        out: list[tuple[int, int]] = []
        items: set[str] = set()
        seen: set[int] = set()
        for a, z in self.stretches(ids):
            state, length = 0, 0
            for at, word in enumerate(ids[a:z].tolist(), a + 1):
                while state and word not in self.nexts[state]:
                    state = self.links[state]
                    length = self.lengths[state]
                state = self.nexts[state].get(word, 0)
                length = length + 1 if state else 0
                hit = length if length >= self.window else 0
                if hit and (w := self._windowed(state)) not in seen:
                    seen.add(w)
                    items |= self.windows[w]
                short = self.short_above[state]
                # the runs of a state are as long as its longest only if what was read is that long
                if short == state and self.lengths[state] > length:
                    short = self.short_above[self.links[state]]
                while short:
                    hit = max(hit, self.lengths[short])
                    if short not in seen:
                        seen.add(short)
                        items |= self.shorts[short]
                        short = self.short_above[self.links[short]]
                    else:
                        break
                if hit:
                    start = at - hit
                    while out and out[-1][1] >= start:
                        start = min(start, out.pop()[0])
                    out.append((start, at))
        return out, items


def _pieces(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words): pieces of items of at most ``PIECE`` words; neighbours share a window less one word."""
    words = F.split(cleaned(F.col(text_col)), " ")
    rows = items.select(F.col(id_col).cast("string").alias("item"), words.alias("words")).where("words[0] != ''")
    step = PIECE - window + 1
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(step))
    cut = F.transform(starts, lambda a: F.array_join(F.slice("words", a + 1, F.lit(PIECE)), " "))
    return rows.select("item", F.explode(cut).alias("words")).distinct()


def _found(docs: DataFrame, automaton: Automaton, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, n_words, spans, items) of every document. Narrow: nothing is shuffled."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton.words.get
        for part in parts:
            counts, spans, items = [], [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                words = text.translate(_PLAIN).split() if text else []
                ids = np.fromiter(map(known, words, repeat(-1)), np.int32, len(words))
                hit, named = automaton.spans(ids) if len(ids) >= automaton.least else ([], set())
                counts.append(len(words))
                spans.append([{"start": a, "end": z} for a, z in hit])
                items.append(sorted(named))
            arrays = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *arrays], ["doc_id", "key", "n_words", "spans", "items"])

    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    return slim.mapInArrow(batches, "doc_id long, key long, n_words long, spans array<struct<start:int,end:int>>, items array<string>")


def _united(spans: Column) -> Column:
    """Spans that touch, as one; apart and in order."""

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        touches = F.coalesce(last["end"] >= s["start"], F.lit(False))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(touches, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int>>"), step)


def overlaps(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, key, n_words, spans, items) of every document: the spans of words (start, end) that windows hit, apart and in order,
    and the ids of the items that have a window there. ``key`` tells rows of unlike id or text apart."""
    pieces = materialise(_pieces(items, item_col, item_text_col, window), "benchmark-pieces")
    total = pieces.agg(F.coalesce(F.sum(F.size(F.split("words", " "))), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block))
    found = []
    for b in range(blocks):
        # what comes to the driver is one block of items, about ``block`` words
        held = pieces.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).select("item", "words").collect()
        automaton = Automaton.of(sorted(((r.item, r.words.encode()) for r in held), key=lambda x: (x[1], x[0] or "")), window)
        found.append(_found(docs, automaton, id_col, text_col))
    if blocks == 1:
        return found[0]
    met = reduce(DataFrame.unionByName, (materialise(f.where("size(spans) > 0").select("key", "spans", "items").distinct(), "benchmark-hits") for f in found))
    met = met.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    met = materialise(met.select("key", _united(F.col("spans")).alias("spans"), "items"), "benchmark-spans")
    none = [F.array().cast(t) for t in ("array<struct<start:int,end:int>>", "array<string>")]
    every = found[-1].select("doc_id", "key", "n_words").join(met, "key", "left")
    return every.select("doc_id", "key", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of ``spans`` (numbers of words) and what stands between them."""
    if not spans:
        return text
    low, places, out, at = text.translate(_PLAIN), [], [], 0
    places = [m.span() for m in _WORDS.finditer(low)]
    for a, z in spans:
        out.append(text[at : places[a][0]])
        at = places[z - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, longest: int = WINDOW, coverage: float = 0.5,
) -> DataFrame:
    """``docs``, with all their columns, without the hit spans of ``longest`` words or more; documents of which more than ``coverage``
    of the words are hit go."""
    hits = overlaps(docs, items, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col, window=window)
    # only documents that are hit take part in the join: their keys and spans
    hits = materialise(hits.where("size(spans) > 0").select("key", "n_words", "spans").dropDuplicates(["key"]), "benchmark-found")
    hits = hits.select(F.col("key").alias("__key"), F.col("n_words").alias("__n"), F.col("spans").alias("__spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t.encode(), [(s["start"], s["end"]) for s in held if s["end"] - s["start"] >= longest]).decode() for t, held in zip(texts, spans, strict=True)])

    key = F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    rows = docs.select(F.struct("*").alias("__row"), key.alias("__key")).join(hits, "__key", "left")
    kept = rows.where(F.col("__n").isNull() | (n_hit(F.col("__spans")) <= F.col("__n") * coverage))
    clean = kept.where("__n IS NULL").select("__row.*")
    held = kept.where("__n IS NOT NULL")
    text = F.col(f"__row.{text_col}")
    return clean.unionByName(held.select(*[cut(text, F.col("__spans")).alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))
