"""Secret scans through a trigram inverted index (DataFrame functions only).

Each rule's regular expression is read for the strings that any match must hold; their trigrams make a Boolean query, an OR of
ANDs. The index lists, for every trigram that some query asks for, the documents that hold it (in lower case, so that rules of
either case are served). Postings are intersected per document, and only documents that a query lets through meet the rule's
expression. A rule without mandatory trigrams (the hex runs) scans every text.

Spans come from Spark's own regular expressions: the text between matches and the matches themselves give each match's place,
in code points, by running sums of their lengths.

Defined cases: null texts are empty and have no span; rows that repeat share their postings and get the same spans; a null id is
kept; texts of any length are scanned whole; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C  # the standard library's own parse of a regular expression
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters are spans of ``kind``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in the order in which spans that start together are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ that are long enough
)
#: Formats that providers document for their credentials.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"://[A-Za-z0-9_.-]{1,64}:[A-Za-z0-9_.!$%*+-]{4,64}@"),
)

#: Matches of a text that are measured together.
RUN = 256

Query = frozenset  # of alternatives, each a frozenset of trigrams that must all be there


def _strings(node: tuple, most: int = 64) -> list[str] | None:
    """All strings that a parsed piece can match, if they are few."""
    kind, arg = node
    if kind is C.LITERAL:
        return [chr(arg)]
    if kind is C.IN:
        chars = []
        for k, a in arg:
            if k is C.LITERAL:
                chars.append(chr(a))
            elif k is C.RANGE and a[1] - a[0] < 8:
                chars += map(chr, range(a[0], a[1] + 1))
            else:
                return None
        return chars if len(chars) <= 8 else None
    if kind is C.SUBPATTERN:
        return _sequence(list(arg[3]), most)
    if kind is C.BRANCH:
        parts = [_sequence(list(x), most) for x in arg[1]]
        return None if any(p is None for p in parts) else [s for p in parts for s in p]
    if kind is C.MAX_REPEAT and arg[0] in (0, 1) and arg[1] == 1:
        inner = _sequence(list(arg[2]), most)
        return None if inner is None else ([""] if arg[0] == 0 else []) + inner
    return None


def _sequence(nodes: list[tuple], most: int) -> list[str] | None:
    found = [""]
    for node in nodes:
        more = _strings(node, most)
        if more is None or len(found) * len(more) > most:
            return None
        found = [a + b for a, b in product(found, more)]
    return found


def _ask(strings: list[str]) -> Query | None:
    """OR over ``strings`` of the AND of their trigrams; None (no condition) if one has none."""
    asks = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in map(str.lower, strings)}
    if frozenset() in asks:
        return None
    return Query(a for a in asks if not any(b < a for b in asks))


def trigram_queries(pattern: str) -> list[Query]:
    """Queries that must all hold in a text with a match of ``pattern``; none if nothing is mandatory."""
    nodes, runs, run = list(_parser.parse(pattern)), [], [""]
    for node in nodes:
        more = _strings(node)
        if more is not None and len(run) * len(more) <= 64:
            run = [a + b for a, b in product(run, more)]
            continue
        if more is None and node[0] is C.MAX_REPEAT and node[1][0] >= 1:  # at least one of something: the run breaks here
            more = None
        runs.append(run)
        run = more or [""]
    runs.append(run)
    return [q for q in map(_ask, runs) if q]


def index(docs: DataFrame, text: Column, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, trigram): the documents, by the key column ``key`` of ``docs``, that hold each trigram which the rules ask for."""
    wanted = sorted({t for r in rules for q in trigram_queries(r.pattern) for ask in q for t in ask})
    every = F.array(*map(F.lit, wanted))
    held = let(F.lower(text), lambda low: F.filter(every, lambda t: F.contains(low, t)))
    return docs.select("key", F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): for each document that some rule's query lets through, the kinds of those rules."""
    held = postings.groupBy("key").agg(F.collect_set("trigram").alias("held"))

    def lets(rule: Rule) -> Column:
        ands = [reduce(Column.__or__, [F.size(F.array_except(F.array(*map(F.lit, sorted(ask))), "held")) == 0 for ask in sorted(q, key=sorted)]) for q in trigram_queries(rule.pattern)]
        return reduce(Column.__and__, ands)

    kinds = F.array_compact(F.array(*[F.when(lets(r), F.lit(r.kind)) for r in rules]))
    return held.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, place, kind, end>> of a rule's matches that are long enough, in code points. Matches are measured in runs of
    ``RUN``, each from its own start, which are then moved by the length of those before: no array is copied once per match."""
    pattern = F.lit(rule.pattern)
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    steps = F.arrays_zip(found.alias("found"), F.slice(between, 1, F.size(found)).alias("before"), measured.alias("measured"))
    span = "struct<start:bigint,place:int,kind:string,end:bigint>"
    none, runs = F.array().cast(f"array<{span}>"), F.array().cast(f"array<array<{span}>>")
    zero = F.lit(0).cast("bigint").alias("at")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["before"])
        end = start + F.length(x["found"])
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        keeps = F.when(F.length(x["measured"]) >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), keeps.alias("spans"))

    def move(state: Column, run: Column) -> Column:
        at = state["at"]
        moved = F.transform(run["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["place"].alias("place"), s["kind"].alias("kind"), (s["end"] + at).alias("end")))
        return F.struct((at + run["at"]).alias("at"), F.concat(state["runs"], F.array(moved)).alias("runs"))

    def measure(steps: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(steps), F.lit(RUN))
        measures = F.transform(starts, lambda i: F.aggregate(F.slice(steps, i, F.lit(RUN)), F.struct(zero, none.alias("spans")), step))
        return F.aggregate(measures, F.struct(zero, runs.alias("runs")), move, lambda s: F.flatten(s["runs"]))

    return F.when(F.size(found) > 0, let(steps, measure)).otherwise(none)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """(doc_id, base, spans): each document's spans of the base kinds and of all kinds, as arrays ordered by start, then kind."""
    rules = base + more
    asked = tuple(r for r in rules if trigram_queries(r.pattern))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    passed = materialise(candidates(index(slim, F.col("text"), asked), asked), "secret-candidates")
    rows = slim.join(passed, "key", "left").select("doc_id", "text", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    found = [
        F.when(F.array_contains("kinds", r.kind), _spans(F.col("text"), r, i)).otherwise(none) if r in asked else _spans(F.col("text"), r, i)
        for i, r in enumerate(rules)
    ]
    rows = rows.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))
    return rows.select("doc_id", F.filter("spans", lambda s: s["place"] < len(base)).alias("base"), "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def matches_in(text: str, rule: Rule) -> list[tuple[str, int, int]]:
    """What :func:`scan` must find of a rule in one text, by Python's own matcher; for tests."""
    return [(rule.kind, m.start(), m.end()) for m in re.finditer(rule.pattern, text, re.ASCII) if len(m[rule.group]) >= rule.least]
