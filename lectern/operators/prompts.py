"""What goes to a model and comes from a user: numbered sources, transcripts, titles, page texts, one-time codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens

# The wording of prompts.
SOURCES, USER, ASSISTANT, PURPOSE, NOTES = "【资料】\n\n", "用户：", "助手：", "用途：", "补充："
#: Longest purpose and notes of a group, and longest title of a conversation, in characters.
MOST_CONTEXT, MOST_TITLE = 300, 20


def _joined(rows: DataFrame, key: str, order: list[str], line: Column, glue: str) -> tuple[DataFrame, Column]:
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("__line"))))
    return rows.groupBy(key), F.array_join(F.transform(lines, lambda x: x["__line"]), glue)


def source_blocks(rows: DataFrame, key: str, order: list[str], number: Column, label: Column, text: Column) -> DataFrame:
    """(key, block): the rows of each key as numbered sources, in ``order``."""
    line = F.concat(F.lit("["), number.cast("string"), F.lit("]（"), label, F.lit("）\n"), text)
    groups, body = _joined(rows, key, order, line, "\n\n")
    return groups.agg(F.concat(F.lit(SOURCES), body).alias("block"))


def transcripts(rows: DataFrame, key: str, order: list[str], role: Column, text: Column) -> DataFrame:
    """(key, transcript): the turns of each key, one to a line, with who speaks."""
    groups, body = _joined(rows, key, order, F.concat(F.when(role == "user", USER).otherwise(ASSISTANT), text), "\n")
    return groups.agg(body.alias("transcript"))


def conversation_titles(rows: DataFrame, key: str, order: list[str], text: Column) -> DataFrame:
    """(key, title): the head of each key's first turn."""
    return rows.groupBy(key).agg(F.left(F.min_by(text, F.struct(*order)), F.lit(MOST_TITLE)).alias("title"))


def group_context(purpose: Column, notes: Column) -> Column:
    """A group's purpose and notes, one to a line; null ones are left out."""
    parts = [F.concat(F.lit(head), F.left(what, F.lit(MOST_CONTEXT))) for head, what in ((PURPOSE, purpose), (NOTES, notes))]
    return F.concat_ws("\n", *parts)


def page_text(document: Column, number: Column, title: Column, text: Column, budget: int) -> Column:
    """A page as a model reads it: where it is from, and its text, cut in proportion where it is over ``budget`` tokens."""
    size = estimate_tokens(text)
    head = F.concat(F.lit("【"), document, F.lit(" 第"), number.cast("string"), F.lit("页 · "), title, F.lit("】\n"))
    cut = F.greatest(F.lit(1), F.floor(F.length(text) * F.lit(float(budget)) / size).cast("int"))
    return F.when(size > budget, F.concat(head, F.left(text, cut), F.lit("…"))).otherwise(F.concat(head, text))


# How long a code holds and must wait for the next, in seconds, and how often it may be tried.
CODE_HOLDS, CODE_WAITS, CODE_TRIES = 600, 60, 5


def check_code(code_hash: Column, expires_at: Column, attempts: Column, code: Column, now: Column) -> Column:
    """ok, wrong or expired: a code that isn't there, is past its time or has been tried too often is expired, whatever is entered."""
    gone = code_hash.isNull() | (expires_at < now) | (attempts >= CODE_TRIES)
    return F.when(gone, "expired").when(F.sha2(code, 256) != code_hash, "wrong").otherwise("ok")


def in_cooldown(last_sent: Column, now: Column) -> Column:
    """Whether the next code must wait."""
    return last_sent > now - F.expr(f"INTERVAL {CODE_WAITS} SECONDS")


def expires(sent: Column) -> Column:
    return sent + F.expr(f"INTERVAL {CODE_HOLDS} SECONDS")
