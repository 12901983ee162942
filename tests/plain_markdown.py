"""Chunks and pages of markdown in plain Python, line by line: what the operators are held against."""

import math
import re
from collections import Counter

from lectern.functions.text import CJK

HEADING, FENCE, ROW = re.compile(r"^(#{1,6})\s+(.*\S)\s*$"), re.compile(r"^\s*(```|~~~)"), re.compile(r"^\s*\|.*\|\s*$")
SENTENCE = re.compile(r"(?<=[。！？!?\n])")


def estimate(text):
    cjk = sum(bool(re.match(f"[{CJK}]", c)) for c in text)
    return cjk + math.ceil((len(text.encode("utf-16-le")) // 2 - cjk) / 4)


def blocks(text):
    lines, out, at = re.sub(r"\r\n?", "\n", text).split("\n"), [], 0
    while at < len(lines):
        line, first = lines[at], at
        at += 1
        if fence := FENCE.match(line):
            while at < len(lines) and not lines[at].lstrip().startswith(fence[1]):
                at += 1
            at += 1
            out.append(("code", "\n".join(lines[first:at]), 0, ""))
        elif head := HEADING.match(line):
            out.append(("heading", line.strip(), len(head[1]), head[2]))
        elif ROW.match(line):
            while at < len(lines) and ROW.match(lines[at]):
                at += 1
            out.append(("table", "\n".join(lines[first:at]), 0, ""))
        elif line.strip():
            while at < len(lines) and lines[at].strip() and not (FENCE.match(lines[at]) or HEADING.match(lines[at]) or ROW.match(lines[at])):
                at += 1
            out.append(("para", "\n".join(lines[first:at]).strip(), 0, ""))
    return out


def sentences(text):
    return [s for s in SENTENCE.split(text) if s.strip()]


def packed(pieces, target):
    out = [""]
    for piece in pieces:
        if out[-1] and estimate(out[-1] + piece) > target:
            out.append("")
        out[-1] += piece
    return [p.strip() for p in out if p.strip()]


def tail_of(text, budget):
    tail = ""
    for piece in reversed(sentences(text)) if budget > 0 else ():
        if tail and estimate(piece + tail) > budget:
            break
        tail = piece + tail
    return tail.strip()


def cells(line):
    line = re.sub(r"\|\s*$", "", re.sub(r"^\s*\|", "", line))
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", line)]


def group_column(rows):
    best, top, n = -1, 0.0, len(rows)
    for j in range(max(map(len, rows))) if n >= 4 else ():
        values = [r[j] if j < len(r) else "" for r in rows]
        filled = [v for v in values if v]
        distinct, runs = len(set(filled)), 1 + sum(a != b for a, b in zip(values, values[1:]))
        if len(filled) >= n / 2 and 2 <= distinct <= n / 2 and distinct / runs >= 0.8 and distinct / runs * (1 - distinct / n) > top:
            best, top = j, distinct / runs * (1 - distinct / n)
    return best


def plain(x):
    return str(int(x)) if x == int(x) else repr(x)


def overview(title, header, rows):
    n, named = len(rows), [h for h in header if h]
    if n < 4:
        return None
    out = [(f"{title} — " if title else "") + f"表格概览：共 {n} 行数据、{len(named)} 列。"] + ([f"列名：{' | '.join(named)}。"] if named else [])
    for j, name in enumerate(header):
        values = [r[j] for r in rows if j < len(r) and r[j]]
        distinct = list(dict.fromkeys(values))
        numbers = [float(d) for d in (re.sub("[,，]", "", v) for v in values) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", d)]
        if values and len(distinct) <= min(40, n / 2):
            out.append(f"「{name or f'第{j + 1}列'}」取值：{'、'.join(distinct)}。")
        elif values and len(numbers) >= 0.8 * len(values):
            out.append(f"「{name or f'第{j + 1}列'}」数值区间 {plain(min(numbers))} ~ {plain(max(numbers))}。")
    return "\n".join(out) if len(out) > 1 else None


def row_packs(top, rows, target, most):
    group, out, now = group_column([cells(r) for r in rows]), [], []
    key = lambda r: (cells(r) + [""] * 99)[group] if group >= 0 else ""
    for r in rows:
        full = now and (key(r) != key(now[0]) or estimate("\n".join([top, *now, r])) > most)
        if full or now and group < 0 and estimate("\n".join([top, *now])) >= target:
            out.append(now)
            now = []
        now = [*now, r]
    return ["\n".join([top, *p]) for p in [*out, now]]


def chunks(text, title="", target=700, most=800, overlap=80, row_mode=False, summary=True):
    """[(content, type, path, is_row)]"""
    out, parts, size, body, stack = [], [], 0, False, []

    def emit(carry, is_row=False):
        nonlocal parts, size, body
        kinds, content = {k for k, t in parts if t.strip()}, "\n\n".join(t for _, t in parts).strip()
        kind = kinds.pop() if len(kinds) == 1 else "text"
        if content:
            out.append((content, kind, [t for _, t in stack], is_row))
        tail = tail_of(content, overlap) if carry and kind == "text" else ""
        parts, size, body = [("text", tail)] if tail else [], estimate(tail), False

    def push(kind, piece):
        nonlocal size, body
        if body and size + estimate(piece) > target:
            emit(True)
        parts.append((kind, piece))
        size, body = size + estimate(piece), True

    for kind, block, level, name in blocks(text):
        if kind == "heading":
            if body:
                emit(False)
            stack = [*(s for s in stack if s[0] < level), (level, name)]
            parts.append(("text", block))
            size += estimate(block)
        elif kind == "table" and row_mode:
            if body:
                emit(False)
            lines = [x for x in block.split("\n") if x.strip()]
            parted = len(lines) > 1 and "-" in lines[1] and not re.sub(r"[\s|:-]", "", lines[1])
            top, rows = "\n".join(lines[: 1 + parted]), lines[1 + parted :]
            above = overview(stack[-1][1] if stack else title, cells(lines[0]), [cells(r) for r in rows]) if rows and summary else None
            for piece in [*([above] if above else []), *(row_packs(top, rows, target, most) if rows else [block])]:
                parts = [("table", piece)]
                emit(False, True)
        elif kind == "para":
            for piece in packed(sentences(block), target) if estimate(block) > most else [block]:
                push("text", piece)
        elif estimate(block) > most:
            if parts:
                emit(False)
            parts = [(kind, block)]
            emit(False)
        else:
            push(kind, block)
    if body:
        emit(False)
    return out


def pages(text, shrink, most=8000, least=300):
    """[(title, content, path, continued)]; ``shrink`` parts what is too long."""
    lines, found, fence = re.sub(r"\r\n?", "\n", text).split("\n"), [], None
    for at, line in enumerate(lines):
        if mark := FENCE.match(line):
            fence = None if fence == mark[1] else fence or mark[1]
        elif fence is None and (head := HEADING.match(line)):
            found.append((at, len(head[1]), head[2]))
    counts = Counter(level for _, level, _ in found)
    level = min((k for k, n in counts.items() if n >= 2), default=min(counts, default=0))
    made, stack, cuts = [], [], [at for at, depth, _ in found if depth == level]
    for at, depth, title in (h for h in found if h[1] <= level):
        stack = [*(s for s in stack if s[0] < depth), (depth, title)]
        if depth == level:
            k = cuts.index(at)
            body = "\n".join(lines[at if k else 0 : (cuts + [len(lines)])[k + 1]]).strip()
            made += [[title, body, [t for _, t in stack]]] if body else []
    if not found and text.strip():
        made = [["全文", text.strip(), []]]
    merged = []

    def join(a, b):
        larger = b if estimate(b[1]) > estimate(a[1]) else a
        return [larger[0], f"{a[1]}\n\n{b[1]}", larger[2]]

    for page in made:
        if merged and estimate(merged[-1][1]) < least:
            merged[-1] = join(merged[-1], page)
        else:
            merged.append(page)
    if len(merged) > 1 and estimate(merged[-1][1]) < least:
        last = merged.pop()
        merged[-1] = join(merged[-1], last)
    parts = [(t, part, path, k > 0) for t, body, path in merged for k, part in enumerate(shrink(body, most, level))]
    taken, out, numbers = {t for t, _, _, more in parts if not more}, [], Counter()
    for title, part, path, more in parts:
        name = title
        while more and name in taken:
            numbers[title] += 1
            name = f"{title}（续{numbers[title]}）"
        taken.add(name)
        out.append((name, part, path, more))
    return out
