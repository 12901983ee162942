"""A Spark data source for archives: members stream into the parsers, none of them held as a row, nor the archive.

``spark.dataSource.register(source()); spark.read.format("archived_documents").load("folder")`` gives a row per member: archive, name,
size, format, markdown, error and, for those left out, why (``skipped``). Members of a ZIP file are split into partitions by its
directory, and read from where they lie; other archives are read from start to end by one task each. The files may be in any store
that Arrow opens.
"""

from __future__ import annotations

import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import FORMATS, MOST_BYTES, MOST_FILES, PARSERS, left_out

#: Members of a ZIP file per partition; code points that a parsed file has at least, if it is of a format that is built, not written.
MEMBERS, LEAST = 64, 20
SCHEMA = "archive string, name string, size long, format string, markdown string, error string, skipped string"
Parser = Callable[[bytes, str], str]


def format_of(name: str) -> str | None:
    ext = name.lower().rpartition(".")[2] if "." in name else ""
    return next((kind for kind, known in FORMATS.items() if ext in known), None)


def parsed(content: bytes, name: str, parsers: dict[str, Parser], fallback: Parser | None) -> tuple[str | None, str | None]:
    """(markdown, error) of a file. What a parser raises, or gives too little of, goes to ``fallback``; its own error says both."""
    kind = format_of(name)
    if kind not in parsers:
        return None, "no parser"
    try:
        text = parsers[kind](content, name).strip()
        why = None if len(text) >= (1 if kind == "text" else LEAST) else f"too little: {len(text)} characters" if text else "empty"
    except Exception as e:  # a bad file is a row, not a failed job
        text, why = "", f"{type(e).__name__}: {e}"
    if why is None:
        return text, None
    if fallback is None or kind == "text":
        return None, why
    try:
        text = fallback(content, name).strip()
    except Exception as e:
        return None, f"{why}; fallback: {type(e).__name__}: {e}"
    return (text, None) if text else (None, f"{why}; fallback: empty")


@dataclass
class Members(InputPartition):
    """Members of an archive: those of these names, or all if there are none; or what is wrong with it."""

    archive: str
    names: tuple[str, ...] = ()
    skipped: tuple[tuple[str, int, str], ...] = ()
    error: str | None = None

    def __post_init__(self) -> None:
        super().__init__(self.archive)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Reader(DataSourceReader):
    def __init__(self, path: str, parsers: dict[str, Parser], fallback: Parser | None):
        self.path, self.parsers, self.fallback = path, parsers, fallback

    def partitions(self) -> list[Members]:
        """ZIP directories are read here: names and sizes, no content."""
        store, path = _store(self.path)
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted(f.path for f in found if f.is_file and f.path.lower().endswith((".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2")))
        return [p for f in files for p in self._split(store, f)]

    def _split(self, store: fs.FileSystem, path: str) -> Iterator[Members]:
        if not path.lower().endswith(".zip"):
            yield Members(path)
            return
        try:
            with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                every = [(m.filename, m.file_size, (m.external_attr >> 28) == 0xA) for m in z.infolist() if not m.is_dir()]
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            yield Members(path, error=f"unreadable: {e}")
            return
        taken, skipped = chosen(every)
        for a in range(0, len(taken), MEMBERS):
            yield Members(path, tuple(taken[a : a + MEMBERS]))
        if skipped:
            yield Members(path, skipped=tuple(skipped))

    def read(self, part: Members) -> Iterator[tuple]:
        if part.error:
            yield part.archive, None, None, None, None, part.error, None
        for name, size, why in part.skipped:
            yield part.archive, name, size, None, None, None, why
        if part.error or part.skipped:
            return
        store, path = _store(self.path)
        try:
            with store.open_input_file(part.archive) as f:
                if part.names:
                    with zipfile.ZipFile(f) as z:
                        for name in part.names:
                            yield self._row(part.archive, name, z.getinfo(name).file_size, lambda name=name, z=z: z.read(name))
                else:
                    yield from self._tar(part.archive, f)
        except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError) as e:
            yield part.archive, None, None, None, None, f"unreadable: {e}", None

    def _tar(self, archive: str, f: object) -> Iterator[tuple]:
        taken, room = 0, MOST_BYTES
        with tarfile.open(fileobj=f, mode="r:*") as t:
            for m in t:
                if m.isdir():
                    continue
                why = left_out(m.name, m.size, not m.isfile()) or ("too many" if taken >= MOST_FILES else "too large" if m.size > room else None)
                if why:
                    yield archive, m.name, m.size, None, None, None, why
                    continue
                taken, room = taken + 1, room - m.size
                yield self._row(archive, m.name, m.size, lambda m=m, t=t: t.extractfile(m).read())

    def _row(self, archive: str, name: str, size: int, content: Callable[[], bytes]) -> tuple:
        try:
            data = content()
        except Exception as e:  # a member that cannot be read keeps no other from it
            return archive, name, size, format_of(name), None, f"{type(e).__name__}: {e}", None
        text, error = parsed(data, name, self.parsers, self.fallback)
        return archive, name, size, format_of(name), text, error, None


def chosen(members: list[tuple[str, int, bool]]) -> tuple[list[str], list[tuple[str, int, str]]]:
    """(names taken, (name, size, why) of those left out) of an archive's members (name, size, link), within its limits. A member that
    doesn't fit keeps none after it from being taken."""
    taken, skipped, room = [], [], MOST_BYTES
    for name, size, link in members:
        why = left_out(name, size, link) or ("too many" if len(taken) >= MOST_FILES else "too large" if size > room else None)
        if why:
            skipped.append((name, size, why))
        else:
            taken.append(name)
            room -= size
    return taken, skipped


def source(parsers: dict[str, Parser] | None = None, fallback: Parser | None = None) -> type[DataSource]:
    """The data source ``archived_documents`` with these parsers by format, beside the known ones, and a parser for what they fail at."""
    known = PARSERS | (parsers or {})

    class ArchivedDocuments(DataSource):
        @classmethod
        def name(cls) -> str:
            return "archived_documents"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: object) -> Reader:
            return Reader(self.options["path"], known, fallback)

    return ArchivedDocuments
