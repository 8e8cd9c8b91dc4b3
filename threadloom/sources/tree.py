"""A folder tree as a data source: spark.read.format("tree"), a row for each file, hidden ones included, without opening any.

Planning lists no more than about ``parts`` folders and keeps no name of a file: it goes down from the root until there are
folders enough for tasks, and a folder of very many is dealt out by hashes of names. Tasks walk on from there. What
ignore files (.gitignore in a git working tree, .ignore anywhere) exclude is decided folder by folder on the way, with the rules
of the folders above handed down, so an excluded folder is neither listed nor entered.

Folders on a local or mounted disk are read with os.scandir; other stores by pyarrow's file systems.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size long, modified timestamp"
BATCH = 4096


@dataclass(frozen=True)
class Entry:
    name: str
    folder: bool
    size: int
    modified: float


class Store:
    """The files below a root, by relative path."""

    def __init__(self, root: str):
        self.local = "://" not in root or root.startswith("file://")
        if self.local:
            self.root = root.removeprefix("file://").rstrip("/") or "/"
        else:
            from pyarrow.fs import FileSystem

            self.system, self.root = FileSystem.from_uri(root.rstrip("/"))

    def at(self, path: str) -> str:
        return os.path.join(self.root, path) if path else self.root

    def entries(self, folder: str) -> Iterator[Entry]:
        """What a folder holds; nothing if it can't be read. Links to files count as files, links to folders don't count."""
        if not self.local:
            from pyarrow.fs import FileSelector, FileType

            for f in self.system.get_file_info(FileSelector(self.at(folder), allow_not_found=True)):
                yield Entry(f.base_name, f.type == FileType.Directory, f.size or 0, f.mtime.timestamp() if f.mtime else 0.0)
            return
        try:
            with os.scandir(self.at(folder)) as found:
                for e in found:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            yield Entry(e.name, True, 0, 0.0)
                        elif e.is_file():
                            s = e.stat()
                            yield Entry(e.name, False, s.st_size, s.st_mtime)
                    except OSError:  # gone meanwhile
                        continue
        except OSError:
            return

    def read(self, path: str) -> bytes | None:
        """None if there is no such file, or it can't be read."""
        try:
            if self.local:
                with open(self.at(path), "rb") as f:
                    return f.read()
            with self.system.open_input_file(self.at(path)) as f:
                return f.read()
        except OSError:
            return None


@dataclass(frozen=True)
class Rules:
    """The lines of one ignore file, and the folder it is in."""

    folder: str
    lines: tuple[str, ...]

    def verdict(self, path: str, is_folder: bool) -> bool | None:
        """Whether the file ignores a path; None where no line matches. The last line that matches counts."""
        inner = path[len(self.folder) + 1 :] if self.folder else path
        for pattern, negated, only_folders in reversed(compiled(self.lines)):
            if (is_folder or not only_folders) and pattern.fullmatch(inner):
                return not negated
        return None


@lru_cache(maxsize=1024)
def compiled(lines: tuple[str, ...]) -> tuple[tuple[re.Pattern, bool, bool], ...]:
    return tuple(x for x in map(rule, lines) if x)


def rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern over the path below the file's folder, negated, for folders only) of a line; none for blanks and comments."""
    line = re.sub(r"(?<!\\)[ \t]+$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    only_folders = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.removeprefix("/")
    if not line:
        return None
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line[i:] == "**" and i and line[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            out += "[^/]*"
            while line.startswith("*", i):
                i += 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := line.find("]", i + 2 + line.startswith(("!", "^"), i + 1))) > 0:
            body = line[i + 1 : end]
            body = ("^/" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\").replace("[", "\\[")
            out, i = f"{out}[{body}]", end + 1
        else:
            i += c == "\\" and i + 1 < len(line)
            out, i = out + re.escape(line[i]), i + 1
    try:
        return re.compile(out, re.S), negated, only_folders
    except re.error:
        return None


@dataclass(frozen=True)
class Walk:
    """How folders are walked: names never entered, and names of ignore files that count."""

    excluded: frozenset[str]
    ignore_files: tuple[str, ...]

    def inside(self, store: Store, folder: str, rules: tuple[Rules, ...]) -> tuple[Rules, ...]:
        """The rules in a folder: those from above and its own, which go before them."""
        for name in self.ignore_files:
            text = store.read(f"{folder}/{name}".lstrip("/"))
            if text:
                rules = (*rules, Rules(folder, tuple(text.decode("utf-8", "replace").split("\n"))))
        return rules

    def admitted(self, store: Store, folder: str, rules: tuple[Rules, ...]) -> Iterator[tuple[str, Entry]]:
        for e in store.entries(folder):
            path = f"{folder}/{e.name}".lstrip("/")
            if e.folder and e.name in self.excluded:
                continue
            verdicts = (r.verdict(path, e.folder) for r in reversed(rules))
            if not next((v for v in verdicts if v is not None), False):
                yield path, e


@dataclass
class Part(InputPartition):
    """A folder for a task: with all below it, without (shallow), or of its entries those whose hash is slot modulo of."""

    folder: str
    rules: tuple[Rules, ...]
    shallow: bool = False
    slot: int = 0
    of: int = 1


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.parts = options["path"], int(options.get("parts", "64"))
        self.git = options.get("gitignore", "true").lower() == "true"
        self.excluded = frozenset(x for x in options.get("excluded", "").split("/") if x)

    def walk(self, store: Store) -> tuple[Walk, tuple[Rules, ...]]:
        """What holds at the root: rules of the folders above it too, within the working tree."""
        names: tuple[str, ...] = (".gitignore", ".ignore") if self.git else (".ignore",)
        above: list[Rules] = []
        if store.local and self.git:
            here, way = os.path.abspath(store.root), []
            while not os.path.exists(os.path.join(here, ".git")):
                parent, name = os.path.split(here)
                if parent == here:
                    return Walk(self.excluded, (".ignore",)), ()  # no working tree: .gitignore says nothing
                way, here = [name, *way], parent
            top = Store(here)
            config = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
            for text in (Store(config).read("git/ignore"), top.read(".git/info/exclude")):
                above += [Rules("", tuple(text.decode("utf-8", "replace").split("\n")))] if text else []
            # paths are relative to the root, so what folders above it say is read as said of the root itself
            for depth in range(len(way)):
                for name in names:
                    if text := top.read("/".join([*way[:depth], name])):
                        above.append(Rules("", tuple(lowered(line, way[depth:]) for line in text.decode("utf-8", "replace").split("\n"))))
        return Walk(self.excluded, names), tuple(above)

    def partitions(self) -> list[Part]:
        store = Store(self.root)
        walk, rules = self.walk(store)
        queue, parts = [("", rules)], []
        while queue and len(queue) + len(parts) < self.parts:
            folder, above = queue.pop(0)
            own = walk.inside(store, folder, above)
            below = []
            for path, e in walk.admitted(store, folder, own):
                if e.folder:
                    below.append(path)
                    if len(below) > self.parts:
                        break
            if len(below) > self.parts:
                parts += [Part(folder, above, False, i, self.parts) for i in range(self.parts)]
            else:
                parts.append(Part(folder, above, True))
                queue += [(path, own) for path in below]
        return parts + [Part(folder, above) for folder, above in queue]

    def read(self, part: Part):
        import pyarrow as pa

        store = Store(self.root)
        walk, _ = self.walk(store)
        kinds = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", tz="UTC"))])
        rows: list[tuple] = []
        todo = [(part.folder, part.rules)]
        while todo:
            folder, above = todo.pop()
            own = walk.inside(store, folder, above)
            for path, e in walk.admitted(store, folder, own):
                if folder == part.folder and part.of > 1 and zlib.crc32(os.fsencode(e.name)) % part.of != part.slot:
                    continue
                if not e.folder:
                    rows.append((os.fsencode(path).decode("utf-8", "replace"), e.size, datetime.fromtimestamp(e.modified, timezone.utc)))
                elif not part.shallow:
                    todo.append((path, own))
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                    rows.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def lowered(line: str, way: list[str]) -> str:
    """A line of an ignore file some folders above the root, as a line at the root: what is anchored elsewhere says nothing."""
    bare = line.lstrip("!").rstrip()
    if "/" not in bare.rstrip("/") or bare.startswith("**/") or not bare or bare.startswith("#"):
        return line
    parts = bare.lstrip("/").split("/")
    if parts[: len(way)] == way and len(parts) > len(way):
        return ("!" if line.startswith("!") else "") + "/" + "/".join(parts[len(way) :])
    return ""


class TreeSource(DataSource):
    """Options: path; gitignore (true); excluded (names of folders that are never entered, joined by /); parts (64)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(TreeSource)
    return spark
