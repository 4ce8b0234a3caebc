"""Readers for `spark.read.format(...)`: pages of documents and decision trees in folders.

`register(spark)` makes them known. A file is a partition; filters on the file
(or the protocol) are taken at planning, so files they rule out are not opened.
Paths are what pyarrow's file systems open; stores that only Spark reads go
through `files.pages_from_text`.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, Not, StringStartsWith

from lucerna.sources.files import EDGES, NODES, parse_tree

PAGES = "source_file string, page int, text string"
PROTOCOLS = "protocol_id string, version string, name string, description string"
TREE_TABLES = {"nodes": NODES, "edges": EDGES, "protocols": PROTOCOLS}
#: Names of the file that holds a protocol's tree, in the folder of a version.
TREE_FILES = ("tree.yaml", "tree.yml", "tree.json")


def opened(path: str) -> tuple:
    """The file system of a path, with or without a scheme, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match("[A-Za-z][A-Za-z0-9+.-]*:", path) else os.path.abspath(path))


def _listed(path: str) -> tuple[object, list]:
    """The root of a path in its file system and its files, at any depth, by path."""
    from pyarrow import fs

    system, root = opened(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return root, sorted((f.path for f in found if f.is_file), key=str)


def _content(base: str, path: str) -> bytes:
    system, _ = opened(base)
    with system.open_input_stream(path) as f:
        return f.read()


def parsed(content: bytes, name: str) -> dict:
    """A YAML or JSON document."""
    if name.endswith(".json"):
        return json.loads(content)
    import yaml

    return yaml.safe_load(content)


@dataclass
class File(InputPartition):
    path: str
    name: str


def _passes(f: Filter, name: str) -> bool:
    """Whether a name passes a filter: equality, a list, a beginning, or the contrary of one of these."""
    if isinstance(f, Not):
        return not _passes(f.child, name)
    if isinstance(f, StringStartsWith):
        return name.startswith(f.value)
    return name in (f.value if isinstance(f, In) else (f.value,))


class _Filtered(DataSourceReader):
    """A reader of files that keeps those whose `key` passes the pushed filters."""

    key = "source_file"

    def __init__(self, options: dict) -> None:
        self.base = options["path"]
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            plain = f.child if isinstance(f, Not) else f
            if isinstance(plain, (EqualTo, In, StringStartsWith)) and plain.attribute == (self.key,):
                self.pushed.append(f)
            else:
                yield f

    def files(self) -> list[File]:
        raise NotImplementedError

    def partitions(self) -> list[InputPartition]:
        return [f for f in self.files() if all(_passes(p, f.name) for p in self.pushed)]


class PagesReader(_Filtered):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.names, self.separator = options.get("names", "*"), options.get("separator", "\f")

    def files(self) -> list[File]:
        return [File(p, p.rpartition("/")[2]) for p in _listed(self.base)[1] if fnmatch.fnmatch(p.rpartition("/")[2], self.names)]

    def read(self, partition: File) -> Iterator[tuple]:
        content = _content(self.base, partition.path).decode()
        if partition.name.endswith(".json"):
            pages = [(p.get("metadata") or {}, p.get("text")) for p in json.loads(content)]
        else:
            pages = [({}, t) for t in content.split(self.separator)]
        for k, (about, text) in enumerate(pages):
            number = next((about[n] for n in ("page", "page_number") if isinstance(about.get(n), int)), k + 1)
            if text and text.strip():
                yield partition.name, number, text


class PagesSource(DataSource):
    """`document_pages`: source_file, page, text; blank pages are left out.

    Options: `path` (a folder), `names` (a pattern of file names), `separator`
    (form feed). A `.json` file is an extractor's list of pages, each with `text`
    and, in `metadata`, its number; elsewhere, and without a number, a page's
    number is its place from 1, blank ones counted.
    """

    @classmethod
    def name(cls) -> str:
        return "document_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)


class TreesReader(_Filtered):
    key = "protocol_id"

    def __init__(self, options: dict, table: str) -> None:
        super().__init__(options)
        self.table = table

    def files(self) -> list[File]:
        """The newest version, by name, of each protocol's folder that has a tree."""
        root, paths = _listed(self.base)
        newest: dict[str, tuple[str, str]] = {}
        for path in paths:
            below = path[len(root.rstrip("/")) + 1 :].split("/")
            if len(below) == 3 and below[2] in TREE_FILES:
                newest[below[0]] = max(newest.get(below[0], ("", "")), (below[1], path))
        return [File(path, protocol) for protocol, (_, path) in sorted(newest.items())]

    def read(self, partition: File) -> Iterator[tuple]:
        head, nodes, edges = parse_tree(parsed(_content(self.base, partition.path), partition.path))
        if head["protocol_id"] != partition.name:
            raise ValueError(f"{partition.path} is the tree of {head['protocol_id']}, not of {partition.name}")
        names = [c.split()[0] for c in TREE_TABLES[self.table].split(", ")]
        for row in {"nodes": nodes, "edges": edges, "protocols": [head]}[self.table]:
            yield tuple(row[n] for n in names)


class TreesSource(DataSource):
    """`decision_trees`: a table of the trees below a folder `protocol/version/tree.yaml` (or .yml, .json), in either dialect.

    Options: `path`, and `table`: nodes (the default), edges or protocols. Of
    each protocol's versions the last by name that has a tree is read; a tree that
    names another protocol than its folder is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "decision_trees"

    def table(self) -> str:
        table = self.options.get("table", "nodes")
        if table not in TREE_TABLES:
            raise ValueError(f"table {table} is none of {', '.join(TREE_TABLES)}")
        return table

    def schema(self) -> str:
        return TREE_TABLES[self.table()]

    def reader(self, schema) -> DataSourceReader:
        return TreesReader(self.options, self.table())


def register(spark: SparkSession) -> None:
    """Makes the readers known to a session, with filters pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PagesSource, TreesSource):
        spark.dataSource.register(source)
