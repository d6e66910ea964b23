"""``spark.read.format("folio")``: tables of documents by path, with filters on page and path pushed into the reader.

Options: path (a folder, a file or a glob), table (default runs), password, mode, cmapDir, baseEncoding, filesPerTask.
Register with ``register(spark)``, which also enables spark.sql.python.filterPushdown.enabled for the session (a reader that takes
filters cannot run without it). Ids are those of ``files.read_files``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .. import schemas


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FolioReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.pages: set[int] | None = None
        self.path: str | None = None

    def pushFilters(self, filters: list[Filter]):
        """Takes equality and membership of page, and equality of path; returns what Spark must filter."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("page",):
                self._limit({f.value})
            elif isinstance(f, In) and f.attribute == ("page",):
                self._limit(set(f.value))
            elif isinstance(f, EqualTo) and f.attribute == ("path",):
                self.path = f.value
            else:
                yield f

    def _limit(self, pages: set[int]) -> None:
        self.pages = pages if self.pages is None else self.pages & pages

    def partitions(self):
        import fnmatch

        from pyarrow import fs

        path = self.options["path"]
        where, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        folder, glob = (base, "*.pdf") if "*" not in base else base.rsplit("/", 1)
        info = where.get_file_info(folder)
        if info.type == fs.FileType.File:
            files = [folder]
        else:
            files = sorted(f.path for f in where.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, glob))
        if self.path is not None:
            files = [f for f in files if f == self.path]
        n = int(self.options.get("filespertask", self.options.get("filesPerTask", 64)))
        return [_Files(files[k : k + n]) for k in range(0, len(files), n)] or [_Files([])]

    def read(self, partition):
        import xxhash
        from pyarrow import fs

        from ..binary.extract import extract

        o = self.options
        table, path = o.get("table", "runs"), o["path"]
        where = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
        names = [c.strip().split(" ")[0] for c in _columns(schemas.ALL[table])]
        for p in partition.paths:
            with where.open_input_stream(p) as f:
                data = f.read()
            # as Spark writes the path
            doc_id = xxhash.xxh64_intdigest((f"{path.split('://')[0]}://{p}" if "://" in path and not path.startswith("file:") else f"file:{p}").encode(), 42)
            head = {"doc_id": doc_id - (1 << 64) if doc_id >> 63 else doc_id, "path": p}
            got = extract(data, {table}, password=o.get("password", ""), recover=o.get("mode", "PERMISSIVE").upper() != "FAILFAST", pages=self.pages, cmap_dir=o.get("cmapdir", o.get("cmapDir")), base_encoding=o.get("baseencoding", o.get("baseEncoding")))
            for r in got[table]:
                r = {**r, **head}
                yield tuple(r.get(n) for n in names)


def _columns(ddl: str) -> list[str]:
    """Top-level columns of a schema text."""
    out, depth, cur = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur]


class FolioSource(DataSource):
    @classmethod
    def name(cls):
        return "folio"

    def schema(self):
        return schemas.ALL[self.options.get("table", "runs")]

    def reader(self, schema):
        return FolioReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolioSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
