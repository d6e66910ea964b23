"""Documents as tables: binary files in, one DataFrame per table out, each by one pass over the files (no shuffle)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .. import schemas

#: Rows that one Arrow batch of results holds at most.
BATCH_ROWS = 1_000


def read_files(spark: SparkSession, path: str | list[str], glob: str = "*.pdf") -> DataFrame:
    """doc_id (a hash of the path), path, length, content of every file under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def extract(files: DataFrame, table: str = "runs", *, password: str = "", mode: str = "PERMISSIVE", pages: list[int] | None = None, cmap_dir: str | None = None, base_encoding: str | None = None, passwords: str | None = None) -> DataFrame:
    """A table (``schemas.ALL``) of the files (doc_id, content, and path if there is one).

    mode PERMISSIVE: faults end in table docs; FAILFAST: they raise. ``passwords`` names a column of passwords, one per file.
    ``pages`` limits the pages that are read at all. A null content counts as an empty file."""
    if table not in schemas.ALL:
        raise ValueError(f"unknown table {table!r}; there are {', '.join(schemas.ALL)}")
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError(f"unknown mode {mode!r}")
    schema = _parse_datatype_string(schemas.ALL[table])
    arrow = to_arrow_schema(schema)
    only, names = None if pages is None else set(pages), [f.name for f in schema]

    def run(batches):
        from ..binary.extract import extract as one

        rows: list[dict] = []
        for b in batches:
            for doc_id, path, content, own in zip(*(b.column(k) for k in range(4)), strict=True):
                got = one(content.as_py() or b"", {table}, password=own.as_py() or password, recover=mode == "PERMISSIVE", pages=only, cmap_dir=cmap_dir, base_encoding=base_encoding)
                for r in got[table]:
                    r["doc_id"] = doc_id.as_py()
                    if "path" in names:
                        r["path"] = path.as_py()
                    rows.append(r)
                    if len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    path = F.col("path") if "path" in files.columns else F.lit(None).cast("string")
    own = F.col(passwords).cast("string") if passwords else F.lit(None).cast("string")
    return files.select(F.col("doc_id").cast("long"), path.alias("path"), F.col("content").cast("binary").alias("content"), own.alias("own")).mapInArrow(run, schema)
