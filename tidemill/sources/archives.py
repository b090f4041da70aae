"""Zip archives as sources.

A member cannot be split while compressed, so one task per archive unpacks it as a stream into the
scratch folder; from there the ordinary readers take over and split the files as usual. A task that
runs twice writes the same bytes to the same name.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import new_scratch
from tidemill.sources.paths import filesystem

# Members taken for data, in any case.
DATA_EXTENSIONS = (".csv", ".json", ".parquet", ".tsv", ".txt")

_CHUNK = 1 << 20


def data_member(names: list[str], member: str | None) -> str:
    """The named member, else the alphabetically first data file."""
    if member is not None:
        if member not in names:
            raise ValueError(f"archive has no member {member!r}: {sorted(names)}")
        return member
    data = sorted(n for n in names if n.lower().endswith(DATA_EXTENSIONS))
    if not data:
        raise ValueError(f"archive holds no data file: {sorted(names)}")
    return data[0]


def _unpack(path: str, member: str | None, target: str) -> tuple[str, int]:
    source_fs, source = filesystem(path)
    target_fs, folder = filesystem(target)
    with source_fs.open_input_file(source) as raw, zipfile.ZipFile(raw) as archive:
        name = data_member(archive.namelist(), member)
        label = hashlib.md5(path.encode()).hexdigest()[:16]
        final = f"{folder}/{label}{os.path.splitext(name)[1].lower()}"
        # Hidden from readers until complete; the move puts the whole file in place at once.
        partial = f"{folder}/_{label}-{uuid.uuid4().hex}"
        size = 0
        with archive.open(name) as stream, target_fs.open_output_stream(partial) as out:
            while chunk := stream.read(_CHUNK):
                size += out.write(chunk)
        target_fs.move(partial, final)
    return name, size


def unpack_archives(spark: SparkSession, path: str, member: str | None = None) -> tuple[str, str]:
    """Unpack one member of every archive under ``path``; returns the folder and the extension."""
    target = new_scratch(spark, "unzip")
    target_fs, folder = filesystem(target)
    target_fs.create_dir(folder, recursive=True)
    # Only paths and sizes are read here: column pruning keeps the archives' bytes out of Spark.
    archives = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    ).select("path")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [_unpack(p, member, target) for p in batch["path"]]
            yield pd.DataFrame(
                {"extension": [os.path.splitext(n)[1].lower() for n, _ in done], "size": [s for _, s in done]}
            )

    kinds = archives.mapInPandas(unpack, "extension string, size long").groupBy("extension").agg(F.sum("size"))
    found = sorted(r["extension"] for r in kinds.collect())
    if not found:
        raise FileNotFoundError(f"no zip archive under {path}")
    if len(found) > 1:
        raise ValueError(f"archives hold different kinds of files: {found}")
    return target, found[0]


def read_zip(spark: SparkSession, path: str, member: str | None = None, delimiter: str | None = None, schema=None) -> DataFrame:
    """The data of one archive, or of all archives in a folder, as one DataFrame."""
    from tidemill.sources.files import read_delimited, read_json

    target, kind = unpack_archives(spark, path, member)
    if kind == ".parquet":
        return spark.read.parquet(target) if schema is None else spark.read.schema(schema).parquet(target)
    if kind in (".json", ".ndjson"):
        return read_json(spark, target, schema=schema)
    return read_delimited(spark, target, delimiter, schema=schema)
