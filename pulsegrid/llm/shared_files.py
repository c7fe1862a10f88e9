"""Files that tasks write to and read from the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from pulsegrid.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(uri: str):
    """The Arrow file system of an address, and the path in it."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def open_read(uri: str):
    """A file to read: memory-mapped where the folder is mounted, else by ranges."""
    import pyarrow as pa
    from pyarrow import fs

    system, path = file_system(uri)
    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)


def open_write(uri: str):
    system, path = file_system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)
