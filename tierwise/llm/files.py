"""Files that tasks write into the folder all executors share.

A file gets a temporary name with its task attempt, and is moved to its last name when complete, so a lost or
repeated attempt leaves no half file under a last name, and equal attempts end in equal files. Folders are those that Arrow's file
systems reach (local and mounted paths, s3, gs, abfs, hdfs); others raise an error.
"""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark import TaskContext


def folder(uri: str) -> tuple[fs.FileSystem, str]:
    """file:/x, file:///x and /x are the same local folder."""
    return fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", uri))


def made(uri: str) -> str:
    """The folder, which then exists."""
    system, base = folder(uri)
    system.create_dir(base, recursive=True)
    return uri


def temporary(path: str) -> str:
    """The name under which this task attempt writes a file."""
    head, _, name = path.rpartition("/")
    return f"{head}/_temporary/{name}.{TaskContext.get().taskAttemptId()}"


def put(uri: str, name: str, data: bytes) -> str:
    """Writes a file under a temporary name in the folder; gives the temporary path."""
    system, base = folder(uri)
    path = temporary(f"{base}/{name}")
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)
    return path


def commit(uri: str, path: str, name: str) -> None:
    """Moves a written file to its last name; once it is there, moving it again changes nothing."""
    system, base = folder(uri)
    if system.get_file_info(path).type == fs.FileType.File:
        system.move(path, f"{base}/{name}")
    elif system.get_file_info(f"{base}/{name}").type != fs.FileType.File:
        raise FileNotFoundError(path)
