"""Files in a shared folder, written and read by tasks through whichever file system its address names."""

from __future__ import annotations

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file://" + uri.removeprefix("file:"))


def write_committed(folder: str, name: str, attempt: str, data: bytes) -> None:
    """Write under a temporary name of this attempt, then rename; a repeated task replaces the same file."""
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{attempt}"
    with fs.open_output_stream(temporary, compression=None) as f:
        f.write(data)
    try:
        fs.move(temporary, f"{path}/{name}")
    except OSError:  # not every file system replaces a file; one that is there has the same bytes
        if fs.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
            raise
        fs.delete_file(temporary)


def read_file(folder: str, name: str) -> bytes:
    fs, path = open_fs(folder)
    with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
        return f.read()
