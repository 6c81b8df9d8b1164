"""Files from inside a task: opening them, and listing folders."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Mapping
from typing import Any

from pyarrow import fs as arrow_fs
from pyspark import cloudpickle

# Sent with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Hadoop's names for stores that Arrow knows by another one, and
# the class of each that takes options.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3"}
ARROW_CLASSES = {"s3": "S3FileSystem", "gs": "GcsFileSystem", "hdfs": "HadoopFileSystem"}

# Hadoop writes paths unescaped, so a URL parser would cut names at `?` or `#`.
_PATH = re.compile(r"(?s)((?:[A-Za-z][A-Za-z0-9+.-]*:)?)((?://[^/]*)?)(/.*)")

StoreOptions = Mapping[str, Mapping[str, Any]]


def split_path(path: str) -> tuple[str, str, str]:
    """`(scheme with its colon, authority, name)`; the name starts with a slash."""
    match = _PATH.fullmatch(path)
    if match is None:
        raise ValueError(f"an absolute path or URI is needed, this is relative: {path!r}")
    return match.groups()


class Stores:
    """Arrow file systems by Hadoop-style path, each opened once per task.

    A path without a scheme is one of the local file system. `options` has
    keyword arguments of Arrow's file system class for a scheme, for example
    `{"s3a": {"endpoint_override": "...", "region": "..."}}`. A value that is a
    function is called in the task, so credentials need not travel with the job.
    """

    def __init__(self, options: StoreOptions | None = None) -> None:
        self._options = {scheme.rstrip(":"): dict(given) for scheme, given in (options or {}).items()}
        self._opened: dict = {}

    def _open_store(self, scheme: str, authority: str):
        named = scheme.removesuffix(":")
        known_as = ARROW_SCHEMES.get(named, named)
        given = self._options.get(named, self._options.get(known_as))
        uri = f"{known_as}:{authority}/"
        try:
            if given is None:
                return arrow_fs.FileSystem.from_uri(uri)
            arguments = {name: value() if callable(value) else value for name, value in given.items()}
            store = getattr(arrow_fs, ARROW_CLASSES[known_as])(**arguments)
            return store, "" if known_as == "hdfs" else authority.removeprefix("//")
        except KeyError:
            raise ValueError(f"options are not known for the scheme {named!r}") from None
        except (ValueError, NotImplementedError) as error:
            raise ValueError(f"Arrow cannot open {scheme}{authority}: {error}") from error

    def _resolve(self, path: str):
        scheme, authority, name = split_path(path)
        store = (scheme, authority)
        if store not in self._opened:
            if scheme in ("", "file:"):
                self._opened[store] = (arrow_fs.LocalFileSystem(), "")
            else:
                self._opened[store] = self._open_store(scheme, authority)
        store_fs, root = self._opened[store]
        return store_fs, root.rstrip("/"), name

    def open(self, path: str):
        store_fs, root, name = self._resolve(path)
        # Arrow would otherwise unpack a name such as `a.gz` while reading it.
        return store_fs.open_input_stream(root + name, compression=None)

    def children(self, path: str) -> Iterator[tuple[str, bool, int]]:
        """`(path, is_folder, length)` of what a folder holds, or of a file itself.

        Every name counts, whatever it starts with. Arrow hands over one folder
        as one list; that is the bound of this function's memory.
        """
        store_fs, root, name = self._resolve(path)
        prefix = path[: len(path) - len(name)]
        found = store_fs.get_file_info(root + name)
        if found.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(path)
        infos = [found]
        if found.type == arrow_fs.FileType.Directory:
            infos = store_fs.get_file_info(arrow_fs.FileSelector(root + name))
        for info in infos:
            is_folder = info.type == arrow_fs.FileType.Directory
            yield prefix + info.path[len(root):], is_folder, info.size or 0
