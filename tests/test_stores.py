"""Paths of remote stores, with a local folder standing in for the bucket."""

from types import SimpleNamespace

import pytest
from pyarrow import fs

from sigillum.functions import stores as module
from sigillum.functions.stores import Stores


@pytest.fixture
def opened(tmp_path, monkeypatch):
    uris = []

    def from_uri(uri):
        uris.append(uri)
        return fs.LocalFileSystem(), f"{tmp_path}/"

    stand_in = SimpleNamespace(
        LocalFileSystem=fs.LocalFileSystem,
        FileSelector=fs.FileSelector,
        FileType=fs.FileType,
        FileSystem=SimpleNamespace(from_uri=from_uri),
    )
    monkeypatch.setattr(module, "arrow_fs", stand_in)
    return uris


@pytest.mark.parametrize(
    "prefix, uri",
    [
        ("s3a://bucket", "s3://bucket/"),
        ("s3://bucket", "s3://bucket/"),
        ("hdfs://name:8020", "hdfs://name:8020/"),
        ("gs://bucket", "gs://bucket/"),
        ("abfss://box@account.example", "abfss://box@account.example/"),
    ],
)
def test_store_is_opened_once_and_keeps_its_own_names(tmp_path, opened, prefix, uri):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "c#?%20.gz").write_bytes(b"as it is")
    (tmp_path / "a b" / "empty").write_bytes(b"")
    stores = Stores()
    assert sorted(stores.children(f"{prefix}/a b")) == [
        (f"{prefix}/a b/c#?%20.gz", False, 8),
        (f"{prefix}/a b/empty", False, 0),
    ]
    assert list(stores.children(f"{prefix}/")) == [(f"{prefix}/a b", True, 0)]
    with stores.open(f"{prefix}/a b/c#?%20.gz") as stream:
        assert stream.read() == b"as it is"
    assert opened == [uri]


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_local_paths(tmp_path, opened, prefix):
    (tmp_path / "x").write_bytes(b"1")
    assert list(Stores().children(f"{prefix}{tmp_path}")) == [(f"{prefix}{tmp_path}/x", False, 1)]
    assert list(Stores().children(f"{prefix}{tmp_path}/x")) == [(f"{prefix}{tmp_path}/x", False, 1)]
    assert opened == []


def test_options_make_the_store_and_functions_are_called_there(tmp_path, opened, monkeypatch):
    (tmp_path / "bucket").mkdir()
    (tmp_path / "bucket" / "x").write_bytes(b"1")
    made = []

    def s3(**arguments):
        made.append(arguments)
        return fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())

    monkeypatch.setattr(module.arrow_fs, "S3FileSystem", s3, raising=False)
    stores = Stores({"s3a": {"endpoint_override": "store.example:9000", "secret_key": lambda: "from a provider"}})
    with stores.open("s3a://bucket/x") as stream:
        assert stream.read() == b"1"
    assert [path for path, *_ in stores.children("s3a://bucket/")] == ["s3a://bucket/x"]
    assert made == [{"endpoint_override": "store.example:9000", "secret_key": "from a provider"}]
    assert opened == []


def test_unknown_schemes_and_relative_paths_are_named():
    with pytest.raises(ValueError, match="nosuch://host"):
        Stores().open("nosuch://host/x")
    with pytest.raises(ValueError, match="'nosuch'"):
        Stores({"nosuch": {}}).open("nosuch://host/x")
    with pytest.raises(ValueError, match="relative: 'a/b'"):
        Stores().open("a/b")


def test_missing_paths_are_named(tmp_path):
    with pytest.raises(FileNotFoundError, match="gone"):
        list(Stores().children(f"{tmp_path}/gone"))
