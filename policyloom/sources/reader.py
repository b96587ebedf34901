"""Python data sources: the framework catalog in YAML, and files in a tree of folders.

    register(spark)
    spark.read.format("framework_catalog").load("catalog.yaml")
    spark.read.format("folder_files").option("pattern", "*.pdf").load("uploads")
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from datetime import UTC, datetime

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = ("name", "version", "website", "pdf_url", "checksum", "local_path", "source_type")
LISTS = ("roles", "dimensions", "regions")


def _store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def _listed(store: arrow_fs.FileSystem, folder: str, recursive: bool) -> list:
    """Files and folders below, without hidden ones and the marks of other jobs."""
    found = store.get_file_info(arrow_fs.FileSelector(folder, recursive=recursive))
    base = folder.rstrip("/") + "/"
    hidden = re.compile(r"(^|/)[._]")
    return sorted((f for f in found if not hidden.search(f.path.removeprefix(base))), key=lambda f: f.path)


class CatalogSource(DataSource):
    """Entries of YAML files, a list under ``frameworks`` or at the top, one partition for each file.

    Of a folder, all files below it count whose name fits the option ``pattern`` (``*.y*ml``).
    ``ord`` is the entry's number in its file.  An entry without a name is left out; missing lists are empty, a single
    value counts as a list of one.  A missing or empty file gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "framework_catalog"

    def schema(self) -> str:
        lists = ", ".join(f"{c} array<string>" for c in LISTS)
        return "file string, ord int, " + ", ".join(f"{c} string" for c in FIELDS) + f", {lists}"

    def reader(self, schema) -> DataSourceReader:
        return _CatalogReader(self.options["path"], self.options.get("pattern", "*.y*ml"))


class _CatalogReader(DataSourceReader):
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def partitions(self) -> list[InputPartition]:
        store, place = _store(self.path)
        info = store.get_file_info(place)
        if info.type == arrow_fs.FileType.Directory:
            files = [f.path for f in _listed(store, place, True) if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern)]
        else:
            files = [place] if info.is_file else []
        return [InputPartition(f) for f in files] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import yaml

        if partition.value is None:
            return
        store, _ = _store(self.path)
        with store.open_input_stream(partition.value) as source:
            found = yaml.safe_load(source.read().decode("utf-8"))
        entries = found.get("frameworks") if isinstance(found, dict) else found
        for number, entry in enumerate(entries or []):
            if not isinstance(entry, dict) or not entry.get("name"):
                continue
            plain = [None if entry.get(c) is None else str(entry[c]) for c in FIELDS]
            lists = [[str(x) for x in (v if isinstance(v, list) else [v])] if (v := entry.get(c)) else [] for c in LISTS]
            yield (partition.value, number, *plain, *lists)


class FilesSource(DataSource):
    """Files of a folder and all folders below: path, time, length and content, empty files included.

    Option ``pattern`` picks names, ``depth`` says how many levels of folders are listed to find partitions (1), of
    which there are at most ``partitions`` (400), with a run of folders each.  A partition lists what is below its
    folders by itself, so that large trees are listed in many tasks, and small folders do not cost a task each.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _FilesReader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("depth", 1)), int(self.options.get("partitions", 400)))


class _FilesReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, depth: int, most: int):
        self.path, self.pattern, self.depth, self.most = path, pattern, depth, max(1, most)

    def partitions(self) -> list[InputPartition]:
        """Runs of folders with a flag: is everything below included, or only the folder's own files."""
        store, place = _store(self.path)
        level, out = [place], []
        for _ in range(self.depth):
            below = []
            for folder in level:
                out.append((folder, False))
                below += [f.path for f in _listed(store, folder, False) if f.type == arrow_fs.FileType.Directory]
            level = below
        out += [(folder, True) for folder in level]
        run = -(-len(out) // self.most)
        return [InputPartition(out[i : i + run]) for i in range(0, len(out), run)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for folder, whole in partition.value:
            for info in _listed(store, folder, whole):
                if info.is_file and fnmatch.fnmatch(info.base_name, self.pattern):
                    with store.open_input_stream(info.path) as source:
                        content = source.read()
                    yield info.path, info.mtime or datetime.fromtimestamp(0, UTC), info.size, content


def register(spark: SparkSession) -> None:
    for source in (CatalogSource, FilesSource):
        spark.dataSource.register(source)


def read_catalog(spark: SparkSession, path: str, pattern: str = "*.y*ml") -> DataFrame:
    """The entries of a YAML catalog, a file or a folder of files."""
    register(spark)
    return spark.read.format(CatalogSource.name()).option("pattern", pattern).load(path)


def read_tree(spark: SparkSession, path: str, pattern: str = "*", depth: int = 1) -> DataFrame:
    """Files of a tree of folders with their checksums."""
    register(spark)
    files = spark.read.format(FilesSource.name()).option("pattern", pattern).option("depth", depth).load(path)
    return files.withColumn("checksum", F.sha2("content", 256))
