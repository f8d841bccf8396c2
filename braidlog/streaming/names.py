"""A streaming source of file names in a list of files and folders, each name once."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from braidlog.sources.reader import file_system


@dataclass
class Name(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class NameSource(DataSource):
    """Format `braidlog_names`; options: inputs (a JSON list of qualified paths), pattern of the names in folders, most in a batch (0: any)."""

    @classmethod
    def name(cls) -> str:
        return "braidlog_names"

    def schema(self) -> str:
        return "path string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        o = self.options
        return NameReader(json.loads(o["inputs"]), o["pattern"], int(o["most"]))


class NameReader(DataSourceStreamReader):
    """An offset is the set of names that were there: what a checkpoint has of it was taken."""

    def __init__(self, inputs: list[str], pattern: str, most: int):
        self.inputs, self.pattern, self.most = inputs, pattern, most
        self.at: list[str] = []

    def listed(self) -> list[str]:
        out = set()
        for path in self.inputs:
            system, inner = file_system(path)
            info = system.get_file_info(inner)
            if info.type == pa.fs.FileType.File:
                out.add(path)
            elif info.type == pa.fs.FileType.Directory:
                found = system.get_file_info(pa.fs.FileSelector(inner))
                out |= {f"{path.rstrip('/')}/{f.base_name}" for f in found if f.type == pa.fs.FileType.File and fnmatch.fnmatchcase(f.base_name, self.pattern)}
        return sorted(out, key=lambda x: x.encode("utf-8", "surrogatepass"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"names": []}

    def latestOffset(self) -> dict:  # noqa: N802
        new = [x for x in self.listed() if x not in set(self.at)]
        self.at = sorted([*self.at, *(new[: self.most] if self.most else new)])
        return {"names": self.at}

    def partitions(self, start: dict, end: dict) -> list[Name]:
        before = set(start["names"])
        self.at = sorted(before | set(end["names"]))
        return [Name(x) for x in end["names"] if x not in before]

    def read(self, partition: Name) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([partition.path])], names=["path"])

    def commit(self, end: dict) -> None:
        self.at = end["names"]
