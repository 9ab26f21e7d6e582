"""Arrow IPC stream files as a Spark data source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructType


def _open(path: str):
    import pyarrow.fs as pafs
    import pyarrow.ipc as ipc

    filesystem, name = pafs.FileSystem.from_uri(path)
    return ipc.open_stream(filesystem.open_input_stream(name))


class FilePartition(InputPartition):
    def __init__(self, number: int, path: str) -> None:
        self.number, self.path = number, path


class ArrowStreamReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: StructType) -> None:
        self.paths, self.names = paths, schema.names

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(i, p) for i, p in enumerate(self.paths)]

    def read(self, partition: FilePartition) -> Iterator:
        """One file, one record batch at a time."""
        import pyarrow as pa

        at = 0
        with _open(partition.path) as stream:
            for batch in stream:
                if "row_index" in self.names and "row_index" not in batch.schema.names:
                    index = pa.array(range(at, at + batch.num_rows), pa.int64())
                    batch = batch.append_column("row_index", index)
                if "__file" in self.names:
                    number = pa.array([partition.number] * batch.num_rows, pa.int32())
                    batch = batch.append_column("__file", number)
                at += batch.num_rows
                yield batch.select(self.names)


class ArrowStreamSource(DataSource):
    """`format("arrow_stream").option("paths", "<path>\\n<path>")`."""

    @classmethod
    def name(cls) -> str:
        return "arrow_stream"

    def _paths(self) -> list[str]:
        return [p for p in self.options["paths"].split("\n") if p]

    def schema(self) -> StructType:
        with _open(self._paths()[0]) as stream:
            return from_arrow_schema(stream.schema).add("row_index", LongType()).add("__file", IntegerType())

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowStreamReader(self._paths(), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowStreamSource)
