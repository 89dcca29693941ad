"""The listing of a remote photo manager as a Spark data source: pages are partitions, updates a stream.

An opener sends one request's body and returns the answer, as files.fetch_assets takes it; it goes to the tasks with the
source.  The first page tells how many assets there are; then every partition asks for its own pages.  Where it does not,
one partition follows the pages.  As a stream the offset is the last update seen, so each batch asks for what is newer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from lumenlake.sources import files, schema as schemas

Opener = Callable[[dict], dict]


class Pages(InputPartition):
    """Pages from first to last; last 0: as long as there is a next one."""

    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


def _row(asset: dict) -> tuple:
    """An asset in the order of the schema; sizes that are no numbers count as missing."""
    exif = asset.get("exifInfo") or {}
    text = lambda d, k: None if d.get(k) is None else str(d[k])
    number = lambda d, k: d[k] if isinstance(d.get(k), int) else None
    inner = (text(exif, "latitude"), text(exif, "longitude"), text(exif, "make"), text(exif, "model"), number(exif, "exifImageWidth"), number(exif, "exifImageHeight"))
    return (*(text(asset, k) for k in ("id", "updatedAt", "fileCreatedAt", "localDateTime", "originalFileName")), number(asset, "width"), number(asset, "height"), inner if asset.get("exifInfo") is not None else None)


class Listing(DataSourceReader):
    def __init__(self, opener: Opener, size: int, spread: int):
        if not 1 <= size <= 1000:
            raise ValueError("page_size must be from 1 to 1000")
        self.opener, self.size, self.spread = opener, size, max(1, spread)

    def _page(self, number: int) -> dict:
        return self.opener({"page": number, "size": self.size, "type": "IMAGE", "withExif": True}).get("assets") or {}

    def partitions(self) -> list[InputPartition]:
        total = self._page(1).get("total")
        if total is None:
            return [Pages(1, 0)]
        pages = max(1, -(-int(total) // self.size))
        step = max(1, -(-pages // self.spread))
        return [Pages(a, min(pages, a + step - 1)) for a in range(1, pages + 1, step)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        if not partition.last:
            yield from map(_row, files.fetch_assets(self.opener, self.size))
            return
        for number in range(partition.first, partition.last + 1):
            yield from (_row(a) for a in self._page(number).get("items") or [] if a.get("id"))


class Updates(SimpleDataSourceStreamReader):
    def __init__(self, opener: Opener, size: int):
        self.opener, self.size = opener, size

    def initialOffset(self) -> dict:
        return {"updated": ""}

    def _newer(self, start: dict) -> list[dict]:
        ask = lambda body: self.opener(body | ({"updatedAfter": start["updated"]} if start["updated"] else {}))
        return [a for a in files.fetch_assets(ask, self.size) if str(a.get("updatedAt") or "") > start["updated"]]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = self._newer(start)
        return iter([_row(a) for a in found]), {"updated": max([start["updated"], *(str(a.get("updatedAt") or "") for a in found)])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([_row(a) for a in self._newer(start) if str(a.get("updatedAt") or "") <= end["updated"]])


def source(opener: Opener, name: str = "remote_assets") -> type[DataSource]:
    """A data source of an opener's assets; options: page_size (250) and partitions (32)."""

    class RemoteAssets(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schemas.ASSETS

        def reader(self, schema) -> DataSourceReader:
            return Listing(opener, int(self.options.get("page_size", "250")), int(self.options.get("partitions", "32")))

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Updates(opener, int(self.options.get("page_size", "250")))

    return RemoteAssets


def read_remote(spark: SparkSession, opener: Opener, page_size: int = 250, partitions: int = 32) -> DataFrame:
    """The assets of a remote manager, page by page in as many tasks as asked for."""
    spark.dataSource.register(source(opener))
    return spark.read.format("remote_assets").option("page_size", page_size).option("partitions", partitions).load()


def stream_remote(spark: SparkSession, opener: Opener, page_size: int = 250) -> DataFrame:
    """The updates of a remote manager as a stream."""
    spark.dataSource.register(source(opener))
    return spark.readStream.format("remote_assets").option("page_size", page_size).load()


class PageFolder:
    """An opener over pages that are files, <folder>/<page>.json each: a listing that has been landed as it was."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, body: dict) -> dict:
        import json

        from pyarrow.fs import FileSystem

        fs, top = FileSystem.from_uri(self.folder)
        with fs.open_input_stream(f"{top}/{body['page']}.json") as f:
            return json.loads(f.read())
