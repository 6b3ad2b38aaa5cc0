"""A single text file that grows, followed line by line: a Python data source for streams.

Offsets are places after whole lines, so a line that is still being written waits. The
driver reads each part once to find the ends of its lines; executors read the same
bytes, cut into parts of PART, again after a failure.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a micro-batch at most, and of one task.
BATCH, PART = 1 << 28, 1 << 24


class Lines(InputPartition):
    def __init__(self, start: int, end: int, number: int) -> None:
        self.start, self.end, self.number = start, end, number


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.last: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0, "lines": 0}

    def parts(self, start: dict, limit: int) -> Iterator[tuple[int, int, int, int]]:
        """start, end, number of the first line and of lines, in parts that end after a line."""
        at, number = start["at"], start["lines"]
        with open(self.path, "rb") as f:
            f.seek(at)
            while at < limit:
                data = f.read(min(PART, limit - at))
                cut = data.rfind(b"\n") + 1
                while not cut and data and at + len(data) < limit:
                    # one line longer than a part
                    more = f.read(min(PART, limit - at - len(data)))
                    data += more
                    cut = data.rfind(b"\n") + 1
                if not cut:
                    return
                n = data.count(b"\n", 0, cut)
                yield at, at + cut, number, n
                at, number = at + cut, number + n
                f.seek(at)

    def latestOffset(self) -> dict:  # noqa: N802
        now = self.last or self.initialOffset()
        limit = min(os.path.getsize(self.path), now["at"] + BATCH)
        for _, end, number, n in self.parts(now, limit):
            now = {"at": end, "lines": number + n}
        self.last = now
        return now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.last is None:  # restarted
            self.last = end
        return [Lines(a, b, number) for a, b, number, _ in self.parts(start, end["at"])]

    def read(self, partition: Lines) -> Iterator[tuple[int, str]]:
        with open(self.path, "rb") as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
        for k, line in enumerate(data[:-1].split(b"\n")):
            yield partition.number + k, line.removesuffix(b"\r").decode("utf-8", "replace")


class GrowingFile(DataSource):
    """Option path: a file that driver and executors can open."""

    @classmethod
    def name(cls) -> str:
        return "tessera_growing_file"

    def schema(self) -> str:
        return "number long, value string"

    def streamReader(self, schema: StructType) -> GrowingReader:  # noqa: N802
        return GrowingReader(self.options["path"])
