"""Saved metric-API responses as a data source, for batches and streams.

``spark.read.format("metric_responses").load(folder)`` and the same with ``readStream`` give the samples of
every response file under a folder, as ``metrics.parse_range`` does for rows of text (an instant query's
one value counts as one sample). Files are dealt to tasks in ``filesPerPartition``. The stream's offset is
the last file name taken, so names must ascend with time, as those of saved responses do; a restart goes on
behind it. A response that can't be read is skipped, as the monitor skips a collector that fails, unless
the option ``failing`` is ``raise``.
"""

from __future__ import annotations

import datetime as dt
import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from opslens.sinks.rowfiles import open_fs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "file string, labels map<string,string>, ts timestamp_ntz, value double"


def _number(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def samples(text: str) -> Iterator[tuple[dict, dt.datetime | None, float | None]]:
    """(labels, time, value) of an instant or range response; raises where it is no response."""
    answer = json.loads(text)
    if answer.get("status") != "success":
        raise ValueError(f"status {answer.get('status')!r}")
    for series in answer["data"]["result"]:
        for at, value in series.get("values") or ([series["value"]] if series.get("value") else []):
            seconds = _number(at)
            ts = None if seconds is None else dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)
            yield {str(k): str(v) for k, v in series.get("metric", {}).items()}, ts, _number(value)


class _Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)


class _Folder:
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.per_task = int(options.get("filesPerPartition", 64))
        self.strict = options.get("failing", "skip") == "raise"

    def names(self) -> list[str]:
        from pyarrow import fs as pafs
        fs, base = open_fs(self.folder)
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        cut = len(base.rstrip("/")) + 1
        return sorted(x.path[cut:] for x in found if x.type == pafs.FileType.File and not x.base_name.startswith((".", "_")))

    def dealt(self, names: list[str]) -> list[InputPartition]:
        return [_Files(names[i:i + self.per_task]) for i in range(0, len(names), self.per_task)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, base = open_fs(self.folder)
        for name in partition.value:
            try:
                with fs.open_input_stream(f"{base}/{name}", compression=None) as held:
                    rows = [(name, *row) for row in samples(held.read().decode())]
            except (ValueError, KeyError, TypeError, AttributeError, OSError):
                if self.strict:
                    raise
                continue
            yield from rows


class ResponseReader(_Folder, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.dealt(self.names())


class ResponseStreamReader(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self.names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.dealt([n for n in self.names() if start["after"] < n <= end["after"]])


class MetricResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "metric_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ResponseReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ResponseStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format ``metric_responses`` known to the session."""
    spark.dataSource.register(MetricResponses)
