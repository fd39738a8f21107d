"""Frame sources that may fail: a reader with retries and one switch to a backup, and a Spark data source around it.

A source is opened by a function: it gives an object with ``read() -> dict | None`` and ``release()``. A failed read is a
None or an error. A live source is read again, reopened after every :attr:`Retry.reopen_every` failures, and given up
after :attr:`Retry.most_failures` in a row; a file that gives nothing has ended. When a source can't be opened or is
given up, the backup takes over, once; its frames say so.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from pathlib import Path
from typing import Any

from pyspark.sql.datasource import DataSource, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

Opener = Callable[[str], Any]
FRAME_SCHEMA = "source string, frame_index long, is_backup boolean, content binary"


@dataclass(frozen=True)
class Retry:
    """How long a live source is tried (fixed starting values)."""

    most_failures: int = 50
    reopen_every: int = 10
    delay_s: float = 0.1


class SourceLost(RuntimeError):
    """A live source was given up."""


class Reader:
    """The frames of one source, one after another."""

    def __init__(self, open_: Opener, source: str, live: bool, retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep) -> None:  # noqa: B008
        self.open, self.source, self.live, self.retry, self.sleep = open_, source, live, retry, sleep
        self.device = open_(source)

    def _try(self) -> dict | None:
        try:
            return self.device.read()
        except Exception:  # noqa: BLE001
            if not self.live:
                raise
            return None

    def read(self) -> dict | None:
        """The next frame; None at the end of a file. A live source that is given up raises :class:`SourceLost`."""
        failures = 0
        while (frame := self._try()) is None:
            if not self.live:
                return None
            failures += 1
            if failures >= self.retry.most_failures:
                raise SourceLost(f"{self.source}: {failures} failed reads in a row")
            if failures % self.retry.reopen_every == 0:
                self.device.release()
                self.device = self.open(self.source)
            self.sleep(self.retry.delay_s)
        return frame

    def release(self) -> None:
        self.device.release()


def frames(open_: Opener, source: str, live: bool, backup: str | None = None, retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:  # noqa: B008
    """The frames of a source and, if it can't be opened or is lost, then those of its backup, once."""
    number = 0
    for name, is_backup in ((source, False), *([(backup, True)] if backup else [])):
        reader = None
        try:
            reader = Reader(open_, name, live and not is_backup, retry, sleep)
            while (frame := reader.read()) is not None:
                yield {"source": name, "frame_index": number, "is_backup": is_backup, **frame}
                number += 1
            return
        except Exception:  # noqa: BLE001
            if is_backup or not backup:
                raise
        finally:
            if reader is not None:
                reader.release()


class _Files:
    def __init__(self, source: str) -> None:
        path = Path(source)
        if not path.exists():
            raise FileNotFoundError(source)
        self.left = iter(sorted(p for p in path.iterdir() if p.is_file()) if path.is_dir() else [path])

    def read(self) -> dict | None:
        path = next(self.left, None)
        return None if path is None else {"content": path.read_bytes()}

    def release(self) -> None:
        self.left = iter(())


def open_files(source: str) -> _Files:
    """A picture, or a folder of them in the order of their names, as a source: the opener that needs nothing else."""
    return _Files(source)


def opener(name: str) -> Opener:
    """The function that 'module:name' means."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _Read:
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def all(self, source: str) -> Iterator[tuple]:
        o = self.options
        retry = Retry(int(o.get("mostfailures", 50)), int(o.get("reopenevery", 10)), float(o.get("delays", 0.1)))
        most = int(o["maxframes"]) if o.get("maxframes") else None
        for f in frames(opener(o["opener"]), source, o.get("live", "false") == "true", o.get("backup") or None, retry):
            if most is not None and f["frame_index"] >= most:
                return
            yield f["source"], f["frame_index"], f["is_backup"], bytes(f.get("content") or b"")


class _Batch:
    """One partition per source, so that sources are read side by side."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.options["path"].split(",") if s]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _Read(self.options).all(partition.value)


class _Stream(SimpleDataSourceStreamReader):
    """A source as a stream of numbered frames; ``step`` frames a micro-batch."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.step = options, int(options.get("step", 100))
        self.running: Iterator[tuple] | None = None
        self.at = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.running is None or self.at != start["frame"]:
            self.running = (r for r in _Read(self.options).all(self.options["path"]) if r[1] >= start["frame"])
        rows = list(islice(self.running, self.step))
        self.at = start["frame"] + len(rows)
        return iter(rows), {"frame": self.at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        rows = (r for r in _Read(self.options).all(self.options["path"]) if r[1] >= start["frame"])
        return islice(rows, end["frame"] - start["frame"])


class FrameSource(DataSource):
    """``spark.read/readStream.format("sightline_frames")`` with the options path, opener ('module:name'), live, backup,
    mostFailures, reopenEvery, delayS, maxFrames and, for streams, step."""

    @classmethod
    def name(cls) -> str:
        return "sightline_frames"

    def schema(self) -> str:
        return FRAME_SCHEMA

    def _options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> Any:
        from pyspark.sql.datasource import DataSourceReader

        return type("_FrameBatch", (_Batch, DataSourceReader), {})(self._options())

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Stream(self._options())
