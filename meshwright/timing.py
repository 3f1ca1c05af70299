"""Timers of named tasks, feature flags and logging of the driver."""

from __future__ import annotations

import importlib.util
import logging
import time
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("meshwright")
_times: dict[str, list[float]] = {}
#: What is there: formats and solvers that other tools take from libraries are built in or absent.
FEATURES = {"complex": False, "adios2": False, "hdf5": False, "parquet": True, "krylov": True, "external_partitioners": False, "arrow": importlib.util.find_spec("pyarrow") is not None}


def init_logging(level: int = logging.INFO) -> logging.Logger:
    """The package's logger, writing to standard error."""
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
    log.setLevel(level)
    return log


class Timer:
    """Wall time of a task; stop() and resume() as often as wanted, flush() registers the sum once."""

    def __init__(self, task: str | None = None):
        self.task, self._sum, self._since = task, 0.0, time.perf_counter()

    def elapsed(self) -> float:
        return self._sum + (time.perf_counter() - self._since if self._since is not None else 0.0)

    def stop(self) -> float:
        self._sum, self._since = self.elapsed(), None
        return self._sum

    def resume(self) -> None:
        if self._since is None:
            self._since = time.perf_counter()

    def start(self) -> None:
        self._sum, self._since = 0.0, time.perf_counter()

    def flush(self) -> float:
        found = self.stop()
        if self.task:
            register_timing(self.task, found)
        self._sum = 0.0
        return found

    def __enter__(self) -> Timer:
        self.start()
        return self

    def __exit__(self, *_) -> None:
        self.flush()


def register_timing(task: str, seconds: float) -> None:
    _times.setdefault(task, []).append(seconds)


def timing(task: str) -> tuple[int, float]:
    """(times, seconds in all) of a task."""
    if task not in _times:
        raise KeyError(task)
    return len(_times[task]), sum(_times[task])


def timings(spark: SparkSession) -> DataFrame:
    """(task, reps, average, total)."""
    return spark.createDataFrame([(t, len(x), sum(x) / len(x), sum(x)) for t, x in sorted(_times.items())], "task string, reps int, average double, total double")


def timed(task: str) -> Callable:
    """Registers the time of every call of a function."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def inner(*args, **options):
            with Timer(task):
                return f(*args, **options)

        return inner

    return wrap
