"""The query service: validate, choose a model, cache, limit with lookahead, time out."""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lexiloom.plans import algebra as A
from lexiloom.plans.lower import Lowering
from lexiloom.plans.parser import QueryError, parse

MAX_ROWS, MAX_SECONDS, CACHE_SECONDS = 100, 30, 30 * 60
CACHE_RESULTS = 500

#: How refusals map to HTTP statuses.
STATUS = {"parse": 400, "too-long": 400, "unsafe": 403, "update": 403, "timeout": 504}


class QueryTimeout(TimeoutError):
    kind = "timeout"


@dataclass(frozen=True)
class Result:
    kind: str
    columns: tuple[str, ...]
    rows: tuple
    has_more: bool
    inferred: bool


class QueryService:
    """Answers query text over a base and an inferred triples frame."""

    def __init__(self, spark: SparkSession, base: DataFrame, inferred: DataFrame | None = None, functions: dict | None = None):
        self.spark, self.base, self.inferred, self.functions = spark, base, inferred, functions
        self._cache: OrderedDict = OrderedDict()  # oldest first
        self._locks: dict = {}  # key -> lock and how many hold or wait for it
        self._lock = threading.Lock()

    def prepare(self, text: str, *, limit: int = MAX_ROWS, offset: int = 0, distinct: bool = False, lookahead: bool = True) -> tuple[A.Query, int, bool]:
        """The bounded query, the number of rows to return and whether one more is fetched."""
        q = parse(text)
        paged = A.has_user_pagination(q)
        most = min(MAX_ROWS, limit, A.user_limit(q) or MAX_ROWS) if q.kind == "select" else MAX_ROWS
        lookahead = lookahead and not paged
        if distinct:
            q = A.ensure_distinct(q)
        if q.kind == "select":
            q = A.limit_results(q, most + (1 if lookahead else 0))
            if offset:
                q = A.offset_results(q, offset)
        return q, most, lookahead

    def run(self, text: str, *, inference: bool | None = None, timeout: float = MAX_SECONDS, **options) -> Result:
        """``inference`` None tries the base and, where a select finds nothing there, the inferred model."""
        q, most, lookahead = self.prepare(text, **options)
        key = (repr(q), inference)
        with self._lock:
            lock, n = self._locks.get(key, (threading.Lock(), 0))
            self._locks[key] = lock, n + 1
        try:
            with lock:  # at most one computation for a key
                with self._lock:
                    hit = self._cache.get(key)
                if hit and time.monotonic() - hit[0] < CACHE_SECONDS:
                    return hit[1]
                out = self._choose(q, inference, min(timeout, MAX_SECONDS), most, lookahead)
                with self._lock:
                    self._cache[key] = (time.monotonic(), out)
                    self._cache.move_to_end(key)
                    while len(self._cache) > CACHE_RESULTS:
                        self._cache.popitem(last=False)
                return out
        finally:
            with self._lock:
                lock, n = self._locks[key]
                if n > 1:
                    self._locks[key] = lock, n - 1
                else:
                    del self._locks[key]

    def _choose(self, q: A.Query, inference: bool | None, timeout: float, most: int, lookahead: bool) -> Result:
        if inference and self.inferred is not None:
            return self._execute(q, self.inferred, timeout, most, lookahead, True)
        out = self._execute(q, self.base, timeout, most, lookahead, False)
        if inference is None and q.kind == "select" and not out.rows and self.inferred is not None:
            return self._execute(q, self.inferred, timeout, most, lookahead, True)
        return out

    def _execute(self, q: A.Query, triples: DataFrame, timeout: float, most: int, lookahead: bool, inferred: bool) -> Result:
        group = f"query-{uuid.uuid4().hex}"
        box: dict = {}

        def work() -> None:
            self.spark.sparkContext.setJobGroup(group, "query", interruptOnCancel=True)
            try:
                df = Lowering(triples, functions=self.functions).run(q)
                if q.kind in ("construct", "describe"):
                    df = df.limit(MAX_ROWS)
                box["rows"], box["columns"] = df.collect(), tuple(df.columns)
            except Exception as e:  # noqa: BLE001  handed to the caller below
                box["error"] = e

        thread = threading.Thread(target=work, daemon=True)
        thread.start()
        thread.join(timeout)
        if thread.is_alive():
            self.spark.sparkContext.cancelJobGroup(group)
            raise QueryTimeout(f"no result within {timeout} s")
        if "error" in box:
            raise box["error"]
        rows = tuple(tuple(r) for r in box["rows"])
        more = lookahead and len(rows) > most
        return Result(q.kind, box["columns"], rows[:most], more, inferred)


def status_of(error: Exception) -> int:
    return STATUS.get(getattr(error, "kind", ""), 500)


__all__ = ["MAX_ROWS", "QueryError", "QueryService", "QueryTimeout", "Result", "status_of"]
