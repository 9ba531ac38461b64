"""Reading paged listings, single objects by key, and histories with a backward cursor, over HTTP.

A listing is asked in the way of PostgREST: ``select``, ``order``, ``limit``, ``offset``, and a parameter ``column=op.value`` per
condition; ``Prefer: count=exact`` makes the answer's Content-Range end in the number of all rows.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    SimpleDataSourceStreamReader,
)

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_COMPARED = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "gte", LessThan: "lt", LessThanOrEqual: "lte"}
#: Seconds before the first repeat of a failed request; they double with each.
WAIT = 0.5


def fetch(url: str, params: Iterable[tuple[str, str]] = (), headers: dict[str, str] | None = None, timeout: float = 30.0, retries: int = 3) -> tuple[bytes, dict[str, str]]:
    """The body and headers of an answer. Refused connections, timeouts, 429 and 5xx are asked again, other errors raised."""
    query = urllib.parse.urlencode(list(params))
    request = urllib.request.Request(f"{url}?{query}" if query else url, headers=headers or {})
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.read(), dict(answer.headers)
        except urllib.error.HTTPError as e:
            if attempt == retries or e.code != 429 and e.code < 500:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt == retries:
                raise
        time.sleep(WAIT * 2**attempt)
    raise AssertionError("unreachable")


def count_rows(url: str, params: Iterable[tuple[str, str]] = (), headers: dict[str, str] | None = None, retries: int = 3) -> int:
    """How many rows a listing has under the conditions; none of them is sent. 0 if the service doesn't say."""
    asked = {"Prefer": "count=exact", "Range-Unit": "items", "Range": "0-0"} | (headers or {})
    total = {k.lower(): v for k, v in fetch(url, params, asked, retries=retries)[1].items()}.get("content-range", "").rpartition("/")[2]
    return int(total) if total.isdigit() else 0


def _literal(value: object) -> str:
    if isinstance(value, datetime):
        return (value if value.tzinfo else value.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).isoformat().replace("+00:00", "Z")
    if isinstance(value, date):
        return value.isoformat()
    return str(value).lower() if isinstance(value, bool) else str(value)


def condition(f: Filter) -> tuple[str, str] | None:
    """The parameter for a pushed filter; None for one that the service isn't asked about."""
    negated, f = (True, f.child) if isinstance(f, Not) else (False, f)
    if len(f.attribute if hasattr(f, "attribute") else ()) != 1:
        return None
    name, prefix = f.attribute[0], "not." if negated else ""
    if type(f) in _COMPARED:
        return name, f"{prefix}{_COMPARED[type(f)]}.{_literal(f.value)}"
    if isinstance(f, In):
        return name, f"{prefix}in.({','.join(json.dumps(_literal(v), ensure_ascii=False) if isinstance(v, str) else _literal(v) for v in f.value)})"
    if isinstance(f, IsNull | IsNotNull):
        return name, f"{'not.' if negated != isinstance(f, IsNotNull) else ''}is.null"
    return None


def _typed(value: object, kind: T.DataType) -> object:
    """A JSON value as one that Arrow takes for the type; null if it doesn't fit."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.TimestampType | T.TimestampNTZType):
            at = datetime.fromisoformat(value)
            at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
            return at.astimezone(timezone.utc) if isinstance(kind, T.TimestampType) else at.replace(tzinfo=None)
        if isinstance(kind, T.DateType):
            return date.fromisoformat(value[:10])
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        if isinstance(kind, T.IntegralType):
            return int(value)
        if isinstance(kind, T.FractionalType):
            return float(value)
        if isinstance(kind, T.ArrayType):
            return [_typed(x, kind.elementType) for x in value]
        if isinstance(kind, T.StructType):
            return {f.name: _typed(value.get(f.name), f.dataType) for f in kind}
    except (ValueError, TypeError, AttributeError):
        return None
    return value


def to_batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist([_typed(r, schema) for r in rows], to_arrow_schema(schema))


@dataclass
class Pages(InputPartition):
    """Rows start to end of a listing; the last partition has no end."""

    start: int
    end: int | None


class RestListing(DataSource):
    """``rest_listing``: a paged listing. Options: url; order (a total one, so that pages don't overlap; new rows should come
    last); page_size (100); pages_per_task (50); limit (all rows); timeout, retries; ``param.<name>`` and ``header.<name>``.

    The rows are counted first, and each task asks for its range of pages. A page may be shorter than asked for: the next one
    starts where it ended. The last task goes on until a page is empty or short, for rows that have come meanwhile.
    Comparisons, IN and null tests of single columns are asked of the service, and only the schema's columns.
    """

    @classmethod
    def name(cls) -> str:
        return "rest_listing"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ListingReader(schema, dict(self.options))


class _ListingReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        named = lambda kind: [(k[len(kind) :], v) for k, v in options.items() if k.lower().startswith(kind)]
        self.schema, self.url = schema, options["url"]
        self.page, self.per_task = int(options.get("page_size", 100)), int(options.get("pages_per_task", 50))
        self.most = int(options["limit"]) if "limit" in options else None
        self.timeout, self.retries = float(options.get("timeout", 30)), int(options.get("retries", 3))
        self.headers, self.conditions = dict(named("header.")), named("param.")
        self.shape = [("select", ",".join(schema.names))] + ([("order", options["order"])] if "order" in options else [])

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            asked = condition(f)
            if asked:
                self.conditions.append(asked)
            else:
                yield f

    def partitions(self) -> list[Pages]:
        n, step = count_rows(self.url, self.conditions, self.headers, self.retries), self.page * self.per_task
        if self.most is not None:
            n = min(n, self.most)
        starts = list(range(0, n, step)) or [0]
        return [Pages(a, b) for a, b in zip(starts, [*starts[1:], self.most], strict=True)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        at = partition.start
        while partition.end is None or at < partition.end:
            limit = self.page if partition.end is None else min(self.page, partition.end - at)
            body, _ = fetch(self.url, [*self.shape, *self.conditions, ("limit", str(limit)), ("offset", str(at))], self.headers, self.timeout, self.retries)
            rows = json.loads(body)
            if not rows:
                return
            yield to_batch(rows, self.schema)
            at += len(rows)


def read_listing(
    spark: SparkSession, url: str, schema: str, order: str, params: dict[str, str] | None = None, headers: dict[str, str] | None = None, page_size: int = 100, pages_per_task: int = 50, limit: int | None = None
) -> DataFrame:
    """The rows of a RestListing. Turns on the session's filter pushdown for Python sources, without which Spark refuses it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(RestListing)
    options = {f"param.{k}": v for k, v in (params or {}).items()} | {f"header.{k}": v for k, v in (headers or {}).items()}
    options |= {"url": url, "order": order, "page_size": page_size, "pages_per_task": pages_per_task} | ({} if limit is None else {"limit": limit})
    return spark.read.format("rest_listing").schema(schema).options(**options).load()


def fetch_objects(keys: DataFrame, key: str, url: str, in_flight: int = 5, tasks: int = 1, headers: dict[str, str] | None = None, retries: int = 0, timeout: float = 30.0, failures: bool = False) -> DataFrame:
    """``key`` and ``document``, the text of each key's object.

    url: a format of the key, ``{0}``, or of its first characters, ``{0:.3}``. At most in_flight requests are open in a task,
    and tasks of them run: so many blocks the distinct keys are dealt to. Keys that fail, after the retries, and null keys
    are left out; with failures they come with a null document and ``error``. Nothing is held but what is in flight.
    """

    def ask(value: str) -> tuple[str, str | None, str | None]:
        try:
            return value, fetch(url.format(urllib.parse.quote(value, safe="")), (), headers, timeout, retries)[0].decode("utf-8"), None
        except (OSError, UnicodeDecodeError, ValueError) as e:
            return value, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                values = batch.column(0).to_pylist()
                for a in range(0, len(values), 4 * in_flight):
                    found = [x for x in pool.map(ask, values[a : a + 4 * in_flight]) if failures or x[1] is not None]
                    columns = [pa.array([x[i] for x in found], pa.string()) for i in range(3 if failures else 2)]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "document", "error"][: len(columns)])

    asked = keys.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()
    return asked.repartition(tasks, key).mapInArrow(run, f"`{key}` string, document string" + (", error string" if failures else ""))


def recent_by_tags(spark: SparkSession, url: str, schema: str, tags: Iterable[str], column: str, ts: str, key: str, limit: int | None = None, since: date | None = None, **listing) -> DataFrame:
    """The latest rows whose array column holds one of the tags, lower-cased; one read per tag, each key once.

    limit: of each read, and of the result, the feature of such a list.
    """
    found = None
    for tag in dict.fromkeys(t.lower() for t in tags):
        params = dict(listing.get("params") or {}) | {column: f"cs.{{{tag}}}"} | ({ts: f"gte.{since.isoformat()}"} if since else {})
        own = read_listing(spark, url, schema, f"{ts}.desc,{key}.desc", **(listing | {"params": params, "limit": limit}))
        found = own if found is None else found.union(own)
    if found is None:
        return spark.createDataFrame([], schema)
    found = found.dropDuplicates([key]).orderBy(F.desc(ts), F.desc(key))
    return found if limit is None else found.limit(limit)


def in_window(rows: DataFrame, ts: str, start: datetime, seconds: float, buffer: float = 120.0) -> DataFrame:
    """Rows from buffer seconds before start to as many after its end, which is left out. A listing is asked for these only."""
    a, b = start - timedelta(seconds=buffer), start + timedelta(seconds=seconds + buffer)
    return rows.where((F.col(ts) >= F.lit(a)) & (F.col(ts) < F.lit(b)))


class Kept:
    """Results by key, for so many seconds; callers that ask for one while it is made wait for it and share it."""

    def __init__(self, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock = seconds, clock
        self._lock, self._locks, self._held = threading.Lock(), {}, {}

    def get(self, key: object, make: Callable[[], DataFrame]) -> DataFrame:
        with self._lock:
            own = self._locks.setdefault(key, threading.Lock())
        with own:
            made, df = self._held.get(key, (None, None))
            if df is None or self.clock() - made >= self.seconds:
                if df is not None:
                    df.unpersist()
                df = make().persist()
                self._held[key] = (self.clock(), df)
            return df


class RestHistory(DataSource):
    """``rest_history``: a stream of a history from its newest row back to its first, page by page.

    Options: url; cursor (``before``: the parameter that takes the last id seen), key (``id``), page_size (100); timeout, retries;
    ``param.<name>`` and ``header.<name>``. A page comes newest first. The offset is the cursor, so a query that starts again
    from its checkpoint goes on where it was; one row of state, however long the history. At the first row it stands still.
    """

    @classmethod
    def name(cls) -> str:
        return "rest_history"

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        return _HistoryReader(schema, dict(self.options))


class _HistoryReader(SimpleDataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.listing = _ListingReader(schema, options)
        self.cursor, self.key = options.get("cursor", "before"), options.get("key", "id")

    def initialOffset(self) -> dict:
        return {"before": None, "done": False}

    def _page(self, start: dict) -> tuple[list[tuple], dict]:
        if start["done"]:
            return [], start
        own = self.listing
        asked = [*own.conditions, ("limit", str(own.page))] + ([(self.cursor, str(start["before"]))] if start["before"] is not None else [])
        rows = json.loads(fetch(own.url, asked, own.headers, own.timeout, own.retries)[0])
        if not rows:
            return [], {"before": start["before"], "done": True}
        return [tuple(_typed(r.get(f.name), f.dataType) for f in own.schema) for r in rows], {"before": rows[-1][self.key], "done": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._page(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start != end:
            rows, start = self._page(start)
            yield from rows
            if start["done"]:
                return

    def commit(self, end: dict) -> None:
        pass


def read_history(spark: SparkSession, url: str, schema: str, **options: str | int) -> DataFrame:
    spark.dataSource.register(RestHistory)
    return spark.readStream.format("rest_history").schema(schema).options(url=url, **options).load()
