"""Paged services as a data source: a row for each page of answers, read by tasks, paced and tried again.

    spark.dataSource.register(PagedService)
    spark.read.format("paged_service").option("url", ...).option("style", "cursor").load()

Options, all as text:

* url: with `{from}` for the page, offset, cursor or token, `{size}` for the rows of a page, and `{slice}` for the slice.
* slices: what the query is cut into (years, languages), separated by `|`; each slice is a read of its own.
* style: `page` (from 1) or `offset` (from 0): every page is a partition, tasks read them side by side; `cursor` or
  `token`: a page names the next one, so a slice is a partition, whose pages are read one after another.
* limit, size: rows wanted of a slice and rows of a page; next, items: the places of the next cursor and of the rows in
  the answer (`meta.next_cursor`); first: the first cursor (`*`; for token style none).
* pause: seconds between a task's calls; lanes: tasks that call at once (partitions are dealt to as many); attempts:
  calls of a page at most, waiting pause, twice that and so on after 429, 5xx and failures of the connection.
* simple: a url without filters that a slice falls back to where its first page fails; its one page is the slice's answer.
* done: `slice:from` of pages that are held already, separated by `|`, which are not called again (for cursors: the
  last page held of a slice, from which the read goes on).

A page that fails after all attempts ends its slice and gives a row with the error, so a later read can go on there.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COLUMNS = "slice string, place string, number int, next string, body string, error string"


class Pages(InputPartition):
    """Calls that one task makes, one after another: (slice, first place, number of the first page)."""

    def __init__(self, calls: list[tuple[str, str, int]]):
        self.calls = calls


def at_path(answer: object, path: str) -> object:
    """What lies at `a.b.c`, or None."""
    for name in path.split(".") if path else []:
        answer = answer.get(name) if isinstance(answer, dict) else None
    return answer


def called(url: str, pause: float, attempts: int, timeout: float) -> tuple[str | None, str | None]:
    """(body, error) of a call; only what may pass is tried again."""
    error = None
    for tried in range(attempts):
        time.sleep(pause * (1 if not tried else 2**tried))
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310  the url is the user's
                return answer.read().decode("utf-8"), None
        except urllib.error.HTTPError as e:
            error = f"HTTP {e.code}"
            if e.code != 429 and e.code < 500:
                break
        except (OSError, ValueError) as e:
            error = type(e).__name__
    return None, error


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        get = options.get
        self.url, self.simple, self.style = options["url"], get("simple", ""), get("style", "page")
        if self.style not in ("page", "offset", "cursor", "token"):
            raise ValueError(f"unknown style {self.style}")
        self.slices = get("slices", "").split("|")
        self.limit, self.size = int(get("limit", "100")), int(get("size", "25"))
        self.size = max(1, min(self.size, self.limit))
        self.next, self.items, self.first = get("next", ""), get("items", ""), get("first", "*" if self.style == "cursor" else "")
        self.pause, self.attempts, self.timeout = float(get("pause", "0")), max(1, int(get("attempts", "3"))), float(get("timeout", "30"))
        self.lanes = max(1, int(get("lanes", "4")))
        self.done = dict.fromkeys(x for x in get("done", "").split("|") if x)

    @property
    def chained(self) -> bool:
        return self.style in ("cursor", "token")

    def partitions(self) -> list[InputPartition]:
        pages = -(-self.limit // self.size)
        calls = []
        for part in self.slices:
            if self.chained:
                calls.append((part, self.first, 0))
                continue
            for k in range(pages):
                place = str(k + 1 if self.style == "page" else k * self.size)
                if f"{part}:{place}" not in self.done:
                    calls.append((part, place, k))
        lanes = [calls[i :: self.lanes] for i in range(self.lanes)]
        return [Pages(lane) for lane in lanes if lane] or [Pages([])]

    def _asked(self, url: str, part: str, place: str) -> tuple[str | None, str | None]:
        values = {"{from}": place, "{size}": str(self.size), "{slice}": part}
        for name, value in values.items():
            url = url.replace(name, urllib.parse.quote(value, safe=""))
        return called(url, self.pause, self.attempts, self.timeout)

    def read(self, partition: Pages) -> Iterator[tuple]:
        for part, place, number in partition.calls:
            if self.chained:
                held = [x.split(":", 1)[1] for x in self.done if x.split(":", 1)[0] == part]
                yield from self._chain(part, held[-1] if held else place, bool(held))
                continue
            body, error = self._asked(self.url, part, place)
            if body is None and number == 0 and self.simple:
                body, error = self._asked(self.simple, part, place)
            yield part, place, number, None, body, error

    def _chain(self, part: str, place: str, held: bool) -> Iterator[tuple]:
        rows, number = 0, 0
        while rows < self.limit:
            body, error = self._asked(self.url, part, place)
            whole = body is None and number == 0 and bool(self.simple)
            if whole:
                body, error = self._asked(self.simple, part, place)
            try:
                answer = json.loads(body) if body is not None else None
            except ValueError:
                answer, error = None, "no JSON"
            found = at_path(answer, self.items)
            following = at_path(answer, self.next) if self.next else None
            following = str(following) if following not in (None, "") else None
            if not (held and number == 0):  # the last page held tells where to go on
                yield part, place, number, following, body if answer is not None else None, error
            rows += len(found) if isinstance(found, list) else 0
            number += 1
            if whole or error or not found or following is None or following == place:
                return
            place = following


class PagedService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_service"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


def results(pages: DataFrame, items: str, schema: str, limit: int | None = None) -> DataFrame:
    """slice, rank, r: the rows of pages in the order of the service, parsed to schema (of one row); at most `limit` of a
    slice, where that is given, as the service's own limit."""
    answer = F.from_json("body", _nested(items, schema))
    rows = F.coalesce(F.col(f"_a.{items}"), F.array()) if items else F.coalesce(F.col("_a"), F.array())
    told = pages.where("body is not null").withColumn("_a", answer)
    sizes = told.select("slice", "number", F.size(rows).alias("_n"))
    # of a slice only the sizes of its pages are put in order
    before = F.expr("transform(sequence(0, size(p) - 1), i -> named_struct('number', p[i].number, 'since', aggregate(slice(p, 1, i), 0L, (s, x) -> s + x.n)))")
    since = sizes.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("number", F.col("_n").cast("long").alias("n")))).alias("p"))
    since = since.select("slice", F.explode(before).alias("b")).select("slice", "b.number", "b.since")
    out = told.join(since, ["slice", "number"]).select("slice", "since", F.posexplode(rows).alias("at", "r")).select("slice", (F.col("since") + F.col("at") + 1).alias("rank"), "r")
    return out if limit is None else out.where(F.col("rank") <= limit)


def _nested(path: str, schema: str) -> str:
    """The schema of an answer that holds rows at a path."""
    out = f"array<struct<{schema}>>"
    for name in reversed(path.split(".") if path else []):
        out = f"struct<`{name}`: {out}>"
    return out
