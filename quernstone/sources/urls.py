"""Documents by url: fetched by tasks through a transport that is passed in, then parsed like uploaded files.

Equal urls are fetched once. Urls are dealt by host and lane: `lanes` is how many tasks may ask one host at a time, so a host with
a third of all urls is asked politely and takes only its lanes; other hosts go on beside it. A task streams through its urls
and holds one answer. Answers that say "later" are asked for again with doubling waits, redirects are followed, and what can't be
had becomes a row with its error, never a failed job.

`source` makes a Spark data source of the same: `spark.read.format(name)` for a list of urls in an option (a request's body), and
`spark.readStream.format(name)` for a listing that grows; both with a partition for each host and lane.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.text import parse
from ..operators.spread import cut, join_spread

# Answers that say "later", and those that say "elsewhere".
LATER, ELSEWHERE = (429, 500, 502, 503, 504), (301, 302, 303, 307, 308)
ANSWER = "url string, final_url string, status int, mime string, content binary, error string, tries int"


@dataclass
class Answer:
    """What a transport gets for a url."""

    status: int
    mime: str = "text/html"
    content: bytes = b""
    location: str | None = None


Transport = Callable[[str], Answer]


@dataclass(frozen=True)
class Rules:
    tries: int = 4
    first_wait: float = 0.5
    redirects: int = 5
    most_bytes: int = 50_000_000


def retrieve(transport: Transport, url: str, rules: Rules = Rules(), sleep: Callable[[float], None] = time.sleep) -> tuple:
    """The row of ANSWER for a url."""
    at, seen, tries = url, {url}, 0
    while True:
        tries += 1
        try:
            answer, error = transport(at), None
        except Exception as e:  # noqa: BLE001  (whatever a transport raises is that url's error)
            answer, error = None, f"{type(e).__name__}: {e}"[:500]
        if (answer is None or answer.status in LATER) and tries < rules.tries:
            sleep(rules.first_wait * 2 ** (tries - 1))
            continue
        if answer is None:
            return url, at, None, None, None, error, tries
        if answer.status in ELSEWHERE and answer.location:
            at = urljoin(at, answer.location)
            if at in seen or len(seen) > rules.redirects:
                return url, at, answer.status, None, None, "too many redirects", tries
            seen.add(at)
            tries -= 1
            continue
        if answer.status != 200:
            return url, at, answer.status, None, None, f"status {answer.status}", tries
        if len(answer.content) > rules.most_bytes:
            return url, at, answer.status, answer.mime, None, f"more than {rules.most_bytes} bytes", tries
        return url, at, answer.status, answer.mime.split(";")[0].strip().lower(), answer.content, None, tries


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def fetch(urls: DataFrame, transport: Transport, rules: Rules = Rules(), lanes: int = 4) -> DataFrame:
    """Answers (url, final_url, status, mime, content, error, tries) for the different urls of a table (url, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                row = retrieve(transport, url, rules)
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[c.split()[0] for c in ANSWER.split(", ")])

    different = urls.select("url").where("url is not null").distinct()
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number, as few bytes of urls are much to wait for
    dealt = different.repartition(parts, host(F.col("url")), F.pmod(F.xxhash64("url"), F.lit(lanes)))
    return dealt.mapInArrow(run, ANSWER)


def ingest_urls(rows: DataFrame, key: str, transport: Transport, rules: Rules = Rules(), lanes: int = 4) -> DataFrame:
    """Rows (key, url, ...) as documents: with mime, text, status ('completed' or 'failed') and error. The answers are written, so no url is asked twice."""
    answers = cut(fetch(rows, transport, rules, lanes), "answers")
    texts = answers.select("url", "mime", parse(F.col("content"), F.col("mime")).alias("text"), "error", F.lit(True).alias("asked_"))
    found = join_spread(rows, texts, "url", [key], "left")
    error = F.when(F.col("asked_").isNull(), F.lit("no url")).otherwise(F.col("error"))
    return found.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("failed")).drop("asked_")


class _Lane(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


def _lanes(urls: list[str], lanes: int) -> list[_Lane]:
    held: dict[tuple, list[str]] = {}
    for url in dict.fromkeys(urls):
        held.setdefault((host_of(url), zlib.crc32(url.encode()) % lanes), []).append(url)
    return [_Lane(u) for _, u in sorted(held.items())]


def source(name: str, transport: Transport, listing: Callable[[int], list[str]] | None = None, rules: Rules = Rules(), lanes: int = 4) -> type[DataSource]:
    """A data source to register: batches read the urls of the option `urls` (one a line), streams what `listing` has from a position on."""

    class Batch(DataSourceReader):
        def __init__(self, urls: list[str]) -> None:
            self.urls = urls

        def partitions(self):
            return _lanes(self.urls, lanes)

        def read(self, partition):
            return (retrieve(transport, url, rules) for url in partition.urls)

    class Stream(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"at": 0}

        def latestOffset(self) -> dict:
            return {"at": len(listing(0))}

        def partitions(self, start: dict, end: dict):
            return _lanes(listing(start["at"])[: end["at"] - start["at"]], lanes)

        def read(self, partition):
            return (retrieve(transport, url, rules) for url in partition.urls)

    class Urls(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ANSWER

        def reader(self, schema):
            return Batch([u for u in self.options.get("urls", "").split("\n") if u])

        def streamReader(self, schema):
            if listing is None:
                raise ValueError("this source has no listing to stream")
            return Stream()

    return Urls


def urls_option(urls: list[str]) -> str:
    """Urls as the option of a batch; a url holds no line break."""
    if any("\n" in u for u in urls):
        raise ValueError(f"a url with a line break: {json.dumps([u for u in urls if chr(10) in u][0])}")
    return "\n".join(urls)
