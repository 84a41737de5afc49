"""Pages and files by address, over any transport: a pause between requests to a host, tries with doubled waits, checksums.

The transport is a function of the address, made once in each task; `http` makes one of the standard library. `fetch` deals rows out by
host, so that one task asks a host at a time. `fetch_scheduled` gives every address of a host a time slot of its own, and any number of
tasks keep to the slots: a slow answer holds up only its own task, and a host's pauses stay as they are. What misses its slot, or is to be
tried again, gets a slot of a later round.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.registry import REFUSED, RETRIED
from lexloom.sources.tables import written

RETRIES, PAUSE, FIRST_WAIT, TIMEOUT = 3, 1.0, 1.0, 30.0


@dataclass(frozen=True)
class Reply:
    """A response: its status, body and type, and the address that redirects led to."""

    status: int
    content: bytes
    content_type: str
    url: str


#: Gives the reply to an address, whatever its status; OSError (timeouts too) where there is none.
Transport = Callable[[str], Reply]


def http(timeout: float = TIMEOUT, headers: dict[str, str] | None = None, verify: bool = True) -> Transport:
    """Requests that follow redirects; without `verify` certificates are not checked."""
    import ssl
    import urllib.error
    import urllib.request

    context = ssl.create_default_context()
    if not verify:
        context.check_hostname, context.verify_mode = False, ssl.CERT_NONE

    def get(url: str) -> Reply:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout, context=context) as r:
                return Reply(r.status, r.read(), r.headers.get("Content-Type", ""), r.url)
        except urllib.error.HTTPError as e:
            return Reply(e.code, e.read(), e.headers.get("Content-Type", ""), e.url or url)

    return get


def tried(url: str, get: Transport, retries: int = RETRIES, first_wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> tuple[Reply | None, int, str]:
    """(last reply or None, attempts, outcome): `ok`, `refused` for a status that is not tried again, `exhausted` after the last try."""
    wait = first_wait
    for attempt in range(1, retries + 2):
        try:
            reply = get(url)
        except OSError:
            reply = None
        if reply is not None and 200 <= reply.status < 300:
            return reply, attempt, "ok"
        if reply is not None and (reply.status in REFUSED or reply.status not in RETRIED):
            return reply, attempt, "refused"
        if attempt <= retries:
            sleep(wait)
            wait *= 2
    return reply, retries + 1, "exhausted"


_SCHEMA = "url string, final_url string, status int, content binary, content_type string, content_length long, sha256 string, attempts int, outcome string"
_ARROW = pa.schema([("url", pa.string()), ("final_url", pa.string()), ("status", pa.int32()), ("content", pa.binary()), ("content_type", pa.string()), ("content_length", pa.int64()), ("sha256", pa.string()), ("attempts", pa.int32()), ("outcome", pa.string())])


def fetch(addresses: DataFrame, transport: Callable[[], Transport] = http, url: str = "url", retries: int = RETRIES, pause: float = PAUSE, first_wait: float = FIRST_WAIT) -> DataFrame:
    """(url, final_url, status, content, content_type, content_length, sha256, attempts, outcome) of each distinct address.

    Null addresses are left out. An address that gives no `ok` has its last status and no content; it stops no other. Write the result
    before it is used twice: each run of the plan asks again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = transport()
        last: dict[str, float] = {}

        def paced(address: str) -> Reply:
            host = address.split("/")[2] if address.count("/") >= 2 else ""
            rest = last.get(host, -pause) + pause - time.monotonic()
            if rest > 0:
                time.sleep(rest)
            last[host] = time.monotonic()
            return get(address)

        for batch in batches:
            for address in batch.column(0).to_pylist():
                reply, attempts, outcome = tried(address, paced, retries, first_wait)
                body = reply.content if reply is not None and outcome == "ok" else None
                row = (address, reply.url if reply else None, reply.status if reply else None, body, reply.content_type if reply else None, None if body is None else len(body), None if body is None else hashlib.sha256(body).hexdigest(), attempts, outcome)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW)], schema=_ARROW)

    known = addresses.select(F.col(url).alias("url")).filter("url is not null").distinct()
    host = F.regexp_extract("url", r"^[^/]*//([^/?#]*)", 1)
    return known.repartition(host).mapInArrow(run, _SCHEMA)


#: Parts of a host's addresses that are ranked apart, so that a host with most addresses is no one task.
RANKED_APART = 256
#: How late a request may be, as a share of the pause; slots are that much further apart, so two requests to a host are at least the pause apart.
LATE = 0.25
HOST = r"^[^/]*//([^/?#]*)"


class Clock:
    """Seconds since 1970 and waiting; machines of a cluster are taken to agree to within LATE of a pause."""

    def now(self) -> float:
        return time.time()

    def sleep(self, seconds: float) -> None:
        time.sleep(seconds)


def slots(addresses: DataFrame, url: str = "url") -> DataFrame:
    """(url, attempt, host, slot): the place of each address among those of its host, from 0, without gaps or repeats.

    Ranks are worked out in parts of a host's addresses, by a hash; the parts' sizes give where each begins.
    """
    part = F.pmod(F.xxhash64(url), F.lit(RANKED_APART))
    rows = addresses.select(F.col(url).alias("url"), "attempt", F.regexp_extract(url, HOST, 1).alias("host"), part.alias("_part"))
    sizes = rows.groupBy("host", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("host").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("host", "_part").orderBy("url")) - 1
    begins = sizes.select("host", "_part", before.alias("_begin"))
    return rows.withColumn("_place", place).join(begins, ["host", "_part"]).select("url", "attempt", "host", (F.col("_begin") + F.col("_place")).alias("slot"))


def fetch_scheduled(
    addresses: DataFrame, transport: Callable[[], Transport] = http, url: str = "url", retries: int = RETRIES, pause: float = PAUSE, first_wait: float = FIRST_WAIT, tasks: int | None = None, lead: float = 2.0, clock: Callable[[], Clock] = Clock
) -> DataFrame:
    """As fetch, by time slots: `tasks` of any number (default: the cores) work on each host, and two requests to a host are `pause` seconds apart at least.

    A round begins `lead` seconds after it is planned. A task that comes too late for a slot leaves the address to the next round, like one whose reply
    may pass later, for which the round waits `first_wait` seconds, doubled with each try. Each round's replies are written before the next one is planned, so none is asked
    for twice; a task that is lost asks again only for what it had.
    """
    spark = addresses.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    spacing = pause * (1 + LATE)
    schema = _SCHEMA + ", again boolean"

    def asked(start: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            get, own = transport(), clock()
            for batch in batches:
                for address, attempt, slot in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    due = start + slot * spacing
                    if own.now() < due:
                        own.sleep(due - own.now())
                    if own.now() > due + LATE * pause:
                        row = (address, None, None, None, None, None, None, attempt, "late", True)
                    else:
                        reply, _, outcome = tried(address, get, 0, 0.0, own.sleep)
                        again = outcome == "exhausted" and attempt < retries
                        body = reply.content if reply is not None and outcome == "ok" else None
                        row = (address, reply.url if reply else None, reply.status if reply else None, body, reply.content_type if reply else None, None if body is None else len(body), None if body is None else hashlib.sha256(body).hexdigest(), attempt + 1, outcome, again)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [*_ARROW.types, pa.bool_()])], names=[*_ARROW.names, "again"])

        return run

    left = addresses.select(F.col(url).alias("url")).filter("url is not null").distinct().withColumn("attempt", F.lit(0))
    done, attempt, own = None, 0, clock()
    while True:
        placed = written(slots(left), "slots")
        if not placed.limit(1).count():
            break
        dealt = placed.select("url", "attempt", "slot", F.pmod("slot", F.lit(tasks)).cast("int").alias("_task")).repartitionByRange(tasks, "_task").sortWithinPartitions("slot").select("url", "attempt", "slot")
        wait = first_wait * 2 ** (attempt - 1) if attempt else 0.0
        replies = written(dealt.mapInArrow(asked(own.now() + lead + wait), schema), "replies")
        rest = replies.filter("again")
        final = replies.filter("not again").drop("again")
        done = final if done is None else done.unionByName(final)
        left = rest.select("url", F.col("attempts").alias("attempt"))
        attempt = rest.agg(F.max(F.when(F.col("outcome") != "late", F.col("attempts")))).first()[0] or 0
    return done if done is not None else spark.createDataFrame([], _SCHEMA)
