"""Syslog over UDP and TCP as streaming sources, for development and single collectors.

Large deployments put a collector and a log broker before ``readStream``.
"""

from __future__ import annotations

import logging
import pickle
import select
import socket
import time
from collections import Counter
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .syslog import MOST_DATAGRAM_BYTES, MOST_LINE_BYTES


class Shed:
    """Counts what a source leaves out, by cause, and warns at most once in each interval."""

    def __init__(self, source: str, interval: float = 5.0, warn: Callable[[str], None] = logging.getLogger(__name__).warning, clock: Callable[[], float] = time.monotonic):
        self.source, self.interval, self.warn, self.clock = source, interval, warn, clock
        self.counts: Counter[str] = Counter()
        self.next = float("-inf")

    @property
    def total(self) -> int:
        return sum(self.counts.values())

    def note(self, cause: str) -> None:
        self.counts[cause] += 1
        if self.clock() >= self.next:
            self.next = self.clock() + self.interval
            self.warn(f"{self.source} sheds: {self.total} so far, now {cause}")


class Taken:
    """Rows that were taken and may be asked for again, until they are committed.

    With ``folder``, each batch is a file there before Spark sees it, so that a new
    process gives the same rows for offsets that were planned before it started.
    """

    def __init__(self, folder: str | None = None):
        self.folder = Path(folder) if folder else None
        self.rows: list[tuple[int, list]] = []
        if self.folder:
            self.folder.mkdir(parents=True, exist_ok=True)
            self.rows = [(int(p.stem), pickle.loads(p.read_bytes())) for p in sorted(self.folder.glob("*.rows"))]

    @property
    def end(self) -> int:
        """The offset after the last row taken."""
        return max((n + len(rows) for n, rows in self.rows), default=0)

    def keep(self, n: int, rows: list) -> None:
        if not rows:
            return
        self.rows.append((n, rows))
        if self.folder:
            part = self.folder / f"{n:020d}.part"
            part.write_bytes(pickle.dumps(rows))
            part.rename(part.with_suffix(".rows"))

    def between(self, start: int, end: int) -> list:
        return [r for n, rows in self.rows for k, r in enumerate(rows, n) if start <= k < end]

    def forget(self, end: int) -> None:
        gone = [n for n, rows in self.rows if n + len(rows) <= end]
        # The last batch stays, for the offset after it.
        gone = [n for n in gone if n != (self.rows[-1][0] if self.rows else None)]
        self.rows = [(n, rows) for n, rows in self.rows if n not in gone]
        for n in gone if self.folder else []:
            (self.folder / f"{n:020d}.rows").unlink(missing_ok=True)


class Udp(DataSource):
    """``spark.readStream.format("syslog_udp").option("port", …)`` after ``register``."""

    @classmethod
    def name(cls) -> str:
        return "syslog_udp"

    def schema(self) -> str:
        return "event_id long, received_at timestamp, peer string, raw binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return UdpReader(self.options)


class UdpReader(SimpleDataSourceStreamReader):
    """Takes what has arrived, up to the quota of a second and the rows of a batch; what is over them is shed and counted.

    Taken rows can be read again until they are committed; with the option ``journal``
    (a folder) also by a process that starts anew.
    """

    def __init__(self, options: dict):
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.bind((options.get("host", "127.0.0.1"), int(options["port"])))
        self.socket.settimeout(float(options.get("wait", "0.2")))
        self.quota = int(options.get("quota", "50000"))
        self.most_rows = int(options.get("most_rows", "200000"))
        self.shed = Shed("syslog_udp")
        self.taken = Taken(options.get("journal"))

    def initialOffset(self) -> dict:
        return {"n": self.taken.end}

    def read(self, start: dict) -> tuple[Iterator, dict]:
        import datetime

        rows, n, began, second, passed = [], start["n"], time.monotonic(), 0, 0
        try:
            while time.monotonic() - began < 1:
                raw, (peer, _) = self.socket.recvfrom(MOST_DATAGRAM_BYTES)
                now = int(time.monotonic())
                second, passed = now, (passed if now == second else 0) + 1
                if passed > self.quota or len(rows) >= self.most_rows:
                    self.shed.note("over the quota of a second" if passed > self.quota else "the batch is full")
                    continue
                rows.append((n, datetime.datetime.now(), peer, raw))
                n += 1
        except TimeoutError:
            pass
        self.taken.keep(start["n"], rows)
        return iter(rows), {"n": n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator:
        return iter(self.taken.between(start["n"], end["n"]))

    def commit(self, end: dict) -> None:
        self.taken.forget(end["n"])


class Tcp(DataSource):
    """``spark.readStream.format("syslog_tcp").option("port", …)``: frames end with a line end."""

    @classmethod
    def name(cls) -> str:
        return "syslog_tcp"

    def schema(self) -> str:
        return "event_id long, received_at timestamp, peer string, raw binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return TcpReader(self.options)


class Frames:
    """Cuts a connection's bytes at line ends; a longer line than allowed ends the connection."""

    def __init__(self, most: int = MOST_LINE_BYTES):
        self.most, self.rest = most, b""

    def feed(self, data: bytes) -> list[bytes]:
        *whole, self.rest = (self.rest + data).split(b"\n")
        if len(self.rest) > self.most or any(len(x) > self.most for x in whole):
            raise ValueError("a frame over the limit")
        return [x.rstrip(b"\r") for x in whole if x.strip(b"\r")]


class TcpReader(SimpleDataSourceStreamReader):
    """Reads what has arrived on all connections. What is not read stays in the sender's window, so nothing is shed.

    Taken rows can be read again as those of ``UdpReader`` can.
    """

    def __init__(self, options: dict):
        self.server = socket.create_server((options.get("host", "127.0.0.1"), int(options["port"])))
        self.wait = float(options.get("wait", "0.2"))
        self.most_rows = int(options.get("most_rows", "50000"))
        self.open: dict[socket.socket, tuple[str, Frames]] = {}
        self.taken = Taken(options.get("journal"))

    def initialOffset(self) -> dict:
        return {"n": self.taken.end}

    def read(self, start: dict) -> tuple[Iterator, dict]:
        import datetime

        rows, n, until = [], start["n"], time.monotonic() + 1
        while time.monotonic() < until and len(rows) < self.most_rows:
            ready, _, _ = select.select([self.server, *self.open], [], [], self.wait)
            if not ready:
                break
            for s in ready:
                if s is self.server:
                    connection, (peer, *_) = s.accept()
                    self.open[connection] = peer, Frames()
                    continue
                peer, frames = self.open[s]
                data = s.recv(1 << 16)
                try:
                    found = frames.feed(data or b"\n")
                except ValueError:
                    found, data = [], b""
                for raw in found:
                    rows.append((n, datetime.datetime.now(), peer, raw))
                    n += 1
                if not data:
                    self.open.pop(s)
                    s.close()
        self.taken.keep(start["n"], rows)
        return iter(rows), {"n": n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator:
        return iter(self.taken.between(start["n"], end["n"]))

    def commit(self, end: dict) -> None:
        self.taken.forget(end["n"])


def register(spark) -> None:
    spark.dataSource.register(Udp)
    spark.dataSource.register(Tcp)
