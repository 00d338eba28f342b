"""The text protocol: `put series ts value`, `scan series t0 t1 [agg]`."""

from __future__ import annotations

import socketserver
from dataclasses import dataclass
from decimal import Decimal

from .db import Db
from .model import EngineError, ProtocolError
from .operators.predicates import AGGREGATES


@dataclass(frozen=True)
class Put:
    series: int
    ts: int
    value: float


@dataclass(frozen=True)
class Scan:
    series: int
    t0: int
    t1: int
    agg: str | None = None


def _number(kind: type, name: str, text: str, low: int | None = None, high: int | None = None):
    try:
        x = kind(text)
    except ValueError:
        raise ProtocolError(f"bad {name}: {text}") from None
    if low is not None and not low <= x <= high:
        raise ProtocolError(f"bad {name}: {text}")
    return x


def _long(name: str, text: str) -> int:
    return _number(int, name, text, -(2**63), 2**63 - 1)


def parse_command(line: str) -> Put | Scan | None:
    """The command of a line, None for a blank one; ProtocolError says which token is wrong."""
    match line.split():
        case []:
            return None
        case ["put", s, ts, v]:
            return Put(_number(int, "series", s, 0, 2**32 - 1), _long("ts", ts), _number(float, "value", v))
        case ["scan", s, t0, t1, *rest] if len(rest) < 2:
            if rest and rest[0] not in AGGREGATES:
                raise ProtocolError(f"unknown agg: {rest[0]}")
            return Scan(_number(int, "series", s, 0, 2**32 - 1), _long("t0", t0), _long("t1", t1), *rest)
        case [command, *_]:
            raise ProtocolError(f"unknown command: {command}")


def _text(value: float) -> str:
    """The shortest digits that give the value back, all of them and without an exponent; NaN, inf and -inf by name."""
    if value != value:
        return "NaN"
    if value in (float("inf"), float("-inf")):
        return "inf" if value > 0 else "-inf"
    digits = format(Decimal(repr(value)), "f")
    return digits.rstrip("0").rstrip(".") if "." in digits else digits


def handle_line(db: Db, line: str) -> str:
    """The reply to a line: `OK`, samples and `END`, or `ERR` with the reason."""
    try:
        match parse_command(line):
            case None:
                return ""
            case Put(series, ts, value):
                db.put(series, ts, value)
                return "OK\n"
            case Scan(series, t0, t1, agg):
                return "".join(f"{ts} {_text(v)}\n" for ts, v in db.scan(series, t0, t1, agg)) + "END\n"
    except EngineError as x:
        return f"ERR {x}\n"


def server(address: tuple[str, int], db: Db) -> socketserver.ThreadingTCPServer:
    """A server to call serve_forever() on; a thread for each connection."""

    class Handler(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            for raw in self.rfile:
                if reply := handle_line(db, raw.decode("utf-8", "replace")):
                    self.wfile.write(reply.encode())

    socketserver.ThreadingTCPServer.allow_reuse_address = True
    out = socketserver.ThreadingTCPServer(address, Handler)
    out.daemon_threads = True
    return out
