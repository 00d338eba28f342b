"""Episode and binding files in TOML."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.fields import FieldSelector
from ..model import BINDINGS, CorruptError, EpisodeSpec, check_series


def _only(table: dict, known: set[str], where: str) -> dict:
    if unknown := set(table) - known:
        raise CorruptError(f"unknown field in {where}: {', '.join(sorted(unknown))}")
    return table


def parse_episodes(text: str) -> list[EpisodeSpec]:
    """`[[episode]]` tables with name, start_ns, end_ns, frame_hz (or none) and `[[episode.series]]` with column and id."""
    out = []
    try:
        for e in _only(tomllib.loads(text), {"episode"}, "the file").get("episode", []):
            _only(e, {"name", "start_ns", "end_ns", "frame_hz", "series"}, "an episode")
            lanes = tuple((_only(s, {"column", "id"}, "a series")["column"], check_series(s["id"])) for s in e.get("series", []))
            out.append(EpisodeSpec(e["name"], lanes, e["start_ns"], e["end_ns"], e.get("frame_hz")).validate())
    except (tomllib.TOMLDecodeError, KeyError) as x:
        raise CorruptError(f"bad episode file: {x}") from x
    return out


def load_episodes(path: str) -> list[EpisodeSpec]:
    return parse_episodes(Path(path).read_text())


def parse_bindings(text: str) -> list[dict]:
    """`[[bindings]]` tables with topic, series, durable (false) and field. A topic or series may be bound once only."""
    out = []
    try:
        for b in _only(tomllib.loads(text), {"bindings"}, "the file").get("bindings", []):
            _only(b, {"topic", "series", "durable", "field"}, "a binding")
            FieldSelector.parse(b["field"])
            out.append({"topic": b["topic"], "series": check_series(b["series"]), "durable": bool(b.get("durable", False)), "field": b["field"]})
    except (tomllib.TOMLDecodeError, KeyError) as x:
        raise CorruptError(f"bad bindings file: {x}") from x
    for key in ("topic", "series"):
        if len({b[key] for b in out}) < len(out):
            raise CorruptError(f"a {key} is bound twice")
    return out


def load_bindings(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(b["topic"], b["series"], b["durable"], b["field"]) for b in parse_bindings(Path(path).read_text())], BINDINGS)


def save_bindings(bindings: list[dict], path: str) -> None:
    text = "".join(f"[[bindings]]\ntopic = {json.dumps(b['topic'])}\nseries = {b['series']}\ndurable = {str(b['durable']).lower()}\nfield = {json.dumps(b['field'])}\n\n" for b in bindings)
    Path(path).write_text(text)
