"""Numbers out of JSON payloads by a path such as `/pose/position/x` or `scan/ranges[0][1]`."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CorruptError

_PART = re.compile(r"([^\[\]]+)((?:\[\d+\])*)")


@dataclass(frozen=True)
class FieldSelector:
    steps: tuple[str | int, ...]

    @classmethod
    def parse(cls, text: str) -> FieldSelector:
        """Names between slashes, each with any number of [index]; one leading slash is allowed."""
        body = text.removeprefix("/")
        steps: list[str | int] = []
        for part in body.split("/"):
            found = _PART.fullmatch(part)
            if not found:
                raise CorruptError(f"bad field selector: {text!r}")
            steps.append(found[1])
            steps += [int(i) for i in re.findall(r"\d+", found[2])]
        return cls(tuple(steps))

    def __str__(self) -> str:
        return "".join(f"[{s}]" if isinstance(s, int) else f"{'/' * bool(i)}{s}" for i, s in enumerate(self.steps))

    @property
    def path(self) -> str:
        quoted = [f"[{s}]" if isinstance(s, int) else "['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']" for s in self.steps]
        return "$" + "".join(quoted)

    def extract(self, payload: Column) -> Column:
        """The number at the path as a double; null for anything else there, a broken payload included."""
        parsed = F.try_parse_json(payload)
        kind = F.schema_of_variant(F.try_variant_get(parsed, self.path, "variant"))
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return F.when(number, F.try_variant_get(parsed, self.path, "double"))


def extract_by_selector(payload: Column, field: Column, selectors: list[str]) -> Column:
    """The number at the row's own selector, for a known set of selectors (those of the bindings); others give null."""
    out = F.lit(None).cast("double")
    for text in sorted(set(selectors)):
        out = F.when(field == text, FieldSelector.parse(text).extract(payload)).otherwise(out)
    return out
