"""The text form of a query: `$name:value` or `$name=value` options, then `#base64` or `v|v|v`."""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass, field

import numpy as np

_OPTION = re.compile(r"\$([^:=\s]+)[:=](\S*)")
_TYPES = {"float": "<f4", "int8": "i1", "uint8": "u1", "int16": "<i2"}


@dataclass
class Query:
    vector: list[float] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)

    @property
    def indexes(self) -> list[str]:
        return [n for n in self.options.get("indexname", "").split(",") if n]

    @property
    def k(self) -> int:
        return int(self.options.get("resultnum", 10))

    @property
    def with_metadata(self) -> bool:
        return self.options.get("extractmetadata", "false").lower() in ("1", "true")


def parse(text: str, separator: str = "|") -> Query:
    """Option names ignore case. Raises ValueError where the vector is missing or no number."""
    query = Query()
    for m in _OPTION.finditer(text):
        query.options[m[1].lower()] = m[2]
    rest = _OPTION.sub(" ", text).split()
    if not rest:
        raise ValueError("no vector in the query")
    if rest[0].startswith("#"):
        kind = _TYPES[query.options.get("datatype", "float").lower()]
        query.vector = np.frombuffer(base64.b64decode(rest[0][1:]), kind).astype(float).tolist()
    else:
        query.vector = [float(v) for v in "".join(rest).split(separator) if v]
    return query


def unparse(query: Query, separator: str = "|") -> str:
    options = " ".join(f"${k}:{v}" for k, v in query.options.items())
    return f"{options} {separator.join(str(v) for v in query.vector)}".strip()
