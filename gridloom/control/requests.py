"""Requests as data: each operation's fields with their other names, kinds, defaults and ranges."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from gridloom.functions.output import parse_flag, parse_size


class RequestError(ValueError):
    """A request that can't be accepted; the text says why."""


@dataclass(frozen=True)
class Field:
    kind: type
    default: object = None
    low: float | None = None
    high: float | None = None
    other: tuple[str, ...] = ()
    choices: tuple[str, ...] = ()
    pair: tuple[str, str] | None = None  # a WxH text that sets these two fields
    implies: tuple[tuple[str, object], ...] = ()  # fields set where this one is true


# The names, other names, defaults and ranges of all fields.
_LIBRARY = {"dbPath": Field(str, "", other=("db",))}
FIELDS: dict[str, dict[str, Field]] = {
    "mosaic": {
        "inputPath": Field(str, "", other=("input",)),
        **_LIBRARY,
        "outputPath": Field(str, "", other=("output",)),
        "tileW": Field(int, 9, 4),
        "tileH": Field(int, 16, 4),
        "outW": Field(int, 0, 0),
        "outH": Field(int, 0, 0),
        "nativeTileW": Field(int, 180, 1),
        "nativeTileH": Field(int, 320, 1),
        "candidates": Field(int, 150, 10),
        "topNrandom": Field(int, 10, 1, other=("topNRandom",)),
        "neighborWindow": Field(int, 0, 0),
        "upscale": Field(int, 0, 1),
        "quality": Field(int, 100, 1, 100, other=("jpegQuality",)),
        "pngLevel": Field(int, 1, 1, 9, other=("pngCompressionLevel",)),
        "lRange": Field(float, 20.0, 0),
        "usePenalty": Field(float, 0.01, other=("penalty",)),
        "labWeight": Field(float, 0.20),
        "gridWeight": Field(float, 0.45),
        "tinyWeight": Field(float, 0.25),
        "edgeWeight": Field(float, 0.05),
        "lbpWeight": Field(float, 0.05),
        "neighborPenalty": Field(float, 100.0, 0),
        "colorStrength": Field(float, 0.04, 0, 0.5),
        "format": Field(str, "", other=("outputFormat",)),
        "writeMode": Field(str, "auto", choices=("auto", "stream", "batch")),
        "outputTile": Field(str, "", pair=("nativeTileW", "nativeTileH")),
        "useGpu": Field(bool, True),
        "cpu": Field(bool, False, implies=(("useGpu", False),)),
        "tiled": Field(bool, False, other=("tiledOutput",)),
        "deepZoom": Field(bool, False, other=("deepzoom",), implies=(("tiled", True),)),
        "colorAdjust": Field(bool, False),
        "adaptiveWeights": Field(bool, False),
        "analyze": Field(bool, False),
        "benchmark": Field(bool, False),
    },
    "build": {
        "inputDir": Field(str, "", other=("input",)),
        "outputDir": Field(str, "", other=("output",)),
        **_LIBRARY,
        "normalizeSize": Field(str, "", pair=("normalizeWidth", "normalizeHeight")),
        "normalizeWidth": Field(int, 180, 1),
        "normalizeHeight": Field(int, 320, 1),
        "threads": Field(int, 0, 0),
        "appendMode": Field(bool, False, other=("append",)),
        "normalizeOnly": Field(bool, False),
        "forceMode": Field(bool, False, other=("force",)),
        "recursive": Field(bool, True),
    },
    "stats": _LIBRARY,
    "health": _LIBRARY,
    "usage": {**_LIBRARY, "limit": Field(int, 50, 1), "showUnused": Field(bool, False, other=("unused",))},
    "export": {**_LIBRARY, "outputDir": Field(str, "", other=("output",)), "confirm": Field(bool, False)},
    "purge": {**_LIBRARY, "dryRun": Field(bool, True), "confirm": Field(bool, False)},
    "inspect": {"imagePath": Field(str, "", other=("input",)), **_LIBRARY},
}
#: Operations whose fields may also come in the query string, before the body.
WITH_QUERY = ("stats", "health", "usage", "export", "purge", "inspect")
WORDS = {"int": "number", "float": "number", "bool": "boolean", "str": "string"}


def _bounded(name: str, field: Field, value):
    show = "{:.6f}".format if field.kind is float else str
    if field.low is not None and field.high is not None:
        if not field.low <= value <= field.high:
            raise RequestError(f"{name} must be between {show(field.low)} and {show(field.high)}")
    elif field.low is not None and value < field.low:
        raise RequestError(f"{name} must be at least {show(field.low)}")
    if field.choices and value not in field.choices:
        raise RequestError(f"{name} must be {', '.join(field.choices[:-1])}, or {field.choices[-1]}")
    return value


def _from_body(name: str, field: Field, value):
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if field.kind in (int, float):
        if not number or not math.isfinite(value):
            raise RequestError(f"{name} must be a number")
        if field.kind is int:
            if value != int(value):
                raise RequestError(f"{name} must be an integer")
            if not -(2**31) <= value < 2**31:
                raise RequestError(f"{name} is out of range")
    elif not isinstance(value, field.kind):
        raise RequestError(f"{name} must be a {WORDS[field.kind.__name__]}")
    return _bounded(name, field, field.kind(value))


def _from_query(name: str, field: Field, text: str):
    if field.kind is bool:
        try:
            return parse_flag(text, False)
        except ValueError:
            raise RequestError(f"{name} must be a boolean") from None
    if field.kind is int:
        if not re.fullmatch(r"[+-]?[0-9]+", text) or not -(2**31) <= int(text) < 2**31:
            raise RequestError(f"{name} must be a number")
        return _bounded(name, field, int(text))
    return _bounded(name, field, field.kind(text))


def _given(values: dict, name: str, field: Field) -> tuple[bool, object]:
    for key in (name, *field.other):
        if key in values:
            return True, values[key]
    return False, None


def parse(operation: str, body: str = "", query: dict[str, str] | None = None) -> dict:
    """The operation's fields: defaults, then the query string's, then the body's. Unknown fields are ignored; a field that
    does not hold raises RequestError. A WxH text sets its two fields, unless the body is at odds with itself."""
    fields = FIELDS[operation]
    got = {name: f.default for name, f in fields.items() if f.pair is None}
    try:
        values = json.loads(body) if body.strip() else {}
    except json.JSONDecodeError:
        raise RequestError("invalid JSON body") from None
    if not isinstance(values, dict):
        raise RequestError("JSON body must be an object")
    sources = [(values, _from_body)]
    if query and operation in WITH_QUERY:
        sources.insert(0, (query, _from_query))
    for given, read in sources:
        for name, field in fields.items():
            there, value = _given(given, name, field)
            if not there:
                continue
            value = read(name, field, value)
            if field.pair:
                try:
                    got |= dict(zip(field.pair, parse_size(value)))
                except ValueError:
                    raise RequestError(f"{name} must use WxH format") from None
            else:
                got[name] = value
        for name, field in fields.items():
            if _given(given, name, field)[0] and field.implies and got[name]:
                got |= dict(field.implies)
    return got


# Characters a one-line command may not hold, its first word, and the commands there are.
FORBIDDEN = "&|;$`(){}<>\"'\\\n\r"
COMMANDS = ("build", "mosaic", "inspect", "db-stats", "db-usage", "db-health", "db-purge", "db-usage-export")


def checked_command(text: str, program: str = "gridloom") -> tuple[str, str]:
    """(command, its words after the program's name) of a one-line command; RequestError if it isn't one."""
    if not text:
        raise RequestError("empty command")
    if any(c in FORBIDDEN or ord(c) < 32 or ord(c) == 127 for c in text):
        raise RequestError("invalid characters in command")
    if not text.startswith(f"{program} "):
        raise RequestError(f"command must start with '{program}'")
    rest = text[len(program) + 1 :]
    name = rest.split(" ", 1)[0]
    if name not in COMMANDS:
        raise RequestError(f"unknown command: {name}")
    return name, rest


def library_place(path: str) -> str:
    """The library folder a path means: the folder itself, or the folder of its images table."""
    return re.sub(r"/images\.parquet/?$", "", path.rstrip("/")) if path else "."
