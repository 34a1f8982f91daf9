"""Planning of outputs: geometry, format limits, and names."""

from __future__ import annotations

import re

# The largest side of each format, the size from which a file is streamed, and TIFF's limits in MiB.
MAX_SIDE = {"jpg": 65_500, "webp": 16_383}
STREAM_MIB, BIG_TIFF_MIB, LZW_BELOW_MIB = 500, 3500, 400
FORMATS = {"jpg": "jpg", "jpeg": "jpg", "png": "png", "webp": "webp", "tif": "tiff", "tiff": "tiff"}


def cover_crop(width: int, height: int, to_w: int, to_h: int) -> tuple[int, int, int, int]:
    """(scaled width, scaled height, left, top) of the resize that covers to_w x to_h and is cropped in the middle."""
    scale = max(to_w / width, to_h / height)
    w, h = max(int(width * scale), to_w), max(int(height * scale), to_h)
    return w, h, (w - to_w) // 2, (h - to_h) // 2


def parse_size(text: str) -> tuple[int, int]:
    """Strict WxH."""
    m = re.fullmatch(r"([1-9][0-9]*)[xX]([1-9][0-9]*)", text)
    if not m:
        raise ValueError("size must use WxH format")
    return int(m[1]), int(m[2])


def parse_flag(text: str, default: bool) -> bool:
    t = text.strip().lower()
    if not t:
        return default
    if t in ("1", "true", "yes", "on"):
        return True
    if t in ("0", "false", "no", "off"):
        return False
    raise ValueError("must be a boolean")


def output_format(path: str, asked: str | None = None) -> str:
    """The asked format, else that of the file name; unknown ones are jpg."""
    name = (asked or (path.rpartition(".")[2] if "." in re.split(r"[/\\]", path)[-1] else "")).lower()
    return FORMATS.get(name, "jpg")


def fitted(width: int, height: int, fmt: str, explicit: bool) -> tuple[int, int, str]:
    """Size and format within the format's limits: too large a jpg becomes tiff unless asked for; others are scaled down."""
    side = MAX_SIDE.get(fmt)
    if not side or max(width, height) <= side:
        return width, height, fmt
    if fmt == "jpg" and not explicit:
        return width, height, "tiff"
    scale = side / max(width, height)
    return max(1, int(width * scale)), max(1, int(height * scale)), fmt


def streams(width: int, height: int, fmt: str, mode: str = "auto", free_bytes: int | None = None) -> bool:
    """Whether rows are written one by one instead of from a whole picture: large ones, unless asked otherwise; where the free memory
    is known, auto streams only if it is less than twice the picture."""
    if mode not in ("auto", "stream", "batch"):
        raise ValueError("writeMode must be auto, stream, or batch")
    raw = width * height * 3
    if fmt not in ("png", "tiff", "jpg") or raw / 2**20 <= STREAM_MIB or mode == "batch":
        return False
    return mode == "stream" or free_bytes is None or free_bytes < 2 * raw


def checked_sides(width: int, height: int) -> tuple[int, int]:
    """The sides, if each and a row of pixels can be counted in 31 bits; ValueError otherwise."""
    if min(width, height) < 1 or max(width * 3, height) >= 2**31:
        raise ValueError(f"output of {width} x {height} pixels is too large")
    return width, height


def export_name(rank: int, runs: int, tiles: int, image_id: int, extension: str) -> str:
    return f"rank{rank:04d}_{runs}runs_{tiles}tiles_id{image_id}{extension}"
