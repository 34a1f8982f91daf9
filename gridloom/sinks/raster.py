"""Pictures from pixel tables: streamed PNG, tiles, and pyramids with their manifest."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.output import BIG_TIFF_MIB
from gridloom.operators.pixels import levels, pyramid
from gridloom.sinks import jpeg


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_stream(rows: Iterable[bytes], width: int, height: int, level: int = 1) -> Iterator[bytes]:
    """PNG bytes of RGB rows, one row in memory at a time."""
    yield b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
    packer, seen = zlib.compressobj(level), 0
    for row in rows:
        if len(row) != 3 * width:
            raise ValueError("row of wrong length")
        seen += 1
        if part := packer.compress(b"\0" + row):
            yield _chunk(b"IDAT", part)
    if seen != height:
        raise ValueError("wrong number of rows")
    yield _chunk(b"IDAT", packer.flush()) + _chunk(b"IEND", b"")


def png_bytes(rgb: np.ndarray, level: int = 1) -> bytes:
    """A whole picture (height x width x RGB) as PNG in memory."""
    return b"".join(png_stream((r.tobytes() for r in np.ascontiguousarray(rgb)), rgb.shape[1], rgb.shape[0], level))


def lzw_bytes(data: bytes) -> bytes:
    """TIFF's LZW of a strip: codes of 9 to 12 bits, one bit earlier than full, a fresh table every 4,094 codes."""
    out, value, held = bytearray(), 0, 0
    table = {bytes([i]): i for i in range(256)}
    size, following = 9, 258

    def put(code: int) -> None:
        nonlocal value, held
        value, held = (value << size) | code, held + size
        while held >= 8:
            out.append(value >> (held - 8) & 0xFF)
            held -= 8
        value &= (1 << held) - 1

    put(256)
    word = b""
    for byte in data:
        longer = word + bytes([byte])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = following
        following += 1
        if following == 4095:
            put(256)
            table = {bytes([i]): i for i in range(256)}
            size, following = 9, 258
        elif following + 1 > 1 << size:
            size += 1
        word = bytes([byte])
    if word:
        put(table[word])
        following += 1
        if following + 1 > 1 << size and size < 12:
            size += 1
    put(257)
    if held:
        out.append(value << (8 - held) & 0xFF)
    return bytes(out)


def tiff_lzw(rgb: np.ndarray) -> bytes:
    """A whole picture (height x width x RGB) as TIFF with one LZW strip a row: for pictures below the limit for it."""
    height, width = rgb.shape[:2]
    strips = [lzw_bytes(r.tobytes()) for r in np.ascontiguousarray(rgb)]
    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 3, None), (259, 3, 1, 5), (262, 3, 1, 2), (273, 4, height, None), (277, 3, 1, 3), (278, 4, 1, 1), (279, 4, height, None), (284, 3, 1, 1)]
    after = 8 + 2 + 12 * len(tags) + 4
    data_at = after + 8 + 8 * height
    starts = np.cumsum([data_at, *[len(s) for s in strips[:-1]]]).tolist()
    if height == 1:
        place = {258: after, 273: starts[0], 279: len(strips[0])}
    else:
        place = {258: after, 273: after + 8, 279: after + 8 + 4 * height}
    head = struct.pack("<2sHIH", b"II", 42, 8, len(tags)) + b"".join(struct.pack("<HHI", t, f, c) + (struct.pack("<HH", v, 0) if f == 3 and v is not None else struct.pack("<I", place[t] if v is None else v)) for t, f, c, v in tags)
    return head + struct.pack("<I", 0) + struct.pack("<HHHH", 8, 8, 8, 0) + struct.pack(f"<{height}I", *starts) + struct.pack(f"<{height}I", *[len(s) for s in strips]) + b"".join(strips)


def _lines(pixels: DataFrame) -> DataFrame:
    """(image_id, y, line): RGB bytes of each row; a row's pixels are bounded by the picture's width."""
    clip = [F.least(F.greatest(F.round(c), F.lit(0)), F.lit(255)).cast("int") for c in "rgb"]
    triple = F.concat(*[F.lpad(F.hex(c), 2, "0") for c in clip])
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("x", triple.alias("p")))), lambda e: e["p"])
    return pixels.groupBy("image_id", "y").agg(F.unhex(F.array_join(ordered, "")).alias("line"))


def write_png(pixels: DataFrame, path: str, width: int, height: int, level: int = 1) -> None:
    """One picture, streamed: its rows are sorted by the cluster and fetched one partition at a time."""
    lines = _lines(pixels.withColumn("image_id", F.lit(0))).repartitionByRange("y").sortWithinPartitions("y").select("line")
    with open(path, "wb") as out:
        for part in png_stream((bytes(r.line) for r in lines.toLocalIterator()), width, height, level):
            out.write(part)


def jpeg_bytes(rgb: np.ndarray, quality: int = 90) -> bytes:
    """A picture (height x width x RGB) as baseline JPEG without subsampling, encoded where it is, in numpy."""
    return jpeg.encode(rgb, quality)


def write_tiles(pixels: DataFrame, folder: str, fmt: str = "png", quality: int = 90) -> DataFrame:
    """Writes every (level, tile_y, tile_x) as folder/level/col_row.png (or .jpg) on the executors (a folder all share) and returns
    what was written (level, tile_x, tile_y, bytes). A tile's rows are bounded by the tile size; repeated tasks write the same bytes."""

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        level, ty, tx = (int(k) for k in key)
        pdf = pdf.sort_values(["y", "x"])
        width, height = int(pdf["x"].max() - pdf["x"].min() + 1), int(pdf["y"].max() - pdf["y"].min() + 1)
        a = pdf[["r", "g", "b"]].round().clip(0, 255).to_numpy("uint8").reshape(height, width, 3)
        data = jpeg_bytes(a, quality) if fmt == "jpg" else b"".join(png_stream((r.tobytes() for r in a), width, height))
        os.makedirs(f"{folder}/{level}", exist_ok=True)
        temp = f"{folder}/{level}/.{tx}_{ty}.{os.getpid()}"
        with open(temp, "wb") as out:
            out.write(data)
        os.replace(temp, f"{folder}/{level}/{tx}_{ty}.{fmt}")
        return pd.DataFrame({"level": [level], "tile_x": [tx], "tile_y": [ty], "bytes": [len(data)]})

    return pixels.groupBy("level", "tile_y", "tile_x").applyInPandas(write, "level int, tile_x int, tile_y int, bytes bigint")


VIEWER = """<!DOCTYPE html><meta charset="utf-8"><title>{name}</title><style>body{{margin:0;overflow:auto}}img{{position:absolute}}</style>
<div id="v"></div><script>
const W={width},H={height},T={tile},TOP={top};let level=Math.max(0,TOP-2);
function show(){{const s=2**(TOP-level),w=Math.ceil(W/s),h=Math.ceil(H/s),v=document.getElementById("v");v.innerHTML="";
for(let y=0;y*T<h;y++)for(let x=0;x*T<w;x++){{const i=new Image();i.src=`{name}_files/${{level}}/${{x}}_${{y}}.{fmt}`;i.style.left=x*T+"px";i.style.top=y*T+"px";i.loading="lazy";v.append(i)}}}}
onkeydown=e=>{{if(e.key=="+"&&level<TOP)level++;if(e.key=="-"&&level>0)level--;show()}};show()
</script>
"""


def write_pyramid(pixels: DataFrame, folder: str, name: str, width: int, height: int, tile: int = 256, fmt: str = "png") -> DataFrame:
    """Deep-zoom pyramid: all levels' tiles under <name>_files, the manifest <name>.dzi, and a page to look at it (+ and - zoom)."""
    os.makedirs(folder, exist_ok=True)
    done = write_tiles(pyramid(pixels, width, height, tile), f"{folder}/{name}_files", fmt).cache()
    done.count()
    with open(f"{folder}/{name}.dzi", "w") as out:
        out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<Image xmlns="http://schemas.microsoft.com/deepzoom/2008" Format="{fmt}" Overlap="0" TileSize="{tile}"><Size Width="{width}" Height="{height}"/></Image>\n')
    with open(f"{folder}/{name}.html", "w") as out:
        out.write(VIEWER.format(name=name, width=width, height=height, tile=tile, top=levels(width, height), fmt=fmt))
    return done


def level_size(width: int, height: int, level: int) -> tuple[int, int]:
    scale = 1 << (levels(width, height) - level)
    return -(-width // scale), -(-height // scale)


def tiff_stream(rows: Iterable[bytes], width: int, height: int, big: bool | None = None) -> Iterator[bytes]:
    """Uncompressed RGB TIFF in one-row strips, one row in memory at a time; BigTIFF above its limit or if `big`."""
    line = 3 * width
    big = width * height * 3 / 2**20 > BIG_TIFF_MIB if big is None else big
    word, size = ("Q", 8) if big else ("I", 4)
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
    kind = 16 if big else 4
    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 3, None), (259, 3, 1, 1), (262, 3, 1, 2), (273, kind, height, None), (277, 3, 1, 3), (278, 4, 1, 1), (279, 4, height, None), (284, 3, 1, 1)]
    entry = 20 if big else 12
    extra = len(head) + (8 if big else 2) + entry * len(tags) + size
    bits = struct.pack("<HHH", 8, 8, 8)
    sizes_at = extra + 8
    strips_at = sizes_at + 4 * height
    data_at = strips_at + size * height
    place = {258: extra, 273: strips_at, 279: sizes_at}
    yield head + struct.pack("<Q" if big else "<H", len(tags))
    for tag, form, count, value in tags:
        whole = {3: 2, 4: 4, 16: 8}[form] * count
        if value is None and whole <= size:
            field = bits if tag == 258 else struct.pack("<" + word, data_at) if tag == 273 else struct.pack("<I", line)
        else:
            field = struct.pack("<" + word, place[tag] if value is None else value)
        yield struct.pack("<HH" + word, tag, form, count) + field.ljust(size, b"\0")
    yield struct.pack("<" + word, 0) + bits.ljust(8, b"\0")
    yield struct.pack("<I", line) * height
    for start in range(0, height, 65_536):
        yield b"".join(struct.pack("<" + word, data_at + line * i) for i in range(start, min(height, start + 65_536)))
    seen = 0
    for row in rows:
        if len(row) != line:
            raise ValueError("row of wrong length")
        seen += 1
        yield row
    if seen != height:
        raise ValueError("wrong number of rows")


def write_tiff(pixels: DataFrame, path: str, width: int, height: int, big: bool | None = None) -> None:
    """One picture as TIFF, streamed like write_png."""
    lines = _lines(pixels.withColumn("image_id", F.lit(0))).repartitionByRange("y").sortWithinPartitions("y").select("line")
    with open(path, "wb") as out:
        for part in tiff_stream((bytes(r.line) for r in lines.toLocalIterator()), width, height, big):
            out.write(part)


def write_encoded(pixels: DataFrame, path: str, width: int, height: int, fmt: str = "jpg") -> None:
    """One picture in a format of the JVM's encoders (jpg, bmp, gif, tiff), whole on the driver: for pictures that fit there."""
    jvm = pixels.sparkSession.sparkContext._jvm
    lines = _lines(pixels.withColumn("image_id", F.lit(0))).repartitionByRange("y").sortWithinPartitions("y").select("line")
    png = b"".join(png_stream((bytes(r.line) for r in lines.toLocalIterator()), width, height))
    picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(png)))
    if not jvm.javax.imageio.ImageIO.write(picture, fmt, jvm.java.io.File(path)):
        raise ValueError(f"no encoder for {fmt}")
