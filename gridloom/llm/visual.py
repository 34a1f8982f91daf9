"""Visually identical text with different characters: one consistent form for every text."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other alphabets that look like a Latin letter, and signs that look like another sign.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ϳ": "j",
    "Ӏ": "I", "ӏ": "l", "օ": "o", "Օ": "O", "ɡ": "g",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "µ": "μ", "Ω": "Ω", "K": "K", "Å": "Å", "‐": "-", "‑": "-",
}
# Ranges of characters that show nothing, beside the format characters and controls.
INVISIBLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
# Ranges of full-width and half-width forms and of joined letters.
FORMS = [(0xFF01, 0xFFEE), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3)]

SIZE = 0x110000
MAX_BYTES = 8 << 20


@functools.cache
def _tables() -> tuple[np.ndarray, ...]:
    """start, length and pool of every code point's expansion; combining class; sorted pair keys and their composites; for
    points whose canonical form is one point, that point; flags of all others."""
    start, length = np.arange(SIZE, dtype=np.int32), np.ones(SIZE, np.int8)
    ccc = np.zeros(SIZE, np.uint8)
    pool: list[int] = []
    keys: dict[int, int] = {}
    single, special = np.arange(SIZE, dtype=np.uint32), np.zeros(SIZE, bool)
    special[0x1160:0x1200] = True

    def expand(text: str) -> str:
        return "".join(LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFD", "".join(LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFD", text))))

    unseen = np.zeros(SIZE, bool)
    for a, b in INVISIBLE:
        unseen[a : b + 1] = True
    form = np.zeros(SIZE, bool)
    for a, b in FORMS:
        form[a : b + 1] = True
    for cp in range(SIZE):
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4 or 0x4E00 <= cp < 0xA000 or cp > 0x2FFFF and not unseen[cp]:
            continue
        c = chr(cp)
        ccc[cp] = unicodedata.combining(c)
        kind = unicodedata.category(c)
        if unseen[cp] or kind == "Cf" or kind == "Cc" and c not in "\t\n\v\f\r\x85":
            out = ""
        elif kind == "Zs" or c == "\t":
            out = " "
        elif form[cp]:
            out = expand(unicodedata.normalize("NFKD", c))
        else:
            out = expand(c)
            pair = unicodedata.decomposition(c).split()
            if len(pair) == 2 and pair[0][0] != "<" and unicodedata.normalize("NFC", c) == c:
                keys[int(pair[0], 16) << 21 | int(pair[1], 16)] = cp
        if out != c:
            start[cp], length[cp] = SIZE + len(pool), len(out)
            pool += map(ord, out)
        whole = unicodedata.normalize("NFC", out)
        if len(whole) == 1 and not unicodedata.combining(whole) and not 0x1160 <= ord(whole) < 0x1200:
            single[cp] = ord(whole)
        else:
            special[cp] = True
    order = sorted(keys)
    return start, length, np.array([*pool, 0], np.uint32), ccc, np.array(order, np.int64), np.array([keys[k] for k in order], np.uint32), single, special


def _ordered(cps: np.ndarray, cls: np.ndarray, new_row: np.ndarray) -> np.ndarray:
    """Marks after a base in the order of their combining classes (stable)."""
    odd = np.flatnonzero((cls[1:] > 0) & (cls[1:] < cls[:-1]) & ~new_row[1:])
    if not len(odd):
        return cps
    return cps[np.lexsort((cls, np.cumsum((cls == 0) | new_row)))]


def canonical_points(cps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code points, and the row of each, of the code points of many texts laid end to end.

    Gathers each point's expansion (none, one or several points), orders marks, and composes base and mark pairs until
    none is left; no pair spans two rows. Hangul syllables stay as they are; jamo sequences compose by rule.
    """
    start, length, pool, ccc, pairs, composites, _, _ = _tables()
    n = length[cps]
    first = start[cps]
    if (first != cps).any():
        at = np.repeat(np.arange(len(cps)), n)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
        source = first[at]
        cps = np.where(source < SIZE, source.astype(np.uint32), pool[np.where(source < SIZE, 0, source - SIZE + inner)])
        rows = rows[at]
    cls = ccc[cps]
    marks = cls > 0
    jamo = (cps >= 0x1100) & (cps < 0x1200)
    if not marks.any() and not jamo.any():
        return cps, rows
    new_row = np.r_[True, rows[1:] != rows[:-1]]
    if marks.any():
        cps = _ordered(cps, cls, new_row)
        cls = ccc[cps]
    gone = np.zeros(len(cps), bool)
    index = np.arange(len(cps))
    # Each round tries, for every base, the next mark that isn't blocked; a run of m marks takes at most m rounds.
    starter = np.maximum.accumulate(np.where((cls == 0) | new_row, index, -1))
    tried = np.zeros(len(cps), bool)
    tried[(cls == 0) | new_row] = True
    while True:
        left = np.flatnonzero(~tried)
        if not len(left):
            break
        now = left[np.r_[True, starter[left][1:] != starter[left][:-1]]]
        base = starter[now]
        key = cps[base].astype(np.int64) << 21 | cps[now]
        hit = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        fits = pairs[hit] == key
        before = now - 1
        blocked = (before > base) & ~gone[before] & (cls[before] >= cls[now])
        fits &= ~blocked
        cps[base[fits]] = composites[hit[fits]]
        gone[now[fits]] = True
        tried[now] = True
    cps, rows, new_row = cps[~gone], rows[~gone], None
    if jamo.any():
        cps, rows = _hangul(cps, rows)
    return cps, rows


def _hangul(cps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = (cps >= 0x1161) & (cps <= 0x1175)
    lead = (cps >= 0x1100) & (cps <= 0x1112)
    join = np.zeros(len(cps), bool)
    join[1:] = v[1:] & lead[:-1] & (rows[1:] == rows[:-1])
    at = np.flatnonzero(join)
    cps = cps.copy()
    cps[at - 1] = 0xAC00 + ((cps[at - 1] - 0x1100) * 21 + (cps[at] - 0x1161)) * 28
    cps, rows = cps[~join], rows[~join]
    open_ = (cps >= 0xAC00) & (cps < 0xD7A4) & ((cps - 0xAC00) % 28 == 0)
    tail = (cps >= 0x11A8) & (cps <= 0x11C2)
    join = np.zeros(len(cps), bool)
    join[1:] = tail[1:] & open_[:-1] & (rows[1:] == rows[:-1])
    at = np.flatnonzero(join)
    cps[at - 1] += cps[at] - 0x11A7
    return cps[~join], rows[~join]


def canonical_array(texts: pa.Array) -> pa.Array:
    """Canonical text of each text of an Arrow array; null stays null."""
    parts, at = [], 0
    texts = texts.cast(pa.string())
    while at < len(texts):
        size, end = 0, at
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + MAX_BYTES, "right")) - 1)
        end = min(end, len(texts))
        parts.append(_canonical_chunk(texts.slice(at, end - at), offsets[at : end + 1]))
        at = end
    return pa.concat_arrays(parts) if parts else texts


def _canonical_chunk(texts: pa.Array, offsets: np.ndarray) -> pa.Array:
    single, special = _tables()[-2:]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    ends = offsets[1:] - offsets[0]
    if len(cps) < len(raw):  # row ends in characters
        ends = ends - np.concatenate([[0], np.cumsum((raw & 0xC0) == 0x80, dtype=np.int32)])[ends]
    out = single[cps]
    odd = special[cps]
    at = np.flatnonzero(odd)
    if len(at):
        # Runs of special points, each with the point before it in its row, are rewritten and spliced back.
        row = np.searchsorted(ends, at, "right")
        row_start = np.concatenate([[0], ends])[row]
        touched = odd
        touched[np.maximum(at - 1, row_start)] = True
        at = np.flatnonzero(touched)
        row = np.searchsorted(ends, at, "right")
        run = np.cumsum(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])]), dtype=np.int32) - 1
        made, made_run = canonical_points(cps[at], run)
        heads = at[np.concatenate([[True], run[1:] != run[:-1]])]
        size = np.ones(len(cps), np.int32)
        size[at] = 0
        size[heads] = np.bincount(made_run, minlength=len(heads))
        stop = np.cumsum(size, dtype=np.int64)
        new = np.empty(int(stop[-1]), np.uint32)
        fill = np.repeat(touched, size)
        new[~fill] = out[~touched]
        new[fill] = made
        ends = np.concatenate([[0], stop])[ends]
        out = new
    data = out.tobytes().decode("utf-32-le").encode("utf-8")
    if len(data) > len(out):
        width = 1 + (out > 0x7F).view(np.int8) + (out > 0x7FF).view(np.int8) + (out > 0xFFFF).view(np.int8)
        ends = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[ends]
    where = np.concatenate([[0], ends]).astype(np.int32)
    valid = None
    if texts.null_count:
        valid = pa.array(np.asarray(texts.is_valid())).buffers()[1]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(where), pa.py_buffer(data), valid)


def with_canonical(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """df with the consistent form of a text column; null stays null, other columns are untouched.

    Blanks of any kind (no line breaks, which a reader sees) become a plain blank, invisible and control characters vanish,
    full-width and half-width forms and joined letters become ordinary ones, look-alike letters their Latin twin, and marks
    are composed. Letter case, accents, raised digits, words and their order stay. Whole texts are processed, whatever
    their length; the operator works batch by batch on each partition and shuffles nothing.
    """
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.StringType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = canonical_array(b.column(b.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [made], names=[*names, out])

    return df.mapInArrow(run, schema)


def equal_looking_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_a, doc_b), smaller key first: records whose texts differ in code points but have one canonical form.

    Records are classed by their raw text within their canonical form (both by 256-bit digests); only forms of two or more
    classes go on, classes are paired, and class pairs are joined with their members, which is the size of the result.
    Byte-identical copies make no pair among themselves. Null texts are in no pair, empty ones count as a text.
    """
    marked = with_canonical(df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("t IS NOT NULL"), "t", "c")
    member = marked.select("k", F.sha2("t", 256).alias("raw"), F.sha2("c", 256).alias("form"))
    from gridloom.session import cut

    member = cut(member)
    forms = member.groupBy("form").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high").select("form")
    member = member.join(forms, "form", "left_semi")
    classes = member.select("form", "raw").distinct()
    pairs = classes.alias("x").join(classes.alias("y"), "form").where("x.raw < y.raw").select("form", F.col("x.raw").alias("raw_x"), F.col("y.raw").alias("raw_y"))
    left = member.select("form", F.col("raw").alias("raw_x"), F.col("k").alias("kx"))
    right = member.select("form", F.col("raw").alias("raw_y"), F.col("k").alias("ky"))
    joined = pairs.join(left, ["form", "raw_x"]).join(right, ["form", "raw_y"])
    return joined.where("kx <> ky").select(F.least("kx", "ky").alias("doc_a"), F.greatest("kx", "ky").alias("doc_b"))
