"""Content hashes and file locations: bringing differing notations to one value."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# two's complement bounds of 64 bits.
WORD = "18446744073709551616"
HALF = "9223372036854775808"


def hash_value(text: Column) -> Column:
    """The 64-bit value a hash text denotes, as an unsigned DECIMAL(20,0).

    Decimal or hexadecimal (0x prefix, or bare digits with a letter among them), any padding with zeros, letter case, blanks
    and sign; a negative number is read as two's complement. Null, texts without digits, other texts and values beyond 64
    bits denote none: null.
    """
    bare = F.lower(F.regexp_replace(text, r"[\s\p{Z}\p{Cf}]+", ""))
    digits = F.regexp_replace(bare, r"^[+-]?(0x)?0*(?=[0-9a-f])", "")
    is_hex = bare.rlike(r"^[+-]?(0x[0-9a-f]+|[0-9a-f]*[a-f][0-9a-f]*)$")
    is_dec = bare.rlike(r"^[+-]?[0-9]+$")
    wide = "decimal(38,0)"
    size = F.when(is_hex & (F.length(digits) <= 16), F.conv(digits, 16, 10).cast(wide)).when(
        is_dec & (F.length(digits) <= 20), digits.try_cast(wide)
    )
    word = F.lit(WORD).cast(wide)
    signed = F.when(bare.startswith("-"), F.when(size <= F.lit(HALF).cast(wide), (word - size) % word)).when(size < word, size)
    return signed.cast("decimal(20,0)")


def hash_key(text: Column) -> Column:
    """hash_value as a BIGINT holding the same 64 bits."""
    value = hash_value(text).cast("decimal(38,0)")
    return F.when(value >= F.lit(HALF).cast("decimal(38,0)"), value - F.lit(WORD).cast("decimal(38,0)")).otherwise(value).cast("bigint")


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).lower()))


def location(path: Column) -> Column:
    """One spelling for every spelling of a file's place.

    Surrounding blanks, kind and number of separators, '.' segments, 'folder/..' detours, letter case and Unicode
    composition do not matter. A '..' that leads above the start stays. Null and blank paths are no place: null.
    Only paths outside ASCII take the Arrow-batched Unicode composition.
    """
    trimmed = F.regexp_replace(path, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "")
    slashed = F.regexp_replace(F.regexp_replace(trimmed, r"\\", "/"), r"/+", "/")
    rooted = F.when(slashed.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    parts = F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != "."))

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        back = (part == "..") & last.isNotNull() & (last != "..")
        return F.when(back, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, part))

    detour = F.exists(parts, lambda s: s == "..")
    walked = F.when(detour, F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)).otherwise(parts)
    place = F.concat(rooted, F.array_join(walked, "/"))
    place = F.when(F.length(F.array_join(walked, "/")) > 0, place)
    return F.when(place.rlike(r"^[\x00-\x7f]*$"), F.lower(place)).otherwise(_composed(place))
