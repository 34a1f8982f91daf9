"""Vector and grid functions as Column builders: everything runs inside the JVM.

A missing or wrongly sized vector has a penalty distance, not null: BAD_GRID for grids, BAD_HISTOGRAM for tiny images and
histograms. Null elements make a distance null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BAD_GRID = 1e6
BAD_HISTOGRAM = 1.0
CELLS = 64

# Weight of each cell of the 8x8 grid, row by row.
CELL_WEIGHTS = [
    0.85, 0.92, 0.96, 0.99, 1.00, 0.99, 0.94, 0.89,
    0.96, 1.02, 1.06, 1.11, 1.11, 1.10, 1.05, 0.98,
    0.97, 1.03, 1.07, 1.10, 1.11, 1.09, 1.05, 0.98,
    0.96, 1.02, 1.06, 1.09, 1.09, 1.07, 1.02, 0.96,
    0.97, 1.03, 1.08, 1.13, 1.13, 1.10, 1.05, 0.98,
    0.98, 1.05, 1.10, 1.14, 1.14, 1.10, 1.06, 0.98,
    0.97, 1.02, 1.06, 1.10, 1.11, 1.06, 1.02, 0.94,
    0.46, 0.47, 0.48, 0.48, 0.48, 0.47, 0.47, 0.46,
]
# The categories' limits and feature weights (colour, grid, tiny, edge, texture).
SMOOTH_EDGE, SMOOTH_VARIANCE, STRONG_EDGE, RICH_ENTROPY = 0.005, 100.0, 0.01, 3.0
CATEGORY_WEIGHTS = {"smooth": (0.25, 0.45, 0.20, 0.05, 0.05), "edge": (0.15, 0.40, 0.25, 0.15, 0.05), "texture": (0.15, 0.40, 0.20, 0.05, 0.20), "normal": (0.20, 0.45, 0.25, 0.05, 0.05)}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: named in a lambda it would otherwise be computed for every element."""
    return F.transform(F.array(value), body)[0]


def _d(x: Column) -> Column:
    return x.cast("double")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _cells() -> Column:
    return F.sequence(F.lit(0), F.lit(CELLS - 1))


def lab_distance(l1: Column, a1: Column, b1: Column, l2: Column, a2: Column, b2: Column) -> Column:
    return F.sqrt((l1 - l2) * (l1 - l2) + (a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2)) / 100


def _cell_square(a: Column, b: Column, i: Column) -> Column:
    parts = [_d(a[i * 3 + c]) - _d(b[i * 3 + c]) for c in range(3)]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def grid_distance(a: Column, b: Column, squared: bool = False) -> Column:
    """Weighted mean cell distance of two 192-value grids / 100; `squared` leaves out the square root."""
    return let(a, lambda a: let(b, lambda b: _grid_distance(a, b, squared)))


def _grid_distance(a: Column, b: Column, squared: bool = False) -> Column:
    weights = F.array(*[F.lit(w) for w in CELL_WEIGHTS])
    term = (lambda i: _cell_square(a, b, i) * weights[i]) if squared else (lambda i: F.sqrt(_cell_square(a, b, i)) * weights[i])
    good = (F.size(a) == 192) & (F.size(b) == 192)
    return F.when(F.coalesce(good, F.lit(False)), total(F.transform(_cells(), term)) / CELLS / 100).otherwise(F.lit(BAD_GRID))


def plain_grid_distance(a: Column, b: Column) -> Column:
    """Mean cell distance / 100 of grids of any equal size divisible by three."""
    return let(a, lambda a: let(b, lambda b: _plain_grid_distance(a, b)))


def _plain_grid_distance(a: Column, b: Column) -> Column:
    n = F.size(a) / 3
    good = (F.size(a) == F.size(b)) & (F.size(a) % 3 == 0) & (F.size(a) > 0)
    every = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.sqrt(_cell_square(a, b, i)))
    return F.when(F.coalesce(good, F.lit(False)), total(every) / n / 100).otherwise(F.lit(BAD_GRID))


def cell_contributions(a: Column, b: Column) -> Column:
    """The 64 cell distances of two grids."""
    return let(a, lambda a: let(b, lambda b: _cell_contributions(a, b)))


def _cell_contributions(a: Column, b: Column) -> Column:
    return F.transform(_cells(), lambda i: F.sqrt(_cell_square(a, b, i)))


def tiny_error(a: Column, b: Column) -> Column:
    """Mean squared difference of two 256-value tiny images, as a share of the largest possible."""
    good = (F.size(a) == 256) & (F.size(b) == 256)
    return F.when(F.coalesce(good, F.lit(False)), l2_squared(a, b) / (256 * 255.0 * 255.0)).otherwise(F.lit(BAD_HISTOGRAM))


def histogram_distance(a: Column, b: Column) -> Column:
    """Half the absolute difference of two 256-bin histograms (total variation)."""
    good = (F.size(a) == 256) & (F.size(b) == 256)
    return F.when(F.coalesce(good, F.lit(False)), total(F.zip_with(a, b, lambda x, y: F.abs(_d(x) - _d(y)))) / 2).otherwise(F.lit(BAD_HISTOGRAM))


def l2_squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))))


def inner_product(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)))


def entropy(histogram: Column) -> Column:
    return F.aggregate(histogram, F.lit(0.0), lambda s, v: F.when(v > 0, s - _d(v) * F.log2(_d(v))).otherwise(s))


def channel(grid: Column, c: int) -> Column:
    """The 64 values of one channel of a 192-value grid."""
    return let(grid, lambda grid: _channel(grid, c))


def _channel(grid: Column, c: int) -> Column:
    return F.transform(_cells(), lambda i: _d(grid[i * 3 + c]))


def variance(values: Column) -> Column:
    return let(values, lambda values: _variance(values))


def _variance(values: Column) -> Column:
    mean = total(values) / F.size(values)
    return total(F.transform(values, lambda v: v * v)) / F.size(values) - mean * mean


def halved(grid: Column) -> Column:
    """The 4x4 grid (48 values) of 2x2 block means."""
    return let(grid, lambda grid: _halved(grid))


def _halved(grid: Column) -> Column:
    def at(k: Column) -> Column:
        cell, c = F.floor(k / 3), k % 3
        r, q = F.floor(cell / 4), cell % 4
        first = ((r * 2 * 8 + q * 2) * 3 + c).cast("int")
        return (_d(grid[first]) + _d(grid[first + 3]) + _d(grid[first + 24]) + _d(grid[first + 27])) / 4

    return F.transform(F.sequence(F.lit(0), F.lit(47)), at)


def doubled(grid: Column) -> Column:
    """The 8x8 grid (192 values) of a 4x4 grid, each cell four times."""
    return let(grid, lambda grid: _doubled(grid))


def _doubled(grid: Column) -> Column:
    def at(k: Column) -> Column:
        cell, c = F.floor(k / 3), k % 3
        return grid[((F.floor(cell / 16) * 4 + F.floor((cell % 8) / 2)) * 3 + c).cast("int")]

    return F.transform(F.sequence(F.lit(0), F.lit(191)), at)


def pattern_codes(plane: Column, width: int = 8, height: int = 8) -> Column:
    """Local binary pattern of every inner pixel: eight neighbours at least as bright as the centre, from the top left clockwise."""
    return let(plane, lambda plane: _pattern_codes(plane, width, height))


def _pattern_codes(plane: Column, width: int = 8, height: int = 8) -> Column:
    around = (-width - 1, -width, -width + 1, 1, width + 1, width, width - 1, -1)
    inner = F.transform(F.sequence(F.lit(0), F.lit((width - 2) * (height - 2) - 1)), lambda k: ((F.floor(k / (width - 2)) + 1) * width + k % (width - 2) + 1).cast("int"))

    def code(i: Column) -> Column:
        made = F.lit(0)
        for bit, step in enumerate(around):
            made = made + F.when(plane[i + step] >= plane[i], 1 << bit).otherwise(0)
        return made

    return F.transform(inner, code)


def pattern_histogram(codes: Column) -> Column:
    return let(codes, lambda codes: _pattern_histogram(codes))


def _pattern_histogram(codes: Column) -> Column:
    n = F.size(codes)
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda c: F.size(F.filter(codes, lambda x: x == c)) / n)


def pattern_entropy(codes: Column) -> Column:
    """Entropy of the pattern histogram without building its 256 bins: sum over the distinct codes."""
    return let(codes, lambda codes: _pattern_entropy(codes))


def _pattern_entropy(codes: Column) -> Column:
    n = F.size(codes)
    share = F.transform(F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda x: x == c)) / n)
    return entropy(share)


def gradient_density(plane: Column, limit: float = 30.0, width: int = 8, height: int = 8) -> Column:
    """Share of all pixels whose differences to the left and upper pixel sum to more than `limit`."""
    return let(plane, lambda plane: _gradient_density(plane, limit, width, height))


def _gradient_density(plane: Column, limit: float = 30.0, width: int = 8, height: int = 8) -> Column:
    inner = F.filter(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: (i % width > 0) & (i >= width))
    strong = F.filter(inner, lambda i: F.abs(plane[i] - plane[i - 1]) + F.abs(plane[i] - plane[i - width]) > limit)
    return F.size(strong) / (width * height)


def category(edge: Column, l_variance: Column, texture: Column, report: bool = False) -> Column:
    """smooth, edge, texture or normal; the report's rule never calls a tile of few edges textured."""
    rich = F.when(texture > RICH_ENTROPY, "texture").otherwise("normal")
    smooth = (edge < SMOOTH_EDGE) & (l_variance < SMOOTH_VARIANCE)
    if report:
        return F.when(smooth, "smooth").when(edge < SMOOTH_EDGE, "normal").when(edge > STRONG_EDGE, "edge").otherwise(rich)
    return F.when(smooth, "smooth").when(edge > STRONG_EDGE, "edge").otherwise(rich)


def category_weights(kind: Column) -> Column:
    """The five feature weights of a category."""
    pick = F.create_map(*[x for k, w in CATEGORY_WEIGHTS.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in w]))])
    return pick[kind]
