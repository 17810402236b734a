"""Grids written along a space-filling curve, and boxes read as ranges of it."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, TILE = "_curve", "_tile"


@dataclass(frozen=True)
class Curve:
    """A Z-order curve over 2**bits x 2**bits cells between two corners; its leading 2 * tile_bits bits name folders.

    Points beyond the corners belong to the cells at the border, so no point is without a cell.
    """

    west: float
    south: float
    east: float
    north: float
    bits: int = 16
    tile_bits: int = 3

    def __post_init__(self):
        if not 0 < self.tile_bits <= self.bits <= 31:
            raise ValueError("a curve has 1 to 31 bits an axis, and no more for its folders")

    @property
    def tile_shift(self) -> int:
        return 2 * (self.bits - self.tile_bits)

    def _axes(self):
        return (self.west, self.east - self.west), (self.south, self.north - self.south)

    def key(self, x: Column, y: Column) -> Column:
        """Bits of both cell numbers in turn, as a long; null if a coordinate is."""
        last = float((1 << self.bits) - 1)
        cells = []
        for v, (low, width) in zip((x, y), self._axes()):
            scaled = (v.cast("double") - low) / (width if width > 0 else 1.0) * float(1 << self.bits)
            cells.append(F.when(v.isNotNull(), F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(last)))))
        bit = lambda c, i, up: F.shiftleft(c.bitwiseAND(F.lit(1 << i).cast("long")), i + up)
        return reduce(lambda a, b: a.bitwiseOR(b), [bit(c, i, up) for up, c in enumerate(cells) for i in range(self.bits)])

    def cell(self, x: float, y: float) -> tuple[int, int]:
        """The cell numbers of a point, by the same steps as in ``key``."""
        last = float((1 << self.bits) - 1)
        return tuple(int(min(max((v - low) / (width if width > 0 else 1.0) * float(1 << self.bits), 0.0), last)) for v, (low, width) in zip((x, y), self._axes()))

    def ranges(self, west: float, south: float, east: float, north: float, most: int = 64) -> list[tuple[int, int]]:
        """At most ``most`` ranges of keys (ends included) that together hold every point of the box, and perhaps others.

        Quadrants are split from the whole grid downwards; those inside the box are ready, and once another split could
        exceed ``most`` the ones at its border are taken whole.
        """
        if not (west <= east and south <= north):
            return []
        (x0, y0), (x1, y1) = self.cell(west, south), self.cell(east, north)
        ready, border = [], [(0, 0, 0)]
        for level in range(self.bits + 1):
            size = 1 << (self.bits - level)
            cut = []
            for x, y, prefix in border:
                if x > x1 or y > y1 or x + size <= x0 or y + size <= y0:
                    continue
                whole = x0 <= x and x + size - 1 <= x1 and y0 <= y and y + size - 1 <= y1
                (ready if whole else cut).append((x, y, prefix) if not whole else (prefix * size * size, (prefix + 1) * size * size - 1))
            if not cut:
                break
            if level == self.bits or len(ready) + 4 * len(cut) > max(most, 4):
                ready += [(p * size * size, (p + 1) * size * size - 1) for _, _, p in cut]
                break
            half = size >> 1
            border = [(x + half * (q & 1), y + half * (q >> 1), 4 * p + q) for x, y, p in cut for q in range(4)]
        out = []
        for a, b in sorted(ready):
            if out and out[-1][1] + 1 == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out


def curve_of(cells: DataFrame, x: str, y: str, bits: int = 16, tile_bits: int = 3) -> Curve:
    """A curve between the corners of the given cells; the unit square if there are none."""
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c).cast("double"))
    ends = tuple(cells.agg(*[f(finite(c)) for f in (F.min, F.max) for c in (x, y)]).first())
    west, south, east, north = ends if None not in ends else (0.0, 0.0, 1.0, 1.0)
    return Curve(west, south, east, north, bits, tile_bits)


def write_curve(cells: DataFrame, path: str, x: str, y: str, curve: Curve, mode: str = "error") -> None:
    """Rows in the order of the curve, in folders of its largest squares; the curve itself is kept with the key's column.

    Ranges of (key, hash of the row) are one exchange and split a cell that holds very many rows. Rows without a coordinate are
    kept in a folder of their own.
    """
    plain = [F.col(f"`{f.name}`") for f in cells.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    about = {"curve": asdict(curve), "x": x, "y": y}
    keyed = cells.select("*", curve.key(F.col(x), F.col(y)).alias(KEY, metadata=about)).withColumn(TILE, F.shiftright(KEY, curve.tile_shift))
    ranged = keyed.repartitionByRange(F.col(KEY), F.xxhash64(*plain)).sortWithinPartitions(TILE, KEY)
    ranged.write.mode(mode).partitionBy(TILE).parquet(path)


def read_box(spark: SparkSession, path: str, west: float, south: float, east: float, north: float, most: int = 64) -> DataFrame:
    """The rows of a box (ends included) of a table written by ``write_curve``.

    The box becomes folders, which are not opened unless it touches them, and ranges of the key, which reach the scan and skip row
    groups; the coordinates decide at last. Rows without a coordinate are in no box.
    """
    rows = spark.read.parquet(path)
    about = rows.schema[KEY].metadata
    curve = Curve(**about["curve"])
    spans = curve.ranges(west, south, east, north, most)
    if not spans:
        return rows.where(F.lit(False)).drop(KEY, TILE)
    tiles = sorted({t for a, b in spans for t in range(a >> curve.tile_shift, (b >> curve.tile_shift) + 1)})
    inside = reduce(or_, [F.col(KEY).between(a, b) for a, b in spans])
    exact = F.col(about["x"]).between(west, east) & F.col(about["y"]).between(south, north)
    return rows.where(F.col(TILE).isin(tiles)).where(inside).where(exact).drop(KEY, TILE)
