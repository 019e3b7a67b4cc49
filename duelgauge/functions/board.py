"""Board index arithmetic, symmetries and occupancy measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHJKLMNOPQRSTUVWXYZ"


def coordinate_to_index(text: Column, size: int) -> Column:
    """`Q16` style coordinate (letter I is skipped) to an index; PASS is the index past the board."""
    upper = F.upper(text)
    letter = F.substring(upper, 1, 1)
    column = F.ascii(letter) - ord("A") - F.when(letter > "I", 1).otherwise(0)
    row = F.regexp_extract(upper, r"^[A-Z](\d+)", 1).try_cast("int") - 1
    return F.when(upper == "PASS", size * size).when(F.length(text) < 2, -1).otherwise(row * size + column)


def index_to_coordinate(index: Column, size: int) -> Column:
    column = index % size
    letter = F.substring(F.lit(LETTERS), (column + 1).cast("int"), F.lit(1))
    row = F.floor(index / size) + 1
    return F.when(index == size * size, "PASS").otherwise(F.concat(letter, row.cast("string")))


def record_to_index(text: Column, size: int) -> Column:
    """Two-letter record point (rows from the top) to an index; anything else is a pass."""
    point = F.upper(text)
    column = F.ascii(F.substring(point, 1, 1)) - ord("A")
    row = size - 1 - (F.ascii(F.substring(point, 2, 1)) - ord("A"))
    return F.when(F.length(text) != 2, size * size).otherwise(row * size + column)


def index_to_record(index: Column, size: int) -> Column:
    letter = lambda i: F.char((i + ord("a")).cast("int"))
    row = size - 1 - F.floor(index / size)
    return F.when(index == size * size, "").otherwise(F.concat(letter(index % size), letter(row)))


def symmetric_index(index: Column, symmetry: Column, size: int) -> Column:
    """Index of a point under one of eight board symmetries; the pass index is unmoved.

    Symmetries 0-3 rotate by 0, 90, 180 and 270 degrees; 4-7 do so after a mirror over the rows.
    """
    last = size - 1
    x, y = index % size, F.floor(index / size)
    quarter = symmetry % 4
    mirrored = symmetry >= 4
    row = F.when(mirrored, last - y).otherwise(y)
    to_x = F.when(quarter == 0, x).when(quarter == 1, row).when(quarter == 2, last - x).otherwise(last - row)
    to_y = F.when(quarter == 0, row).when(quarter == 1, last - x).when(quarter == 2, last - row).otherwise(x)
    return F.when(index == size * size, index).otherwise(to_y * size + to_x)


# Worth of a 2x2 region by its white and black piece counts, for ranks 1 to 7 in order.
REGION_WORTH = {
    (0, 1): (2, 3, 4, 5, 6, 7, 8),
    (0, 2): (7, 6, 5, 4, 3, 0, 0),
    (0, 3): (9, 8, 7, 6, 5, 4, 0),
    (0, 4): (9, 8, 7, 6, 5, 4, 0),
    (1, 0): (8, 7, 6, 5, 4, 3, 2),
    (1, 1): (8, 7, 6, 5, 6, 7, 8),
    (1, 2): (10, 9, 8, 7, 6, 5, 4),
    (1, 3): (11, 10, 9, 8, 7, 6, 5),
    (2, 0): (0, 0, 3, 4, 5, 6, 7),
    (2, 1): (4, 5, 6, 7, 8, 9, 10),
    (2, 2): (7, 7, 7, 7, 7, 7, 7),
    (3, 0): (0, 4, 5, 6, 7, 8, 9),
    (3, 1): (5, 6, 7, 8, 9, 10, 11),
    (4, 0): (0, 4, 5, 6, 7, 8, 9),
}
RANK_1 = 0xFF
RANK_8 = 0xFF << 56


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def region_mask(rank: int, file: int) -> int:
    return 0b11 << (8 * (rank - 1) + file) | 0b11 << (8 * rank + file)


def mixedness(white: Column, black: Column) -> Column:
    """How interleaved the two armies are: the worth of all 49 regions, from two occupancy masks.

    A flat sum of bit counts and constant lookups, so it compiles into the generated code.
    """
    worth = [0] * (7 * 25)
    for (w, b), values in REGION_WORTH.items():
        for rank, value in enumerate(values, start=1):
            worth[(rank - 1) * 25 + w * 5 + b] = value
    total = F.lit(0)
    for rank in range(1, 8):
        row = F.array(*[F.lit(v) for v in worth[(rank - 1) * 25 : rank * 25]])
        for file in range(7):
            mask = F.lit(signed(region_mask(rank, file))).cast("bigint")
            held = F.bit_count(white.bitwiseAND(mask)) * 5 + F.bit_count(black.bitwiseAND(mask))
            total = total + F.get(row, held)
    return total


def piece_count(white: Column, black: Column, kings: Column, pawns: Column) -> Column:
    """Pieces other than kings and pawns."""
    return F.bit_count(white.bitwiseOR(black).bitwiseAND(F.bitwise_not(kings.bitwiseOR(pawns))))


def back_rank_sparse(white: Column, black: Column) -> Column:
    low = F.bit_count(white.bitwiseAND(F.lit(RANK_1).cast("bigint"))) < 4
    high = F.bit_count(black.bitwiseAND(F.lit(signed(RANK_8)).cast("bigint"))) < 4
    return low | high
