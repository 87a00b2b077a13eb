"""The grid: region, cell and tile sizes. All positions are projected metres."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Grid:
    """A square region cut into cells, tiles, and basic tiles of several tiles."""

    low: int = -4_800_000
    high: int = 4_800_000
    cell: int = 500
    tile: int = 8_000
    basic: int = 3  # tiles along the side of a basic tile

    @property
    def cells(self) -> int:
        return (self.high - self.low) // self.cell

    @property
    def tiles(self) -> int:
        return (self.high - self.low) // self.tile

    @property
    def basics(self) -> int:
        return -(-self.tiles // self.basic)


#: The region of the test tables.
SMALL = Grid(low=-24_000, high=24_000)
HIGH_WEIGHTS = (15, 20, 25, 30)
