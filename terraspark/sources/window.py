"""The part of a raster that a scan reads.

A window is an option of the scan and not a pushed filter: in Spark 4.1 what one query
pushes into a Python source stays with the table, and the next query on the same
DataFrame would read too little.
"""

from __future__ import annotations


class Bounds:
    """Half-open ranges of rows and columns."""

    def __init__(self, height: int, width: int, option: str | None = None):
        z0, x0, z1, x1 = map(int, option.split(",")) if option else (0, 0, height, width)
        self.z, self.x = (max(z0, 0), min(z1, height)), (max(x0, 0), min(x1, width))

    def meets(self, z: tuple[int, int] | None = None, x: tuple[int, int] | None = None) -> bool:
        """Whether a part with these half-open spans can hold a cell."""
        return all(span is None or max(span[0], own[0]) < min(span[1], own[1]) for span, own in ((z, self.z), (x, self.x)))


def option(window: tuple[int, int, int, int] | None) -> dict[str, str]:
    """(z0, x0, z1, x1) as an option of a scan."""
    return {} if window is None else {"window": ",".join(map(str, window))}
