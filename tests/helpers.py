"""What the tests share."""

from __future__ import annotations


def rows(df, *columns) -> list[tuple]:
    """Sorted rows of a frame, nulls first."""
    picked = df.select(*columns) if columns else df
    found = [tuple(r) for r in picked.collect()]
    return sorted(found, key=lambda r: tuple((v is not None, str(v)) for v in r))
