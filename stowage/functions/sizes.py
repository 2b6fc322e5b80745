"""Quantities of bytes as text."""

from __future__ import annotations

import re

#: Units of byte quantities; fixed values.
UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40}


def parse_size(value: int | str) -> int:
    """Bytes of ``8MiB``, ``1 KiB``, ``1.5 GB`` or a bare number."""
    if isinstance(value, int):
        return value
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", value)
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"not a quantity of bytes: {value!r}")
    return int(float(m[1]) * UNITS[m[2].lower()]) if "." in m[1] else int(m[1]) * UNITS[m[2].lower()]


def format_size(n: float) -> str:
    """A quantity in the largest binary unit that leaves at least 1."""
    for unit in ("TiB", "GiB", "MiB", "KiB"):
        if n >= UNITS[unit.lower()]:
            return f"{n / UNITS[unit.lower()]:.2f} {unit}"
    return f"{n:.0f} B"
