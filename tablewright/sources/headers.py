"""Header names of text files and workbooks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from tablewright.columns import RESERVED
from tablewright.functions.constants import AUTO_NAME_FORMAT, WHITESPACE


class IngestError(ValueError):
    """A source cannot be read as a table."""


def header_names(raw: Sequence[str | None], width: int | None = None) -> list[str]:
    """Final column names: stripped, blank ones numbered; equal (without case) and reserved ones refused."""
    cells = list(raw) + [None] * max(0, (width or 0) - len(raw))
    if not cells:
        raise IngestError("the file has no header")
    names, seen = [], set()
    for number, cell in enumerate(cells, start=1):
        name = (cell or "").strip(WHITESPACE)
        if not name or re.fullmatch(r"Unnamed: \d+", name):
            name = AUTO_NAME_FORMAT.format(number)
        if name.lower() in RESERVED:
            raise IngestError(f"column name '{name}' is reserved")
        if name.lower() in seen:
            raise IngestError(f"duplicate column name '{name}'")
        seen.add(name.lower())
        names.append(name)
    return names
