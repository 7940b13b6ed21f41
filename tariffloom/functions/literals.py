"""Small fixed tables as one literal column."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_rows(rows: Sequence[tuple], schema: str) -> Column:
    """``rows`` as one ``array<struct>`` constant that Catalyst folds; ``schema`` is the DDL of
    a row.  Only for tables whose size is fixed by the program."""
    names = [part.split()[0].strip("`") for part in schema.split(",")]
    text = json.dumps([dict(zip(names, row)) for row in rows], ensure_ascii=False)
    fields = ", ".join(f"`{n}`: {part.split()[1]}" for n, part in zip(names, schema.split(",")))
    return F.from_json(F.lit(text), f"array<struct<{fields}>>")
