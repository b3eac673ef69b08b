"""Caption line layout, linear in the length of the text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from turnout.functions import fixed

LINE = StructType([StructField("line_no", IntegerType()), StructField("line", StringType()),
                   StructField("before", IntegerType()), StructField("total", IntegerType())])


def fold(text: str, width: int) -> list[str]:
    """Greedy word wrap; a word longer than the line stands alone."""
    lines: list[list[str]] = []
    room = -1
    for word in text.split():
        if len(word) + 1 <= room:
            lines[-1].append(word)
            room -= len(word) + 1
        else:
            lines.append([word])
            room = width - len(word)
    return [" ".join(parts) for parts in lines]


@F.pandas_udf(ArrayType(LINE))
def caption_layout(text: pd.Series) -> pd.Series:
    """Lines of a turn, each with the characters before it and in all."""
    def one(t):
        lines = fold(t or "", fixed.CAPTION_CHARS)
        total, out, seen = sum(map(len, lines)), [], 0
        for i, line in enumerate(lines):
            out.append({"line_no": i, "line": line, "before": seen, "total": max(total, 1)})
            seen += len(line)
        return out
    return pd.Series([one(t) for t in text])
