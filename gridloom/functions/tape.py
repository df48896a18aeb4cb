"""A tape machine as a table function: programs of eight instructions over a tape of 30 000 cells.

User code in this library is compiled by Spark's code generation; this interpreter is for programs that come as data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

CELLS = 30_000


def execute(program: str, given: bytes = b"", most: int = 10_000_000) -> bytes:
    """The output of a program; cells are bytes and wrap around, input that has run out leaves a cell as it is.
    A program that takes more than most instructions, or has unmatched brackets, raises ValueError."""
    jump, open_ = {}, []
    for at, c in enumerate(program):
        if c == "[":
            open_.append(at)
        elif c == "]":
            if not open_:
                raise ValueError(f"unmatched ] at {at}")
            jump[at] = open_.pop()
            jump[jump[at]] = at
    if open_:
        raise ValueError(f"unmatched [ at {open_[-1]}")
    tape, head, at, out, source = bytearray(CELLS), 0, 0, bytearray(), iter(given)
    for _ in range(most):
        if at >= len(program):
            return bytes(out)
        match program[at]:
            case ">":
                head = (head + 1) % CELLS
            case "<":
                head = (head - 1) % CELLS
            case "+":
                tape[head] = (tape[head] + 1) & 255
            case "-":
                tape[head] = (tape[head] - 1) & 255
            case ".":
                out.append(tape[head])
            case ",":
                tape[head] = next(source, tape[head])
            case "[" if not tape[head]:
                at = jump[at]
            case "]" if tape[head]:
                at = jump[at]
        at += 1
    raise ValueError("too many instructions")


def execute_column(df: DataFrame, program: str) -> DataFrame:
    """df (id, program) with the output of each program as text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(output=[execute(p or "").decode("latin-1") for p in pdf[program]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, output string")
