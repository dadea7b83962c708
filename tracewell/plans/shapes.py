"""Texts of one shape are read once: statements that differ only in the digits of their names share what is read.

A run of digits after a letter or an underscore changes neither the lexemes of a
text nor which of its names are equal, as long as equal runs stay equal.  Such runs
are numbered, the text with the numbers is read, and the runs are put back.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Hashable
from typing import Any

#: Fixed value: digits that stand before the number of a run; a text that has them itself is read as it is.
MARK = "7301946285"
#: Fixed value: most different runs of a text, as their numbers have three digits.
MOST_RUNS = 1000
# A run before an x is left, for 0x begins a hexadecimal number; a digit comes first, as that is found fast.
_RUN = re.compile(r"([0-9](?<=[A-Za-z_][0-9])[0-9]*(?![0-9xX]))")
_MARKED = re.compile(MARK + "([0-9]{3})")


def shape_of(text: str) -> tuple[tuple[tuple[str, ...], tuple[int, ...]], tuple[str, ...]]:
    """The text without its runs of digits and which of them are equal, and the different runs."""
    # Letters beyond ASCII may become others in lower case, so that names are equal whose runs have unlike neighbours.
    if not text.isascii() or MARK in text:
        return ((text,), ()), ()
    pieces = _RUN.split(text)
    found = pieces[1::2]
    if len(found) < 2:
        return (tuple(pieces[::2]), (0,) * len(found)), tuple(found)
    numbers = {run: k for k, run in enumerate(dict.fromkeys(found))}
    if len(numbers) > MOST_RUNS:
        return ((text,), ()), ()
    return (tuple(pieces[::2]), tuple([numbers[run] for run in found])), tuple(numbers)


def numbered(between: tuple[str, ...], numbers: tuple[int, ...]) -> str:
    """The text of a shape, with numbered marks in place of the runs."""
    return between[0] + "".join([f"{MARK}{k:03}{piece}" for k, piece in zip(numbers, between[1:], strict=True)])


def filler(value: str) -> str | Callable[..., str]:
    """A value read from a shape: itself, or what makes it from the runs of a text."""
    if MARK not in value:
        return value
    pieces = _MARKED.split(value)
    pieces[::2] = [p.replace("{", "{{").replace("}", "}}") for p in pieces[::2]]
    pieces[1::2] = [f"{{{int(p)}}}" for p in pieces[1::2]]
    return "".join(pieces).format


class ShapeTable:
    """Rows of a text as columns of values, read once per shape.

    ``read`` gives for a text a list of (values, tag): as many values as there are
    columns, and anything that does not depend on names.
    """

    def __init__(self, read: Callable[[str], list[tuple[tuple, Hashable]]], width: int, shapes: int = 4096):
        @functools.lru_cache(maxsize=shapes)
        def prepared(shape: tuple[tuple[str, ...], tuple[int, ...]]) -> tuple[int, list[tuple[list, list]], list]:
            rows = read(numbered(*shape))
            columns: list[tuple[list, list]] = []
            for c in range(width):
                fillers = [filler(values[c]) if shape[1] else values[c] for values, _ in rows]
                columns.append((fillers, [k for k, f in enumerate(fillers) if not isinstance(f, str)]))
            return len(rows), columns, [tag for _, tag in rows]

        self.prepared = prepared

    def append(self, text: str, columns: list[list[str]], tags: list[Any]) -> int:
        """Add the rows of ``text``; their number."""
        shape, runs = shape_of(text)
        n, prepared, said = self.prepared(shape)
        for column, (fillers, varying) in zip(columns, prepared, strict=True):
            if not varying:
                column += fillers
            elif n == 1:
                column.append(fillers[0](*runs))
            else:
                column += [f if isinstance(f, str) else f(*runs) for f in fillers]
        tags += said
        return n
