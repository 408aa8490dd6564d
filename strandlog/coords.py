"""Coordinates of operations, and the grammar of bundle and operation ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BUNDLE_SIZE = 10_000
FILE_NAME = re.compile(r"^([0-9]{6})\.jsonl\.zst$")


def to_global(bundle: Column | str, position: Column | str, size: int = BUNDLE_SIZE) -> Column:
    b, p = (F.col(x) if isinstance(x, str) else x for x in (bundle, position))
    return ((b.cast("long") - 1) * F.lit(size) + p).cast("long")


def bundle_of(global_pos: Column | str, size: int = BUNDLE_SIZE) -> Column:
    g = F.col(global_pos) if isinstance(global_pos, str) else global_pos
    return (F.floor(g / F.lit(size)) + 1).cast("int")


def position_of(global_pos: Column | str, size: int = BUNDLE_SIZE) -> Column:
    g = F.col(global_pos) if isinstance(global_pos, str) else global_pos
    return (g % F.lit(size)).cast("int")


def file_name(bundle: int) -> str:
    return f"{bundle:06d}.jsonl.zst"


def _bundle(word: str, last: int) -> int:
    word = word.strip()
    if word == "root":
        return 1
    if word == "head":
        return last
    back = re.fullmatch(r"(?:head)?~(.*)", word)
    if back:
        if not back[1].isdigit():
            raise ValueError(f"{word!r}: what follows ~ has to be a whole number")
        if int(back[1]) >= last:
            raise ValueError(f"{word!r} goes back beyond the first of {last} bundles")
        return last - int(back[1])
    if not word.isdigit():
        raise ValueError(f"{word!r} names no bundle")
    return int(word)


def bundle_intervals(spec: str, last: int) -> list[tuple[int, int]]:
    """Inclusive, sorted, disjoint intervals of a spec such as `1-10,15`, `root`, `head~2`, `~2` or `latest:5`."""
    if last == 0:
        raise ValueError("the log has no bundles yet")
    if spec.startswith("latest:"):
        n = int(spec.removeprefix("latest:"))
        return [(max(1, last - n + 1), last)] if n else []
    out = []
    for part in filter(None, map(str.strip, spec.split(","))):
        ends = part.split("-")
        if len(ends) > 2:
            raise ValueError(f"{part!r} is no range")
        low, high = _bundle(ends[0], last), _bundle(ends[-1], last)
        if not low or not high:
            raise ValueError("bundles are numbered from 1 on")
        if low > high:
            raise ValueError(f"{part!r} ends before it starts")
        if high > last:
            raise ValueError(f"{part!r} is out of range: bundle {last} is the last one")
        out.append((low, high))
    return merged(out)


def operation_intervals(spec: str, last: int | None = None) -> list[tuple[int, int]]:
    """Inclusive, sorted, disjoint intervals of global positions of a spec such as `0,5-7`."""
    out = []
    for part in filter(None, map(str.strip, spec.split(","))):
        ends = [x.strip() for x in part.split("-")]
        if len(ends) > 2 or not all(x.isdigit() for x in ends):
            raise ValueError(f"{part!r} is no range")
        low, high = int(ends[0]), int(ends[-1])
        if low > high:
            raise ValueError(f"{part!r} ends before it starts")
        if last is not None and high > last:
            raise ValueError(f"{part!r} is out of range: operation {last} is the last one")
        out.append((low, high))
    return merged(out)


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(intervals):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def within(column: str, intervals: list[tuple[int, int]]) -> Column:
    """A predicate of betweens, which reaches the scan's row-group statistics."""
    out = F.lit(False)
    for low, high in intervals:
        out = out | F.col(column).between(low, high)
    return out


def pruned(intervals: list[tuple[int, int]], size: int = BUNDLE_SIZE) -> Column:
    """Operations at these global positions, with the bundle bounds that follow from them, for partition pruning."""
    bundles = merged([(low // size + 1, high // size + 1) for low, high in intervals])
    return within("bundle", bundles) & within("global_pos", intervals)


def parse_pointer(pointer: str, size: int = BUNDLE_SIZE) -> tuple[int, int]:
    """(bundle, position) of `bundle:position` or of a global position."""
    b, colon, p = pointer.partition(":")
    if colon:
        if not b.isdigit() or not p.isdigit():
            raise ValueError(f"{pointer!r} has to be two whole numbers")
        if int(b) < 1:
            raise ValueError("bundles are numbered from 1 on")
        return int(b), int(p)
    if not pointer.isdigit():
        raise ValueError(f"{pointer!r} is neither a global position nor bundle:position")
    return int(pointer) // size + 1, int(pointer) % size
