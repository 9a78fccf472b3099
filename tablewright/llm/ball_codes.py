"""Vector codes of a few bytes: a codebook for each part of the vectors, learned by ball k-means.

The parts that share an entry are its ball. A round of Lloyd's algorithm asks for the nearest entry
of every part; the triangle inequality answers most of that without measuring:

* An entry is a neighbour of a ball if it is at most two radii from the ball's entry. Others can't
  take a part of the ball.
* A part nearer to its entry than half the way to the nearest neighbour is in the stable core and
  keeps its entry.
* Beyond the core, the half-way distances of the neighbours cut the ball into rings. A part in the
  k-th ring is compared with the k nearest neighbours only, exactly, in whole numbers.

Vectors and their codes are written between rounds, so a lost executor costs a task, not the rounds
before. A round is one pass: sums, counts and radii by part and entry go to the driver, a table of
fixed size, which gives the next codebooks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.staging import drop_table, stage

#: Components below this keep all sums of a batch within 64 bits; larger ones are Python's integers.
SAFE = 1 << 24
#: Tasks that share the rows of one label when its errors are added to them.
SALTS = 16
#: What splits a sum of many digits in two.
HIGH = 10**19


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, and for each entry a bound on the squared radius of its ball (None: none known)."""

    entries: list[np.ndarray]
    radii: list[list[int | None]]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, joined by commas."""
        numbers = (str(int(x)) for part in self.entries for x in part.reshape(-1))
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def part_bounds(size: int, parts: int) -> list[tuple[int, int]]:
    """Where each part starts and ends; the first ones are one longer if the size can't be divided."""
    small, more = divmod(size, parts)
    ends = np.cumsum([small + (i < more) for i in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: as 64-bit integers, or as Python's where those are too narrow."""
    vectors = vectors.astype(np.float64)
    if not vectors.size or np.abs(vectors).max() < SAFE / scale:
        return np.floor(vectors * scale).astype(np.int64)
    exact = [math.floor(x) * scale + math.floor((x - math.floor(x)) * scale) for x in vectors.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(vectors.shape)


def _distance(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    gap = points - entry
    return (gap * gap).sum(axis=1)


def _isqrt_up(n: int) -> int:
    root = math.isqrt(n)
    return root + (root * root < n)


def neighbours(entries: np.ndarray, radii: list[int | None]) -> list[list[tuple[int, int]]]:
    """For each ball the (squared distance, entry) of its neighbours, nearest first."""
    found = []
    for i, radius in enumerate(radii):
        apart = [int(d) for d in _distance(entries, entries[i])]
        near = sorted((d, j) for j, d in enumerate(apart) if j != i and (radius is None or d <= 4 * radius))
        found.append(near)
    return found


def nearest(
    points: np.ndarray, held: np.ndarray, entries: np.ndarray, near: list[list[tuple[int, int]]]
) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point, the lower one of ties, and its squared distance.

    `held` tells which ball each point is in, `near` the neighbours of every ball.
    """
    best, error = held.copy(), np.zeros(len(points), points.dtype)
    for i, around in enumerate(near):
        own = np.flatnonzero(held == i)
        if not len(own):
            continue
        d = _distance(points[own], entries[i])
        error[own] = d
        # A neighbour matters from half its distance on: there it may be as near, and win the tie.
        halves = np.array([apart for apart, _ in around], dtype=points.dtype)
        ring = np.searchsorted(halves, 4 * d, side="right") if len(halves) else np.zeros(len(own), np.int64)
        for k, (_, j) in enumerate(around):
            out = np.flatnonzero(ring > k)
            if not len(out):
                break
            rows = own[out]
            other = _distance(points[rows], entries[j])
            wins = (other < error[rows]) | ((other == error[rows]) & (j < best[rows]))
            best[rows[wins]], error[rows[wins]] = j, other[wins]
    return best, error


def _kept(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    def usable(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    rows = vectors.select(
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{vector_column}`").alias("vector"),
        F.col(f"`{label_column}`").alias("label"),
    )
    # size() is -1 or null for a null vector, by setting.
    return rows.filter(F.col("vector").isNotNull() & ~F.exists("vector", usable))


def _first_books(kept: DataFrame, parts: int, entries: int, scale: int) -> tuple[Codebooks, int] | None:
    """Codebooks of the rows of least id, and the length of the vectors; None if there are no rows."""
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    size = kept.orderBy(*order).select(F.size("vector")).first()
    if size is None:
        return None
    first = kept.filter(F.size("vector") == size[0]).orderBy(*order).select("vector").limit(entries).collect()
    numbers = whole_numbers(np.array([r.vector for r in first], np.float64).reshape(len(first), size[0]), scale)
    books = [numbers[:, a:b] for a, b in part_bounds(size[0], parts)]
    return Codebooks(books, [[None] * len(first) for _ in books]), size[0]


def _matrix(vectors: pd.Series, size: int, scale: int) -> np.ndarray:
    return whole_numbers(np.array(vectors.tolist(), np.float64).reshape(len(vectors), size), scale)


def _codes(codes: pd.Series, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(-1, parts).astype(np.int64)


def _assigned(rows: DataFrame, books: Codebooks, size: int, scale: int, measured: bool = False) -> DataFrame:
    """`rows` with their codes under `books`; the codes they come with tell the balls. `measured` adds
    `error`, and leaves the vectors out."""
    bounds = part_bounds(size, len(books.entries))
    near = [neighbours(e, r) for e, r in zip(books.entries, books.radii)]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            numbers, held = _matrix(batch["vector"], size, scale), _codes(batch["code"], len(bounds))
            found, total = np.zeros_like(held), 0
            for p, (a, b) in enumerate(bounds):
                points, entries = _alike(numbers[:, a:b], books.entries[p])
                found[:, p], error = nearest(points, held[:, p], entries, near[p])
                total = error + total
            batch["code"] = [row.tobytes() for row in found.astype(np.uint8)]
            if measured:
                batch["error"] = pd.array([e if e < 1 << 63 else None for e in map(int, total)], dtype="Int64")
                batch = batch.drop(columns="vector")
            yield batch

    names = ["id", "label", "code"] if measured else ["id", "label", "vector", "code"]
    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in names]
    return rows.mapInPandas(assign, ", ".join([*fields, "error bigint"] if measured else fields))


def _alike(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as Python's integers if one of them needs those."""
    if points.dtype == entries.dtype:
        return points, entries
    return points.astype(object), entries.astype(object)


def _sums(rows: DataFrame, books: Codebooks, size: int, scale: int) -> DataFrame:
    """part, entry, n, radius and the sum at each position, over all vectors.

    Batches are summed before the shuffle. A sum travels as two decimals, its multiples of HIGH and
    the rest, for it may pass 38 digits; the radius is a double, rounded up."""
    bounds = part_bounds(size, len(books.entries))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            numbers, codes = _matrix(batch["vector"], size, scale), _codes(batch["code"], len(bounds))
            out = []
            for p, (a, b) in enumerate(bounds):
                points, entries = _alike(numbers[:, a:b], books.entries[p])
                for j in np.unique(codes[:, p]).tolist():
                    ball = points[codes[:, p] == j]
                    radius = float(_isqrt_up(int(_distance(ball, entries[j]).max()))) * (1 + 1e-9)
                    sums = [divmod(int(s), HIGH) for s in ball.sum(axis=0)]
                    out.append((p, j, len(ball), radius, [{"high": str(h), "low": str(x)} for h, x in sums]))
            yield pd.DataFrame(out, columns=["part", "entry", "n", "radius", "sums"])

    schema = "part int, entry int, n bigint, radius double, sums array<struct<high:string,low:string>>"
    found = rows.select("vector", "code").mapInPandas(add, schema)
    each = found.select("part", "entry", "n", "radius", F.posexplode_outer("sums").alias("at", "s"))
    return each.groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"),
        F.max("radius").alias("radius"),
        *[F.sum(F.col(f"s.{c}").cast("decimal(38,0)")).alias(c) for c in ("high", "low")],
    )


def _next_books(books: Codebooks, sums: DataFrame) -> Codebooks:
    """Each entry at floor(sum / count) of its parts; unused ones stay.

    No part of a ball is farther from the new entry than the radius and the entry's way together.
    """
    balls: dict[tuple[int, int], tuple[int, dict[int, int]]] = {}
    for r in sums.collect():  # parts x entries x positions
        _, means = balls.setdefault((r.part, r.entry), (math.ceil(r.radius), {}))
        if r["at"] is not None:
            means[r["at"]] = (int(r.high) * HIGH + int(r.low)) // r.n
    entries, radii = [], []
    for p, old in enumerate(books.entries):
        balls_of_part = [balls.get((p, j), (0, {})) for j in range(len(old))]
        new = [[means.get(k, int(x)) for k, x in enumerate(row)] for row, (_, means) in zip(old, balls_of_part)]
        ways = [sum((x - int(y)) ** 2 for x, y in zip(*rows)) for rows in zip(new, old)]
        wide = any(abs(x) >= SAFE for row in new for x in row)
        entries.append(np.array(new, dtype=object if wide else np.int64).reshape(old.shape))
        radii.append([(r + _isqrt_up(way)) ** 2 for (r, _), way in zip(balls_of_part, ways)])
    return Codebooks(entries, radii)


def learn_codes(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> tuple[DataFrame, Codebooks]:
    """Rows (id, label, code, error) and the codebooks after `rounds` rounds.

    Components count as floor(scale * x). Rows whose vector is null or holds nulls, NaN or infinite
    numbers go, and so do vectors of another length than the one of least id. Codebooks start from
    the `entries` (256 at most) rows of least id, null ids last and equal ids by their vectors; a
    table of fewer rows has shorter codebooks. Repeated rows count each, ties go to the lower
    entry. `code` has a byte for each part; `error` is the squared distance to the entries, null
    where it passes 64 bits. Components are smaller than 1e40, as all floats are. Other columns are left out. Of an empty table the result is empty, and
    so are the codebooks. Vectors and codes are written once a round, two rounds are kept.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    kept = _kept(vectors, id_column, vector_column, label_column)
    start = _first_books(kept, parts, entries, scale)
    if start is None:
        empty = kept.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return empty, Codebooks([], [])
    books, size = start
    rows = _assigned(
        kept.filter(F.size("vector") == size).withColumn("code", F.lit(bytes(parts))), books, size, scale
    )
    held = None
    for _ in range(rounds):
        before, held = held, stage(rows)
        if before is not None:
            drop_table(before)
        books = _next_books(books, _sums(held, books, size, scale))
        rows = _assigned(held, books, size, scale)
    coded = stage(_assigned(held if rounds else rows, books, size, scale, measured=True))
    if held is not None:
        drop_table(held)
    return coded, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """`coded` with `label_error`: the error of all rows of its label, nulls together.

    Rows of a label that many share are dealt to SALTS tasks."""
    exact = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = coded.groupBy(F.col("label").alias("of")).agg(exact.try_cast("bigint").alias("label_error"))
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("dealt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    same = F.col("label").eqNullSafe(F.col("of")) & (F.col("dealt") == F.col("salt"))
    return dealt.join(totals, same).drop("of", "salt", "dealt")
