"""Training and evaluation transforms on chip arrays.

Each transform takes chips (``chip_id, c, h, w, px``) and returns chips with single
precision pixels, for ``df.transform``. None of them shuffles. Steps that follow each
other run fused: one pass over Arrow batches, chips of one size as one numpy stack.

Random steps draw from the chip's id and the seed, so that any partitioning gives the
same augmentation. Spark hashes id, seed and step to one number per chip; a generator
that is a function of that number and a counter (``mix``) gives as many draws per chip
as it has channels or pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from furrow.functions.arrays import REFLECTANCE_SCALE, coin, quarter_turns
from furrow.functions.hashing import hash_int
from furrow.operators.chips import row_slices
from furrow.session import ship_package

Transform = Callable[[DataFrame], DataFrame]
Groups = list[tuple[slice | np.ndarray, np.ndarray]]
ID = "chip_id"
STACK_BYTES = 32 << 20  # pixels that are transformed at once

# The multipliers of a public 32-bit mixing function, and the odd
# number next to 2**32 over the golden ratio, which sets counters apart.
MIX = (0x7FEB352D, 0x846CA68B)
GOLDEN = 0x9E3779B9
SECOND_LANE = 0x85EBCA6B


def mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of every number."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(MIX[0])
    x ^= x >> np.uint32(15)
    x *= np.uint32(MIX[1])
    x ^= x >> np.uint32(16)
    return x


def draws(keys: np.ndarray, n: int) -> np.ndarray:
    """``n`` hashed numbers per key, one row each."""
    return mix(keys.astype(np.uint32)[:, None] + np.arange(n, dtype=np.uint32) * np.uint32(GOLDEN))


def as_uniform(hashed: np.ndarray) -> np.ndarray:
    """Hashed numbers as doubles in [0, 1)."""
    return hashed / float(1 << 32)


@dataclass(frozen=True)
class Step:
    """``run`` gets equal chips as one stack (chip, channel, y, x) and an array per
    column of ``columns``; it returns parts of the stack with the rows they are of."""

    run: Callable[..., Groups]
    columns: dict[str, Column] = field(default_factory=dict)


def _stack(runs: list[Callable[..., Groups]], pixels: np.ndarray, columns: list[dict[str, np.ndarray]]) -> Groups:
    """Equal chips after all steps, in parts with the rows they are of."""
    groups: Groups = [(np.arange(len(pixels)), pixels)]
    for run, own in zip(runs, columns):
        groups = [
            (rows[part], done)
            for rows, stack in groups
            for part, done in run(stack, **{name: values[rows] for name, values in own.items()})
        ]
    return groups


def _batch(runs: list[Callable[..., Groups]], columns: list[pa.Array], drawn: list[dict[str, np.ndarray]]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(heights, widths, pixels) after all steps; rows without pixels keep theirs."""
    px = columns[3]
    shapes = np.stack([c.fill_null(0).to_numpy().astype(np.int64) for c in columns[:3]], axis=1)
    gone = np.asarray(px.is_null())
    offsets = px.offsets.to_numpy().astype(np.int64)
    values = px.values.to_numpy(zero_copy_only=False)
    size = np.where(gone, 0, np.diff(offsets))
    wrong = np.flatnonzero(~gone & (size != shapes.prod(axis=1)))
    if len(wrong):
        raise ValueError(f"chip has {size[wrong[0]]} values, expected {' x '.join(map(str, shapes[wrong[0]]))}")
    first = size.cumsum() - size
    out = np.empty(int(size.sum()), np.float32)
    heights, widths = shapes[:, 1].copy(), shapes[:, 2].copy()
    for shape in np.unique(shapes[~gone], axis=0):
        rows = np.flatnonzero(~gone & (shapes == shape).all(axis=1))
        stack = values[offsets[rows][:, None] + np.arange(shape.prod())].astype(np.float64).reshape(-1, *shape)
        for part, done in _stack(runs, stack, [{n: v[rows] for n, v in own.items()} for own in drawn]):
            out[first[rows[part]][:, None] + np.arange(shape.prod())] = done.reshape(len(done), -1)
            heights[rows[part]], widths[rows[part]] = done.shape[2:]
    at = pa.array(np.append(0, size.cumsum()).astype(np.int32), mask=np.append(gone, False))
    same = [pa.array(new, mask=np.asarray(old.is_null())) for new, old in zip((heights, widths), columns[1:3])]
    return *same, pa.ListArray.from_arrays(at, pa.array(out))


class Fused:
    """Steps applied in order in one pass."""

    def __init__(self, *steps: Step):
        self.steps = steps

    def __call__(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        names = df.columns
        # Positions stand for the columns, whose names may clash with anything.
        kept = [F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]
        drawn = [(k, name, c) for k, step in enumerate(self.steps) for name, c in step.columns.items()]
        rows = df.select(*kept, *(c.alias(f"d{i}") for i, (_, _, c) in enumerate(drawn)))
        place = {n: names.index(n) for n in ("c", "h", "w", "px")}
        labels = [f"c{i}" for i in range(len(names))]
        steps, runs = [(k, name) for k, name, _ in drawn], [step.run for step in self.steps]  # columns stay on the driver

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi in row_slices(batch.column(place["px"]), STACK_BYTES // 8):
                    part = batch.slice(lo, hi - lo)
                    columns: list[dict[str, np.ndarray]] = [{} for _ in runs]
                    for i, (k, name) in enumerate(steps):
                        columns[k][name] = part.column(len(names) + i).to_numpy(zero_copy_only=False)
                    out = _batch(runs, [part.column(place[n]) for n in ("c", "h", "w", "px")], columns)
                    cells = list(part.columns[: len(names)])
                    for n, values in zip(("h", "w", "px"), out):
                        cells[place[n]] = values.cast(batch.column(place[n]).type) if n != "px" else values
                    yield pa.RecordBatch.from_arrays(cells, names=labels)

        schema = T.StructType(
            [T.StructField(f"c{i}", T.ArrayType(T.FloatType()) if n == "px" else df.schema[n].dataType) for i, n in enumerate(names)]
        )
        return rows.mapInArrow(run, schema).toDF(*names)


def compose(*steps: Transform) -> Transform:
    """Apply transforms in order; neighbours from this module run as one pass."""
    joined: list[Transform] = []
    for step in steps:
        if joined and isinstance(step, Fused) and isinstance(joined[-1], Fused):
            joined[-1] = Fused(*joined[-1].steps, *step.steps)
        else:
            joined.append(step)
    return joined[0] if len(joined) == 1 else lambda df: reduce(lambda d, step: d.transform(step), joined, df)


def _whole(stack: np.ndarray) -> Groups:
    return [(slice(None), stack)]


def scale_reflectance(scale: float = REFLECTANCE_SCALE) -> Transform:
    if scale <= 0:
        raise ValueError(f"cannot divide by scale {scale}")
    return Fused(Step(lambda stack: _whole(stack / float(scale))))


def normalize(mean: Sequence[float], std: Sequence[float]) -> Transform:
    """``(x - mean) / std`` per channel; a chip with another channel count fails."""
    if len(mean) != len(std):
        raise ValueError(f"{len(mean)} means for {len(std)} deviations")
    m, s = (np.array(v, np.float64)[:, None, None] for v in (mean, std))

    def run(stack: np.ndarray) -> Groups:
        if stack.shape[1] != len(m):
            raise ValueError(f"chip has {stack.shape[1]} channels, expected {len(m)}")
        return _whole((stack - m) / s)

    return Fused(Step(run))


def _flip(op: str, axis: int, p: float, seed: int) -> Transform:
    def run(stack: np.ndarray, flip: np.ndarray) -> Groups:
        flip = flip.astype(bool)
        if flip.any():
            stack[flip] = np.flip(stack[flip], axis)
        return _whole(stack)

    return Fused(Step(run, {"flip": coin(F.col(ID), seed, op, p)}))


def hflip(p: float = 0.5, seed: int = 0) -> Transform:
    return _flip("hflip", 3, p, seed)


def vflip(p: float = 0.5, seed: int = 0) -> Transform:
    return _flip("vflip", 2, p, seed)


def rot90(seed: int = 0, turns: Column | None = None) -> Transform:
    """Turn each chip counter-clockwise by 0..3 quarters (or by ``turns``).

    A quarter turn swaps height and width: out (w, h), out[y, x] = in[x, w-1-y].
    """

    def run(stack: np.ndarray, k: np.ndarray) -> Groups:
        parts = [(np.flatnonzero(k % 4 == n), n) for n in range(4)]
        return [(rows, np.rot90(stack[rows], n, axes=(2, 3))) for rows, n in parts if len(rows)]

    return Fused(Step(run, {"k": turns if turns is not None else quarter_turns(F.col(ID), seed)}))


def spectral_jitter(brightness: float = 0.1, contrast: float = 0.1, seed: int = 0) -> Transform:
    """Scale and shift each channel by its own draw."""

    def run(stack: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> Groups:
        a, b = (as_uniform(draws(key, stack.shape[1]))[:, :, None, None] * 2.0 - 1.0 for key in (scale, shift))
        return _whole(stack * (a * contrast + 1.0) + b * brightness)

    return Fused(Step(run, {op: hash_int(F.col(ID), seed, op) for op in ("scale", "shift")}))


def gaussian_noise(std: float = 0.01, seed: int = 0) -> Transform:
    """Add independent normal noise. Two pixels share the two draws of a Box-Muller pair."""

    def run(stack: np.ndarray, noise: np.ndarray) -> Groups:
        flat = stack.reshape(len(stack), -1)
        if flat.base is None or not flat.flags.writeable:
            flat = flat.copy()
        hashed = draws(noise, (flat.shape[1] + 1) // 2)
        radius = np.sqrt(np.log(1.0 - as_uniform(hashed)) * -2.0) * float(std)
        angle = as_uniform(mix(hashed ^ np.uint32(SECOND_LANE))) * (2.0 * np.pi)
        flat[:, ::2] += radius * np.cos(angle)
        half = flat.shape[1] // 2
        flat[:, 1::2] += radius[:, :half] * np.sin(angle[:, :half])
        return _whole(flat.reshape(stack.shape))

    return Fused(Step(run, {"noise": hash_int(F.col(ID), seed, "noise")}))


def val_transforms(mean: Sequence[float], std: Sequence[float], scale: float = REFLECTANCE_SCALE) -> Transform:
    return compose(scale_reflectance(scale), normalize(mean, std))


def train_transforms(mean: Sequence[float], std: Sequence[float], seed: int = 0, scale: float = REFLECTANCE_SCALE) -> Transform:
    return compose(
        scale_reflectance(scale),
        normalize(mean, std),
        hflip(0.5, seed),
        vflip(0.5, seed),
        rot90(seed),
        spectral_jitter(0.1, 0.1, seed),
        gaussian_noise(0.01, seed),
    )
