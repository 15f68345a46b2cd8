"""Key frames: changes that are far enough apart, with a uniform sample where they are too few."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from evidloom.sources.stored import stored

# Least change, seconds between kept frames, samples a second, and the fallback's density.
CHANGE, GAP, RATE = 0.03, 10.0, 2
SECONDS_EACH, LEAST = 15, 5


def strided(frames: DataFrame, fps: float, rate: float = RATE) -> DataFrame:
    """Every ``fps / rate``-th frame by ``frame_no``; every frame where that is under one."""
    return frames.filter(F.col("frame_no") % max(1, int(fps / rate)) == 0)


def duration(total_frames: Column, fps: Column) -> Column:
    """Seconds of a video; zero where it has no frame rate."""
    return F.when(fps > 0, total_frames / fps).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Chains:
    """What the greedy scan does in a stretch of changes, whichever one it enters by.

    ``times`` are those of the stretch's first frame and of the changes behind it. ``runs`` stand for all places that
    the scan may enter by, but the first frame: (time of the last such place, last time kept, number kept).
    """

    first: tuple[float, int]
    runs: list[tuple[float, float, int]]


def later(times: np.ndarray, gap: float) -> np.ndarray:
    """For each time the place of the next one more than ``gap`` later; the length where there is none."""
    nxt = np.searchsorted(times, times + gap, side="right")
    n = len(times)
    while True:  # sums and differences may round apart by a step
        back = (nxt > 0) & (times[np.maximum(nxt - 1, 0)] - times > gap)
        on = (nxt < n) & ~(times[np.minimum(nxt, n - 1)] - times > gap)
        if not back.any() and not on.any():
            return nxt
        nxt = np.where(back, np.searchsorted(times, times[np.maximum(nxt - 1, 0)], side="left"), nxt)
        nxt = np.where(on, np.searchsorted(times, times[np.minimum(nxt, n - 1)], side="right"), nxt)


def chains(times: np.ndarray, gap: float) -> Chains:
    """By pointer doubling: each round doubles how far along its chain every place knows the last one and the count."""
    n = len(times)
    jump = np.append(later(times, gap), n)
    last, count = np.arange(n + 1), np.append(np.ones(n, np.int64), 0)
    while (jump[:n] < n).any():
        going = jump < n
        last, count = np.where(going, last[jump], last), count + np.where(going, count[jump], 0)
        jump = np.where(going, jump[jump], n)
    # The last kept time before is at most the first time here (or the one before all), so no later place is entered by.
    entered = np.flatnonzero(times - max(times[0], -gap) > gap)
    m = int(entered[0]) + 1 if len(entered) else n
    cut = np.flatnonzero((last[1 : m - 1] != last[2:m]) | (count[1 : m - 1] != count[2:m])) + 1
    ends = [*cut.tolist(), m - 1] if m > 1 else []
    return Chains((float(times[last[0]]), int(count[0])), [(float(times[i]), float(times[last[i]]), int(count[i])) for i in ends])


PIECES = "block int, asset {asset}, place bigint, ts double, frame_id {frame}, changed boolean, piece struct<frames:bigint,changes:bigint,end:double,before:double,signal:double,first_end:double,first_kept:bigint,runs:array<struct<hi:double,end:double,kept:bigint>>>"


def pieces(frames: DataFrame, change: float = CHANGE, gap: float = GAP) -> DataFrame:
    """Frames in order of asset and time, dealt out by ranges; written.

    An asset's frames in one range are a piece. Rows with ``piece`` null are frames, ``place`` counting from the
    piece's first (whose ``changed`` is null: its predecessor may be elsewhere). A row with ``piece`` ends each piece:
    how many frames and changes, its last time, its first and last signal, and what the greedy scan makes of it.
    Frames without a time are left out; a null signal is no change.
    """
    own = frames.select("asset", F.col("ts").cast("double").alias("ts"), "frame_id", F.col("signal").cast("double").alias("signal")).filter("ts is not null")
    schema = PIECES.format(asset=own.schema["asset"].dataType.simpleString(), frame=own.schema["frame_id"].dataType.simpleString())
    kinds = to_arrow_schema(own.limit(0).selectExpr("0 block", "asset", "0L place", "ts", "frame_id", "true changed").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        asset, begun, held = None, False, _Piece()
        for batch in batches:
            names, ts, signal = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            place, changed, ended = np.empty(len(names), np.int64), np.empty(len(names), bool), []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if begun and names[lo] != asset:
                    ended.append(held.row(block, asset, gap))
                    held = _Piece()
                asset, begun = names[lo], True
                place[lo:hi] = np.arange(held.frames, held.frames + hi - lo)
                changed[lo:hi] = held.add(ts[lo:hi], signal[lo:hi], change)
            n = len(names)
            columns = [pa.array([block] * n, pa.int32()), batch.column(0), pa.array(place), batch.column(1), batch.column(2), pa.array(changed, pa.bool_(), mask=place == 0), pa.nulls(n, schema_arrow.field("piece").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema_arrow)
            if ended:
                yield pa.RecordBatch.from_pylist(ended, schema=schema_arrow)
        if begun:
            yield pa.RecordBatch.from_pylist([held.row(block, asset, gap)], schema=schema_arrow)

    piece = pa.struct([("frames", pa.int64()), ("changes", pa.int64()), ("end", pa.float64()), ("before", pa.float64()), ("signal", pa.float64()), ("first_end", pa.float64()), ("first_kept", pa.int64()), ("runs", pa.list_(pa.struct([("hi", pa.float64()), ("end", pa.float64()), ("kept", pa.int64())])))])
    schema_arrow = pa.schema([*(pa.field(f.name, f.type) for f in kinds), pa.field("piece", piece)])
    ordered = own.repartitionByRange("asset", "ts", "frame_id").sortWithinPartitions("asset", "ts", "frame_id")
    return stored(ordered.mapInArrow(run, schema))


class _Piece:
    """One asset's frames in one range, as they pass: only the times of its changes are held."""

    def __init__(self) -> None:
        self.frames, self.times, self.signal, self.before, self.end = 0, [], np.nan, np.nan, np.nan

    def add(self, ts: np.ndarray, signal: np.ndarray, change: float) -> np.ndarray:
        signal = signal.astype(np.float64)
        changed = np.abs(np.diff(signal, prepend=self.signal)) > change
        changed[:1] &= self.frames > 0
        if not self.frames:
            self.before = float(signal[0])
            self.times.append(ts[:1])
        self.times.append(ts[changed])
        self.frames, self.signal, self.end = self.frames + len(ts), float(signal[-1]), float(ts[-1])
        return changed

    def row(self, block: int, asset: object, gap: float) -> dict:
        times = np.concatenate(self.times)
        found = chains(times, gap)
        piece = {"frames": self.frames, "changes": len(times) - 1, "end": self.end, "before": self.before, "signal": self.signal, "first_end": found.first[0], "first_kept": found.first[1], "runs": [{"hi": h, "end": e, "kept": k} for h, e, k in found.runs]}
        return {"block": block, "asset": asset, "ts": float(times[0]), "piece": piece}


def entered(found: DataFrame, change: float = CHANGE, gap: float = GAP, target: int | None = None) -> DataFrame:
    """(block, asset, last, first, before, offset, step, goal, few) of each piece: the state that the scan comes to it with.

    Pieces of an asset are gone through in order; a piece's own frames aren't read again, as its chains say where the
    scan leaves it. ``few`` says whether the asset has fewer kept frames than the uniform sample's ``goal``.
    """
    rows = found.filter("piece is not null").select("block", "asset", "ts", "piece.*").repartition("asset").sortWithinPartitions("asset", "block")
    asset_type = to_arrow_schema(rows.select("asset").schema).field(0).type
    out_schema = pa.schema([("block", pa.int32()), ("asset", asset_type), ("last", pa.float64()), ("first", pa.bool_()), ("before", pa.float64()), ("offset", pa.int64()), ("step", pa.int64()), ("goal", pa.int64()), ("few", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if held and row["asset"] != held[0]["asset"]:
                    out += _entries(held, change, gap, target)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=out_schema)
        if held:
            yield pa.RecordBatch.from_pylist(_entries(held, change, gap, target), schema=out_schema)

    return rows.mapInArrow(run, f"block int, asset {rows.schema['asset'].dataType.simpleString()}, last double, first boolean, before double, offset bigint, step bigint, goal bigint, few boolean")


def _entries(rows: list[dict], change: float, gap: float, target: int | None) -> list[dict]:
    """The state that the scan comes to each piece of one asset with, and the asset's sample."""
    last, before, offset, kept, out = -gap, np.nan, 0, 1, []
    for i, r in enumerate(rows):
        out.append({"block": r["block"], "asset": r["asset"], "last": last, "first": i == 0, "before": before, "offset": offset})
        taken = i > 0 and abs(r["before"] - before) > change and r["ts"] - last > gap
        run = next((x for x in r["runs"] if x["hi"] - last > gap), None)
        if taken:
            last, kept = r["first_end"], kept + r["first_kept"]
        elif run:
            last, kept = run["end"], kept + run["kept"]
        before, offset = r["signal"], offset + r["frames"]
    goal = target or max(math.floor(rows[-1]["end"] / SECONDS_EACH), LEAST)
    rest = {"step": max(offset // goal, 1), "goal": goal, "few": kept < goal}
    return [x | rest for x in out]


def _scanned(found: DataFrame, states: DataFrame, change: float, gap: float, sampled: bool) -> DataFrame:
    """Kept frames, block by block with the state that the scan comes with; and the uniform sample where ``sampled`` asks for it."""
    # The first frame's signal is the piece's ``before``.
    heads = found.filter("piece is not null").select("block", "asset", F.col("piece.before").alias("own"))
    told = states.join(heads.withColumnsRenamed({"block": "b", "asset": "a"}), F.col("block").eqNullSafe(F.col("b")) & F.col("asset").eqNullSafe(F.col("a"))).drop("a", "b")
    frames = found.filter("piece is null").select("block", "asset", "place", "ts", "frame_id", "changed")
    if not sampled:
        frames = frames.filter("changed or place = 0")
    kind = frames.select("asset", "ts", "frame_id").schema

    def run(key, frames: pa.Table, states: pa.Table) -> pa.Table:
        at = {s["asset"]: s for s in states.to_pylist()}
        frames = frames.take(np.lexsort((frames.column("place").to_numpy(), pc.rank(frames.column("asset"), tiebreaker="dense").to_numpy())))
        names, place, ts = frames.column("asset").to_pylist(), frames.column("place").to_numpy(), frames.column("ts").to_numpy()
        changed = frames.column("changed").to_numpy(zero_copy_only=False)
        keep = np.zeros(len(names), bool)
        last = state = None
        for i, (name, p, t, c) in enumerate(zip(names, place.tolist(), ts.tolist(), changed.tolist(), strict=True)):
            if p == 0:
                state = at[name]
                last = state["last"]
                c = not state["first"] and abs(state["own"] - state["before"]) > change
                keep[i] = state["first"]
            if c and t - last > gap:
                last, keep[i] = t, True
            if sampled and state["few"] and (p + state["offset"]) % state["step"] == 0 and p + state["offset"] < state["step"] * state["goal"]:
                keep[i] = True
        return frames.filter(pa.array(keep)).select(["asset", "ts", "frame_id"])

    return frames.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, kind)


def greedy_throttle(frames: DataFrame, change: float = CHANGE, gap: float = GAP) -> DataFrame:
    """(asset, ts, frame_id) of kept frames: an asset's first, and changes more than ``gap`` after the last kept change.

    A change is a difference of more than ``change`` to the frame before. The first frame doesn't count as a kept
    change; before all there is one at ``-gap``. Ties in time go by frame_id. Frames without a time are left out, a
    null signal is no change, a null asset is an asset. However many frames an asset has, no task gets more of them
    than a range holds: ranges are scanned side by side, each with the state that the ones before it lead to.
    """
    found = pieces(frames, change, gap)
    return _scanned(found, entered(found, change, gap), change, gap, sampled=False)


def uniform(frames: DataFrame, target: int | None = None) -> DataFrame:
    """A uniform sample of each asset: at most ``target`` frames, or one for each 15 seconds and five at least.

    Frames are counted range by range, so an asset of any length is many tasks' work.
    """
    found = pieces(frames.withColumn("signal", F.lit(0.0)))
    states = entered(found, target=target).select(F.col("block").alias("b"), F.col("asset").alias("a"), "offset", "step", "goal")
    placed = found.filter("piece is null").join(states, (F.col("block") == F.col("b")) & F.col("asset").eqNullSafe(F.col("a"))).withColumn("place", F.col("place") + F.col("offset"))
    return placed.filter((F.col("place") % F.col("step") == 0) & (F.col("place") < F.col("step") * F.col("goal"))).select("asset", "ts", "frame_id", "goal")


def key_frames(frames: DataFrame, change: float = CHANGE, gap: float = GAP) -> DataFrame:
    """Kept changes, and the uniform sample besides for assets that have too few of them; in one pass over the ranges."""
    found = pieces(frames, change, gap)
    return _scanned(found, entered(found, change, gap), change, gap, sampled=True)
