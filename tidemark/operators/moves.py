"""Price moves per symbol: noise, the state machine of a move, and the detection built on it.

What depends on all rows before runs over the sorted rows of a symbol one by one with a state of fixed size, so a
symbol's rows pass through a task in batches and are never gathered.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Decay of the noise, and its floor as a part of the price.
DECAY, FLOOR = 0.10, 0.0001


def in_order(rows: DataFrame, key: str, order: list[str], begin: Callable[[Any], Any], step: Callable[[Any, Any], tuple | None], schema: str) -> DataFrame:
    """``step(state, row)`` for the rows of each key in order, from ``begin`` of the key's first row on; what it returns, unless None, is a row of the result."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                if state is None or k != at:
                    at, state = k, begin(row)
                made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def noise_seed(ticks: DataFrame, now_us: int, width_us: int, least: int = 15) -> DataFrame:
    """(symbol, n, seed, seed_price, seed_us), the last two being the last tick's, from the moves other than zero in the window up to ``now_us``: their decayed mean from ``least`` of them on, else their median; never below the floor at the last price.

    The decayed mean is a sum of weights that fall with the rank from the end, so it needs no array of the moves.
    """
    o = Window.partitionBy("symbol").orderBy("us", "tick_id")
    recent = ticks.filter(F.col("us").between(now_us - width_us, now_us)).withColumn("move", F.abs(F.col("price") - F.lag("price").over(o)))
    last = recent.groupBy("symbol").agg(F.max_by("price", F.struct("us", "tick_id")).alias("price"), F.max("us").alias("seed_us"))
    moves = recent.filter("move > 0").withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("us"), F.desc("tick_id"))) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    weight = F.pow(F.lit(1 - DECAY), F.col("back")) * F.when(F.col("back") == F.col("n") - 1, 1.0).otherwise(DECAY)
    seeds = moves.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("move") * weight).alias("decayed"), F.median("move").alias("middle"))
    floor = F.col("price") * FLOOR
    seed = F.when(F.col("n") >= least, F.col("decayed")).otherwise(F.col("middle"))
    return last.join(seeds, "symbol", "left").select("symbol", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.greatest(F.coalesce(seed, floor), floor).alias("seed"), F.col("price").alias("seed_price"), "seed_us")


@dataclass(frozen=True)
class MoveRules:
    """Multiples of noise that declare a move and that end it on a retrace or for want of progress; ``jump_pct`` triggers."""

    declare: float = 2.5
    retrace: float = 1.5
    progress: float = 0.5
    idle_ticks: int = 4
    slack: float = 1.0
    alarm: float = 2.0
    jump_pct: float = 2.0


@dataclass
class Move:
    state: str = "idle"
    noise: float = 0.0
    last: float | None = None
    low: float = 0.0
    low_us: int = 0
    start: float = 0.0
    start_us: int = 0
    noise_at_start: float = 0.0
    peak: float = 0.0
    stalled: int = 0
    cusum: float = 0.0
    trigger_us: int | None = None
    trigger_price: float = 0.0
    build_us: int | None = None

    def rest(self, price: float, us: int) -> None:
        """Back to idle; only the noise and the last price are kept, and a price of zero sets no new low."""
        low, low_us = (price, us) if price > 0 else (self.low, self.low_us)
        self.__init__(noise=self.noise, last=self.last, low=low, low_us=low_us)

    def tick(self, price: float, us: int, r: MoveRules) -> str | None:
        """Takes a price in; returns why a move ended, if one did. A triggered move only follows the noise."""
        if self.last is None:
            self.noise, self.low, self.low_us = price * FLOOR, price, us
        self.noise += DECAY * (abs(price - (self.last or price)) - self.noise)
        self.last = price
        if self.state == "idle":
            if price <= self.low or self.low == 0:
                self.low, self.low_us = price, us
            if 0 < r.declare * self.noise < price - self.low:
                self.state, self.start, self.start_us = "building", self.low, self.low_us
                self.noise_at_start, self.peak, self.stalled, self.cusum = self.noise, price, 0, 0.0
        elif self.state == "building":
            self.peak = max(self.peak, price)
            self.cusum = max(0.0, self.cusum + (price - self.start) / max(self.noise, 1e-12) - r.slack)
            if 0 < r.retrace * self.noise < self.peak - price:
                self.rest(price, us)
                return "retrace"
            # the peak already holds this price, so progress beyond it cannot show: moves stall after idle_ticks
            self.stalled = 0 if price > self.peak + r.progress * self.noise > self.peak else self.stalled + 1
            if self.stalled >= r.idle_ticks:
                self.rest(price, us)
                return "lateral"
        return None


STATES = "tick_id long, symbol string, us long, state string, noise double, start_price double, peak double, cusum double, cusum_pass boolean, build_us long, confirm_us long, trigger_price double, ended string"


class Tick(NamedTuple):
    tick_id: int
    symbol: str
    us: int
    price: float


def _step(m: Move, row, rules: MoveRules) -> tuple:
    before, price, us = m.last, row.price, row.us
    ended, confirm = m.tick(price, us, rules), None
    if before and (price - before) / before * 100 >= rules.jump_pct:
        if m.trigger_us is None:
            m.build_us = us - m.start_us if m.state == "building" else None
            m.state, m.trigger_us, m.trigger_price = "triggered", us, price
        else:
            confirm = us - m.trigger_us
    out = (row.tick_id, row.symbol, us, "confirming" if confirm is not None else m.state, m.noise, m.start or None, m.peak or None, m.cusum, m.cusum >= rules.alarm, m.build_us, confirm, m.trigger_price or None, ended)
    if confirm is not None:
        m.rest(price, us)
        out = (*out[:-1], "done")
    return out


#: What a seed brings to a symbol's first row.
SEED = ("seed", "seed_price", "seed_us")


def with_seeds(ticks: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """``ticks`` with the seed of their symbol, nulls without one. ``seeds`` has one row for each symbol."""
    if seeds is None:
        return ticks.withColumns({"seed": F.lit(None).cast("double"), "seed_price": F.lit(None).cast("double"), "seed_us": F.lit(None).cast("long")})
    return ticks.join(seeds.select("symbol", *SEED), "symbol", "left")


def seeded(row) -> Move:
    """The move that a symbol begins with: at rest at the seed's price with its noise, which is never below the floor; without a seed one that its first price sets."""
    if row.seed_price is None or row.seed_price != row.seed_price:
        return Move()
    floor = row.seed_price * FLOOR
    noise = max(row.seed, floor) if row.seed is not None and row.seed > 0 else floor
    return Move(noise=noise, last=row.seed_price, low=row.seed_price, low_us=int(row.seed_us))


def move_states(ticks: DataFrame, rules: MoveRules = MoveRules(), seeds: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Each tick (tick_id, symbol, us, price) with the state after it, the move it belongs to, and why a move ended at it.

    A rise of ``jump_pct`` from the tick before triggers: a building move has then taken ``build_us``, one that was never
    declared none (null). The next such rise confirms it and ends it as ``done``. Ticks without a price are left out. ``seeds`` (symbol, seed,
    seed_price, seed_us), as ``noise_seed`` makes them from ticks before these, set what a symbol begins with.
    """
    priced = ticks.filter("price is not null and not isnan(price)").select("tick_id", "symbol", "us", "price")
    return in_order(with_seeds(priced, seeds), "symbol", ["us", "tick_id"], seeded, lambda m, row: _step(m, row, rules), STATES)


def states_after(rows: DataFrame, moves: DataFrame, rules: MoveRules) -> DataFrame:
    """``move_states`` of ``rows`` (tick_id, symbol, us, price) that go on from ``moves`` (symbol, move), with a column ``move``: it is null but for one further row of each symbol, which has the move after its last tick and is no tick. Numbers of the further row are zero, for a null would make a batch's ids inexact."""
    names = [*(f.split()[0] for f in STATES.split(", ")), "move"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, m = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if m is None or row.symbol != at:
                    if m is not None:
                        out.append((0, at, 0, *[None] * (len(names) - 4), json.dumps(asdict(m))))
                    at, m = row.symbol, Move(**json.loads(row.move)) if isinstance(row.move, str) else Move()
                out.append((*_step(m, row, rules), None))
            yield pd.DataFrame(out, columns=names)
        if m is not None:
            yield pd.DataFrame([(0, at, 0, *[None] * (len(names) - 4), json.dumps(asdict(m)))], columns=names)

    known = F.broadcast(moves.withColumnRenamed("symbol", "_symbol"))
    return rows.join(known, F.col("symbol").eqNullSafe(F.col("_symbol")), "left").drop("_symbol").repartition("symbol").sortWithinPartitions("symbol", "us", "tick_id").mapInPandas(run, f"{STATES}, move string")


def stream_move_states(ticks: DataFrame, late: str, rules: MoveRules = MoveRules()) -> DataFrame:  # noqa: B008
    """``move_states`` of a stream (tick_id, symbol, ts, us, price), whatever the batches that ticks come in.

    A symbol's ticks wait in its state until the watermark, ``late`` behind the newest tick, has passed them, and are then taken in order of
    (us, tick_id), in the batch that moved it or by a timer; so the state is a move and the ticks of that time. A tick that comes later still is dropped,
    as the watermark drops it; ticks that the watermark has not passed when the stream ends are not in the result. For batches that
    a task cannot hold, ``run_move_states`` keeps the waiting ticks as a table.
    """
    names = [f.split()[0] for f in STATES.split(", ")]
    columns = ["us", "tick_id", "price"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        m, held = (Move(**json.loads(state.get[0])), json.loads(state.get[1])) if state.exists else (Move(), [])
        for f in frames:
            held += f[columns].to_numpy(object).tolist()
        held.sort(key=lambda t: (t[0], t[1]))
        passed = state.getCurrentWatermarkMs()
        n = next((i for i, t in enumerate(held) if t[0] >= passed * 1000), len(held))
        out = [_step(m, Tick(i, key[0], us, price), rules) for us, i, price in held[:n]]
        held = held[n:]
        state.update((json.dumps(asdict(m)), json.dumps(held)))
        if held:
            state.setTimeoutTimestamp(max(held[0][0] // 1000, passed) + 1)
        yield pd.DataFrame(out, columns=names)

    priced = ticks.filter("price is not null and not isnan(price)").select("tick_id", "symbol", "ts", "us", "price").withWatermark("ts", late)
    return priced.groupBy("symbol").applyInPandasWithState(run, STATES, "move string, held string", "append", "EventTimeTimeout")
