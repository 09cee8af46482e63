"""Rules over bars: parameters by time frame, pump, dump, breakout and cross, and the scan of all of them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .windows import with_ema

#: Thresholds of each rule.
BASE = {
    "pump": {"delta_pct": 1.4, "vol_mult": 2.6, "min_notional": 80_000.0},
    "dump": {"delta_pct": -1.4, "vol_mult": 2.6, "min_notional": 80_000.0},
    "bo_up": {"buffer_pct": 0.20, "vol_mult": 2.2, "ema_confirm": 1.0, "min_notional": 120_000.0},
    "bo_dn": {"buffer_pct": 0.20, "vol_mult": 2.2, "ema_confirm": 1.0, "min_notional": 120_000.0},
    "cross": {"vol_mult": 2.0, "min_notional": 100_000.0},
    "early": {"delta_pct": 2.5, "vol_mult": 1.8, "min_notional": 50_000.0, "buffer_pct": 0.20, "ema_confirm": 1.0},
}
#: What a time frame changes in them, key by key; ``frame`` holds its late filter and whether early rules run.
FRAMES = {
    "15m": {
        "frame": {"early_enabled": 1.0},
        "pump": {"delta_pct": 1.4, "vol_mult": 2.6, "min_notional": 80_000.0},
        "dump": {"delta_pct": -1.4, "vol_mult": 2.6, "min_notional": 80_000.0},
        "bo_up": {"vol_mult": 2.2, "min_notional": 120_000.0},
        "bo_dn": {"vol_mult": 2.2, "min_notional": 120_000.0},
        "cross": {"vol_mult": 2.0, "min_notional": 100_000.0},
    },
    "30m": {
        "frame": {"early_enabled": 1.0},
        "pump": {"delta_pct": 2.2, "vol_mult": 2.2, "min_notional": 120_000.0},
        "dump": {"delta_pct": -2.2, "vol_mult": 2.2, "min_notional": 120_000.0},
        "bo_up": {"vol_mult": 2.0, "min_notional": 150_000.0},
        "bo_dn": {"vol_mult": 2.0, "min_notional": 150_000.0},
        "cross": {"vol_mult": 1.8, "min_notional": 150_000.0},
    },
    "1h": {
        "frame": {"early_enabled": 0.0, "late_filter_pct": 5.0},
        "pump": {"delta_pct": 3.2, "vol_mult": 2.0, "min_notional": 150_000.0},
        "dump": {"delta_pct": -3.2, "vol_mult": 2.0, "min_notional": 150_000.0},
        "bo_up": {"vol_mult": 1.8, "min_notional": 200_000.0},
        "bo_dn": {"vol_mult": 1.8, "min_notional": 200_000.0},
    },
}


@dataclass(frozen=True)
class RuleParams:
    """Lengths in bars, thresholds by rule, and what time frames change in them."""

    ema: int = 20
    fast: int = 9
    slow: int = 20
    lookback: int = 32
    volumes: int = 20
    base: dict = field(default_factory=lambda: BASE)
    frames: dict = field(default_factory=lambda: FRAMES)

    def with_notional(self, factor: float) -> RuleParams:
        """The same rules with all floors of notional times ``factor``."""

        def scaled(rules: dict) -> dict:
            return {r: {k: v * factor if k == "min_notional" else v for k, v in p.items()} for r, p in rules.items()}

        return replace(self, base=scaled(self.base), frames={f: scaled(r) for f, r in self.frames.items()})


def _as_map(rules: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(f"{r}.{k}"), F.lit(float(v))) for r, p in rules.items() for k, v in p.items())).cast("map<string,double>")


def params_overlay(spark: SparkSession, p: RuleParams = RuleParams()) -> DataFrame:  # noqa: B008
    """(timeframe, params): a row for each time frame, with the thresholds of all rules, each replaced where the time frame has its own."""
    rows = spark.createDataFrame([(f,) for f in p.frames], "timeframe string")
    own = F.lit(None).cast("map<string,double>")
    for name, rules in p.frames.items():
        own = F.when(F.col("timeframe") == name, _as_map(rules)).otherwise(own)
    return rows.select("timeframe", F.map_zip_with(_as_map(p.base), own, lambda k, x, y: F.coalesce(y, x)).alias("params"))


def bar_notional(bars: DataFrame, late_pct: Column | None = None) -> DataFrame:
    """``bars`` with ``notional`` and the move ``pct`` from open to close, zero for an open of zero; bars that have moved ``late_pct`` or more are left out."""
    pct = F.when(F.col("o") != 0, (F.col("c") - F.col("o")) / F.col("o") * 100).otherwise(0.0)
    told = bars.withColumns({"notional": F.col("v") * (F.col("h") + F.col("l") + F.col("c")) / 3, "pct": pct})
    return told if late_pct is None else told.filter(F.coalesce(F.abs("pct") < late_pct, F.lit(True)))


def _facts(bars: DataFrame, p: RuleParams, by: tuple[str, ...]) -> DataFrame:
    """``bars`` with averages, the extremes of the bars before, and the median of the last volumes, zero counting as one."""
    o = Window.partitionBy(*by).orderBy("open_us")
    prior, median = o.rowsBetween(-p.lookback, -1), F.percentile(F.col("v"), 0.5).over(o.rowsBetween(1 - p.volumes, 0))
    spans = tuple(dict.fromkeys((p.ema, p.fast, p.slow)))
    told = with_ema(bars, "c", spans, "open_us", "open_us", by=by)
    gap = F.col(f"ema{p.fast}") - F.col(f"ema{p.slow}")
    told = told.withColumns({"hi": F.max("h").over(prior), "lo": F.min("l").over(prior), "nth": F.row_number().over(o), "med": F.when(median == 0, 1.0).otherwise(median), "gap": gap})
    return told.withColumn("before", F.lag("gap").over(o))


def _extras(**values: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(n) for n, v in values.items())))


def rule_scan(bars: DataFrame, params: DataFrame, p: RuleParams = RuleParams(), *, last_only: bool = False) -> DataFrame:  # noqa: B008
    """(timeframe, symbol, open_us, rule, price, notional, extras): a row for each rule that a bar fires.

    ``bars`` is (timeframe, symbol, open_us, o, h, l, c, v), ``params`` comes from ``params_overlay``; bars of a time frame
    that it lacks fire nothing. A series' first ``lookback`` + 4 bars say nothing, and neither does a bar that has moved as
    far as its frame's late filter. Early rules run in frames that enable them. Bars with a null volume fire nothing. Averages
    start at a series' first bar, however long ago. A rule's cooldown is ``cooldown_filter`` over the result.
    """
    told = _facts(bars, p, ("timeframe", "symbol")).filter(F.col("nth") >= p.lookback + 5)
    if last_only:
        told = told.withColumn("_last", F.max("open_us").over(Window.partitionBy("timeframe", "symbol"))).filter("open_us = _last").drop("_last")
    told = bar_notional(told.join(params, "timeframe"), F.element_at("params", F.lit("frame.late_filter_pct")))

    def at(rule: str, name: str) -> Column:
        return F.element_at("params", F.lit(f"{rule}.{name}"))

    c, ema = F.col("c"), F.col(f"ema{p.ema}")
    enough = lambda rule: (F.col("v") >= at(rule, "vol_mult") * F.col("med")) & (F.col("notional") >= at(rule, "min_notional"))
    above = lambda rule: (c > F.col("hi") * (1 + at(rule, "buffer_pct") / 100)) & ((at(rule, "ema_confirm") == 0) | (c > ema))
    below = (c < F.col("lo") * (1 - at("bo_dn", "buffer_pct") / 100)) & ((at("bo_dn", "ema_confirm") == 0) | (c < ema))
    early = at("frame", "early_enabled") != 0
    pct, hi, lo, e = F.round("pct", 3), F.round("hi", 4), F.round("lo", 4), F.round(ema, 4)
    crossed = _extras(ema_fast=F.round(f"ema{p.fast}", 4), ema_slow=F.round(f"ema{p.slow}", 4))
    fired = {
        "pump": ((F.col("pct") >= at("pump", "delta_pct")) & enough("pump"), _extras(delta_pct=pct)),
        "dump": ((F.col("pct") <= at("dump", "delta_pct")) & enough("dump"), _extras(delta_pct=pct)),
        "bo_up": (above("bo_up") & enough("bo_up"), _extras(range_hi=hi, ema=e)),
        "bo_dn": (below & enough("bo_dn"), _extras(range_lo=lo, ema=e)),
        "cross_up": ((F.col("before") <= 0) & (F.col("gap") > 0) & enough("cross"), crossed),
        "cross_dn": ((F.col("before") >= 0) & (F.col("gap") < 0) & enough("cross"), crossed),
        "pump_early": (early & (F.col("pct") >= at("early", "delta_pct")) & enough("early"), _extras(delta_pct=pct, early=F.lit(True))),
        "bo_up_early": (early & above("early") & enough("early"), _extras(range_hi=hi, ema=e, early=F.lit(True))),
    }
    rules = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(name).alias("rule"), extras.alias("extras"))) for name, (when, extras) in fired.items())))
    return told.withColumn("r", F.explode(rules)).select("timeframe", "symbol", "open_us", "r.rule", c.alias("price"), "notional", "r.extras")


def _alone(bars: DataFrame, rules: dict[str, dict], p: RuleParams) -> DataFrame:
    """The scan of one time frame with the given rules only; a rule that is not given asks for more volume than any."""
    never = {r: {"vol_mult": float("inf"), "min_notional": 0.0, "delta_pct": 0.0, "buffer_pct": 0.0, "ema_confirm": 0.0} for r in BASE}
    own = replace(p, base=never | rules, frames={"all": {"frame": {"early_enabled": 0.0}}})
    return rule_scan(bars.withColumn("timeframe", F.lit("all")), params_overlay(bars.sparkSession, own), own).drop("timeframe")


def rule_pump_dump(bars: DataFrame, pump: dict, dump: dict, p: RuleParams = RuleParams()) -> DataFrame:  # noqa: B008
    """(symbol, open_us, pct, rule, notional) of the bars that say pump or dump, each by thresholds of its own (delta_pct, vol_mult, min_notional)."""
    found = _alone(bars, {"pump": pump, "dump": dump}, p)
    return found.select("symbol", "open_us", F.get_json_object("extras", "$.delta_pct").cast("double").alias("pct"), "rule", "notional")


def rule_breakout(bars: DataFrame, up: dict, down: dict, p: RuleParams = RuleParams()) -> DataFrame:  # noqa: B008
    """(symbol, open_us, rule, level, ema) of the bars that close beyond the extremes of the bars before (buffer_pct, vol_mult, ema_confirm, min_notional)."""
    found = _alone(bars, {"bo_up": up, "bo_dn": down}, p)
    level = F.coalesce(F.get_json_object("extras", "$.range_hi"), F.get_json_object("extras", "$.range_lo")).cast("double")
    return found.select("symbol", "open_us", "rule", level.alias("level"), F.get_json_object("extras", "$.ema").cast("double").alias("ema"))


def rule_ema_cross(bars: DataFrame, cross: dict, p: RuleParams = RuleParams()) -> DataFrame:  # noqa: B008
    """(symbol, open_us, rule, ema_fast, ema_slow) of the bars at which the fast average passes the slow one (vol_mult, min_notional)."""
    found = _alone(bars, {"cross": cross}, p)
    return found.select("symbol", "open_us", "rule", *(F.get_json_object("extras", f"$.{n}").cast("double").alias(n) for n in ("ema_fast", "ema_slow")))


def alert_format(prefix: str, rule: Column, symbol: Column, timeframe: Column, price: Column, extras: Column) -> Column:
    """One line: prefix, rule, symbol, time frame, price with six significant digits, and the extras as JSON."""
    return F.format_string(f"[{prefix}] %s | %s %s @ %s | %s", F.upper(rule), symbol, timeframe, general(price), extras)


def general(x: Column, digits: int = 6) -> Column:
    """A number with ``digits`` significant digits as %g writes it: without trailing zeros, and with an exponent if that is below -4 or not below ``digits``."""
    sci = F.format_string(f"%.{digits - 1}e", x)
    power = F.regexp_extract(sci, "e([+-][0-9]+)$", 1).cast("int")
    short = lambda s: F.when(F.contains(s, F.lit(".")), F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", "")).otherwise(s)
    held = F.transform(F.array(F.struct(x.alias("x"), power.alias("p"))), lambda s: F.coalesce(*[F.when(s["p"] == i, short(F.format_string(f"%.{digits - 1 - i}f", s["x"]))) for i in range(-4, digits)]))
    return F.coalesce(held[0], F.concat(short(F.regexp_extract(sci, "^(.*)e", 1)), F.regexp_extract(sci, "(e[+-][0-9]+)$", 1)))
