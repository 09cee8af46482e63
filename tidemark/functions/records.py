"""Records as they are stored: canonical hashes, known and other extras, normalised candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(values: Column) -> Column:
    """A map of key to JSON text as one object, keys sorted, with a space after colon and comma; null values are null."""
    quoted = lambda k: F.concat(F.lit('"'), k, F.lit('": '))
    parts = F.transform(F.array_sort(F.map_keys(values)), lambda k: F.concat(quoted(k), F.coalesce(F.element_at(values, k), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def config_hash(values: Column, digits: int = 16) -> Column:
    """The first hexadecimal digits of the SHA-256 of a configuration; one that is empty or null hashes as the word empty_config."""
    text = F.when(F.coalesce(F.size(values), F.lit(0)) > 0, canonical_json(values)).otherwise("empty_config")
    return F.substring(F.sha2(text, 256), 1, digits)


#: Extras that have columns of their own.
KNOWN = ("delta", "buy_ratio", "n_trades", "rel_vol", "stage_pct", "market_regime", "operator_window", "operator_sleep", "local_hour", "utc_hour", "confirm_ratio", "confirm_window_s")


def extras_split(extras: Column, known: dict[str, str], most_bytes: int = 8192) -> tuple[dict[str, Column], Column]:
    """(columns, rest) of a JSON object: the values of ``known`` (name to type), and all other keys as JSON.

    Values that do not fit their type are null, and so are numbers that are not finite. The rest has its leading keys as long as it
    stays within ``most_bytes``; it is null without any. Text that reads as a number, true, false or null is written as such.
    """
    m = F.from_json(extras, "map<string,string>")
    value = lambda k: F.element_at(m, F.lit(k))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    typed = {k: finite(value(k).try_cast("double")) if t == "double" else value(k).try_cast("double").try_cast(t) if t in ("int", "long") else value(k).try_cast(t) for k, t in known.items()}

    def text(v: Column) -> Column:
        plain = v.rlike(r"^(-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null)$")
        lost = v.isin("NaN", "Infinity", "-Infinity") | v.isNull()
        return F.when(lost, "null").when(plain, v).otherwise(F.concat(F.lit('"'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('"')))

    others = F.filter(F.map_entries(m), lambda e: ~e["key"].isin(*known))
    parts = F.transform(others, lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), text(e["value"])))
    begin = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def take(s: Column, p: Column) -> Column:
        longer = F.when(s["text"] == "", p).otherwise(F.concat(s["text"], F.lit(", "), p))
        fits = ~s["full"] & (F.octet_length(longer) + 2 <= most_bytes)
        return F.struct(F.when(fits, longer).otherwise(s["text"]).alias("text"), (~fits).alias("full"))

    held = F.aggregate(parts, begin, take)["text"]
    return typed, F.when(held != "", F.concat(F.lit("{"), held, F.lit("}")))


#: What an entry gate and an operator's window may say.
GATES, WINDOWS = ("passed", "rejected"), ("awake", "sleep")


def normalized_candidate(symbol: Column, version: Column, config: Column, decision: Column, window: Column, latency_ms: Column) -> tuple[Column, Column, Column, Column]:
    """(why a candidate is not stored, its gate decision, its operator window, its latency): without symbol, version or
    configuration it is not stored; other decisions are unknown, other windows null; a latency is not negative, and zero if it is no number."""
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    dropped = F.when(blank(symbol), "symbol").when(blank(version), "detector_version").when(config.isNull(), "config")
    odd = F.isnan(latency_ms) | (F.abs(latency_ms) == float("inf"))
    latency = F.when(odd, 0.0).otherwise(F.greatest(F.lit(0.0), latency_ms))
    return dropped, F.when(decision.isin(*GATES), decision).otherwise("unknown"), F.when(window.isin(*WINDOWS), window), latency
