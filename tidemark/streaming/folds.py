"""States that advance one row at a time per key, in the rows' order, over any micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark import config as C
from tidemark.functions.validity import japan_date

Step = Callable[[tuple, Row], tuple[tuple, tuple | None]]


class Fold(StatefulProcessor):
    """Value state of a key: the place (at, seq) of the newest row taken, and what the step carries.

    A batch's rows of a key are taken in order of (at, seq). A row at or behind the place already
    reached can no longer be folded in: it comes out flagged late and changes nothing. The
    state goes after `ttl_ms` without use; the key then starts anew. With a time to live Spark
    keeps running batches without data, so an availableNow run ends only where
    spark.sql.streaming.noDataMicroBatches.enabled is false.
    """

    def __init__(self, step: Step, start: tuple, carried: str, names: list[str], ttl_ms: int | None):
        self.step, self.start, self.ttl = step, start, ttl_ms
        self.layout, self.names = f"at long, seq long, {carried}", names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", self.layout, self.ttl)
        self.row, self.blank = Row(*self.names), (None,) * (len(self.names) - 4)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        held = self.head.get() if self.head.exists() else None
        place, carried = (tuple(held[:2]), tuple(held[2:])) if held else (None, self.start)
        moved = False
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            if place is not None and (r.at, r.seq) <= place:
                yield self.row(*key, r.at, r.seq, True, *self.blank)
                continue
            place, moved = (r.at, r.seq), True
            carried, out = self.step(carried, r)
            if out is not None:
                yield self.row(*key, r.at, r.seq, False, *out)
        if moved:
            self.head.update((*place, *carried))

    def close(self) -> None:
        pass


def fold(rows: DataFrame, key: str, step: Step, start: tuple, carried: str, output: str, ttl_ms: int | None) -> DataFrame:
    """`step` over rows (key, at, seq, ...) per key. Rows without key, at or seq are left out. Needs the RocksDB state store."""
    kind = dict(rows.dtypes)[key]
    names = [key, "at", "seq", "late", *(c.split()[0] for c in output.split(","))]
    return rows.where(F.col(key).isNotNull() & F.col("at").isNotNull() & F.col("seq").isNotNull()).groupBy(key).transformWithState(
        Fold(step, start, carried, names, ttl_ms), f"{key} {kind}, at long, seq long, late boolean, {output}", "Append", "ProcessingTime" if ttl_ms else "None"
    )


def _days(col: str) -> list:
    return [F.unix_date(F.col(col)).cast("long").alias("at"), F.lit(0).cast("long").alias("seq")]


def _day(name: str):
    return F.date_from_unix_date(F.col("at").cast("int")).alias(name)


def _velocity(confirm: int) -> Step:
    def step(carried: tuple, r: Row) -> tuple[tuple, tuple]:
        state, candidate, days = carried
        raw, sure = r.raw_state, False
        if raw is None:
            state, candidate, days = None, None, 0
        elif state is None:
            state, candidate, days = raw, raw, 1
        elif raw == state:
            candidate, days, sure = raw, 0, True
        else:
            days = days + 1 if candidate == raw else 1
            candidate, sure = raw, days >= confirm
            if sure:
                state, days = raw, 0
        return (state, candidate, days), (raw, state, candidate, days, sure)

    return step


def stream_velocity(raw: DataFrame, confirm: int = C.VELOCITY["confirm"], ttl_ms: int | None = None) -> DataFrame:
    """Confirmed velocity state per theme, one step per day as the days arrive.

    raw: theme_id, as_of (date, one row a theme and day), raw_state (null: no reading, which
    resets). A day behind one already taken comes out with late = true and no state.
    """
    out = fold(
        raw.select("theme_id", *_days("as_of"), "raw_state"), "theme_id", _velocity(confirm), (None, None, 0), "state string, candidate string, days long",
        "raw_state string, state string, candidate string, candidate_days long, confirmed boolean", ttl_ms,
    )
    return out.select("theme_id", _day("as_of"), "raw_state", "state", "candidate", F.col("candidate_days").cast("int").alias("candidate_days"), "confirmed", "late")


def _regime(rungs: dict, stress_days: int) -> Step:
    sb, b, e, se = (rungs[k] for k in ("strong_bull", "bull", "bear", "strong_bear"))

    def step(carried: tuple, r: Row) -> tuple[tuple, tuple]:
        on_sb, on_b, on_e, on_se, prev, state, days, quiet = carried
        t = r.trend
        if t is not None:
            twice = prev is not None
            on_sb = (twice and min(t, prev) >= sb[0]) or (on_sb and t >= sb[1])
            on_b = (twice and min(t, prev) >= b[0]) or (on_b and t >= b[1])
            on_e = (twice and max(t, prev) <= e[0]) or (on_e and t <= e[1])
            on_se = (twice and max(t, prev) <= se[0]) or (on_se and t <= se[1])
        now = "Strong Bull" if on_sb else "Bull" if on_b else "Strong Bear" if on_se else "Bear" if on_e else "Neutral"
        days = days + 1 if now == state else 1
        quiet = 0 if r.stress_hit else min(quiet + 1, stress_days)
        return (on_sb, on_b, on_e, on_se, t, now, days, quiet), (now, days, quiet < stress_days)

    return step


def stream_regime(scores: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Hysteresis state, its duration and the stress flag per market, one step per session.

    scores: market_id, session (date, one row a market and session), trend (null or not a number: no
    reading, the rungs stay), stress_hit (null: no hit). A session behind one already taken comes
    out with late = true and no state.
    """
    trend = F.when(~F.isnan("trend"), F.col("trend")).alias("trend")
    out = fold(
        scores.select("market_id", *_days("session"), trend, "stress_hit"), "market_id", _regime(C.REGIME_RUNGS, C.STRESS["clear_days"]),
        (False, False, False, False, None, None, 0, C.STRESS["clear_days"]), "sb boolean, b boolean, e boolean, se boolean, prev double, state string, days long, quiet long",
        "state string, state_days long, stress_active boolean", ttl_ms,
    )
    return out.select("market_id", _day("session"), "state", F.col("state_days").cast("int").alias("state_days"), "stress_active", "late")


def _usage(carried: tuple, r: Row) -> tuple[tuple, tuple | None]:
    now = (r.fingerprint, r.usage_day)
    return now, None if now == carried else (r.fingerprint,)


def stream_usage_changes(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Events that differ from the user's previous one or open a new Japan day.

    events: event_id, user_id, ts, fingerprint (null is a value). Only the last fingerprint, its day
    and place are held per user; the trigger's batch limit bounds what one user brings at once. An
    event behind one already taken comes out with late = true, since it can't be compared any more.
    """
    rows = events.select(
        "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("seq"), "fingerprint", F.unix_date(japan_date(F.col("ts"))).cast("long").alias("usage_day")
    )
    out = fold(rows, "user_id", _usage, (None, None), "fingerprint string, usage_day long", "fingerprint string", ttl_ms)
    return out.select(F.col("seq").alias("event_id"), "user_id", F.timestamp_micros("at").alias("ts"), "fingerprint", "late")
