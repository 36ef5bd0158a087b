"""Contract checks. Every check returns violations (rule, key, detail); empty means accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scoring import is_finite, positive
from tidemark.functions.validity import clean, japan_date
from tidemark.operators.keyed import split_lag, union_all, violations

# Closed vocabularies.
ROLES = ("core", "related", "watch", "exclude")
PURITY = ("high", "medium", "low")
CLASSES = {"structural": ("ranked", "thin"), "tactical": ("heat_only",), "watch": ("none",)}
MINIMUM_CORE = {"ranked": 4, "thin": 2, "heat_only": 2, "none": 0}
CURRENCIES = ("USD", "JPY")
HELD_DECISIONS = ("unset", "hold", "add_review", "wait_pullback", "reduce_review", "exit_review", "review")
TICKER = r"^[A-Z0-9.^=-]{1,20}$"
FROZEN = ("score_mode", "definition_version", "core_members", "related_members", "watch_members", "benchmark")


def missing_columns(df: DataFrame, required: list[str], name: str) -> DataFrame:
    lost = sorted(set(required) - set(df.columns))
    schema = "rule string, key string, detail string"
    return df.sparkSession.createDataFrame([("missing_columns", name, ",".join(lost))] if lost else [], schema)


def duplicates(df: DataFrame, rule: str, key: Column) -> DataFrame:
    per = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return violations(per, rule, F.col("n") > 1, F.col("k"), F.col("n"))


def overlapping(intervals: DataFrame, keys: list[str], start: str, end: str, label: str) -> DataFrame:
    """Intervals that begin before an earlier one of the same key has ended.

    A running maximum of end dates finds them in one ordered pass: no pairs are formed.
    """
    w = Window.partitionBy(*keys).orderBy(start, label).rowsBetween(Window.unboundedPreceding, -1)
    far = F.to_date(F.lit("9999-12-31"))
    rows = intervals.withColumn("_end", F.coalesce(F.col(end), far))
    rows = rows.withColumn("_reach", F.max("_end").over(w))
    return violations(rows, "overlapping_core", F.col(start) <= F.col("_reach"), F.concat_ws("|", *keys), F.col(label))


def check_config(
    themes: DataFrame, entities: DataFrame, memberships: DataFrame, classes: dict[str, tuple[str, ...]] = CLASSES,
    pinned: dict[str, list[str]] | None = None,
) -> DataFrame:
    """All configuration rules over themes, entities and dated memberships."""
    none = F.lit(None).cast("string")
    tid, eid = F.col("theme_id"), F.col("entity_id")
    row_key = F.concat_ws("|", "theme_id", "entity_id", "role")
    class_ok = F.col("theme_class").isin(*classes)
    mode_ok = F.lit(False)
    for c, modes in classes.items():
        mode_ok = mode_ok | ((F.col("theme_class") == c) & F.col("score_mode").isin(*modes))
    all_modes = sorted({m for ms in classes.values() for m in ms})
    out = [
        violations(themes, "blank_theme_id", clean(tid).isNull(), tid, none),
        duplicates(themes, "duplicate_theme_id", tid),
        violations(themes, "theme_class", ~class_ok, tid, F.col("theme_class")),
        violations(themes, "score_mode", ~F.col("score_mode").isin(*all_modes), tid, F.col("score_mode")),
        violations(themes, "class_to_mode", class_ok & ~mode_ok, tid, F.col("score_mode")),
        violations(themes, "benchmark_required", (F.col("score_mode") != "none") & clean(F.col("primary_benchmark")).isNull(), tid, none),
        violations(entities, "blank_entity_id", clean(eid).isNull(), eid, none),
        duplicates(entities, "duplicate_entity_id", eid),
        violations(entities, "public_without_ticker", (F.col("status") == "public") & clean(F.col("ticker")).isNull(), eid, none),
    ]
    shared = entities.where(clean(F.col("ticker")).isNotNull()).groupBy(F.upper(clean(F.col("ticker"))).alias("k")).agg(F.countDistinct("entity_id").alias("n"))
    out.append(violations(shared, "ticker_on_several_entities", F.col("n") > 1, F.col("k"), F.col("n")))
    unknown = lambda col, ref, rule: violations(
        memberships.join(ref.select(col).distinct(), col, "left_anti"), rule, F.lit(True), row_key, F.col(col)
    )
    out += [
        unknown("theme_id", themes, "unknown_theme"),
        unknown("entity_id", entities, "unknown_entity"),
        violations(memberships, "role", ~F.col("role").isin(*ROLES), row_key, F.col("role")),
        violations(memberships, "purity", ~F.col("purity").isin(*PURITY), row_key, F.col("purity")),
        violations(memberships, "effective_from_required", F.col("effective_from").isNull(), row_key, none),
        violations(memberships, "ends_before_start", F.col("effective_to") < F.col("effective_from"), row_key, F.col("effective_to")),
    ]
    named = memberships.join(entities.select("entity_id", F.upper(clean(F.col("ticker"))).alias("_t")), "entity_id")
    out.append(violations(named, "ticker_mismatch", F.upper(clean(F.col("ticker"))) != F.col("_t"), row_key, F.col("ticker")))
    moded = memberships.where(F.col("role") == "core").join(themes.select("theme_id", "score_mode"), "theme_id")
    out.append(violations(moded, "core_in_unscored_theme", F.col("score_mode") == "none", row_key, none))
    exact = F.concat_ws("|", "theme_id", "entity_id", "role", F.coalesce(F.col("effective_from").cast("string"), F.lit("")), F.coalesce(F.col("effective_to").cast("string"), F.lit("")))
    out.append(duplicates(memberships, "duplicate_membership", exact))
    core = memberships.where((F.col("role") == "core") & F.col("effective_from").isNotNull())
    out.append(overlapping(core, ["entity_id"], "effective_from", "effective_to", "theme_id"))
    per = memberships.where(F.col("role") == "core").groupBy("theme_id").agg(F.count(F.lit(1)).alias("n"))
    sized = themes.join(per, "theme_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    low = F.lit(0)
    for mode, least in MINIMUM_CORE.items():
        low = F.when(F.col("score_mode") == mode, least).otherwise(low)
    out.append(violations(sized, "minimum_core", F.col("n") < low, tid, F.col("n")))
    for theme, tickers in (pinned or {}).items():
        have = memberships.where((tid == theme) & (F.col("role") == "core")).agg(F.sort_array(F.collect_set("ticker")).alias("t"))
        want = F.sort_array(F.array(*[F.lit(t) for t in tickers]))
        out.append(violations(have, "pinned_basket", F.col("t") != want, F.lit(theme), F.array_join("t", ",")))
    return union_all(out)


def config_warnings(themes: DataFrame, memberships: DataFrame) -> DataFrame:
    """Thin themes with their core count: worth knowing, not a violation."""
    per = memberships.where(F.col("role") == "core").groupBy("theme_id").agg(F.count(F.lit(1)).alias("n"))
    rows = themes.where(F.col("score_mode") == "thin").join(per, "theme_id", "left")
    return violations(rows, "thin_monitor", F.lit(True), F.col("theme_id"), F.coalesce("n", F.lit(0)))


def validate_candidate(previous: DataFrame, candidate: DataFrame, history_before: DataFrame, history_after: DataFrame) -> DataFrame:
    """Whether a new snapshot may replace the previous one.

    Snapshots: theme_id, as_of, the frozen definition columns, quality, missing_core,
    strength_n, heat_n, strength_score, heat_score. Histories: as_of, theme_id, content_hash.
    """
    cols = [*FROZEN, "as_of", "quality", "missing_core", "strength_n", "heat_n", "strength_score", "heat_score"]
    side = lambda df, p: df.select("theme_id", *[F.col(c).alias(p + c) for c in cols], F.lit(True).alias(p + "in"))
    rows = side(previous, "a_").join(side(candidate, "b_"), "theme_id", "full_outer")
    a, b = (lambda c: F.col("a_" + c)), (lambda c: F.col("b_" + c))
    key, none = F.col("theme_id"), F.lit(None).cast("string")
    both = a("in").isNotNull() & b("in").isNotNull()
    out = [
        violations(rows, "theme_set_changed", ~both, key, F.when(b("in").isNull(), "removed").otherwise("added")),
        duplicates(candidate, "theme_set_changed", F.col("theme_id")),
        violations(rows, "as_of_regressed", both & (b("as_of") < a("as_of")), key, b("as_of")),
    ]
    out += [violations(rows, "frozen_" + c, both & ~a(c).eqNullSafe(b(c)), key, none) for c in FROZEN]
    lost = F.array_except(b("missing_core"), a("missing_core"))
    out += [
        violations(rows, "new_missing_data", both & (F.size(lost) > 0), key, F.array_join(lost, ",")),
        violations(rows, "newly_insufficient", both & (a("quality") != "insufficient") & (b("quality") == "insufficient"), key, none),
        violations(rows, "fewer_strength_eligible", both & (b("strength_n") < a("strength_n")), key, b("strength_n")),
        violations(rows, "fewer_heat_eligible", both & (b("heat_n") < a("heat_n")), key, b("heat_n")),
    ]
    for s in ("strength_score", "heat_score"):
        out.append(violations(rows, "lost_" + s, both & a(s).isNotNull() & b(s).isNull(), key, none))
        out.append(violations(rows, "invalid_" + s, b(s).isNotNull() & ~F.coalesce(b(s).between(0, 100), F.lit(False)), key, b(s)))
    ids = ["as_of", "theme_id", "content_hash"]
    rewritten = history_before.join(history_after.select(*ids), ids, "left_anti")
    out.append(violations(rewritten, "history_rewritten", F.lit(True), F.col("theme_id"), F.col("as_of")))
    added = history_after.join(history_before.select(*ids), ids, "left_anti")
    last = candidate.agg(F.max("as_of").alias("_now")).join(previous.agg(F.max("as_of").alias("_was")))
    odd = added.join(F.broadcast(last)).where((F.col("as_of") != F.col("_now")) | (F.col("_now") == F.col("_was")))  # one row
    out.append(violations(odd, "unexpected_history", F.lit(True), F.col("theme_id"), F.col("as_of")))
    fresh = candidate.join(F.broadcast(last)).where(F.col("_now") > F.col("_was")).join(added.select("theme_id", "as_of"), ["theme_id", "as_of"], "left_anti")
    out.append(violations(fresh, "history_not_appended", F.lit(True), F.col("theme_id"), F.col("as_of")))
    return union_all(out)


def check_holdings(holdings: DataFrame) -> DataFrame:
    """Row rules of holdings, and one decision per account and ticker."""
    key = F.concat_ws("|", F.col("account_id").cast("string"), F.col("holding_id").cast("string"))
    amount = F.col("quantity") * F.col("cost")
    agreed = holdings.groupBy("account_id", "ticker").agg((F.min("decision") != F.max("decision")).alias("split"))
    return union_all(
        [
            violations(holdings, "ticker", ~F.coalesce(F.col("ticker").rlike(TICKER), F.lit(False)), key, F.col("ticker")),
            violations(holdings, "quantity", ~positive(F.col("quantity")), key, F.col("quantity")),
            violations(holdings, "cost", ~F.coalesce(is_finite(F.col("cost")) & (F.col("cost") >= 0), F.lit(False)), key, F.col("cost")),
            violations(holdings, "amount", ~is_finite(amount), key, amount),
            violations(holdings, "currency", ~F.col("currency").isin(*CURRENCIES), key, F.col("currency")),
            violations(holdings, "decision", ~F.col("decision").isin(*HELD_DECISIONS), key, F.col("decision")),
            violations(holdings, "broker", F.length("broker") > 60, key, F.col("broker")),
            duplicates(holdings, "duplicate_holding", key),
            violations(agreed, "decision_differs", F.col("split"), F.concat_ws("|", F.col("account_id").cast("string"), "ticker"), F.lit(None)),
        ]
    )


def check_ledgers(snapshots: DataFrame, flows: DataFrame, dividends: DataFrame) -> DataFrame:
    """Row rules of valuations, flows and dividends.

    snapshots also carry `allocation` (array of doubles) when known; timestamps must fall on
    their record's Japan date.
    """
    acct = F.col("account_id").cast("string")
    s_key, none = F.concat_ws("|", acct, F.col("date").cast("string")), F.lit(None).cast("string")
    f_key, d_key = F.concat_ws("|", acct, F.col("flow_id").cast("string")), F.concat_ws("|", acct, F.col("dividend_id").cast("string"))
    off_day = lambda date: F.col("ts").isNotNull() & (japan_date(F.col("ts")) != F.col(date))
    total = F.aggregate("allocation", F.lit(0.0), lambda a, x: a + x)
    sign = F.when(F.col("type") == "deposit", F.col("amount_jpy") <= 0).when(F.col("type") == "withdrawal", F.col("amount_jpy") >= 0).otherwise(True)
    return union_all(
        [
            violations(snapshots, "assets", ~F.coalesce(is_finite(F.col("assets_jpy")) & (F.col("assets_jpy") >= 0), F.lit(False)), s_key, F.col("assets_jpy")),
            violations(snapshots, "status", ~F.col("status").isin("recorded", "closed", "invalid", "pending"), s_key, F.col("status")),
            violations(snapshots, "timestamp_day", off_day("date"), s_key, none),
            violations(snapshots, "allocation_total", (F.size("allocation") > 0) & (F.abs(total - F.col("assets_jpy")) > 1), s_key, none),
            duplicates(snapshots, "duplicate_snapshot", s_key),
            violations(flows, "flow_amount", ~is_finite(F.col("amount_jpy")), f_key, F.col("amount_jpy")),
            violations(flows, "flow_sign", sign, f_key, F.col("type")),
            violations(flows, "timestamp_day", off_day("date"), f_key, none),
            duplicates(flows, "duplicate_flow", f_key),
            violations(dividends, "dividend_amount", ~F.coalesce(F.col("net_amount") >= 0, F.lit(False)), d_key, F.col("net_amount")),
            violations(dividends, "dividend_fx", ~positive(F.col("fx")), d_key, F.col("fx")),
            violations(dividends, "dividend_status", ~F.col("status").isin("paid", "pending", "cancelled"), d_key, F.col("status")),
            duplicates(dividends, "duplicate_dividend", d_key),
        ]
    )


def check_periods(periods: DataFrame) -> DataFrame:
    """Ownership periods: end not before start, no overlap within an account."""
    key = F.concat_ws("|", F.col("account_id").cast("string"), F.col("start").cast("string"))
    rows = split_lag(periods.withColumn("_bucket", F.trunc("start", "year")), ["account_id"], "_bucket", ["start"], {"_pend": "end"})
    open_before = ~F.col("_first") & (F.col("_pend").isNull() | (F.col("_pend") >= F.col("start")))
    return violations(periods, "ends_before_start", F.col("end") < F.col("start"), key, F.col("end")).unionByName(
        violations(rows, "overlapping_period", open_before, key, F.col("_pend"))
    )


def check_calendar(sessions: DataFrame, closed: DataFrame, start: str, end: str) -> DataFrame:
    """Unique sessions, disjoint closures, every day covered, open before close on the session's day."""
    key, none = F.col("session").cast("string"), F.lit(None).cast("string")
    days = sessions.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
    known = sessions.select(F.col("session").alias("day")).unionByName(closed.select(F.col("date").alias("day"))).distinct()
    gap = days.join(known, "day", "left_anti")
    extra = known.join(days, "day", "left_anti")
    both = sessions.join(closed.select(F.col("date").alias("session")).distinct(), "session", "left_semi")
    same_day = (F.to_date("open_ts") == F.col("session")) & (F.to_date("close_ts") == F.col("session"))
    return union_all(
        [
            duplicates(sessions, "duplicate_session", key),
            duplicates(closed, "duplicate_closure", F.col("date").cast("string")),
            violations(both, "closure_is_session", F.lit(True), key, none),
            violations(gap, "coverage_gap", F.lit(True), F.col("day"), none),
            violations(extra, "outside_range", F.lit(True), F.col("day"), none),
            violations(sessions, "interval", ~(F.col("open_ts") < F.col("close_ts")), key, none),
            violations(sessions, "session_date", ~same_day, key, none),
        ]
    )


def check_archive(archive: DataFrame, value: str = "close", limit: int | None = None) -> DataFrame:
    """Series rules: known ticker form and currency, unique dates, positive values; with `limit`, bounded length."""
    key = F.concat_ws("|", "ticker", F.col("date").cast("string"))
    size = archive.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), (F.min("currency") != F.max("currency")).alias("mixed"))
    return union_all(
        [
            violations(archive, "ticker", ~F.coalesce(F.col("ticker").rlike(TICKER), F.lit(False)), key, F.col("ticker")),
            violations(archive, "currency", ~F.col("currency").isin(*CURRENCIES), key, F.col("currency")),
            violations(archive, "value", ~positive(F.col(value)), key, F.col(value)),
            duplicates(archive, "duplicate_date", key),
            violations(size, "too_long", F.col("n") > limit if limit else F.lit(False), F.col("ticker"), F.col("n")),
            violations(size, "mixed_currency", F.col("mixed"), F.col("ticker"), F.lit(None)),
        ]
    )
