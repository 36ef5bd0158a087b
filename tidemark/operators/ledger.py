"""Append-only records, evidence manifests, prediction life cycle, audit and change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import record_hash
from tidemark.functions.scoring import is_finite, positive
from tidemark.functions.validity import clean, japan_date
from tidemark.operators.dims import effective_at_exclusive
from tidemark.operators.keyed import split_lag
from tidemark.operators.research import basket_paths, session_window

LICENSED = ("source", "data_as_of", "revision", "license_class")
MARKETS = ("XNYS", "XNAS", "ARCX", "XASE", "BATS")


def append_records(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to insert and conflicts. Same id and hash is a no-op, another hash is a conflict."""
    fresh = new.groupBy("kind", "id").agg(
        F.min("hash").alias("hash"), F.min_by("body", "hash").alias("body"), (F.min("hash") != F.max("hash")).alias("_split")
    )
    rows = fresh.join(existing.select("kind", "id", F.col("hash").alias("_old")), ["kind", "id"], "left")
    clash = F.col("_split") | F.coalesce(F.col("_old") != F.col("hash"), F.lit(False))
    insert = rows.where(F.col("_old").isNull() & ~F.col("_split")).select("kind", "id", "body", "hash")
    conflicts = rows.where(clash).select("kind", "id", F.col("_old").alias("existing_hash"), F.col("hash").alias("new_hash"))
    return insert, conflicts


def capture_manifest(sources: DataFrame, keys: list[str], captured_at: str = "captured_at") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifests, content-addressed objects and rejected captures.

    A capture is rejected as a whole when one of its inputs is from the future or lacks
    provenance.
    """
    day = F.to_date(captured_at)
    reason = F.coalesce(
        F.when(F.col("body").isNull(), "raw body required"),
        F.when(F.col("available_at") > F.col(captured_at), "future source availability"),
        *[F.when(clean(F.col(c)).isNull(), f"missing source {c}") for c in LICENSED],
        F.when(F.col("data_as_of") > day, "future observation date"),
    )
    rows = sources.withColumn("content_hash", F.sha2(F.col("body"), 256)).withColumn("_why", reason)
    entry = F.struct(*LICENSED, "available_at", "content_hash")
    line = F.concat_ws("|", "name", *[F.col(c).cast("string") for c in LICENSED], F.col("available_at").cast("string"), "content_hash")
    grouped = rows.groupBy(*keys, captured_at).agg(
        F.min("_why").alias("reason"), F.sort_array(F.collect_list(line)).alias("_lines"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", entry)))).alias("inputs"),
    )
    ident = record_hash(F.col(captured_at), F.array_join("_lines", "\n"))
    good = grouped.where(F.col("reason").isNull()).select(*keys, captured_at, ident.alias("manifest_id"), "inputs")
    rejected = grouped.where(F.col("reason").isNotNull()).select(*keys, captured_at, "reason")
    kept = rows.join(good.select(*keys, captured_at), [*keys, captured_at], "left_semi")
    return good, kept.groupBy("content_hash").agg(F.min("body").alias("body")), rejected


def input_as_of(manifests: DataFrame, cutoff: Column) -> DataFrame:
    """Inputs with their point-in-time verdict against a cutoff."""
    rows = manifests.select("*", F.explode("inputs").alias("name", "entry")).drop("inputs")
    late = (F.col("captured_at") > cutoff) | (F.col("entry.available_at") > cutoff)
    return rows.withColumn("usable", ~late)


def issue_predictions(requests: DataFrame, definitions: DataFrame, sessions: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted predictions with a deterministic id, and rejected requests with the first broken rule.

    requests: request_id, theme_id, horizon, model_version, issued_at, expected, theme_cost,
    benchmark_cost. definitions: theme_id, valid_from, valid_to, known_at, members, benchmark.
    versions: model_version, registered_at.
    """
    ask = session_window(requests, sessions, F.col("horizon"))
    defs = effective_at_exclusive(definitions, requests.select("request_id", "theme_id", "issued_at"))
    found = defs.groupBy("request_id").agg(
        F.max_by(F.struct("members", "benchmark"), F.struct("known_at", "valid_from")).alias("d")
    ).select("request_id", "d.*")
    rows = ask.join(found, "request_id", "left").join(versions, "model_version", "left")
    cost_ok = F.col("theme_cost").between(0, 0.999999) & F.col("benchmark_cost").between(0, 0.999999)
    reason = F.coalesce(
        F.when(clean(F.col("request_id").cast("string")).isNull(), "identity/provenance required"),
        F.when(~is_finite(F.col("expected")), "finite expected excess return required"),
        F.when(~F.coalesce(cost_ok, F.lit(False)), "invalid cost rate"),
        F.when(F.col("registered_at").isNull(), "unknown model version"),
        F.when(F.col("registered_at") > F.col("issued_at"), "future registered version"),
        F.when(F.col("members").isNull(), "definition not effective at issuance"),
        F.when(F.size("members") == 0, "core missing"),
        F.when(F.size(F.array_distinct("members")) < F.size("members"), "duplicate core"),
        F.col("window_error"),
    )
    rows = rows.withColumn("reason", reason).withColumn("prediction_id", record_hash(F.col("request_id")))
    w = F.lit(1.0) / F.size("members")
    good = rows.where(F.col("reason").isNull()).select(
        "prediction_id", "request_id", "theme_id", "horizon", "model_version", "issued_at", "expected", "theme_cost", "benchmark_cost",
        "benchmark", F.transform("members", lambda t: F.struct(t.alias("ticker"), w.alias("weight"))).alias("members"),
        "entry_seq", "exit_seq", "entry_at", "exit_at",
    )
    return good, rows.where(F.col("reason").isNotNull()).select("request_id", "reason")


def new_predictions(existing: DataFrame, issued: DataFrame) -> DataFrame:
    """Retried requests issue nothing new."""
    return issued.join(existing.select("prediction_id"), "prediction_id", "left_anti")


def current_status(events: DataFrame) -> DataFrame:
    """Last status event of each prediction."""
    return events.groupBy("prediction_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def status_counts(current: DataFrame) -> DataFrame:
    c = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return current.agg(c("pending"), c("scored"), c("unresolved"))


def due_predictions(predictions: DataFrame, events: DataFrame, outcomes: DataFrame, manifest_id: str, at: Column, correction: bool = False) -> DataFrame:
    """Predictions with an `action` of pending, unchanged or score."""
    done = outcomes.where(F.col("manifest_id") == manifest_id).select("prediction_id").distinct().withColumn("_same", F.lit(True))
    rows = predictions.join(current_status(events).drop("seq"), "prediction_id", "left").join(done, "prediction_id", "left")
    settled = F.lit(False) if correction else F.coalesce(F.col("status") == "scored", F.lit(False))
    action = (
        F.when(F.col("exit_at") > at, "pending").when(settled | F.col("_same").isNotNull(), "unchanged").otherwise("score")
    )
    return rows.withColumn("action", action).drop("_same")


def score_outcomes(due: DataFrame, bars: DataFrame, at: Column) -> DataFrame:
    """Weighted total-return outcome, or unresolved with the first failing evidence rule.

    bars: ticker, seq, open, close, available_at, close_ts, quality, tradable_open. A bar counts
    only if its session was closed, it was available by `at`, and it is verified.
    """
    timely = (F.col("available_at") >= F.col("close_ts")) & (F.col("available_at") <= at)
    usable = bars.where(timely & (F.col("quality") == "verified")).select(
        "ticker", "seq", F.when(F.col("tradable_open") & positive(F.col("open")), F.col("open")).alias("open"), "close"
    )
    rows = due.join(basket_paths(due, usable), "prediction_id")
    ok = F.col("incomplete").isNull()
    t, b = F.col("theme_return"), F.col("benchmark_return")
    return rows.select(
        *due.columns, F.when(ok, "scored").otherwise("unresolved").alias("outcome_status"), F.col("incomplete").alias("reason"),
        F.when(ok, t).alias("theme_return"), F.when(ok, b).alias("benchmark_return"), F.when(ok, t - b).alias("excess_return"),
        F.when(ok, t - F.col("theme_cost")).alias("cost_adjusted_return"),
        F.when(ok, t - b - F.col("theme_cost") + F.col("benchmark_cost")).alias("cost_adjusted_excess"),
        F.when(ok, F.col("max_favorable")).alias("max_favorable"), F.when(ok, F.col("max_adverse")).alias("max_adverse"),
        F.when(ok & (F.col("expected") != 0), (F.col("expected") > 0) == (t - b > 0)).alias("direction_correct"),
    )


def version_outcomes(prior: DataFrame, scored: DataFrame, reason: str | None) -> tuple[DataFrame, DataFrame]:
    """New outcome versions, and failed corrections that leave the earlier score in place."""
    count = prior.groupBy("prediction_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = scored.join(count, "prediction_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    versions = rows.where(F.col("outcome_status") == "scored").select(
        *scored.columns, (F.col("_n") + 1).alias("outcome_version"), F.when(F.col("_n") > 0, F.lit(reason)).alias("correction_reason")
    )
    errors = rows.where((F.col("outcome_status") != "scored") & (F.col("_n") > 0)).select("prediction_id", "reason")
    return versions, errors


def audit(records: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """Checksum failures and dangling references.

    references: name -> frame with columns id (the pointing record) and target_kind, target_id.
    """
    bad = records.where(F.sha2(F.col("body"), 256) != F.col("hash")).select(
        F.lit("record checksum mismatch").alias("rule"), "kind", "id", F.lit(None).cast("string").alias("target")
    )
    known = records.select(F.col("kind").alias("target_kind"), F.col("id").alias("target_id"))
    for name, ref in references.items():
        lost = ref.join(known, ["target_kind", "target_id"], "left_anti").select(
            F.lit("missing reference").alias("rule"), F.lit(name).alias("kind"), "id", F.concat_ws(":", "target_kind", "target_id").alias("target")
        )
        bad = bad.unionByName(lost)
    return bad


def unfinished_runs(records: DataFrame) -> DataFrame:
    done = records.where(F.col("kind") == "run_finished").select("id")
    return records.where(F.col("kind") == "run_started").join(done, "id", "left_anti").select("id")


def usage_changes(events: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", fingerprint: str = "fingerprint") -> DataFrame:
    """Events that differ from the previous one of the user, or open a new Japan day; chained ids.

    A user may hold any share of the events: the lag runs per (user, day). Repeats are equal to
    their predecessor by definition, so comparing with the previous event and with the previous
    kept event is the same.
    """
    rows = events.withColumn("usage_day", japan_date(F.col(ts)))
    rows = split_lag(rows, [key], "usage_day", [ts, order], {"_fp": fingerprint, "_day": "usage_day"})
    keep = rows.where(
        F.col("_first") | ~F.col(fingerprint).eqNullSafe(F.col("_fp")) | (F.col("usage_day") != F.col("_day"))
    ).drop("_first", "_fp", "_day")
    keep = keep.withColumn("record_id", record_hash(F.col(key), F.col(ts), F.col(order), F.col(fingerprint)))
    return split_lag(keep, [key], "usage_day", [ts, order], {"previous_record_id": "record_id"}).drop("_first")


def decision_log(states: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """Changes of a chosen value per key; an unset start is not a change."""
    rows = split_lag(states, keys, bucket, order, {"before": "value"})
    rows = rows.withColumn("before", F.coalesce("before", F.lit("unset")))
    return rows.where(F.col("value") != F.col("before")).drop("_first")


def rationale_log(states: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """Changes of a tag set per key with what was added and removed."""
    rows = states.withColumn("tags", F.sort_array("tags"))
    rows = split_lag(rows, keys, bucket, order, {"before": "tags"})
    none = F.array().cast("array<string>")
    rows = rows.withColumn("before", F.coalesce("before", none)).where(F.col("tags") != F.col("before"))
    return rows.select(
        *[c for c in rows.columns if c not in ("_first",)], F.array_except("tags", "before").alias("added"), F.array_except("before", "tags").alias("removed")
    )
