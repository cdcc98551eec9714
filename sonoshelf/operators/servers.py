"""What is known of each server: its state, and its model by what was seen before what was configured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoshelf.functions.text import basename

STALE_S = 1800


def ago(gone: Column) -> Column:
    """Seconds as "5s ago", "3m ago", "2h ago" or "4d ago", cut; "just now" for a time ahead."""
    told = F.when(gone < 0, "just now")
    for limit, unit, letter in ((60, 1, "s"), (3600, 60, "m"), (86_400, 3600, "h")):
        told = told.when(gone < limit, F.concat(F.floor(gone / unit).cast("string"), F.lit(f"{letter} ago")))
    return told.when(gone.isNotNull(), F.concat(F.floor(gone / 86_400).cast("string"), F.lit("d ago")))


def _gone(as_of: Column, at: str) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6


def with_state(servers: DataFrame, as_of: Column, stale_s: int = STALE_S) -> DataFrame:
    """servers with state and detail.

    servers: beat and current_file of a live claim, probed, reachable and ready of its arbiter (null without one), jobs and
    last_finished of past runs. A claim comes first, fresh or stalled; then what the probe says; without one, what past
    runs tell."""
    beat, name = _gone(as_of, "beat"), basename(F.col("current_file"))
    probed = F.coalesce("probed", F.lit(False))
    # The states and what is said of them.
    cases = [
        (F.col("beat").isNotNull() & (beat <= stale_s), "transcribing", F.when(F.coalesce(name, F.lit("")).isin("", "."), "transcribing").otherwise(F.concat(F.lit("transcribing "), name))),
        (F.col("beat").isNotNull(), "stalled", F.concat(F.lit("claim heartbeat stale ("), ago(beat), F.lit(") — runner may have crashed"))),
        (probed & ~F.coalesce("reachable", F.lit(False)), "offline", F.lit("host unreachable (gpu-arbiter not responding)")),
        (probed & F.coalesce("ready", F.lit(False)), "ready", F.lit("connected — GPU available")),
        (probed, "busy", F.lit("GPU busy")),
        (F.col("jobs") > 0, "idle", F.when(F.col("last_finished").isNull(), "idle — no live claim").otherwise(F.concat(F.lit("idle — last active "), ago(_gone(as_of, "last_finished"))))),
    ]
    state, detail = F, F
    for when, label, told in cases:
        state, detail = state.when(when, label), detail.when(when, told)
    return servers.withColumn("detail", detail.otherwise("configured — no activity observed yet")).withColumn("state", state.otherwise("not_seen"))


def with_models(servers: DataFrame, names: tuple[str, ...] = ("model", "family", "runtime")) -> DataFrame:
    """servers with each name and name_source, from observed_name if that isn't empty, else from configured_name."""
    out = servers
    for n in names:
        seen, meant = F.nullif(F.col(f"observed_{n}"), F.lit("")), F.nullif(F.col(f"configured_{n}"), F.lit(""))
        source = F.when(seen.isNotNull(), "observed").when(meant.isNotNull(), "configured").otherwise("")
        out = out.withColumn(n, F.coalesce(seen, meant, F.lit(""))).withColumn(f"{n}_source", source)
    return out
