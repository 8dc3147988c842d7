"""Return and level series on the lattice: exact endpoints, gaps, runs and sample gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtape.operators.ordered import carry, haloed, longest_run, sliced
from tandemtape.operators.sync import CELLS, SyncConfig, as_of, finest_step, measures, rejection
from tandemtape.session import cut

MINIMUM_OBSERVATIONS = 300


@dataclass(frozen=True)
class SeriesSpec:
    """One econometric configuration; times in milliseconds."""

    name: str
    sampling_ms: int
    horizon_ms: int
    endpoint_ms: int
    trim_ms: int
    trim_policy: str = "baseline"
    ordering: str = "coinbase_first"


def specifications(base: SyncConfig, unit: int = 1) -> list[SeriesSpec]:
    """Baseline and six robustness configurations; endpoints of the changed ones lie on the faster lattice."""
    s, h, t, fast = base.sampling_ms, base.horizon_ms, base.trim_ms, 50 * unit
    return [
        SeriesSpec("baseline", s, h, s, t),
        SeriesSpec("sampling_250ms", 250 * unit, h, fast, t),
        SeriesSpec("sampling_500ms", 500 * unit, h, fast, t),
        SeriesSpec("horizon_250ms", s, 250 * unit, fast, t),
        SeriesSpec("horizon_500ms", s, 500 * unit, fast, t),
        SeriesSpec("no_additional_trim", s, h, s, 0, trim_policy="no_additional_trim"),
        SeriesSpec("kraken_first", s, h, s, t, ordering="kraken_first"),
    ]


def thinned(rows: DataFrame, interval_ms: int, attempt: str = "attempt_id", anchor: str = "anchor_us") -> DataFrame:
    """Rows on the exact lattice that starts at the attempt's first row."""
    first = rows.groupBy(attempt).agg(F.min(anchor).alias("_t0"))
    return rows.join(first, attempt).where((F.col(anchor) - F.col("_t0")) % (interval_ms * 1000) == 0).drop("_t0")


def support(quotes: DataFrame, bounds: DataFrame, base: SyncConfig, specs: list[SeriesSpec], attempt: str = "attempt_id"):
    """Finest lattice with acceptance under the baseline rule; returns the frame and its step."""
    step = finest_step(
        [base] + [SyncConfig(sampling_ms=m, trim_ms=s.trim_ms) for s in specs for m in (s.sampling_ms, s.endpoint_ms, s.horizon_ms)]
    )
    grid = measures(as_of(quotes, bounds, step, attempt))
    return grid.select(
        attempt, "cell", "anchor_us", "start_us", "end_us", "cb_mid", "kr_mid",
        (rejection(base) == "none").alias("accepted"),
    ), step


def anchored_returns(fine: DataFrame, spec: SeriesSpec, step_ms: int, attempt: str = "attempt_id") -> DataFrame:
    """Accepted anchors with the forward log return to exactly anchor + horizon, stamped at the start.

    A return needs every endpoint-lattice row in [t, t + h] to exist and be accepted with positive mids.
    """
    trim, every = spec.trim_ms // step_ms, spec.endpoint_ms // step_ms
    if spec.horizon_ms % spec.endpoint_ms:
        raise ValueError("return horizon is not a multiple of the endpoint interval")
    reach, h = spec.horizon_ms // step_ms, spec.horizon_ms // spec.endpoint_ms
    past_trim = F.col("cell") - trim
    rows = fine.where(
        (past_trim >= 0) & (past_trim % every == 0) & (F.col("anchor_us") <= F.col("end_us") - spec.trim_ms * 1000)
    )
    usable = F.col("accepted") & F.coalesce((F.col("cb_mid") > 0) & (F.col("kr_mid") > 0), F.lit(False))
    halo, track = haloed(rows.withColumn("_ok", usable.cast("int")), [attempt], "cell", ahead=reach, size=CELLS)
    w = track.window()
    traversed = w.rangeBetween(0, reach)
    ahead = lambda c: F.lead(F.ln(c), h).over(w) - F.ln(c)
    complete = F.sum("_ok").over(traversed) == h + 1
    return (
        halo.withColumn("valid", complete)
        .withColumn("cb_return", F.when(complete, ahead("cb_mid")))
        .withColumn("kr_return", F.when(complete, ahead("kr_mid")))
        .where("_own")
        .where(past_trim % (spec.sampling_ms // step_ms) == 0)
        .select(
            attempt, F.lit(spec.name).alias("configuration_id"), F.lit(spec.sampling_ms).cast("bigint").alias("sampling_ms"),
            F.lit(spec.horizon_ms).cast("bigint").alias("horizon_ms"), "cell", "anchor_us", "accepted", "valid",
            "cb_mid", "kr_mid", "cb_return", "kr_return",
        )
    )


def configured(fine: DataFrame, specs: Sequence[SeriesSpec], step_ms: int, attempt: str = "attempt_id") -> DataFrame:
    """Anchors of several configurations in one table, so what follows runs once over all of them."""
    return reduce(DataFrame.unionByName, [anchored_returns(fine, s, step_ms, attempt) for s in specs])


def labelled(anchors: DataFrame, attempt: str = "attempt_id") -> DataFrame:
    """Accepted anchors numbered in order, with gap flag, valid-run id and gap-free segment id; a cut table."""
    keys = [attempt, "configuration_id"]
    accepted = anchors.where("accepted")
    rows, track = sliced(accepted, keys, ["cell"], "cell", CELLS)
    linked = cut(carry(rows, track, before={"_t": F.col("anchor_us")}))
    step = (F.col("anchor_us") - F.col("_t")) / 1000.0
    linked = linked.withColumn("step_ms", step).withColumn(
        "is_gap", F.coalesce(F.col("step_ms") > 3.0 * F.col("sampling_ms"), F.lit(False))
    )
    return cut(carry(
        linked, track,
        sums={
            "seq": F.lit(1).cast("bigint"),
            "run": (~F.col("valid")).cast("bigint"),
            "segment": F.col("is_gap").cast("bigint"),
        },
    ).drop("_t", "_slice"))


def runs(rows: DataFrame, attempt: str = "attempt_id") -> DataFrame:
    """Earliest longest run of valid returns per attempt and configuration."""
    keys = [attempt, "configuration_id"]
    return longest_run(rows.where("valid"), keys, "run", "seq")


def segments(rows: DataFrame, attempt: str = "attempt_id") -> DataFrame:
    """Earliest longest gap-free segment of levels, with the log level it starts from."""
    keys = [attempt, "configuration_id"]
    best = longest_run(rows, keys, "segment", "seq")
    start = rows.select(
        *keys, F.col("seq").alias("run_start"), F.ln("cb_mid").alias("cb_origin"), F.ln("kr_mid").alias("kr_origin")
    )
    return best.join(start, [*keys, "run_start"])


def diagnostics(anchors: DataFrame, rows: DataFrame, minimum: int = MINIMUM_OBSERVATIONS, attempt: str = "attempt_id") -> DataFrame:
    """Series diagnostics and the sample gate.  ``missing_share`` is gaps over transitions, not missing points."""
    keys = [attempt, "configuration_id"]
    offered = anchors.groupBy(*keys, "sampling_ms", "horizon_ms").agg(F.count(F.lit(1)).alias("input_synchronized_rows"))
    counted = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("accepted_input_rows"), F.count_if("valid").alias("usable_return_pairs"),
        F.count_if("is_gap").alias("gap_count"), F.max("step_ms").alias("maximum_gap"),
        F.min("anchor_us").alias("series_start_us"), F.max("anchor_us").alias("series_end_us"),
    )
    best = runs(rows, attempt).select(*keys, F.col("run_length").alias("longest_return_run"))
    level = longest_run(rows, keys, "segment", "seq").select(*keys, F.col("run_length").alias("longest_level_segment"))
    joined = offered.join(counted, keys, "left").join(best, keys, "left").join(level, keys, "left")
    n, longest = F.coalesce("accepted_input_rows", F.lit(0)), F.coalesce("longest_return_run", F.lit(0))
    enough = n >= 2
    return joined.select(
        *keys,
        F.col("sampling_ms").alias("sampling_interval_ms"), F.col("horizon_ms").alias("return_horizon_ms"),
        "input_synchronized_rows", n.alias("accepted_input_rows"),
        F.coalesce("usable_return_pairs", F.lit(0)).alias("usable_return_pairs"),
        F.coalesce("gap_count", F.lit(0)).alias("gap_count"),
        F.when(enough, F.col("maximum_gap")).otherwise(0.0).alias("maximum_gap"),
        F.when(enough, F.col("longest_level_segment") - 1).otherwise(0).alias("longest_contiguous_segment"),
        longest.alias("longest_return_run"),
        "series_start_us", "series_end_us",
        F.when(enough, (F.col("series_end_us") - F.col("series_start_us")) / F.lit(1e6)).otherwise(0.0).alias("effective_duration"),
        F.when(enough, F.col("gap_count") / (n - 1)).otherwise(1.0).alias("missing_share"),
        F.when(longest >= minimum, "COMPUTED").otherwise("INSUFFICIENT_SAMPLE").alias("status"),
        F.when(~enough, "Less than 2 rows").when(
            longest < minimum, "Longest contiguous return segment below min obs"
        ).alias("insufficiency_reason"),
    )


def model_returns(rows: DataFrame, minimum: int = MINIMUM_OBSERVATIONS, attempt: str = "attempt_id") -> DataFrame:
    """Returns of the longest run, numbered from 0, for attempts that pass the sample gate."""
    keys = [attempt, "configuration_id"]
    best = runs(rows, attempt).where(F.col("run_length") >= minimum)
    return rows.where("valid").join(best, [*keys, "run"]).select(
        *keys, (F.col("seq") - F.col("run_start")).alias("pos"), F.col("run_length").alias("n"), "anchor_us",
        F.col("cb_return").alias("y1"), F.col("kr_return").alias("y2"),
    )


def model_levels(rows: DataFrame, minimum: int = MINIMUM_OBSERVATIONS, attempt: str = "attempt_id") -> DataFrame:
    """Log levels of the longest gap-free segment relative to its first row, for attempts past the same gate."""
    keys = [attempt, "configuration_id"]
    gate = runs(rows, attempt).where(F.col("run_length") >= minimum).select(*keys)
    best = segments(rows, attempt).join(gate, keys, "left_semi")
    return rows.join(best, [*keys, "segment"]).select(
        *keys, (F.col("seq") - F.col("run_start")).alias("pos"), F.col("run_length").alias("n"), "anchor_us",
        (F.ln("cb_mid") - F.col("cb_origin")).alias("y1"), (F.ln("kr_mid") - F.col("kr_origin")).alias("y2"),
    )
