"""Stable ids, content hashes, order-free fingerprints and duplicate reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtape.operators.ordered import SLICE, carry, longest_run, sliced
from tandemtape.operators.parsing import frame_bytes
from tandemtape.session import cut

EXAMPLES = 10


def json_string(value: Column) -> Column:
    """A JSON string literal of the value."""
    boxed = F.to_json(F.array(value.cast("string")))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def content_id(*parts: Column | str | int) -> Column:
    """SHA-256 of the compact JSON array of the parts; integer columns stay unquoted, strings are quoted."""
    pieces = []
    for item in parts:
        if isinstance(item, int):
            pieces.append(F.lit(str(item)))
        elif isinstance(item, str):
            pieces.append(json_string(F.lit(item)))
        else:
            pieces.append(item)
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *pieces), F.lit("]")), 256)


def event_id(schema_version, dataset, manifest, venue, session, shard, index, kind: str, child) -> Column:
    """Id of a normalized row within one dataset."""
    texts = [json_string(c) for c in (schema_version, dataset, manifest, venue, session, shard)]
    return content_id(*texts, index.cast("string"), kind, child.cast("string"))


def source_event_id(venue, session, shard, index, kind: str, child) -> Column:
    """The same event's id without any dataset part, so it survives re-normalization."""
    return content_id(*[json_string(c) for c in (venue, session, shard)], index.cast("string"), kind, child.cast("string"))


def short_id(prefix: str, canonical: Column) -> Column:
    """Readable id: prefix and the first 16 hex digits of the content's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical, 256), 1, 16))


def frame_hash(venue: Column, frame_type: Column, raw_frame: Column) -> Column:
    text = F.concat(venue, F.lit("|"), frame_type, F.lit("|"), F.lower(F.hex(frame_bytes(frame_type, raw_frame))))
    return F.sha2(text, 256)


def _canonical(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.BooleanType, T.DoubleType)):
        text = value.cast("string")
    elif isinstance(kind, T.TimestampType):
        text = json_string(F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(value)
    else:
        text = json_string(value)
    return F.coalesce(text, F.lit("null"))


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of the row as a JSON array of canonical values."""
    fields = [df.schema[c] for c in (columns or df.columns)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[_canonical(f) for f in fields]), F.lit("]")), 256)


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Order-free table hash: a mergeable fold over row hashes, so it needs no sort and no single task."""
    hashed = df.withColumn("_h", row_hash(df, columns))
    low = F.conv(F.substring("_h", 1, 12), 16, 10).cast("decimal(20,0)")
    high = F.conv(F.substring("_h", 13, 12), 16, 10).cast("decimal(20,0)")
    return hashed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(low), F.lit(0)).cast("decimal(38,0)").alias("hash_sum_a"),
        F.coalesce(F.sum(high), F.lit(0)).cast("decimal(38,0)").alias("hash_sum_b"),
    )


def combined_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """One hash over the fingerprints of several tables, in name order."""
    parts = None
    for name in sorted(tables):
        line = fingerprint(tables[name]).select(
            F.concat_ws(":", F.lit(name), "row_count", "hash_sum_a", "hash_sum_b").alias("part")
        )
        parts = line if parts is None else parts.unionAll(line)
    return parts.agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("part"))), 256).alias("dataset_hash"))


def frame_duplicates(frames: DataFrame, session: str = "session_id", index: str = "record_index") -> DataFrame:
    """Hash each frame, count its copies in the session and number them in record order.  No row is dropped."""
    hashed = frames.withColumn("frame_hash", frame_hash(F.col("venue"), F.col("frame_type"), F.col("raw_frame")))
    return numbered_copies(hashed, session, index)


def numbered_copies(hashed: DataFrame, session: str = "session_id", index: str = "record_index") -> DataFrame:
    """Frames with ``frame_hash`` marked as copies: how many of each the session holds, and which of them a frame is.

    Copies of one frame may be a large part of a session, so they are numbered slice by slice.  ``hashed`` is read twice.
    """
    placed, track = sliced(hashed, [session, "frame_hash"], [index], index, SLICE)
    one = F.lit(1).cast("bigint")
    out = carry(placed, track, sums={"_nth": one}, totals={"duplicate_count": one})
    return out.select(
        *hashed.columns,
        "duplicate_count",
        (F.col("_nth") - 1).alias("occurrence_index"),
        F.when(F.col("duplicate_count") > 1, "EXACT_RAW_FRAME_DUPLICATE").otherwise("UNIQUE").alias("duplicate_class"),
    )


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids seen more than once and how often."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")


def repeated_id_count(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Surplus rows per table: total minus distinct ids, by two map-side combined aggregates."""
    per_id = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("seen"))
    return per_id.groupBy(*by).agg(
        F.sum("seen").alias("ids"), F.sum(F.col("seen") - 1).alias("duplicate_ids"),
        F.count(F.when(F.col("seen") > 1, 1)).alias("repeated_ids"),
    )


def trade_id_repeats(trades: DataFrame, keys: Sequence[str], content: Column, index: Sequence[str]) -> DataFrame:
    """Per key group: repeats of a trade id, split into equal to and different from the first content seen.

    The first content per id is a small mergeable aggregate; ids are joined back, not windowed, so that one id holding
    many rows stays spread over tasks.
    """
    rows = trades.withColumn("_content", content)
    counted = rows.groupBy(*keys, "trade_id", "_content").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*index)).alias("_at")
    )
    first = counted.groupBy(*keys, "trade_id").agg(
        F.sum("_n").alias("_all"), F.min(F.struct("_at", "_n")).alias("_first")
    )
    return first.groupBy(*keys).agg(
        F.sum("_all").alias("trades"),
        F.sum(F.col("_all") - 1).alias("duplicate_trade_id_count"),
        F.sum(F.col("_first._n") - 1).alias("exact_duplicate_trade_count"),
        F.sum(F.col("_all") - F.col("_first._n")).alias("conflicting_duplicate_trade_count"),
    )


def duplicate_groups(frames: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """Repeated frames by hash: class, surplus copies, first record indices and suggested severity.

    Takes classified frames with ``frame_hash``.  The first indices are kept by a two-step top-n: per slice, then over
    the slices, so the copies of one frame are never gathered.
    """
    seen = frames.withColumn("_slice", F.floor(F.col("record_index") / SLICE))
    first = Window.partitionBy("session_id", "frame_hash", "_slice").orderBy("record_index")
    partial = (
        seen.withColumn("_rank", F.row_number().over(first))
        .groupBy("session_id", "frame_hash", "_slice")
        .agg(
            F.count(F.lit(1)).alias("_n"), F.first("channel").alias("channel"), F.first("message").alias("message"),
            F.collect_list(F.when(F.col("_rank") <= examples, F.col("record_index"))).alias("_few"),
        )
        .withColumn("_few", F.slice(F.sort_array("_few"), 1, examples))
    )
    best = Window.partitionBy("session_id", "frame_hash").orderBy("_slice")
    kept = partial.withColumn("_place", F.row_number().over(best))
    groups = kept.groupBy("session_id", "frame_hash").agg(
        F.sum("_n").alias("_n"), F.first("channel").alias("channel"), F.first("message").alias("message"),
        F.slice(
            F.sort_array(F.flatten(F.collect_list(F.when(F.col("_place") <= examples, F.col("_few"))))), 1, examples
        ).alias("record_indices"),
    ).where("_n > 1")
    return groups.select(
        "session_id", "frame_hash",
        frame_class(F.col("channel"), F.col("message")).alias("frame_class"),
        (F.col("_n") - 1).alias("surplus_copies"),
        "record_indices",
        F.col("channel").isin("trade", "ticker").alias("carries_market_event"),
        duplicate_severity(frame_class(F.col("channel"), F.col("message"))).alias("suggested_severity"),
    )


def frame_class(channel: Column, message: Column) -> Column:
    snapshot = F.when(message == "snapshot", "snapshot").otherwise("update")
    return (
        F.when(channel == "heartbeat", "heartbeat")
        .when(channel == "status", "status")
        .when(message == "subscribe", "subscription acknowledgement")
        .when(channel == "trade", F.concat(F.lit("trade "), snapshot))
        .when(channel == "ticker", F.concat(F.lit("ticker "), snapshot))
        .when(channel == "unsupported", "unsupported")
        .otherwise("other")
    )


def duplicate_severity(kind: Column) -> Column:
    return (
        F.when(kind == "subscription acknowledgement", "informational or warning")
        .when(kind.startswith("trade"), "warning")
        .otherwise("informational")
    )


def payload_trade_repeats(records: DataFrame, content: Column, examples: int = EXAMPLES) -> DataFrame:
    """Trade ids met more than once inside payload arrays, with how their contents and frames differ."""
    rows = records.withColumn("_content", content)
    pairs = rows.groupBy("session_id", "trade_id", "_content", "frame_hash").agg(
        F.count(F.lit(1)).alias("_n"), F.min("record_index").alias("first_index")
    )
    return (
        pairs.groupBy("session_id", "trade_id")
        .agg(
            F.sum("_n").alias("entries"), F.countDistinct("_content").alias("contents"),
            F.countDistinct("frame_hash").alias("frames"), F.min("first_index").alias("first_index"),
        )
        .where("entries > 1")
        .select(
            "session_id", "trade_id", "entries",
            (F.col("contents") == 1).alias("identical_contents"),
            (F.col("contents") > 1).alias("conflicting_contents"),
            (F.col("frames") < F.col("entries")).alias("same_frame_repeated"),
            (F.col("frames") > 1).alias("in_different_frames"),
            "first_index",
        )
    )


def consecutive_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: str, what: str) -> DataFrame:
    """Rows equal to the row before them, and the longest run of equal rows, per key."""
    rows, track = sliced(df.select(*keys, *dict.fromkeys([*order, position, what])), keys, order, position)
    flagged = carry(rows, track, before={"_prev": F.col(what)})
    flagged = cut(flagged.withColumn("_new", F.when(F.col("_prev") == F.col(what), 0).otherwise(1)))
    runs = carry(flagged, track, sums={"_run": F.col("_new")})
    best = longest_run(runs, keys, "_run", position)
    totals = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(1 - F.col("_new")).alias("consecutive_duplicates")
    )
    return totals.join(best.select(*keys, F.col("run_length").alias("longest_run")), list(keys))


def chain_breaks(
    events: DataFrame, campaign: str, genesis: str, order: str = "event_index", number: str = "event_index"
) -> DataFrame:
    """Ledger rows that break the hash chain: index not next, previous hash wrong, or own hash not the recomputed one.

    Needs ``previous_hash``, ``event_hash`` and ``canonical_payload``; ``order`` is the position in the file, ``number`` the
    index the event claims.
    """
    placed, track = sliced(events, [campaign], [order], order)
    linked = carry(placed, track, before={"_hash": F.col("event_hash"), "_index": F.col(number)})
    expected_index = F.coalesce(F.col("_index") + 1, F.lit(0))
    return (
        linked.select(
            campaign, order,
            (F.col(number) != expected_index).alias("index_mismatch"),
            (F.col("previous_hash") != F.coalesce("_hash", F.lit(genesis))).alias("previous_mismatch"),
            (F.col("event_hash") != F.sha2("canonical_payload", 256)).alias("hash_mismatch"),
        )
        .where("index_mismatch OR previous_mismatch OR hash_mismatch")
    )


def compare_runs(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Determinism verdict of two outputs: fingerprints, row counts and ids present in only one of them."""
    names = ["row_count", "hash_sum_a", "hash_sum_b"]
    prints = fingerprint(first).withColumn("_run", F.lit(1)).unionAll(fingerprint(second).withColumn("_run", F.lit(2)))
    ids = (
        first.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
        .unionAll(second.select(key, F.lit(0), F.lit(1)))
        .groupBy(key)
        .agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
        .where(F.col("_a") != F.col("_b"))
    )
    of = lambda run, c: F.max(F.when(F.col("_run") == run, F.col(c)))
    same = F.lit(True)
    for c in names:
        same = same & (of(1, c) == of(2, c))
    verdict = prints.agg(
        of(1, "row_count").alias("first_row_count"), of(2, "row_count").alias("second_row_count"), same.alias("_same")
    )
    return verdict.withColumn("differing_ids", ids.select(F.count(F.lit(1))).scalar()).select(
        "first_row_count", "second_row_count", "differing_ids",
        (F.col("_same") & (F.col("differing_ids") == 0)).alias("identical"),
    )


def run_differences(first: DataFrame, second: DataFrame, key: str, bits: tuple[int, ...] = (24, 12, 0)) -> DataFrame:
    """The keys at which two outputs differ: key, first_rows, second_rows.

    A hash tree over ranges of the key, a whole number: blocks of 2^24 keys are compared by their order-free fingerprints, differing blocks by
    blocks of 2^12 keys, and those key by key.  Each level shuffles one row per block and task and goes on with the rows of differing
    blocks only, so two equal outputs cost one pass.  Rows that repeat count; a null key is a key of its own.
    """
    both = first.withColumn("_run", F.lit(1)).unionByName(second.withColumn("_run", F.lit(2)))
    names = ["row_count", "hash_sum_a", "hash_sum_b"]
    of = lambda run, c: F.coalesce(F.max(F.when(F.col("_run") == run, F.col(c))), F.lit(0))
    for shift in bits:
        block = F.shiftright(F.col(key).cast("bigint"), shift)
        prints = fingerprint(both.withColumn("_block", block), first.columns, ["_run", "_block"])
        unlike = [of(1, c) != of(2, c) for c in names]
        found = prints.groupBy("_block").agg(
            of(1, "row_count").alias("first_rows"), of(2, "row_count").alias("second_rows"), (unlike[0] | unlike[1] | unlike[2]).alias("_differs"),
        ).where("_differs").drop("_differs")
        if shift:
            found = found.withColumnRenamed("_block", "_in")
            both = both.join(found, block.eqNullSafe(F.col("_in")), "left_semi")
    return found.withColumnRenamed("_block", key)
