"""Raw frames to one result per frame: market records, control, error, unsupported or failure."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtape.functions import payload as P
from tandemtape.schemas import SYMBOLS, VENUE_1, VENUE_2

ERROR_TEXT = 500
REASON_TEXT = 200


@dataclass(frozen=True)
class RecordShape:
    """Where one venue keeps the fields of a trade or quote record."""

    time: str
    numbers: dict[str, str]
    ids: tuple[str, ...]
    texts: tuple[str, ...] = ()


# Field names of both venues' messages.
TRADE_SHAPE = {
    VENUE_1: RecordShape("time", {"price": "price", "quantity": "size"}, ("trade_id", "sequence"), ("side",)),
    VENUE_2: RecordShape("timestamp", {"price": "price", "quantity": "qty"}, ("trade_id",), ("side",)),
}
QUOTE_SHAPE = {
    VENUE_1: RecordShape(
        "time",
        {"bid_price": "best_bid", "bid_size": "best_bid_size", "ask_price": "best_ask", "ask_size": "best_ask_size"},
        ("sequence",),
    ),
    VENUE_2: RecordShape(
        "timestamp", {"bid_price": "bid", "bid_size": "bid_qty", "ask_price": "ask", "ask_size": "ask_qty"}, ()
    ),
}
MAY_BE_ZERO = {"bid_size", "ask_size"}


def frame_text(frame_type: Column, raw_frame: Column) -> Column:
    """Payload text: text frames as they are, binary frames from base64; null when not UTF-8."""
    binary = F.try_to_binary(raw_frame, F.lit("base64"))
    return F.when(frame_type == "binary", F.try_validate_utf8(binary.cast("string"))).otherwise(raw_frame)


def frame_bytes(frame_type: Column, raw_frame: Column) -> Column:
    binary = F.try_to_binary(raw_frame, F.lit("base64"))
    return F.when(frame_type == "binary", binary).otherwise(F.encode(raw_frame, "UTF-8"))


def aggressor(venue: Column, side: Column) -> Column:
    """Venue 1 reports the maker, so its side is turned round; venue 2 reports the aggressor."""
    flip = venue == VENUE_1
    return (
        F.when(side == "sell", F.when(flip, "buy").otherwise("sell"))
        .when(side == "buy", F.when(flip, "sell").otherwise("buy"))
        .otherwise("unknown")
    )


def _valid(record: Column, shape: RecordShape) -> Column:
    checks = [P.has_time(record, shape.time)]
    checks += [P.has_id(record, name) for name in shape.ids]
    checks += [P.has_text(record, name) for name in shape.texts]
    # Only the sign is judged here: a number that cannot be stored exactly must stop the job, not become a bad frame.
    checks += [
        P.has_not_negative(record, source) if name in MAY_BE_ZERO else P.has_positive(record, source)
        for name, source in shape.numbers.items()
    ]
    met = checks[0]
    for check in checks[1:]:
        met = met & check
    return met


def settled(df: DataFrame, *names: str) -> DataFrame:
    """Compute the named columns once.

    They pass through a one-element generator, which the optimizer does not look through; otherwise the long parse
    expressions would be copied into every later filter and projection that mentions them.
    """
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(F.struct(*names))))


def _validator(shape: RecordShape):
    return lambda record: _valid(record, shape)


def classify(frames: DataFrame) -> DataFrame:
    """Add ``payload``, ``result_kind``, ``channel``, ``message``, ``detail`` and ``records`` (VARIANT array).

    result_kind is one of: undecodable, not_object, invalid, trade, quote, heartbeat, acknowledgement, status,
    control, error, unsupported.
    """
    body = F.col("payload")
    decoded = frames.withColumn("_text", frame_text(F.col("frame_type"), F.col("raw_frame")))
    decoded = decoded.withColumns({"payload": P.parsed(F.col("_text")), "_brace": F.col("_text").rlike(P.OBJECT)})
    decoded = decoded.withColumns(
        {
            "_object": body.isNotNull() & F.col("_brace"),
            "_first": F.col("venue") == VENUE_1,
            "_type": F.when(P.has_text(body, "type"), P.text_of(body, "type")),
            "_channel": F.when(P.has_text(body, "channel"), P.text_of(body, "channel")),
            "_method": P.text_of(body, "method"),
            "_data": F.try_variant_get(body, "$.data", "array<variant>"),
            "_result": P.part(body, "result"),
            "_product": P.text_of(body, "product_id"),
        }
    )
    mine = F.lit(SYMBOLS[VENUE_2])
    ours = lambda r: P.text_of(r, "symbol") == mine
    named = F.forall("_data", lambda r: P.has_text(r, "symbol"))  # only an object can have one
    listed = F.coalesce((F.size("_data") > 0) & named, F.lit(False))
    decoded = decoded.withColumns(
        {
            "_listed": listed,
            "_mine": F.when(listed, F.filter("_data", ours)),
            "_success": F.coalesce(
                F.try_variant_get(body, "$.success", "string"), F.try_variant_get("_result", "$.success", "string")
            ),
        }
    )
    typ, chan, product = F.col("_type"), F.col("_channel"), F.col("_product")
    other_product = product.isNotNull() & (product != SYMBOLS[VENUE_1])

    venue_1 = (
        F.when(typ.isNull(), "invalid")
        .when(typ.isin("match", "last_match", "ticker") & ~P.has_text(body, "product_id"), "invalid")
        .when(typ.isin("match", "last_match", "ticker", "heartbeat", "subscriptions") & other_product, "unsupported")
        .when(typ.isin("match", "last_match"), "trade")
        .when(typ == "ticker", "quote")
        .when(typ == "heartbeat", "heartbeat")
        .when(typ == "subscriptions", "acknowledgement_1")
        .when((typ == "error") & P.has_text(body, "message"), "error")
        .when(typ == "error", "invalid")
        .otherwise("unsupported")
    )
    other_symbol = P.text_of(F.col("_result"), "symbol")
    venue_2 = (
        F.when(
            F.col("_method") == "subscribe",
            F.when(
                ~F.coalesce(P.kind(F.col("_result")) == "OBJECT", F.lit(False)) | ~P.has_text(F.col("_result"), "channel"),
                "invalid",
            )
            .when(other_symbol.isNotNull() & (other_symbol != mine), "unsupported")
            .when(F.col("_success") == "false", "error")
            .otherwise("acknowledgement"),
        )
        .when(F.col("_method") == "error", F.when(P.has_text(body, "error"), "error").otherwise("invalid"))
        .when(chan.isNull(), "invalid")
        .when(chan.isin("trade", "ticker") & ~F.col("_listed"), "invalid")
        .when(chan.isin("trade", "ticker") & (F.size("_mine") == 0), "unsupported")
        .when(chan == "trade", "trade")
        .when(chan == "ticker", "quote")
        .when(chan == "heartbeat", "heartbeat")
        .when(chan == "status", "status")
        .otherwise("unsupported")
    )
    kinds = (
        F.when(F.col("payload").isNull(), "undecodable")
        .when(~F.col("_object"), "not_object")
        .when(F.col("_first"), venue_1)
        .otherwise(venue_2)
    )
    placed = decoded.withColumn("_kind", kinds)
    records = (
        F.when(F.col("_kind").isin("trade", "quote") & F.col("_first"), F.array(body))
        .when(F.col("_kind").isin("trade", "quote"), F.col("_mine"))
    )
    # Frames of venue 1 are their one record; those of venue 2 hold several.
    sound = F.lit(True)
    for kind, shapes in (("trade", TRADE_SHAPE), ("quote", QUOTE_SHAPE)):
        met = F.when(F.col("_first"), _valid(body, shapes[VENUE_1])).otherwise(F.forall("_mine", _validator(shapes[VENUE_2])))
        sound = F.when(F.col("_kind") == kind, met).otherwise(sound)
    placed = placed.withColumn("records", records).withColumn("_sound", sound)
    # Venue 1 acknowledgements carry no "subscription" wording in their summary text apart from the type itself.
    final = (
        F.when(~F.col("_sound"), "invalid").when(F.col("_kind") == "acknowledgement_1", "acknowledgement")
        .otherwise(F.col("_kind"))
    )
    out = placed.select(
        *frames.columns,
        "payload",
        final.alias("result_kind"),
        F.when(F.col("_first"), F.when(typ.isin("match", "last_match"), "matches").otherwise(typ))
        .otherwise(F.coalesce(F.when(F.col("_method") == "subscribe", P.text_of(F.col("_result"), "channel")), chan))
        .alias("channel"),
        F.when(F.col("_first"), typ)
        .when(
            F.col("_object"),
            F.when(F.col("_method").isin("subscribe", "error"), F.col("_method"))
            .otherwise(F.coalesce(P.text_of(body, "type"), F.lit("update")))
        ).alias("message"),
        F.substring(
            F.when(
                F.col("_kind") == "error",
                F.when(F.col("_first"), P.text_of(body, "message")).otherwise(
                    F.coalesce(
                        P.text_of(body, "error"), P.text_of(F.col("_result"), "error"),
                        F.lit("kraken subscription error"),
                    )
                ),
            ), 1, REASON_TEXT,
        ).alias("detail"),
        F.when(final.isin("trade", "quote"), F.col("records")).alias("records"),
    )
    return settled(out, "payload", "result_kind", "channel", "message", "detail", "records")


def outcome(kind: Column, records: Column) -> Column:
    """Outcome code of a frame.  Several quotes in one frame have no code of their own, as in the stored tables."""
    return (
        F.when(kind == "undecodable", "JSON_DECODE_ERROR")
        .when(kind.isin("not_object", "invalid"), "PARSE_ERROR")
        .when((kind == "trade") & (F.size(records) > 1), "NORMALIZED_MULTIPLE_TRADES")
        .when(kind == "trade", "NORMALIZED_TRADE")
        .when((kind == "quote") & (F.size(records) == 1), "NORMALIZED_TOP_OF_BOOK")
        .when(kind == "heartbeat", "HEARTBEAT")
        .when(kind == "acknowledgement", "SUBSCRIPTION_ACKNOWLEDGEMENT")
        .when(kind == "status", "STATUS_MESSAGE")
        .when(kind == "control", "CONTROL_MESSAGE")
        .when(kind == "unsupported", "UNSUPPORTED_MESSAGE")
        .when(kind == "error", "EXCHANGE_ERROR")
        .otherwise("NO_NORMALIZED_EVENT")
    )


def _pick(shapes: dict[str, RecordShape], get) -> Column:
    return F.when(F.col("venue") == VENUE_1, get(shapes[VENUE_1])).otherwise(get(shapes[VENUE_2]))


def market_records(classified: DataFrame, kind: str, fields: Sequence[str] | None = None) -> DataFrame:
    """One row per trade or quote record: child index after the symbol filter, numbers as exact text.

    ``fields`` names the fields of a record that are wanted, all when missing; what is not named is not read.
    """
    shapes = TRADE_SHAPE if kind == "trade" else QUOTE_SHAPE
    kept = [c for c in classified.columns if c not in ("payload", "records")]
    rows = classified.where(F.col("result_kind") == kind).select(
        *kept, F.posexplode("records").alias("child_index", "record")
    )
    record = F.col("record")
    found = {
        "event_ts": _pick(shapes, lambda s: P.time_of(record, s.time)),
        "event_ts_text": _pick(shapes, lambda s: P.text_of(record, s.time)),
        **{n: _pick(shapes, lambda s, n=n: P.text_of(record, s.numbers[n])) for n in shapes[VENUE_1].numbers},
        "source_sequence": F.when(F.col("venue") == VENUE_1, P.text_of(record, "sequence"))
        .otherwise(P.text_of(record, "trade_id") if kind == "trade" else F.lit(None)),
    }
    if kind == "trade":
        found |= {"trade_id": P.text_of(record, "trade_id"), "aggressor_side": aggressor(F.col("venue"), P.text_of(record, "side"))}
    names = [n for n in found if fields is None or n in fields]
    return settled(rows.select(*kept, "child_index", *[found[n].alias(n) for n in names]), "child_index", *names)
