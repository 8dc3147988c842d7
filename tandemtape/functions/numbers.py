"""Exact decimals: guards for the stored type and half-even derived values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandemtape.schemas import STORED, STORED_PRECISION, STORED_SCALE

_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(_NUMBER), F.lit(False))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def guard(text: Column) -> Column:
    """Why a number given as text cannot be stored exactly; null when it can."""
    return bind(text, _problem)


def _problem(text: Column) -> Column:
    exponent = F.coalesce(F.nullif(F.regexp_extract(text, r"[eE]([+-]?\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    body = F.regexp_replace(F.trim(F.regexp_replace(text, r"[eE].*$", "")), r"^[+-]", "")
    decimals = F.length(F.regexp_extract(body, r"\.(\d*)", 1)) - exponent
    digits = F.greatest(F.length(F.regexp_replace(F.regexp_replace(body, r"\.", ""), r"^0+", "")), F.lit(1))
    integer = F.greatest(digits - decimals, F.lit(0))
    return (
        F.when(text.isNull() | ~text.rlike(_NUMBER), F.lit("NOT_FINITE_DECIMAL"))
        .when(decimals > STORED_SCALE, F.lit("SCALE_EXCEEDED"))
        .when(integer + STORED_SCALE > STORED_PRECISION, F.lit("PRECISION_EXCEEDED"))
    )


def stored(text: Column) -> Column:
    """The exact stored value; a number that does not fit stops the job, as a silent null would lose data."""
    return bind(
        text,
        lambda t: F.when(
            t.isNotNull() & _problem(t).isNotNull(), F.raise_error(F.concat(F.lit("decimal does not fit: "), t))
        ).otherwise(t.try_cast(STORED)),
    )


# --- exact derived values -----------------------------------------------------------------------------------------------
# A stored number has up to 38 digits, so a sum may need 39, a product 76 and a quotient any number.  Spark would round
# them to fit 38.  Here a number is a whole part and its 18 places as a long, whole numbers of at most 38 digits are
# multiplied and divided block by block, and only the result is rounded, half-even, to 18 places.  A result that does not
# fit the stored type stops the job.
_WHOLE = "decimal(38,0)"


def _power(tens: int) -> Column:
    return F.lit(str(10**tens)).cast(f"decimal({tens + 1},0)")


def _quotient(value: Column, by: Column) -> Column:
    """Whole quotient of two non-negative whole decimals; the remainder is taken off first, so nothing is rounded."""
    return ((value - value % by).cast(_WHOLE) / by).cast(_WHOLE)


def _parts(value: Column) -> Column:
    """Floor of a stored number, and the rest in units of its last place."""
    places = F.pmod(value, F.lit(1).cast("decimal(1,0)"))
    return F.struct(
        F.floor(value).cast("decimal(21,0)").alias("whole"),
        ((places * _power(9)).cast("decimal(18,9)") * _power(9)).cast("bigint").alias("rest"),
    )


def _size(value: Column) -> Column:
    """The parts of the absolute value.  Decimal signs are not changed anywhere: Spark rounds a negated number to 34 digits."""
    flipped = lambda p: F.struct((-p["whole"] - (p["rest"] > 0).cast("decimal(1,0)")).cast("decimal(21,0)").alias("whole"), F.when(p["rest"] > 0, F.lit(10**18) - p["rest"]).otherwise(F.lit(0).cast("bigint")).alias("rest"))
    return bind(_parts(value), lambda p: F.when(p["whole"] < 0, flipped(p)).otherwise(p))


def _joined(whole: Column, rest: Column, minus: Column | None = None) -> Column:
    """``whole`` + ``rest`` * 10^-18 as a stored number, for a rest in -10^18 .. 3 * 10^18; with the other sign under ``minus``."""
    unit = 10**18
    carry = F.when(rest < 0, -1).when(rest >= 2 * unit, 2).when(rest >= unit, 1).otherwise(0).cast("bigint")
    placed = F.struct((whole + carry.cast("decimal(2,0)")).cast(_WHOLE).alias("w"), (rest - carry * F.lit(unit)).alias("r"))

    def written(p: Column) -> Column:
        below = (p["w"] < 0) & (p["r"] > 0)
        size = F.when(below, -p["w"] - 1).otherwise(F.abs(p["w"])).cast("string")
        places = F.when(below, F.lit(unit) - p["r"]).otherwise(p["r"]).cast("string")
        sign = p["w"] < 0 if minus is None else minus
        return F.concat(F.when(sign, "-").otherwise(""), size, F.lit("."), F.lpad(places, 18, "0"))

    fits = lambda t: F.coalesce(t.try_cast(STORED), F.raise_error(F.concat(F.lit("derived decimal does not fit: "), t)).cast(STORED))
    return bind(bind(placed, written), fits)


# Most numbers have at most nine whole digits and nine places.  Their sums and products fit 38 digits, and quotients of such numbers
# go through plain longs, so those come out of generated code; only what does not fit takes the long way.
_NARROW = "decimal(18,9)"


def _of_both(a: Column, b: Column, narrow, wide, where=None) -> Column:
    """``narrow`` of both numbers where they fit (and ``where`` holds), else ``wide`` of both stored numbers; null where one is missing.

    Hand in columns, not long expressions: both are mentioned several times.
    """
    a, b = a.cast(STORED), b.cast(STORED)
    x, y = a.try_cast(_NARROW), b.try_cast(_NARROW)
    fits = F.coalesce((x.cast(STORED) == a) & (y.cast(STORED) == b), F.lit(False))
    fits = fits if where is None else fits & where(a, b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast(STORED)).when(fits, narrow(x, y).cast(STORED)).otherwise(wide(a, b))


def _parts_of_both(a: Column, b: Column, use) -> Column:
    return bind(F.struct(_parts(a).alias("a"), _parts(b).alias("b")), use)


def total(a: Column, b: Column) -> Column:
    return _of_both(a, b, lambda x, y: x + y, lambda a, b: _parts_of_both(a, b, lambda s: _joined(s["a"]["whole"] + s["b"]["whole"], s["a"]["rest"] + s["b"]["rest"])))


def difference(a: Column, b: Column) -> Column:
    return _of_both(a, b, lambda x, y: x - y, lambda a, b: _parts_of_both(a, b, lambda s: _joined(s["a"]["whole"] - s["b"]["whole"], s["a"]["rest"] - s["b"]["rest"])))


def times(value: Column, tens: int) -> Column:
    """``value`` * 10^``tens`` for a few tens."""
    value = value.cast(STORED)
    small = value.try_cast("decimal(28,18)")
    return F.when(value.isNull(), F.lit(None).cast(STORED)).when(small.isNotNull(), (small * _power(tens)).cast(STORED)).otherwise(product(value, _power(tens)))


def midpoint(a: Column, b: Column) -> Column:
    """Half of the sum, half-even."""

    def halved(s: Column) -> Column:
        whole, rest = s["a"]["whole"] + s["b"]["whole"], s["a"]["rest"] + s["b"]["rest"]
        odd = F.pmod(whole, F.lit(2).cast("decimal(1,0)"))
        return bind(
            F.struct(((whole - odd) * F.lit("0.5").cast("decimal(1,1)")).cast("decimal(22,0)").alias("w"), (rest + odd.cast("bigint") * F.lit(10**18)).alias("r")),
            lambda t: bind(F.struct(t["w"].alias("w"), F.shiftright(t["r"], 1).alias("q"), (t["r"] % 2).alias("odd")), lambda h: _joined(h["w"], h["q"] + h["odd"] * (h["q"] % 2))),
        )

    return _of_both(a, b, lambda x, y: (x + y) * F.lit("0.5").cast("decimal(1,1)"), lambda a, b: _parts_of_both(a, b, halved))


def product(a: Column, b: Column) -> Column:
    """a * b to 18 places, half-even."""

    def crossed(s: Column) -> Column:
        aw, bw = s["a"]["whole"].cast("decimal(20,0)"), s["b"]["whole"].cast("decimal(20,0)")
        ar, br = s["a"]["rest"].cast("decimal(18,0)"), s["b"]["rest"].cast("decimal(18,0)")
        return F.struct((aw * bw).cast(_WHOLE).alias("high"), ((aw * br).cast(_WHOLE) + (ar * bw).cast(_WHOLE)).cast(_WHOLE).alias("middle"), (ar * br).cast(_WHOLE).alias("low"))

    def carried(s: Column) -> Column:
        middle = (s["middle"] + _quotient(s["low"], _power(18))).cast(_WHOLE)
        return F.struct(s["high"].alias("high"), middle.alias("middle"), (s["low"] % _power(18)).cast("bigint").alias("cut"))

    def rounded(s: Column, minus: Column) -> Column:
        half, odd = F.lit(5 * 10**17), s["middle"] % 2 == 1
        up = (s["cut"] > half) | ((s["cut"] == half) & odd)
        return _joined((s["high"] + _quotient(s["middle"], _power(18))).cast(_WHOLE), (s["middle"] % _power(18)).cast("bigint") + up.cast("bigint"), minus)

    return _of_both(a, b, lambda x, y: x * y, lambda a, b: bind(bind(bind(F.struct(_size(a).alias("a"), _size(b).alias("b")), crossed), carried), lambda s: rounded(s, (a < 0) != (b < 0))))


def ratio(a: Column, b: Column) -> Column:
    """a / b to 18 places, half-even; null where b is 0.

    Whole quotient first, then two blocks of nine digits from the exact remainders.  A base of 10^11 and more leaves no room for nine
    digits beside its remainder in 38; its digits come one by one from sums that are reduced before they are taken.
    """
    units = lambda p: (p["whole"].cast("decimal(20,0)") * _power(18)).cast(_WHOLE) + p["rest"].cast("decimal(18,0)")

    def whole(s: Column) -> Column:
        value, by = units(s["a"]).cast(_WHOLE), units(s["b"]).cast(_WHOLE)
        return bind(F.struct(value.alias("value"), by.alias("by")), lambda v: F.struct(_quotient(v["value"], v["by"]).alias("q"), (v["value"] % v["by"]).cast(_WHOLE).alias("left"), v["by"].alias("by")))

    def block(s: Column) -> Column:
        """The next nine digits behind those found in ``digits``."""
        return bind(
            (s["left"].cast("decimal(29,0)") * _power(9)).cast(_WHOLE),
            lambda wide: F.struct((s["digits"] * F.lit(10**9) + _quotient(wide, s["by"]).cast("bigint")).alias("digits"), (wide % s["by"]).cast(_WHOLE).alias("left"), s["by"].alias("by")),
        )

    def plus(x: Column, y: Column, by: Column) -> Column:
        """Sum of (digits, left) pairs below ``by``, without passing it."""
        over = x["left"] >= by - y["left"]
        return F.struct((x["digits"] + y["digits"] + over.cast("bigint")).alias("digits"), F.when(over, x["left"] - (by - y["left"])).otherwise(x["left"] + y["left"]).cast(_WHOLE).alias("left"))

    def one_by_one(s: Column) -> Column:
        twice = lambda x: bind(x, lambda v: plus(v, v, s["by"]))

        def tenfold(x: Column) -> Column:
            return bind(twice(x), lambda two: bind(twice(twice(two)), lambda eight: plus(two, eight, s["by"])))

        start = F.struct(F.lit(0).cast("bigint").alias("digits"), s["left"].alias("left"))
        return bind(F.aggregate(F.sequence(F.lit(1), F.lit(18)), start, lambda x, _: tenfold(x)), lambda r: F.struct(r["digits"].alias("digits"), r["left"].alias("left"), s["by"].alias("by")))

    def rounded(s: Column, places: Column, minus: Column) -> Column:
        rest = places["by"] - places["left"]
        up = (places["left"] > rest) | ((places["left"] == rest) & (places["digits"] % 2 == 1))
        return _joined(s["q"], places["digits"] + up.cast("bigint"), minus)

    def places(s: Column, minus: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("digits"), s["left"].alias("left"), s["by"].alias("by"))
        found = F.when(s["by"] < _power(29), bind(block(start), block)).otherwise(one_by_one(s))
        return bind(found, lambda p: rounded(s, p, minus))

    def long_way(a: Column, b: Column) -> Column:
        sizes = F.struct(_size(a).alias("a"), _size(b).alias("b"))
        return F.when(b != 0, bind(bind(sizes, whole), lambda s: places(s, (a < 0) != (b < 0))))

    def in_longs(s: Column) -> Column:
        """Digits in steps of four, from remainders that leave room for them; both numbers are longs of 10^-9."""
        value, by, sign = F.abs(s["x"]), F.abs(s["y"]), F.when((s["x"] < 0) != (s["y"] < 0), -1).otherwise(1).cast("bigint")
        left, digits = value % by, F.lit(0).cast("bigint")
        for step in (10**4, 10**4, 10**4, 10**4, 10**2):
            digits, left = digits * step + F.call_function("div", left * step, by), (left * step) % by
        return bind(
            F.struct(digits.alias("digits"), left.alias("left"), by.alias("by"), (F.call_function("div", value, by) * sign).alias("whole"), sign.alias("sign")), rounded_longs
        )

    def rounded_longs(s: Column) -> Column:
        up = (2 * s["left"] > s["by"]) | ((2 * s["left"] == s["by"]) & (s["digits"] % 2 == 1))
        behind = ((s["sign"] * (s["digits"] + up.cast("bigint"))).cast("decimal(19,0)") * F.lit("1e-18").cast("decimal(18,18)")).cast("decimal(19,18)")
        return (s["whole"].cast("decimal(19,0)") + behind).cast(STORED)

    def narrow(x: Column, y: Column) -> Column:
        longs = F.struct(*[(v * _power(9)).cast("bigint").alias(n) for n, v in (("x", x), ("y", y))])
        return F.when(y != 0, bind(longs, in_longs))

    return _of_both(a, b, narrow, long_way, lambda a, b: (b > -900_000) & (b < 900_000))
