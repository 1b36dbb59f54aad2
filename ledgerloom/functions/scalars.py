"""Column expressions: no UDF, everything stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def money(x: Column) -> Column:
    """Dollars with four exact places, so that sums do not depend on row order."""
    return x.cast(MONEY)


def sum_or_zero(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def dbl(x: Column) -> Column:
    return x.cast("double")


def share(part: Column, whole: Column) -> Column:
    """Percentage of the whole; zero when the whole is zero."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(dbl(part) / dbl(whole) * 100)


def day_of_seconds(x: Column) -> Column:
    return F.to_date(F.timestamp_seconds(x))


def day_of_millis(x: Column) -> Column:
    return F.to_date(F.timestamp_millis(x))


def scale_amount(raw: Column, decimals: Column) -> Column:
    """Raw integer amount in whole units; unknown decimals give an unknown amount, never the raw one."""
    return dbl(raw) / F.pow(F.lit(10.0), decimals)


def round_cents(x: Column) -> Column:
    """Two places, halves toward plus infinity."""
    return F.floor(x * 100 + 0.5) / F.lit(100.0)


def let(value: Column, body) -> Column:
    """Compute a value once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def six_digits(x: Column) -> Column:
    """Six significant digits of the exact binary value; a true tie goes away from zero.

    Formatting would round the shortest decimal text instead, which turns a value just below a tie upwards. So the
    value is scaled by an exact power of ten, and where the scaled value looks like a tie the sign of the
    multiplication's rounding error (Dekker's product) decides.
    """
    power = lambda n: F.pow(F.lit(10.0), F.greatest(F.lit(0), n))
    split = lambda v: (v * 134217729.0) - ((v * 134217729.0) - v)

    def below_tie(size, up, scaled):
        def sign(s):
            xl, ul = size - s["xh"], up - s["uh"]
            return ((s["xh"] * s["uh"] - scaled) + s["xh"] * ul + xl * s["uh"]) + xl * ul < 0

        return let(F.struct(split(size).alias("xh"), split(up).alias("uh")), sign)

    def finish(s):
        size, places, up, down, scaled = (s[n] for n in ("size", "places", "up", "down", "scaled"))
        whole = F.floor(scaled).cast("double")
        low = F.when(places >= 0, below_tie(size, up, scaled)).otherwise(size < (whole + 0.5) * down)
        digits = F.when(scaled - whole == 0.5, F.when(low, whole).otherwise(whole + 1)).otherwise(F.floor(scaled + 0.5).cast("double"))
        return F.when(places >= 0, digits / up).otherwise(digits * down)

    def scale(s):
        scaled = F.when(s["places"] >= 0, s["size"] * s["up"]).otherwise(s["size"] / s["down"])
        return let(F.struct(s["size"].alias("size"), s["places"].alias("places"), s["up"].alias("up"), s["down"].alias("down"), scaled.alias("scaled")), finish)

    def powers(s):
        return let(F.struct(s["size"].alias("size"), s["places"].alias("places"), power(s["places"]).alias("up"), power(-s["places"]).alias("down")), scale)

    size = F.abs(x)
    places = (F.lit(5) - F.floor(F.log10(size))).cast("int")
    rounded = let(F.struct(size.alias("size"), places.alias("places")), powers)
    tiny = F.format_string("%.5e", x).cast("double")
    return F.when(x == 0, F.lit(0.0)).when(size < 1e-17, tiny).when(x.isNotNull(), F.signum(x) * rounded)


def token_cents(planck: Column, unit: Column) -> Column:
    """Integer base units to cents of one token, rounded half up on exact integers."""
    doubled = (planck * 200 + unit).cast("decimal(38,0)")
    return F.floor(doubled / (unit * 2).cast("decimal(38,0)")).cast("double") / 100


def digit_count(raw: Column) -> Column:
    """Digits of an integer amount held as text: sign, leading zeros and fraction do not count."""
    bare = F.regexp_replace(raw, r"^[-+]?0*", "")
    return F.length(F.regexp_replace(bare, r"\..*$", ""))


def normal_address(x: Column) -> Column:
    """Last forty hex digits, lower case, without prefix."""
    return F.right(F.regexp_replace(F.lower(x), "^0x", ""), F.lit(40))


def printable_or_null(hex_text: Column) -> Column:
    """Text behind a zero-padded hex field, or NULL when any byte is not printable ASCII."""
    digits = F.regexp_replace(hex_text, "^0x", "")
    packed = F.regexp_replace(F.regexp_replace(digits, "^(00)+", ""), "(00)+$", "")
    even = F.when(F.length(packed) % 2 == 1, F.concat(F.lit("0"), packed)).otherwise(packed)
    text = F.decode(F.unhex(even), "ISO-8859-1")
    return F.when(text.rlike(r"^[ -~]+$"), text)


def printable_head(hex_text: Column) -> Column:
    """Printable ASCII from the start of a hex field up to the first other byte."""
    return F.regexp_extract(F.decode(F.unhex(hex_text), "ISO-8859-1"), r"^[ -~]*", 0)


def hex_uint(hex_text: Column) -> Column:
    """Big-endian unsigned integer of at most sixteen hex digits."""
    return F.conv(hex_text, 16, 10).cast("decimal(20,0)").cast("bigint")


def swap_bytes(hex_text: Column) -> Column:
    """Byte order reversed, on the hex text: reversing a binary value would treat it as UTF-8."""
    return F.regexp_replace(F.reverse(hex_text), "(.)(.)", "$2$1")


def hex_uint_le(hex_text: Column) -> Column:
    """Little-endian unsigned integer."""
    return hex_uint(swap_bytes(hex_text))


def compound_apy(rate_ray: Column) -> Column:
    """Yearly yield in percent of a per-year rate in units of 1e-27, compounded every second."""
    seconds = F.lit(31536000.0)
    return F.expm1(seconds * F.log1p(rate_ray / F.lit(1e27) / seconds)) * 100


def gap_bps(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, b) * 10000


def percent_diff(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, b) * 100


def permill(x: Column) -> Column:
    return x / F.lit(10000.0)


def perbill(x: Column) -> Column:
    return x / F.lit(10000000.0)


def initiation_venue(operation: Column) -> Column:
    """Name before the first slash, then before the first colon; nothing there means a direct trade."""
    head = F.split_part(F.split_part(operation, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))
    return F.coalesce(F.nullif(head, F.lit("")), F.lit("Direct"))


def route_name(token_in: Column, token_out: Column) -> Column:
    return F.concat(F.coalesce(token_in, F.lit("?")), F.lit("→"), F.coalesce(token_out, F.lit("?")))


def account_label(hex_id: Column) -> Column:
    """Structural reading of a 32-byte account from its leading bytes."""
    h = F.regexp_replace(F.lower(hex_id), "^0x", "")
    tag = F.substring(h, 1, 8)
    para = hex_uint_le(F.substring(h, 9, 8))
    pallet_hex = F.substring(h, 9, 16)
    pallet_text = F.decode(F.unhex(pallet_hex), "ISO-8859-1")
    pallet = F.when(pallet_text.rlike(r"^[ -~]{8}$"), pallet_text).otherwise(F.concat(F.lit("0x"), pallet_hex))
    kind = (
        F.when(tag == F.lit("70617261"), "child")
        .when(tag == F.lit("7369626c"), "sibling")
        .when(tag == F.lit("6d6f646c"), "pallet")
    )
    is_para = kind.isin("child", "sibling")
    return F.when(
        h.rlike("^[0-9a-f]{64}$"),
        F.struct(
            kind.alias("kind"),
            F.when(is_para, para).alias("para_id"),
            F.when(kind == "pallet", pallet).alias("pallet_id"),
            F.when(is_para, F.concat(F.lit("para "), para.cast("string")))
            .when(kind == "pallet", F.concat(F.lit("pallet "), pallet))
            .alias("label"),
        ),
    )


def first_rule(rules: list[tuple[Column, str]], default: str) -> Column:
    """The first rule that holds names the row."""
    chain = F.when(rules[0][0], rules[0][1])
    for condition, name in rules[1:]:
        chain = chain.when(condition, name)
    return chain.otherwise(default)


def classified(df: DataFrame, text: str, rules: DataFrame, default: str, name: str = "route") -> DataFrame:
    """The class of each row's text by the caller's rules (prefix, class, exact): an exact rule first, else the longest prefix.

    Rules are looked up by equality on the few prefix lengths that occur, so any number of rules costs one join a length.
    A prefix that is listed twice has the class that is first in order.
    """
    kept = rules.groupBy("prefix", F.coalesce("exact", F.lit(False)).alias("exact")).agg(F.min("class").alias("class"))
    lengths = sorted(r[0] for r in kept.filter(~F.col("exact")).select(F.length("prefix")).distinct().collect())
    found = df.join(kept.filter("exact").select(F.col("prefix").alias("__whole"), F.col("class").alias("__exact")), F.col(text) == F.col("__whole"), "left").drop("__whole")
    order = [F.col("__exact")]
    for n in reversed(lengths):
        of_length = kept.filter(~F.col("exact") & (F.length("prefix") == n)).select(F.col("prefix").alias("__prefix"), F.col("class").alias(f"__class{n}"))
        found = found.join(of_length, F.substring(text, 1, n) == F.col("__prefix"), "left").drop("__prefix")
        order.append(F.col(f"__class{n}"))
    return found.withColumn(name, F.coalesce(*order, F.lit(default))).drop("__exact", *[f"__class{n}" for n in lengths])


def word_field(word: Column, low_bit: int, width: int) -> Column:
    """Unsigned field of a packed 256-bit word given as 64 hex digits; fields span whole nibbles or stay in one."""
    if low_bit % 4 == 0 and width % 4 == 0:
        start = 64 - (low_bit + width) // 4 + 1
        return F.conv(F.substring(word, start, width // 4), 16, 10).cast("decimal(20,0)").cast("bigint")
    nibble = F.conv(F.substring(word, 64 - low_bit // 4, 1), 16, 10).cast("int")
    return F.shiftright(nibble, low_bit % 4).bitwiseAND((1 << width) - 1).cast("bigint")


def block_time(block: Column, b0: Column, t0: Column, b1: Column, t1: Column) -> Column:
    """Seconds at a block by the line through two timed blocks."""
    return t0 + (block - b0) * ((t1 - t0) / (b1 - b0))


# Packed reserve configuration as (first bit, width).
RESERVE_FIELDS = {
    "ltv_bps": (0, 16),
    "liquidation_threshold_bps": (16, 16),
    "liquidation_bonus_bps": (32, 16),
    "decimals": (48, 8),
    "active": (56, 1),
    "frozen": (57, 1),
    "borrowing_enabled": (58, 1),
    "paused": (60, 1),
    "reserve_factor_bps": (64, 16),
    "borrow_cap": (80, 36),
    "supply_cap": (116, 36),
    "protocol_fee_bps": (152, 16),
    "category": (168, 8),
}


def reserve_configuration(word: Column) -> list[Column]:
    """One column per field of a packed reserve configuration."""
    return [
        (word_field(word, low, width) == 1 if width == 1 else word_field(word, low, width)).alias(name)
        for name, (low, width) in RESERVE_FIELDS.items()
    ]


def owner_kind(system: Column, label: Column, custody: str, proxy: str) -> Column:
    """Whose account a row is: protocol, another chain, a custody label, a proxy label, or nobody known."""
    text = F.lower(F.coalesce(label, F.lit("")))
    return (
        F.when(system == "pallet", "pallet")
        .when(system.isin("sibling", "child", "sovereign"), "sovereign")
        .when(text.rlike(custody), "custodial")
        .when(text.rlike(proxy), "proxy")
    )


def canonical_json(**fields: Column) -> Column:
    """Parameters as JSON with sorted keys; a NULL parameter is left out. The text is the identity."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]))
