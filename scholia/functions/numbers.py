"""Column functions over numbers, dates and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date patterns in the order tried.
DATE_PATTERNS = [
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM",
    "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy/MM",
    "yyyy.MM.dd", "yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy.MM",
]


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def level(x: Column) -> Column:
    """L below 0.34, M below 0.67, else H."""
    return F.when(x < 0.34, "L").when(x < 0.67, "M").otherwise("H")


def finite(x: Column, default: float = 0.0) -> Column:
    number = x.try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(default)).otherwise(number)


def exact(x: Column, places: int = 18) -> Column:
    """A double by its shortest decimal form; null where that has more places or digits than fit."""
    found = x.cast("string").try_cast(f"decimal(37,{places})")
    return F.when(found.cast("double") == x, found)


def added(a: Column, b: Column) -> Column:
    """a + b of the shortest decimal forms, as a double; the doubles' own sum where a form has over 18 places or digits."""
    return F.coalesce((exact(a) + exact(b)).cast("double"), a + b)


def subtracted(a: Column, b: Column) -> Column:
    """a - b likewise."""
    return F.coalesce((exact(a) - exact(b)).cast("double"), a - b)


def multiplied(a: Column, b: Column) -> Column:
    """a * b of the shortest decimal forms, as a double; the doubles' own product where a form has over 9 places or digits."""
    x, y = (c.cast("string").try_cast("decimal(18,9)") for c in (a, b))
    return F.when((x.cast("double") == a) & (y.cast("double") == b), (x * y).cast("double")).otherwise(a * b)


def divided(a: Column, b: Column, places: int = 10) -> Column:
    """Half up; zero over anything is zero, anything else over zero an error.

    Exact for operands with up to 9 places and quotients below 10 ** (18 - places); else the doubles' quotient.
    """
    if places < 0:
        raise ValueError("places must not be negative")
    x, y = (c.cast("string").try_cast("decimal(19,9)") for c in (a, b))
    whole = (x.cast("double") == a) & (y.cast("double") == b)
    quotient = F.when(whole, F.round(x / y, places).cast(f"decimal(38,{places})")).otherwise(F.round(a / b, places).try_cast(f"decimal(38,{places})"))
    return F.when(a == 0, F.lit(0).cast(f"decimal(38,{places})")).otherwise(F.when(b == 0, F.raise_error(F.lit("division by zero"))).otherwise(quotient))


def megabytes(n: Column) -> Column:
    """A count of bytes as megabytes, half up to two places."""
    hundredths = F.floor((n.cast("decimal(20,0)") * 200 + 1048576) / 2097152)
    return hundredths.cast("double") / 100


def parsed_date(text: Column) -> Column:
    """The first of the patterns that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(p)) for p in DATE_PATTERNS])


def whole_days(a: Column, b: Column) -> Column:
    """Days between two times, without their fraction or sign."""
    return F.floor(F.abs(F.unix_micros(a) - F.unix_micros(b)) / 86_400_000_000).cast("long")


def spelled_span(seconds: Column) -> Column:
    """`d days h hours m minutes`."""
    s = seconds.cast("long")
    return F.concat(F.floor(s / 86400).cast("string"), F.lit(" days "), F.floor(s % 86400 / 3600).cast("string"), F.lit(" hours "), F.floor(s % 3600 / 60).cast("string"), F.lit(" minutes"))


def ip_number(ip: Column) -> Column:
    """A dotted address as one number; null if it isn't one."""
    p = F.split(ip, r"\.")
    byte = r"(25[0-5]|2[0-4]\d|1\d\d|\d?\d)"
    return F.when(ip.rlike(rf"^{byte}(\.{byte}){{3}}$"), ((p[0].cast("long") * 256 + p[1].cast("long")) * 256 + p[2].cast("long")) * 256 + p[3].cast("long"))


def ip_allowed(ip: Column, rules: list[str]) -> Column:
    """Whether ip is in a list of addresses, `10.0.*.*` and `10.0.0.1-10.0.0.9`."""
    found = F.lit(False)
    for rule in rules:
        low, _, high = rule.partition("-")
        low, high = low.replace("*", "0"), (high or low).replace("*", "255")
        number = lambda x: sum(int(b) << 8 * (3 - i) for i, b in enumerate(x.split(".")))
        found = found | ip_number(ip).between(number(low), number(high))
    return found


def internal_ip(ip: Column) -> Column:
    return ip_allowed(ip, ["10.*.*.*", "172.16.0.0-172.31.255.255", "192.168.*.*", "127.*.*.*"])


def epsilon(step: Column, start: float, end: float, steps: int) -> Column:
    """Linear from start to end over so many steps, end from there on."""
    return F.lit(start) + (F.lit(end) - F.lit(start)) * F.least(F.lit(1.0), step / F.lit(float(steps)))
