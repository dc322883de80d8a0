"""Scalar column builders shared by the operators. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED_TEXT = "[REDACTED]"

# Text that marks a secret.
SECRET_MARKERS = ["api_key", "apikey", "password", "secret", "sk-", "token"]

# Accepted date spellings as (shape, format), tried in this order.
DATE_FORMATS = [
    (r"^\d{2}[A-Za-z]{3}\d{4} \d{2}:\d{2}:\d{2}$", "ddMMMyyyy HH:mm:ss"),
    (r"^\d{2}[A-Za-z]{3}\d{4}$", "ddMMMyyyy"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$", "MM/dd/yyyy HH:mm:ss"),
]


def clean(value: Column) -> Column:
    """Trimmed text; blank becomes NULL."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def to_number(value: Column) -> Column:
    return clean(value).try_cast("double")


def to_whole(value: Column) -> Column:
    """Integer, also from text such as "7.0"."""
    return clean(value).try_cast("double").cast("long")


def to_flag(value: Column) -> Column:
    text = clean(value)
    return F.when(text == "1", True).when(text == "0", False)


def to_instant(value: Column) -> Column:
    """Date text in one of the accepted spellings, as a timestamp in the session zone.

    The shape is tested first: a failed parse costs an exception, a failed match does not.
    """
    text = clean(value)
    out = F.lit(None).cast("timestamp")
    for shape, pattern in reversed(DATE_FORMATS):
        # month names parse only when capitalised
        spelled = F.initcap(text) if "MMM" in pattern else text
        out = F.when(text.rlike(shape), F.try_to_timestamp(spelled, F.lit(pattern))).otherwise(out)
    return out


def has_offset(value: Column) -> Column:
    """True for date-time text that names its UTC offset."""
    return F.coalesce(value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), F.lit(False))


def money(value: Column) -> Column:
    return F.round(value.cast("decimal(38,10)"), 2).cast("decimal(18,2)")


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL where the denominator is zero."""
    return F.when(denominator != 0, numerator.cast("double") / denominator)


def sigmoid(value: Column) -> Column:
    return 1 / (1 + F.exp(-clip(value, -35, 35)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def bin_of(value: Column, bins: int, low: float = 0.0, high: float = 1.0) -> Column:
    """Equal-width bin, first and last bin taking what lies outside."""
    # multiplied by the number of bins, not divided by a width: 0.3 of ten bins is bin 3
    raw = F.floor((value - F.lit(low)) / F.lit(high - low) * bins)
    return F.greatest(F.least(raw, F.lit(bins - 1)), F.lit(0)).cast("int")


def canonical_hash(*names: str) -> Column:
    """SHA-256 of the compact JSON of columns in name order; NaN and infinity are refused."""
    fields = [F.col(n) for n in sorted(names)]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    bad = text.rlike(r'":"?-?(NaN|Infinity)"?[,}]')
    return F.sha2(F.when(bad, F.raise_error(F.lit("a value is not finite")).cast("string")).otherwise(text), 256)


def hash_fraction(value: Column) -> Column:
    """Uniform number in [0, 1) from the first 15 hex digits of SHA-256."""
    digits = F.conv(F.substring(F.sha2(value.cast("string"), 256), 1, 15), 16, 10)
    return digits.cast("bigint").cast("double") / F.lit(float(2**60))


def hash_bucket(value: Column, n: int) -> Column:
    """SHA-256 modulo n, folded from the left in pieces of 32 bits."""
    if not 1 <= n < 1 << 31:
        raise ValueError("bucket count must be from 1 to 2^31 - 1")
    digest = F.sha2(value.cast("string"), 256)
    out = F.lit(0).cast("bigint")
    # a power of two leaves only the last piece
    for at in range(57 if n & (n - 1) == 0 else 1, 58, 8):
        piece = F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
        out = (out * F.lit(1 << 32) + piece) % n
    return out.cast("int")


def secret_like(value: Column) -> Column:
    low = F.lower(value)
    hits = [low.contains(m) for m in SECRET_MARKERS]
    found = hits[0]
    for h in hits[1:]:
        found = found | h
    return F.coalesce(found, F.lit(False))


def reasons(**checks: Column) -> Column:
    """Names of the checks that hold, in the order given.

    They are joined and split again: a lambda, as in array_compact, would have every check walked as a tree instead of compiled.
    """
    return F.array_remove(F.split(F.concat_ws("\u0001", *[F.when(cond, F.lit(name)) for name, cond in checks.items()]), "\u0001"), "")


def band(value: Column, edges: list[tuple[float, str]], last: str, missing: str | None = None) -> Column:
    """Label of the first edge that the value is below."""
    out = F.when(value.isNull(), F.lit(missing)) if missing is not None else None
    for edge, label in edges:
        cond = value < F.lit(edge)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(last))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)
