"""Column-level helpers (all built-in Spark expressions, codegen friendly)."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's Double.MIN_VALUE / Double.MAX_VALUE: the seeds of the reference's
# max/min accumulators.  An extreme that never moved off its seed is
# reported as 0.0.
JAVA_DOUBLE_MIN = 5e-324
JAVA_DOUBLE_MAX = 1.7976931348623157e308


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def metrics_key(category: Column | str = "category",
                region: Column | str = "region") -> Column:
    """Kafka message key ``category#region`` (a null side prints as "null",
    like Java string concatenation)."""
    return F.concat(F.coalesce(col(category), F.lit("null")), F.lit("#"),
                    F.coalesce(col(region), F.lit("null")))


def safe_div(num: Column | str, den: Column | str) -> Column:
    """num / den, 0.0 when den is not positive."""
    return F.when(col(den) > 0, col(num) / col(den)).otherwise(F.lit(0.0))


# Steps of the fixed-point sum: ten-thousandths, in limbs of 20 bits and above.
_PARTS, _LIMB = 10_000, 20


def exact_sum(c: Column | str) -> Column:
    """AGG-2: sum of doubles that does not depend on the order or grouping of
    the rows.  Values that are ten-thousandths (money) below 9e11 are added as
    integers, in two limbs of 64 bits that no real table overflows (about 1e9
    rows of the largest such value), and the exact total is rounded once.  Any
    other value is added as a double; NaN and infinities come out as they do
    from ``sum``.  Null rows are ignored; null if there is no other."""
    v = col(c)
    k = F.rint(v * F.lit(float(_PARTS)))
    ok = F.coalesce((F.abs(v) < F.lit(9e11)) & (k / F.lit(float(_PARTS)) == v), F.lit(False))
    n = k.try_cast("long")
    high = F.sum(F.when(ok, F.shiftright(n, _LIMB))).cast("decimal(38,0)")
    low = F.sum(F.when(ok, n.bitwiseAND(F.lit((1 << _LIMB) - 1).cast("long")))).cast("decimal(38,0)")
    unit = F.lit(Decimal(1) / _PARTS)
    fixed = ((high * F.lit(1 << _LIMB).cast("decimal(8,0)") + low).cast("decimal(34,0)") * unit).cast("double")
    rest = F.sum(F.when(~ok, v))
    return F.when(rest.isNull(), fixed).otherwise(F.coalesce(fixed, F.lit(0.0)) + rest)


def reported_max(raw_max: Column | str) -> Column:
    """Largest amount, or 0.0 when no amount beat Double.MIN_VALUE."""
    m = col(raw_max)
    return F.when(m > F.lit(JAVA_DOUBLE_MIN), m).otherwise(F.lit(0.0))


def reported_min(raw_min: Column | str) -> Column:
    """Smallest amount, or 0.0 when no amount was below Double.MAX_VALUE."""
    m = col(raw_min)
    return F.when(m < F.lit(JAVA_DOUBLE_MAX), m).otherwise(F.lit(0.0))


def fixed(x: Column | str, decimals: int = 2, missing: str | None = None) -> Column:
    """``%.Nf`` text (Java formatter, HALF_UP); ``missing`` replaces null."""
    v = col(x)
    out = F.when(v.isNotNull(), F.format_string(f"%.{int(decimals)}f", v))
    return F.coalesce(out, F.lit(missing)) if missing is not None else out


def threshold_status(x: Column | str, bands: Sequence[tuple[float | None, str]]) -> Column:
    """Band label for a value: ``bands`` is ``[(None, base), (t1, l1), ...]``
    ascending; a value takes the label of the highest threshold it reaches."""
    v = col(x)
    base = [label for t, label in bands if t is None]
    expr = F.lit(base[0] if base else None)
    for t, label in sorted(((t, l) for t, l in bands if t is not None), key=lambda p: p[0]):
        expr = F.when(v >= F.lit(t), F.lit(label)).otherwise(expr)
    return F.when(v.isNull(), F.lit(None)).otherwise(expr)


def value_text(x: Column | str, mapping: dict[float, str]) -> Column:
    """Exact value mapping (e.g. 0 -> INACTIVE, 1 -> PEAK); others as text."""
    v = col(x)
    expr = v.cast("string")
    for k, label in mapping.items():
        expr = F.when(v == F.lit(k), F.lit(label)).otherwise(expr)
    return expr


def epoch_ms(ts: Column | str) -> Column:
    """Epoch milliseconds of a TIMESTAMP or TIMESTAMP_NTZ (read as UTC)."""
    return F.unix_millis(col(ts).cast("timestamp"))
