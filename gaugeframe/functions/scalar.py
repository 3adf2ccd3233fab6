"""Column expressions: digests, reproducible draws, geometry, rates and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two-sided 95 % normal quantile and the upload limits.
Z95 = 1.959963984540054
MAX_BYTES = 10 * 1024 * 1024
MAX_PIXELS = 20_000_000
MIN_SIDE = 16
MAX_SIDE = 2048


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def sized_content_hash(width: Column, height: Column, content: Column) -> Column:
    """Hash of the size together with the content, so equal bytes of another shape differ."""
    size = F.concat(F.lit("("), width.cast("string"), F.lit(", "), height.cast("string"), F.lit(")"))
    return F.sha2(F.concat(size.cast("binary"), content.cast("binary")), 256)


def row_digest(names: Sequence[str]) -> Column:
    """Digest of a record, independent of column order; length prefixes keep it injective."""
    parts = []
    for name in sorted(names):
        text = F.col(name).cast("string")
        parts.append(F.coalesce(
            F.concat(F.lit(f"{name}:"), F.length(text).cast("string"), F.lit(":"), text, F.lit(";")),
            F.lit(f"{name}:-;")))
    return F.sha2(F.concat(*parts), 256)


def hex_word(digest: Column, word: int = 0) -> Column:
    """The word-th group of eight hex digits of a digest, as a number below 2^32."""
    return F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("bigint")


def draw(seed: int | str, *columns: Column) -> Column:
    """A number below 2^32 that depends on the seed and the columns only."""
    parts = [F.lit(str(seed))] + [c.cast("string") for c in columns]
    return hex_word(F.sha2(F.concat_ws("|", *parts), 256))


def unit(number: Column) -> Column:
    return number / F.lit(4294967296.0)


def order_bits(value: Column) -> Column:
    """The 64 bits of a double as a bigint in the order of the doubles: both zeros are 0, NaN is largest, NULL stays."""
    a = F.abs(value)
    finite = F.when((a > 0) & (a < float("inf")), a)
    guess = F.floor(F.log2(finite)).cast("int")
    two = lambda e: F.pow(F.lit(2.0), e)                   # powers of two are exact
    e = F.when(two(guess) > finite, guess - 1).when(two(guess + 1) <= finite, guess + 1).otherwise(guess)
    normal = (e + 1023).cast("bigint") * 2 ** 52 + ((finite / two(e) - 1) * 2.0 ** 52).cast("bigint")
    size = (F.when(F.isnan(value), F.lit(2 ** 63 - 1)).when(a == float("inf"), F.lit(2047 * 2 ** 52)).when(a == 0, F.lit(0))
            .when(a < 2.0 ** -1022, (finite / 5e-324).cast("bigint")).otherwise(normal)).cast("bigint")
    return F.when(value.isNotNull(), F.when(value < 0, -size).otherwise(size))


def harmonic_mean(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_divide(2 * a * b, a + b), F.lit(0.0)))


def valid_unit(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & value.between(0, 1), F.lit(False))


def wilson(successes: Column, trials: Column, z: float = Z95) -> Column:
    """Score interval as struct(lower, upper); NULL without trials, an error on impossible counts."""
    s, n = successes.cast("double"), trials.cast("double")
    p = F.try_divide(s, n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / scale
    radius = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / scale
    bad = (n < 0) | (s < 0) | (s > n)
    return (F.when(bad, F.raise_error(F.lit("successes must lie between 0 and trials")).cast("struct<lower:double,upper:double>"))
            .when(n > 0, F.struct(F.greatest(F.lit(0.0), centre - radius).alias("lower"),
                                  F.least(F.lit(1.0), centre + radius).alias("upper"))))


def letterbox(width: Column, height: Column, target_width: int, target_height: int) -> dict[str, Column]:
    """Fit into the target keeping the aspect ratio; halves round to even."""
    scale = F.least(F.lit(float(target_width)) / width, F.lit(float(target_height)) / height)
    new_width = F.greatest(F.lit(1), F.bround(width * scale).cast("int"))
    new_height = F.greatest(F.lit(1), F.bround(height * scale).cast("int"))
    return {
        "scale": scale,
        "resized_width": new_width,
        "resized_height": new_height,
        "left_offset": F.floor((F.lit(target_width) - new_width) / 2).cast("int"),
        "top_offset": F.floor((F.lit(target_height) - new_height) / 2).cast("int"),
        "valid_area": (new_width * new_height).cast("bigint"),
    }


def size_reason(size_bytes: Column, width: Column, height: Column) -> Column:
    """Why an upload is refused, NULL when it is accepted."""
    return (F.when(size_bytes > MAX_BYTES, "bytes")
            .when(width.cast("bigint") * height > MAX_PIXELS, "pixels")
            .when((F.least(width, height) < MIN_SIDE) | (F.greatest(width, height) > MAX_SIDE), "dimensions"))


def unsafe_path(path: Column) -> Column:
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def standardised_partial_area(area: Column, limit: float) -> Column:
    """Rescale a partial area so that chance is 0.5 and perfection is 1."""
    low, high = 0.5 * limit * limit, limit
    return 0.5 * (1 + (area - low) / (high - low))
