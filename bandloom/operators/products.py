"""Spectra as products: restoring, retaining, selecting, averaging.

The 16 products of four channels are the four autos and, of each pair, a real and an imaginary part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REFERENCE_SLICE = 31
PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]
#: (product, a, b, part): autos first, then the pairs' real and imaginary parts.
PRODUCTS = [(c, c, c, "auto") for c in range(4)] + [(4 + 2 * k + i, a, b, part) for k, (a, b) in enumerate(PAIRS) for i, part in enumerate(("re", "im"))]


def product_dimension(spark: SparkSession) -> DataFrame:
    """The 16 rows of the product axis."""
    return spark.createDataFrame(PRODUCTS, "product int, a int, b int, part string")


def covariance_labels() -> list[str]:
    """The order of a covariance's products: each auto before the pairs it leads, parts interleaved."""
    out = []
    for a in range(4):
        out.append(f"{a}{a}R")
        out += [f"{a}{b}{p}" for b in range(a + 1, 4) for p in "RI"]
    return out


def normalise_products(wanted: str | list) -> list[str]:
    """Labels for ``all``, tokens such as ``00``, ``01R``, ``01C`` (both parts) or pairs of channels; unknown ones raise."""
    if wanted == "all":
        return covariance_labels()
    out = []
    for w in [wanted] if isinstance(wanted, str) else wanted:
        token = f"{w[0]}{w[1]}" if isinstance(w, tuple) else str(w)
        pair, part = token[:2], token[2:].upper() or ("R" if token[0] == token[1:2] else "C")
        names = [f"{pair}R", f"{pair}I"] if part == "C" and pair[0] != pair[1] else [f"{pair}{'R' if part == 'C' else part}"]
        for n in names:
            if n not in covariance_labels():
                raise ValueError(f"no such product: {w!r}")
            out.append(n)
    return list(dict.fromkeys(out))


def parse_token(token: str) -> tuple[int, int, str, int]:
    """(a, b, part, sign) of ``00``, ``01R``, ``01I``, ``01C``, ``-01R``; part is auto, re, im or complex. Channels in falling
    order mirror the product: the imaginary part changes its sign."""
    sign, body = (-1, token[1:]) if token.startswith("-") else (1, token)
    if len(body) not in (2, 3) or not body[:2].isdigit() or max(map(int, body[:2])) > 3 or body[2:].upper() not in ("", "R", "I", "C"):
        raise ValueError(f"not a product: {token!r}")
    a, b, part = int(body[0]), int(body[1]), body[2:].upper()
    if a == b:
        return a, b, "auto", sign
    return a, b, {"R": "re", "I": "im", "C": "complex", "": "complex"}[part], sign


def select_product(df: DataFrame, keys: list[str], token: str, product: str = "product", value: str = "value") -> DataFrame:
    """keys and value of one product; a complex one is a struct (re, im) built by one grouping of its two parts."""
    a, b, part, sign = parse_token(token)
    lo, hi, mirrored = min(a, b), max(a, b), -1 if a > b else 1
    number = {(x, y, p): n for n, x, y, p in PRODUCTS}
    if part == "auto":
        return df.filter(F.col(product) == number[a, a, "auto"]).select(*keys, (sign * F.col(value)).alias(value))
    if part in ("re", "im"):
        s = sign * (mirrored if part == "im" else 1)
        return df.filter(F.col(product) == number[lo, hi, part]).select(*keys, (s * F.col(value)).alias(value))
    re, im = number[lo, hi, "re"], number[lo, hi, "im"]
    both = df.filter(F.col(product).isin(re, im)).groupBy(*keys).agg(F.max(F.when(F.col(product) == re, F.col(value))).alias("re"), F.max(F.when(F.col(product) == im, F.col(value))).alias("im"))
    return both.select(*keys, F.struct((sign * F.col("re")).alias("re"), (sign * mirrored * F.col("im")).alias("im")).alias(value))


def restore_slices(df: DataFrame, data: str, bit_slice: str) -> DataFrame:
    """Multiply each bin by 2^(slice - 31), once: rows with restored = true stay as they are."""
    factor = F.pow(F.lit(2.0), F.col(bit_slice) - REFERENCE_SLICE)
    done = F.coalesce(F.col("restored"), F.lit(False)) if "restored" in df.columns else F.lit(False)
    return df.withColumn(data, F.when(done, F.col(data)).otherwise(F.transform(data, lambda x: x * factor))).withColumn("restored", F.lit(True))


def slice_violations(df: DataFrame, slices: str) -> DataFrame:
    """Rows whose slices are not 16 whole finite numbers from 0 to 31."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (x != F.floor(x)) | (x < 0) | (x > 31)
    return df.filter(F.col(slices).isNull() | (F.size(slices) != 16) | F.exists(slices, bad))


def retain(df: DataFrame, data: str) -> DataFrame:
    """Rows with a finite value anywhere; indices are to be given before."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.filter(F.exists(data, ok))


def number_rows(df: DataFrame, keys: list[str], order: list, name: str = "orig_idx") -> DataFrame:
    """The row's index within its session, from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def bins(df: DataFrame, data: str, keep: list[str], first: int = 0, count: int | None = None) -> DataFrame:
    """One row per bin (keep, bin, value); a range of bins is cut out before the explosion. NaN becomes null."""
    cut = F.slice(data, first + 1, count) if count is not None else F.slice(data, first + 1, F.greatest(F.size(data) - first, F.lit(0)))
    out = df.select(*keep, F.posexplode(cut).alias("bin", "value"))
    return out.withColumn("bin", F.col("bin") + first).withColumn("value", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")))


def mean_spectrum(rows: DataFrame, keys: list[str], value: str = "value", positive: Column | None = None) -> DataFrame:
    """Mean and population deviation per key and bin; only positive values where ``positive`` holds."""
    v = F.col(value) if positive is None else F.when(~positive | (F.col(value) > 0), F.col(value))
    return rows.groupBy(*keys, "bin").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))


def waterfall(rows: DataFrame, t: Column, step: float, keys: list[str], is_auto: Column, value: str = "value") -> DataFrame:
    """Mean per time step and bin of log10 of positive autos, and of crosses as they are."""
    v = F.when(~is_auto, F.col(value)).when(F.col(value) > 0, F.log10(F.col(value) + 1e-10))
    return rows.groupBy(*keys, F.floor(t / step).cast("long").alias("step"), "bin").agg(F.avg(v).alias("level"))


def sized(array: Column, size: int, fill=0.0) -> Column:
    """The array cut or padded to ``size``."""
    return F.slice(F.concat(F.coalesce(array, F.array().cast("array<double>")).cast("array<double>"), F.array_repeat(F.lit(float(fill)), size)), 1, size)


def _fits(array: Column, size: int) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(array) == size) & ~F.exists(array, bad), F.lit(False))


def exactly_sized(array: Column, size: int) -> Column:
    """The array if it has ``size`` finite values, else null."""
    return F.when(_fits(array, size), array)


def size_violations(df: DataFrame, arrays: dict[str, tuple[Column, int]]) -> DataFrame:
    """name and n: how many rows have no array of exactly so many finite values in each of ``arrays``; only where there are."""
    counts = df.agg(*[F.count_if(~_fits(c, n)).alias(name) for name, (c, n) in arrays.items()])
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("n")) for name in arrays])
    return counts.select(F.inline(each)).filter("n > 0")


def max_inner_shape(df: DataFrame, data: str) -> DataFrame:
    """One row: the greatest outer and inner length of the nested arrays ``data``; 0 where there are none."""
    inner = F.aggregate(F.coalesce(data, F.array().cast("array<array<double>>")), F.lit(0), lambda m, x: F.greatest(m, F.coalesce(F.size(x), F.lit(0))))
    return df.agg(F.coalesce(F.max(F.size(data)), F.lit(0)).alias("outer"), F.coalesce(F.max(inner), F.lit(0)).alias("inner"))


def common_keys(rows: DataFrame, attributes: str) -> DataFrame:
    """Keys of the map column ``attributes`` that every row has."""
    total = rows.select(F.count("*").alias("total"))
    keys = rows.select(F.explode(F.map_keys(attributes)).alias("key")).groupBy("key").count()
    return keys.crossJoin(F.broadcast(total)).filter("count = total").select("key")


def widen(long: DataFrame, keys: list[str], channel: str, value: str, names: list[str]) -> DataFrame:
    """Dynamic channels as columns, of the given names: the mean where a key has several values."""
    return long.groupBy(*keys).pivot(channel, names).agg(F.avg(value))


def cube(rows: DataFrame, keys: list[str], data: str, product: str = "product", n: int = 16) -> DataFrame:
    """keys and ``cube``, n products by the greatest number of averages by the greatest length that the key's nested arrays
    ``data`` have; what a product lacks is null. Products outside the axis go; of rows with the same product the greatest
    array stands; a key without any product has no row. At most n rows of a key meet, since repeats go first."""
    good = rows.filter(F.col(product).between(0, n - 1) & F.col(data).isNotNull())
    one = good.groupBy(*keys, product).agg(F.max(data).alias("_d"))
    inner = F.aggregate("_d", F.lit(0), lambda m, x: F.greatest(m, F.coalesce(F.size(x), F.lit(0))))
    g = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(product, "_d"))).alias("_by"), F.max(F.size("_d")).alias("_n"), F.max(inner).alias("_m"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda p: F.transform(upto("_n"), lambda i: F.transform(upto("_m"), lambda j: F.get(F.get(F.try_element_at("_by", p), i), j)))
    return g.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell).alias("cube"))


def fixed_cube(data: Column, n: int = 16, size: int = 2048) -> Column:
    """n arrays of ``size`` values of a nested array: longer ones are cut, what is lacking is null. A flat spectrum is given
    as an array that holds it alone."""
    fill = F.array_repeat(F.lit(None).cast("double"), size)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.slice(F.concat(F.coalesce(F.get(data, p), F.array().cast("array<double>")), fill), 1, size))
