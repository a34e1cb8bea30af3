"""Loading what was written: the files below some folders, and the kinds of many sources as one set of tables.

A source is a folder with one table a kind, as ``sinks`` writes it. What a column's values are is said in its metadata, so
sources that disagree are refused from their schemas, before a row is read.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import products, stats
from .sinks import LAYOUTS
from .tables import ContractError, read_products, terms_of, with_terms

#: Columns that a kind keeps only if all its sources have them, kinds that are kept only if all sources have them, and
#: columns whose arrays differ in length from source to source.
EVERYWHERE = {"spectra": ("mjd",), "tr_spectra": ("mjd",), "zoom": ("mjd",)}
SHARED_KINDS = ("interpolated",)
RAGGED = {"tr_spectra": ("data",)}
#: Kinds that can serve as time axis, the preferred first.
LADDER = ["spectra", "tr_spectra", "zoom", "telemetry"]


def files_below(spark: SparkSession, root: str, formats: Collection[str]) -> DataFrame:
    """root, inner (the path below it), path of all files of ``formats`` below a folder, or of the one file that ``root`` is.
    Contents are not read, and files without any do not count."""
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(formats) + "}").load(root).select("path")
    except AnalysisException as e:
        raise FileNotFoundError(root) from e
    after = F.expr(f"substring(path, instr(path, '{_quoted(base)}') + {len(base)} + 1)")
    return found.select(F.lit(root).alias("root"), F.when(after == "", F.regexp_extract("path", r"[^/]+$", 0)).otherwise(after).alias("inner"), "path")


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def resolve_paths(spark: SparkSession, roots: str | list[str], formats: list[str]) -> DataFrame:
    """root, inner, path of the files to load. Of files that differ in their suffix alone, the first of ``formats`` counts; a
    root that is not there, or has no file of these formats, raises FileNotFoundError."""
    each = [files_below(spark, r, formats) for r in dict.fromkeys([roots] if isinstance(roots, str) else roots)]
    for files, root in zip(each, dict.fromkeys([roots] if isinstance(roots, str) else roots), strict=True):
        if files.isEmpty():
            raise FileNotFoundError(f"no {' or '.join(formats)} below {root}")
    if not each:
        raise FileNotFoundError("no folder is given")
    best = stats.preferred_paths(reduce(DataFrame.unionByName, each), formats, F.regexp_replace("inner", r"\.[^./]+$", ""))
    return best.select("root", "inner", "path")


def agreed_terms(sources: dict[str, DataFrame]) -> dict[str, dict[str, str]]:
    """What each column's values are, by the metadata of all sources that have it. Sources that differ, one that says nothing
    from one that does included, raise ContractError. No row is read."""
    out: dict[str, dict[str, str]] = {}
    for column in dict.fromkeys(c for df in sources.values() for c in df.columns):
        said = {name: terms_of(df, column) for name, df in sources.items() if column in df.columns}
        if len({tuple(sorted(t.items())) for t in said.values()}) > 1:
            raise ContractError(f"sources differ in what {column} is: {said}")
        out[column] = next(iter(said.values()))
    return out


def padded(df: DataFrame, column: str) -> DataFrame:
    """Arrays, or arrays of arrays, brought to the greatest lengths of all rows with NaN; nulls stay. One aggregation finds
    the lengths."""
    nan, c = F.lit(float("nan")), F.col(column)
    kind = dict(df.dtypes)[column]
    if not kind.startswith("array<array<"):
        n = df.agg(F.coalesce(F.max(F.size(column)), F.lit(0))).first()[0]
        return df.withColumn(column, F.when(c.isNotNull(), products.sized(c, max(n, 0), float("nan"))))
    outer, inner = products.max_inner_shape(df, column).first()
    rows = F.transform(c, lambda x: products.sized(x, inner, float("nan")))
    more = F.array_repeat(F.array_repeat(nan, inner), F.greatest(outer - F.size(c), F.lit(0)))
    return df.withColumn(column, F.when(c.isNotNull(), F.concat(rows, more)))


def combine(sources: dict[str, DataFrame], everywhere: Collection[str] = (), ragged: Collection[str] = ()) -> DataFrame:
    """Rows of all sources of a kind, with the ``source`` they come from.

    Columns of ``everywhere`` are kept only if all sources have them; another column is null where its source lacks it.
    Arrays of ``ragged`` columns are padded with NaN to one shape. Sources must agree on terms (see ``agreed_terms``), and
    the result says them again. A column named ``source`` is refused.
    """
    if any("source" in df.columns for df in sources.values()):
        raise ContractError("a source has a column named source")
    terms = agreed_terms(sources)
    apart = [c for c in everywhere if not all(c in df.columns for df in sources.values())]
    out = stats.concat_sources([df.drop(*apart).withColumn("source", F.lit(name)) for name, df in sources.items()])
    for c in ragged:
        if c in out.columns:
            out = padded(out, c)
    for c, said in terms.items():
        if said and c in out.columns:
            out = with_terms(out, c, **said)
    return out


def merged_constants(rows: DataFrame, order: list[str], keys: tuple[str, ...] = ("key",), value: str = "value") -> DataFrame:
    """Per key the value of the first row in ``order``, and how many distinct values there are."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.struct(*order, value)).alias(value), F.count_distinct(value).alias("n_values"))


@dataclass(frozen=True)
class Loaded:
    """Tables by kind, the time scale, the kind that serves as time axis, and constants with their number of values."""

    tables: dict[str, DataFrame]
    scale: str
    axis: str
    constants: DataFrame | None

    def product(self, token: str, first: int = 0, count: int | None = None) -> DataFrame:
        """source, session_id, orig_idx, bin, value of one product (see ``products.select_product``) from the spectra's
        bins ``first`` on."""
        if "spectra" not in self.tables:
            raise ValueError("no spectra were loaded")
        keys = ["source", "session_id", "orig_idx"]
        rows = products.bins(self.tables["spectra"], "data", [*keys, "product"], first, count)
        return products.select_product(rows, [*keys, "bin"], token)


def load(spark: SparkSession, roots: str | list[str], assume_scale: str | None = None, preferred: str | None = None) -> Loaded:
    """The written sources below ``roots`` as one.

    Kinds of all sources are combined, each by its rule; ``interpolated`` is kept only if all have it. The time scale is what
    the constants ``time_scale`` agree on; a source without one makes it unknown, which ``assume_scale`` must then settle
    without contradicting any source; conflicts raise ValueError. The axis is the ``preferred`` kind if it is there, else the
    first of LADDER; none raises. A root without tables raises FileNotFoundError.
    """
    roots = list(dict.fromkeys([roots] if isinstance(roots, str) else roots))
    if assume_scale is not None and assume_scale.lower() == "unknown":
        raise ValueError("unknown is no time scale that can be assumed")
    files = resolve_paths(spark, roots, ["parquet"])
    # At most one row a root and kind.
    there = files.select("root", F.substring_index("inner", "/", 1).alias("kind")).filter(F.col("kind").isin(*LAYOUTS)).distinct().collect()
    kinds = {k: [r for r in roots if (r, k) in {(x["root"], x["kind"]) for x in there}] for k in LAYOUTS}
    kinds = {k: having for k, having in kinds.items() if having and (k not in SHARED_KINDS or having == roots)}
    raw = {k: {r: spark.read.parquet(f"{r.rstrip('/')}/{k}") for r in having} for k, having in kinds.items()}
    terms = {k: agreed_terms(by) for k, by in raw.items()}
    tables = {}
    for k, by in raw.items():
        read = {}
        for r, df in by.items():
            got = read_products(spark, r.rstrip("/"), k) if k == "spectra" else df
            for c, said in terms[k].items():
                if said and c in df.columns:
                    got = with_terms(got, c, **said)
            read[r] = got
        tables[k] = combine(read, EVERYWHERE.get(k, ()), RAGGED.get(k, ()))
    place = F.array_position(F.array(*map(F.lit, roots)), F.col("source"))
    constants = merged_constants(tables["constants"].withColumn("_place", place), ["_place", "session_id"]) if "constants" in tables else None
    told = spark.createDataFrame([(r,) for r in roots], "source string")
    if constants is not None:
        known = tables["constants"].filter("key = 'time_scale'").select("source", F.lower("value").alias("time_scale"))
        told = told.join(known, "source", "left")
    else:
        told = told.withColumn("time_scale", F.lit(None).cast("string"))
    told = told.select(F.coalesce("time_scale", F.lit("unknown")).alias("time_scale"), F.lit("").alias("clock_source"), F.lit(0).alias("start"))
    scale = stats.require_scale(told, assume_scale and assume_scale.lower())
    if scale == "unknown":
        raise ValueError("the sources do not record a time scale: assume_scale must name it")
    axes = [k for k in ([preferred] if preferred else []) + LADDER if k in tables]
    if not axes:
        raise ValueError("no table that can serve as time axis")
    return Loaded(tables, scale, axes[0], constants)
