"""Small complex matrices as tables: (keys, a, b, re, im), and what is computed on them.

Element-wise work is joins and columns; what needs a whole 4x4 matrix packs it per key and runs batches in NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .products import covariance_labels

#: Fixed value: Boltzmann's constant, J/K.
K_B = 1.380649e-23


def conj(m: DataFrame, keys: list[str]) -> DataFrame:
    """The adjoint: indices swapped, imaginary part negated."""
    return m.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), "re", (-F.col("im")).alias("im"))


def hermitian(m: DataFrame, keys: list[str]) -> DataFrame:
    """(M + M^H) / 2, by one grouping of the matrix with its adjoint."""
    return m.select(*keys, "a", "b", "re", "im").unionByName(conj(m, keys)).groupBy(*keys, "a", "b").agg((F.sum("re") / 2).alias("re"), (F.sum("im") / 2).alias("im"))


def hermitian_residual(m: DataFrame, keys: list[str]) -> DataFrame:
    """keys, absolute and relative: the greatest |M - M^H|, and that over the greatest |M|."""
    t = conj(m, keys).withColumnsRenamed({"re": "_re", "im": "_im"})
    d = F.hypot(F.col("re") - F.col("_re"), F.col("im") - F.col("_im"))
    g = m.join(t, [*keys, "a", "b"]).groupBy(*keys).agg(F.max(d).alias("absolute"), F.max(F.hypot("re", "im")).alias("_s"))
    return g.select(*keys, "absolute", F.when(F.col("_s") > 0, F.col("absolute") / F.col("_s")).otherwise(0.0).alias("relative"))


def assemble(upper: DataFrame, keys: list[str]) -> DataFrame:
    """The full Hermitian matrix of entries with a <= b."""
    return upper.select(*keys, "a", "b", "re", "im").unionByName(conj(upper.filter("a < b"), keys))


def diagonal(m: DataFrame) -> DataFrame:
    zero = lambda c: F.when(F.col("a") == F.col("b"), F.col(c)).otherwise(0.0)
    return m.withColumns({"re": zero("re"), "im": zero("im")})


def open_covariance(sky: DataFrame, moon: DataFrame, loss: DataFrame, t_moon: float, t_ant: float) -> DataFrame:
    """k * sky + 4 k T_moon R_moon + 4 k T_ant R_loss; sky has (time_idx, freq_idx, a, b), the others (freq_idx, a, b)."""
    part = lambda d, t: d.select("freq_idx", "a", "b", (4 * K_B * t * F.col("re")).alias("_re"), (4 * K_B * t * F.col("im")).alias("_im"))
    both = part(moon, t_moon).unionByName(part(loss, t_ant)).groupBy("freq_idx", "a", "b").agg(F.sum("_re").alias("_re"), F.sum("_im").alias("_im"))
    return sky.join(both, ["freq_idx", "a", "b"], "left").select("time_idx", "freq_idx", "a", "b", (K_B * F.col("re") + F.coalesce("_re", F.lit(0.0))).alias("re"), (K_B * F.col("im") + F.coalesce("_im", F.lit(0.0))).alias("im"))


def pack(m: DataFrame, keys: list[str], name: str = "m", size: int = 4) -> DataFrame:
    """keys and the matrix as one array, row by row, re and im in turn; absent entries are 0."""
    cells = F.map_from_entries(F.collect_list(F.struct((F.col("a") * size + F.col("b")).alias("k"), F.struct("re", "im").alias("v"))))
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.array(F.coalesce(F.col("_c")[k]["re"], F.lit(0.0)), F.coalesce(F.col("_c")[k]["im"], F.lit(0.0)))))
    return m.groupBy(*keys).agg(cells.alias("_c")).select(*keys, flat.alias(name))


def unpack(df: DataFrame, keys: list[str], name: str = "m", size: int = 4) -> DataFrame:
    return df.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.struct(F.col(name)[2 * k].alias("re"), F.col(name)[2 * k + 1].alias("im")))).alias("_pos", "_v")).select(*keys, F.floor(F.col("_pos") / size).cast("int").alias("a"), (F.col("_pos") % size).cast("int").alias("b"), "_v.re", "_v.im")


def to_complex(col: pd.Series, size: int = 4) -> np.ndarray:
    flat = np.stack(col.to_numpy()).astype(float)
    return (flat[:, 0::2] + 1j * flat[:, 1::2]).reshape(-1, size, size)


def from_complex(m: np.ndarray) -> list[np.ndarray]:
    return list(np.stack([m.real, m.imag], axis=-1).reshape(len(m), -1))


def _with(df: DataFrame, **more: str) -> T.StructType:
    """The schema of ``df`` with more columns."""
    return T.StructType([*df.schema.fields, *[T.StructField(n, T.ArrayType(T.DoubleType()) if k.startswith("array") else T.DoubleType()) for n, k in more.items()]])


def loading(packed: DataFrame, za: str, zl: str, out: str = "loading") -> DataFrame:
    """Add ZL (ZA + ZL)^-1 of packed impedances, by a solve from the right, not by an inverse."""
    schema = _with(packed, **{out: "array<double>"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            a, b = to_complex(p[za]), to_complex(p[zl])
            m = np.linalg.solve(np.swapaxes(a + b, 1, 2), np.swapaxes(b, 1, 2))
            yield p.assign(**{out: from_complex(np.swapaxes(m, 1, 2))})

    return packed.mapInPandas(run, schema)


def load_covariance(packed: DataFrame, covariance: str, m: str, out: str = "loaded") -> DataFrame:
    """Add M C M^H, projected on its Hermitian part, with the least eigenvalue's ratio to the greatest and C's condition."""
    schema = _with(packed, **{out: "array<double>", "eigen_ratio": "double", "condition": "double"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            c, load = to_complex(p[covariance]), to_complex(p[m])
            x = load @ c @ np.conj(np.swapaxes(load, 1, 2))
            x = (x + np.conj(np.swapaxes(x, 1, 2))) / 2
            e = np.linalg.eigvalsh(x)
            top = np.abs(e).max(axis=1)
            yield p.assign(**{out: from_complex(x), "eigen_ratio": np.where(top > 0, e[:, 0] / np.where(top > 0, top, 1), 0.0), "condition": np.linalg.cond(c)})

    return packed.mapInPandas(run, schema)


def product_channels(m: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the 16 real channels of a Hermitian matrix, in the covariance's order (00R, 01R, 01I, ...); absent is 0."""
    value = lambda label: F.coalesce(F.max(F.when((F.col("a") == int(label[0])) & (F.col("b") == int(label[1])), F.col("re" if label[2] == "R" else "im"))), F.lit(0.0))
    return m.filter("a <= b").groupBy(*keys).agg(F.array(*[value(x) for x in covariance_labels()]).alias("channels"))


def from_product_channels(df: DataFrame, keys: list[str]) -> DataFrame:
    """The full Hermitian matrix (keys, a, b, re, im) of 16 real channels."""
    labels = covariance_labels()
    at = {x: k for k, x in enumerate(labels)}
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("channels")[at[f"{a}{b}R"]].alias("re"), (F.lit(0.0) if a == b else F.col("channels")[at[f"{a}{b}I"]]).alias("im")) for a in range(4) for b in range(a, 4)]
    return assemble(df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*"), keys)


def closure(parts: list[DataFrame | tuple[Column, Column]], whole: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the greatest |sum of the parts - whole| over the greatest |whole|, entry by entry.

    A part is a table of its own, or (re, im) of columns that stand beside the whole's, whose cells are then one row each.
    With such columns alone a key's cells become two numbers before anything is shuffled; tables meet in one shuffle.
    """
    value = lambda c: F.coalesce(c, F.lit(0.0))
    beside = [p for p in parts if isinstance(p, tuple)]
    less = [sum((value(p[i]) for p in beside), -F.col(c)) for i, c in enumerate(("re", "im"))]
    signed = whole.select(*keys, "a", "b", less[0].alias("re"), less[1].alias("im"), F.hypot("re", "im").alias("_s"))
    if len(beside) == len(parts):
        return signed.groupBy(*keys).agg((F.max(F.hypot("re", "im")) / F.max("_s")).alias("closure"))
    for part in parts:
        if not isinstance(part, tuple):
            signed = signed.unionByName(part.select(*keys, "a", "b", "re", "im", F.lit(None).cast("double").alias("_s")))
    cell = signed.repartition(*keys).groupBy(*keys, "a", "b").agg(F.hypot(F.sum("re"), F.sum("im")).alias("_d"), F.max("_s").alias("_s"))
    return cell.groupBy(*keys).agg((F.max("_d") / F.max("_s")).alias("closure"))


def passivity(m: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the greatest singular value of each matrix: a passive scattering matrix has none above 1."""
    packed = pack(m, keys)
    schema = _with(packed.drop("m"), greatest="double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.drop(columns="m").assign(greatest=np.linalg.norm(to_complex(p["m"]), ord=2, axis=(1, 2)))

    return packed.mapInPandas(run, schema)


def matrix_quality(m: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """keys, reciprocity (greatest |M - M^T| over greatest |M|), least eigenvalue of the Hermitian part of Re M, pass."""
    t = m.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), F.col("re").alias("_re"), F.col("im").alias("_im"))
    d = m.join(t, [*keys, "a", "b"]).groupBy(*keys).agg(F.max(F.hypot(F.col("re") - F.col("_re"), F.col("im") - F.col("_im"))).alias("_d"), F.max(F.hypot("re", "im")).alias("_s"))
    packed = pack(m, keys)
    schema = _with(packed.drop("m"), least="double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            x = to_complex(p["m"])
            h = (x + np.conj(np.swapaxes(x, 1, 2))) / 2
            yield p.drop(columns="m").assign(least=np.linalg.eigvalsh(h)[:, 0])

    out = d.join(packed.mapInPandas(run, schema), keys).withColumn("reciprocity", F.when(F.col("_s") > 0, F.col("_d") / F.col("_s")).otherwise(0.0))
    return out.select(*keys, "reciprocity", "least", ((F.col("reciprocity") <= tolerance) & (F.col("least") >= -tolerance * F.col("_s"))).alias("passes"))


def radiometric_noise(cov: DataFrame, keys: list[str], bandwidth_hz: float, seconds: float) -> DataFrame:
    """keys, a, b, part, sigma of rows (keys, a, b, part, value): autos |T| / sqrt(B t); parts of a pair
    sqrt(max(0, (|Ta Tb| +- (re^2 - im^2)) / (2 B t))). A pair without both parts or both autos gives no rows here and is
    found by ``incomplete_pairs``."""
    bt = bandwidth_hz * seconds
    auto = cov.filter("a = b").select(*keys, "a", F.abs("value").alias("_t"))
    pair = cov.filter("a != b").groupBy(*keys, "a", "b").agg(F.max(F.when(F.col("part") == "re", F.col("value"))).alias("re"), F.max(F.when(F.col("part") == "im", F.col("value"))).alias("im")).filter("re is not null and im is not null")
    pair = pair.join(auto.withColumnRenamed("_t", "_ta"), [*keys, "a"]).join(auto.select(*keys, F.col("a").alias("b"), F.col("_t").alias("_tb")), [*keys, "b"])
    sq, common = F.col("re") * F.col("re") - F.col("im") * F.col("im"), F.col("_ta") * F.col("_tb")
    sigma = lambda s: F.sqrt(F.greatest((common + s) / (2 * bt), F.lit(0.0)))
    both = pair.select(*keys, "a", "b", F.explode(F.array(F.struct(F.lit("re").alias("part"), sigma(sq).alias("sigma")), F.struct(F.lit("im").alias("part"), sigma(-sq).alias("sigma")))).alias("x")).select(*keys, "a", "b", "x.*")
    return auto.select(*keys, "a", F.col("a").alias("b"), F.lit("auto").alias("part"), (F.col("_t") / bt**0.5).alias("sigma")).unionByName(both)


def incomplete_pairs(cov: DataFrame, keys: list[str]) -> DataFrame:
    return cov.filter("a != b").groupBy(*keys, "a", "b").agg(F.count_distinct("part").alias("n")).filter("n < 2").drop("n")


def stokes(re_t: Column, im_t: Column, re_p: Column, im_p: Column) -> dict[str, Column]:
    """I, Q, U, V of a complex field (theta, phi)."""
    return {
        "i": re_t * re_t + im_t * im_t + re_p * re_p + im_p * im_p, "q": re_t * re_t + im_t * im_t - re_p * re_p - im_p * im_p,
        "u": 2 * (re_t * re_p + im_t * im_p), "v": 2 * (im_t * re_p - re_t * im_p),
    }


def pair_stokes(fields: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b (a <= b) and re and im of I, Q, U, V of each pair of ports, of rows (keys, port, t_re, t_im, p_re, p_im):
    products of one port's field with the other's conjugate. For a port with itself they are its own Stokes parameters.
    One grouping per key, whose ports are few."""
    field = F.struct("port", "t_re", "t_im", "p_re", "p_im")
    ports = fields.groupBy(*keys).agg(F.array_sort(F.collect_list(field)).alias("_f"))
    one = ports.select(*keys, "_f", F.explode("_f").alias("x"))
    both = one.select(*keys, "x", F.explode(F.filter("_f", lambda y: y["port"] >= F.col("x")["port"])).alias("y"))
    x, y = F.col("x"), F.col("y")
    re = lambda p, q: x[f"{p}_re"] * y[f"{q}_re"] + x[f"{p}_im"] * y[f"{q}_im"]
    im = lambda p, q: x[f"{p}_im"] * y[f"{q}_re"] - x[f"{p}_re"] * y[f"{q}_im"]
    return both.select(
        *keys, x["port"].alias("a"), y["port"].alias("b"), (re("t", "t") + re("p", "p")).alias("i_re"), (im("t", "t") + im("p", "p")).alias("i_im"), (re("t", "t") - re("p", "p")).alias("q_re"), (im("t", "t") - im("p", "p")).alias("q_im"),
        (re("t", "p") + re("p", "t")).alias("u_re"), (im("t", "p") + im("p", "t")).alias("u_im"), (im("t", "p") - im("p", "t")).alias("v_re"), (re("p", "t") - re("t", "p")).alias("v_im"),
    )


def sky_fraction(grid: DataFrame, keys: list[str], power: Column, theta: str = "theta_deg", phi: str = "phi_deg", step_deg: float = 1.0) -> DataFrame:
    """Share of the sphere's integral of ``power`` over directions above the horizon, and below; the repeated last phi bin
    is left out."""
    area = F.sin(F.radians(theta)) * F.lit(np.radians(step_deg) ** 2)
    g = grid.filter(F.col(phi) < 360).groupBy(*keys).agg((F.sum(F.when(F.col(theta) <= 90, power * area)) / (4 * np.pi)).alias("sky"))
    return g.withColumn("ground", 1 - F.col("sky"))


def rotate_phi(grid: DataFrame, steps: int, step_deg: float, phi: str = "phi_deg") -> DataFrame:
    """Rotate a periodic grid by whole steps; the bin at 360 repeats the one at 0."""
    moved = grid.filter(F.col(phi) < 360).withColumn(phi, F.pmod(F.col(phi) + steps * step_deg, F.lit(360.0)))
    return moved.unionByName(moved.filter(F.col(phi) == 0).withColumn(phi, F.lit(360.0)))


def c4_mean(grid: DataFrame, keys: list[str], values: list[str], phi: str = "phi_deg") -> DataFrame:
    """Mean over four ports, port k rotated back by k quarter turns."""
    back = F.pmod(F.col(phi) - 90.0 * F.col("port"), F.lit(360.0))
    return grid.filter(F.col(phi) < 360).withColumn(phi, back).groupBy(*keys, phi).agg(*[F.avg(v).alias(v) for v in values])


def circulant(m: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of a 4x4 matrix over each cyclic diagonal, and over the two that reciprocity equates."""
    d = F.pmod(F.col("b") - F.col("a"), F.lit(4))
    return m.groupBy(*keys, F.when(d == 3, 1).otherwise(d).alias("step")).agg(F.avg("re").alias("re"), F.avg("im").alias("im"))


def horizon_taper(theta_rad: Column, width: float) -> Column:
    return 1 - F.pow(F.atan((theta_rad - np.pi / 2) / width) / np.pi + 0.5, F.lit(2.0))


def gaussian_beam(theta: Column, phi: Column, theta0: float, phi0: float, sigma: float) -> Column:
    return F.exp(-(F.pow(theta - theta0, F.lit(2.0)) + F.pow(phi - phi0, F.lit(2.0))) / (2 * sigma**2))


def response_verdict(za: DataFrame, resistances: dict[str, DataFrame], keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """One row a key with all that a response's matrices must satisfy, and whether they do: ``condition`` of the impedance;
    ``reciprocity`` |Z - Z^T|, over the greatest |Z|; ``least`` and ``passive``, the least eigenvalue of its dissipative half
    (Z + Z^H) / 2; ``closure`` |sum of the resistances - that half|, over the greatest of any of these; and of each
    resistance R ``<name>_hermitian`` |R - R^H| over the greatest |R| and ``<name>_least``, its least eigenvalue.

    Residuals may be ``tolerance``, eigenvalues may be below 0 by that share of their matrix's greatest entry. Entries that
    are absent are 0, and so is a resistance that a key lacks; keys without an impedance have no row. One grouping packs all
    matrices of a key, which are few; each batch is one call of every NumPy routine.
    """
    names = list(resistances)
    told = za.select(*keys, "a", "b", "re", "im", F.lit(0).alias("_m"))
    for i, name in enumerate(names):
        told = told.unionByName(resistances[name].select(*keys, "a", "b", "re", "im", F.lit(i + 1).alias("_m")))
    n = len(names) + 1
    cell = F.struct((F.col("_m") * 16 + F.col("a") * 4 + F.col("b")).alias("k"), "re", "im")
    packed = told.groupBy(*keys).agg(F.collect_list(cell).alias("_c"), F.max(F.col("_m") == 0).alias("_z")).filter("_z")
    packed = packed.select(*keys, F.transform("_c", lambda x: x["k"]).alias("_k"), F.transform("_c", lambda x: x["re"]).alias("_re"), F.transform("_c", lambda x: x["im"]).alias("_im"))
    more = {"condition": "double", "reciprocity": "double", "least": "double", "closure": "double", **{f"{m}_{w}": "double" for m in names for w in ("hermitian", "least")}, "passive": "double", "passes": "double"}
    schema = _with(packed.drop("_k", "_re", "_im"), **more)

    def greatest(x: np.ndarray) -> np.ndarray:
        return np.abs(x).max(axis=(1, 2))

    def share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.divide(x, of, out=np.zeros_like(x), where=of > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            m = np.zeros((len(p), n * 16), complex)
            for i, (k, re, im) in enumerate(zip(p["_k"], p["_re"], p["_im"], strict=True)):
                m[i, k] = np.asarray(re, float) + 1j * np.asarray(im, float)
            m = m.reshape(len(p), n, 4, 4)
            adjoint = np.conj(np.swapaxes(m, 2, 3))
            half = (m + adjoint) / 2
            z, lost = m[:, 0], half[:, 0]
            scales = [greatest(m[:, i]) for i in range(1, n)]
            out = {"condition": np.linalg.cond(z), "reciprocity": share(greatest(z - np.swapaxes(z, 1, 2)), greatest(z)), "least": np.linalg.eigvalsh(lost)[:, 0]}
            out["closure"] = share(greatest(m[:, 1:].sum(axis=1) - lost), np.maximum.reduce([greatest(lost), *scales]))
            passive = out["least"] >= -tolerance * greatest(lost)
            good = passive & (out["reciprocity"] <= tolerance) & (out["closure"] <= tolerance)
            for i, name in enumerate(names):
                out[f"{name}_hermitian"] = share(greatest(m[:, i + 1] - adjoint[:, i + 1]), scales[i])
                out[f"{name}_least"] = np.linalg.eigvalsh(half[:, i + 1])[:, 0]
                good &= (out[f"{name}_hermitian"] <= tolerance) & (out[f"{name}_least"] >= -tolerance * scales[i])
            yield p.drop(columns=["_k", "_re", "_im"]).assign(**out, passive=passive.astype(float), passes=good.astype(float))

    return packed.mapInPandas(run, schema).withColumns({"passive": F.col("passive") == 1, "passes": F.col("passes") == 1})
