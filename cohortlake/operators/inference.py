"""Standard errors, bands and tests from influence functions.

psi holds (key columns, unit, psi), non-zeros only; n_total is the number of units behind it, zeros included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortlake.functions.stats import chi2_tail, z_quantile


def covariance(psi: DataFrame, key: str, n_total: int) -> DataFrame:
    """a, b, value: the entries of psi' psi / n."""
    left, right = psi.select("unit", F.col(key).alias("a"), F.col("psi").alias("pa")), psi.select("unit", F.col(key).alias("b"), F.col("psi").alias("pb"))
    return left.join(right, "unit").groupBy("a", "b").agg((F.sum(F.col("pa") * F.col("pb")) / n_total).alias("value"))


#: Draws that one digest gives signs for.
BITS = 128


def digests(unit: Column, draws: int, seed: int) -> Column:
    """The digests that hold a unit's signs, 128 draws each: the MD5 of unit, block and seed, the same in any engine that has it.

    The sign of draw b (from 1) is bit (b - 1) % 128, from the highest, of block (b - 1) // 128: 1 is plus.
    """
    blocks = F.sequence(F.lit(0), F.lit(-(-max(1, draws) // BITS) - 1))
    return F.transform(blocks, lambda k: F.unhex(F.md5(F.concat_ws("|", unit.cast("string"), k.cast("string"), F.lit(str(seed))).cast("binary"))))


def clustered(psi: DataFrame, keys: list[str], clusters: DataFrame) -> tuple[DataFrame, int]:
    """Mean psi of each cluster over all its units (zeros included), and how many clusters there are. clusters: unit, cluster."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    sums = psi.join(clusters, "unit").groupBy(*keys, "cluster").agg(F.sum("psi").alias("psi")).join(sizes, "cluster")
    return sums.select(*keys, F.col("cluster").alias("unit"), (F.col("psi") / F.col("size")).alias("psi")), sizes.count()


#: Units whose signs are laid out at once.
SLICE = 2048


def bootstrap(psi: DataFrame, key: str, draws: int, seed: int, n: int) -> DataFrame:
    """draw, key, value: sqrt(n) times the mean of psi under random signs.

    A unit's psi are gathered first, so its digests are made once; signs times psi is a matrix product for some units at a time, and
    each task leaves one row for a key, which holds its sums over all draws.
    """
    if draws < 0:
        raise ValueError("boot_iterations must be >= 0")
    draws, kind = max(1, draws), psi.schema[key].dataType.simpleString()
    types = to_arrow_schema(T.StructType([T.StructField("key", psi.schema[key].dataType), T.StructField("sums", T.ArrayType(T.DoubleType()))]))
    units = psi.groupBy("unit").agg(F.collect_list(F.struct(F.col(key).alias("key"), "psi")).alias("own")).select("own", digests(F.col("unit"), draws, seed).alias("signs"))

    def partial(batches):
        sums: dict[object, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                own, signs = part.column(0), part.column(1)
                raw = np.frombuffer(b"".join(signs.flatten().to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
                signed = np.unpackbits(raw, axis=1)[:, :draws].astype(np.float64) * 2 - 1
                flat = own.flatten()
                keys, value = flat.field("key").to_pylist(), flat.field("psi").to_numpy(zero_copy_only=False)
                names = list(dict.fromkeys(keys))
                place = {k: i for i, k in enumerate(names)}
                matrix = np.zeros((len(names), part.num_rows))
                np.add.at(matrix, (np.array([place[k] for k in keys], dtype=np.int64), np.repeat(np.arange(part.num_rows), own.value_lengths().to_numpy())), value)
                for k, row in zip(names, matrix @ signed):
                    sums[k] = sums[k] + row if k in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)).cast(types[0].type), pa.array([v.tolist() for v in sums.values()], types[1].type)], schema=types)

    summed = units.mapInArrow(partial, f"key {kind}, sums array<double>")
    each = summed.select("key", F.posexplode("sums").alias("pos", "part")).groupBy("key", "pos").agg(F.sum("part").alias("total"))
    return each.select((F.col("pos") + 1).alias("draw"), F.col("key").alias(key), (F.col("total") / n * np.sqrt(n)).alias("value"))


def bootstrap_errors(boot: DataFrame, key: str, n: int, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(key, std_error from the interquartile range), (one row: crit_val of the simultaneous band)."""
    width = z_quantile(0.75) - z_quantile(0.25)
    spread = boot.groupBy(key).agg(((F.expr("percentile_disc(0.75) within group (order by value)") - F.expr("percentile_disc(0.25) within group (order by value)")) / width).alias("sigma"))
    errors = spread.select(key, (F.col("sigma") / np.sqrt(n)).alias("std_error"))
    most = boot.join(F.broadcast(spread.filter("sigma > 0")), key).groupBy("draw").agg(F.max(F.abs(F.col("value") / F.col("sigma"))).alias("most"))
    return errors, most.agg(F.expr(f"percentile_disc({1 - alpha}) within group (order by most)").alias("crit_val"))


def with_band(df: DataFrame, crit: float, att: str = "ATT") -> DataFrame:
    """std_error (0 as null), lower, upper and zero_not_in_cband ('*' where the band has no 0)."""
    se = F.when(F.col("std_error") != 0, F.col("std_error"))
    df = df.withColumn("std_error", se)
    df = df.withColumns({"lower": F.col(att) - crit * F.col("std_error"), "upper": F.col(att) + crit * F.col("std_error")})
    apart = F.signum("lower") * F.signum("upper") > 0
    return df.withColumn("zero_not_in_cband", F.when(apart, "*").otherwise(""))


#: Cells of one test at most: their covariances, a square of as many, are solved on the driver.
MOST_TESTED = 2000


def wald_pre_test(att: dict, psi: DataFrame, key: str, n: int) -> dict[str, float]:
    """W = n a' V^-1 a over the pre-treatment cells in att (key -> ATT) and its chi-square tail; rounded to 6 digits."""
    names = sorted(att)
    if len(names) > MOST_TESTED:
        raise ValueError(f"{len(names)} cells before treatment: {MOST_TESTED} at most are tested together")
    place = {name: i for i, name in enumerate(names)}
    v = np.zeros((len(names), len(names)))
    for r in covariance(psi.filter(F.col(key).isin(names)), key, n).collect():  # cells by cells: few
        v[place[r["a"]], place[r["b"]]] = r["value"]
    keep = [i for i in range(len(names)) if v[i, i] > 0]
    a = np.array([att[names[i]] for i in keep])
    if not keep:
        return {"wald_stat": float("nan"), "df": 0, "p_value": float("nan")}
    stat = float(n * a @ np.linalg.solve(v[np.ix_(keep, keep)], a))
    return {"wald_stat": round(stat, 6), "df": len(keep), "p_value": round(chi2_tail(stat, len(keep)), 6)}
