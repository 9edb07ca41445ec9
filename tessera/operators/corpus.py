"""Labels, leakage and sampling of a corpus with train, validation and test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import taxonomy

# Characters of a code that count, safe rows for each vulnerable one, least safe rows.
MAX_CODE_CHARS, SAFE_RATIO, MIN_SAFE_ROWS = 4000, 4.0, 3000


def labelled(corpus: DataFrame) -> DataFrame:
    """Rows of the taxonomy with label, cut code and its hash; what folds to no class goes."""
    return (
        corpus.withColumn("label", taxonomy.label(F.col("is_vulnerable"), F.col("cwe_id")))
        .where(F.col("label").isNotNull())
        .withColumn("code", F.substring(F.coalesce("code", F.lit("")), 1, MAX_CODE_CHARS))
        .withColumn("code_hash", F.md5("code"))
    )


def _sides(rows: DataFrame) -> DataFrame:
    """Of each hash whether training has it, and whether validation or test has; equal codes meet as partial aggregates, so a hot one never fills a task."""
    train = F.col("split") == "train"
    return rows.groupBy("code_hash").agg(F.bool_or(train).alias("_trained"), F.bool_or(~train).alias("_held"))


def flag_leaks(rows: DataFrame) -> DataFrame:
    """Adds dup_of_train to validation and test rows: whether the training split, before any removal, has the same code."""
    trained = _sides(rows).where("_trained").select("code_hash", "_trained")
    return rows.join(trained, "code_hash", "left").withColumn("dup_of_train", F.when(F.col("split") != "train", F.coalesce("_trained", F.lit(False)))).drop("_trained")


def drop_leaks(rows: DataFrame) -> DataFrame:
    """Training rows whose code is in validation or test go; the others stay."""
    # few codes are on both sides, so this is the smaller table
    both = _sides(rows).where("_trained AND _held").select("code_hash", "_held")
    return rows.join(both, "code_hash", "left").where((F.col("split") != "train") | F.col("_held").isNull()).drop("_held")


def common_codes(rows: DataFrame) -> DataFrame:
    """Codes that training and the held-out splits share; none after drop_leaks."""
    return rows.where("split = 'train'").select("code_hash").intersect(rows.where("split <> 'train'").select("code_hash"))


def partition_classes(rows: DataFrame, dropped: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of the classes that stay, and of those that go."""
    gone = F.col("label").isin(*dropped) if dropped else F.lit(False)
    return rows.where(~gone), rows.where(gone)


def _order(id_col: str, seed: int):
    return F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)


def sized_sample(rows: DataFrame, key: str, wanted: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Of each key exactly as many rows as `wanted` (key, k) says, by the order of a hash.

    The k-th hash is found by a window over counts of hash bins, so that no
    key's rows are ever sorted in one task: all bins below it are taken, and
    only the bin that holds it is ranked.
    """
    bins = rows.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed))).withColumn("_bin", F.shiftright("_h", 52))
    sizes = bins.groupBy(key, "_bin").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = sizes.withColumn("_before", before).join(wanted, key).withColumn("_take", F.col("k") - F.col("_before")).where("_take > 0")
    # at most 4096 bins for each key
    placed = bins.join(quota.select(key, "_bin", "_n", "_take"), [key, "_bin"])
    whole = placed.where("_take >= _n")
    ranked = placed.where("_take < _n").withColumn("_r", F.row_number().over(Window.partitionBy(key, "_bin").orderBy("_h", id_col))).where("_r <= _take").drop("_r")
    return whole.unionByName(ranked).select(*rows.columns)


def downsample_safe(train: DataFrame, ratio: float = SAFE_RATIO, least: int = MIN_SAFE_ROWS, id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """All vulnerable rows, and of the safe ones `ratio` times as many, though `least` where there are."""
    n = train.agg(F.count_if(F.col("label") != taxonomy.SAFE).alias("v"), F.count_if(F.col("label") == taxonomy.SAFE).alias("s"))
    wanted = n.select(F.lit(taxonomy.SAFE).alias("label"), F.least("s", F.greatest(F.bround(F.col("v") * ratio).cast("long"), F.lit(least).cast("long"))).alias("k"))
    safe = sized_sample(train.where(F.col("label") == taxonomy.SAFE), "label", wanted, id_col, seed)
    return train.where(F.col("label") != taxonomy.SAFE).unionByName(safe)


def stratified_sample(rows: DataFrame, n: int, key: str = "label", id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """About n rows with each key's share kept, one of a key at least; everything if n is not below the rows' number or not positive."""
    if n <= 0:
        return rows
    counts = rows.groupBy(key).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))
    share = F.bround(F.col("_c") * F.lit(float(n)) / F.col("_t")).cast("long")
    wanted = counts.join(F.broadcast(total)).select(key, F.when(F.lit(n) >= F.col("_t"), F.col("_c")).otherwise(F.least("_c", F.greatest(F.lit(1).cast("long"), share))).alias("k"))
    return sized_sample(rows, key, wanted, id_col, seed)


def label_conflicts(rows: DataFrame) -> DataFrame:
    """Codes that carry different labels."""
    return rows.groupBy("code_hash").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set("label")).alias("labels")).where(F.size("labels") > 1).withColumn("labels", F.array_join("labels", ","))
