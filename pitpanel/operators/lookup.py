"""Two-tier key lookup: exact key first, then an unambiguous coarser key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.parsing import normalise_key, outward_key


def unambiguous_keys(lookup: DataFrame, *, fine: str, coarse: str, target: str, flag: str | None = None) -> DataFrame:
    """Coarse keys that map to exactly one target; ambiguous ones are left out, not voted on.

    min = max stands for "one distinct value" and needs no distinct expansion.
    """
    extra = [F.min_by(F.col(flag), F.col(fine)).alias(flag)] if flag else []
    return (
        lookup.filter(F.col(coarse).isNotNull())
        .groupBy(coarse)
        .agg(F.min(target).alias(target), F.max(target).alias("_max"), *extra)
        .filter(F.col(target) == F.col("_max"))
        .drop("_max")
    )


def two_tier_lookup(df: DataFrame, *, key: str, lookup: DataFrame, fine: str = "postcode", coarse: str = "outcode",
                    target: str = "ldz", flag: str | None = "is_nts", normalise=normalise_key,
                    coarsen=outward_key) -> DataFrame:
    """Add ``target``, ``match_level`` (full / outcode / none) and the flag; row count unchanged.

    ``lookup`` must be unique on ``fine``.  ``normalise`` and ``coarsen`` turn the raw
    key into the two join keys.
    """
    carried = [target] + ([flag] if flag else [])
    full = lookup.select(F.col(fine).alias("_fine"), *[F.col(c).alias(f"_full_{c}") for c in carried])
    part = unambiguous_keys(lookup, fine=fine, coarse=coarse, target=target, flag=flag).select(
        F.col(coarse).alias("_coarse"), *[F.col(c).alias(f"_part_{c}") for c in carried]
    )
    hit = F.col(f"_full_{target}").isNotNull()
    joined = (
        df.withColumns({"_fine": normalise(F.col(key)), "_coarse": coarsen(F.col(key))})
        .join(full, "_fine", "left")
        .join(part, "_coarse", "left")
    )
    level = (
        F.when(hit, F.lit("full"))
        .when(F.col(f"_part_{target}").isNotNull(), F.lit("outcode"))
        .otherwise(F.lit("none"))
    )
    picked: list[Column] = [
        F.when(hit, F.col(f"_full_{c}")).otherwise(F.col(f"_part_{c}")).alias(c) for c in carried
    ]
    return joined.select(*[F.col(c) for c in df.columns], *picked, level.alias("match_level"))


def match_shares(df: DataFrame, *, level: str = "match_level") -> DataFrame:
    """Rows and share per match level; the total comes from the few level rows."""
    counts = df.groupBy(level).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(level, "n", (F.col("n") / total).alias("share"))
