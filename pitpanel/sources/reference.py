"""Reference tables: population points and the fine-key to zone lookup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.functions import parsing
from pitpanel.operators.guards import require_coverage, require_same_codes
from pitpanel.operators.pointintime import first_per_key
from pitpanel.sources.series import read_text_csv


def population_points(centroids: DataFrame, populations: DataFrame, others: DataFrame, *, code: str = "area_code",
                      country: str = "EW", other_country: str = "S", minimum_match: float = 0.99) -> DataFrame:
    """Two publishers' small areas as points with a population.

    The first publisher's centroids and counts come apart; a join that loses more than
    one in a hundred centroids is refused, since the loss would be regional.
    """
    joined = centroids.select(code, "latitude", "longitude").join(populations.select(code, "population"), code)
    require_coverage(centroids, joined, minimum=minimum_match)
    columns = [code, "country", "latitude", "longitude", "population"]
    union = joined.withColumn("country", F.lit(country)).select(*columns).unionByName(
        others.withColumn("country", F.lit(other_country)).select(*columns)
    )
    typed = union.withColumns({c: F.col(c).try_cast("double") for c in ("latitude", "longitude", "population")})
    return typed.dropna(subset=["latitude", "longitude", "population"]).filter(F.col("population") > 0)


def zone_lookup(spark: SparkSession, sheets: Mapping[str, str], *, codes: Sequence[str], other_codes: Sequence[str] = (),
                outward: str = "Outcode", inward: str = "Incode", zone: str = "LDZ", exit_zone: str = "Exit Zone") -> DataFrame:
    """One row per fine key from several sheets (name -> CSV path), tagged by sheet.

    ``other_codes`` are zones outside the main set; the main set must match ``codes`` exactly.
    """
    parts = [
        read_text_csv(spark, path, [outward, inward, zone, exit_zone]).withColumn("gdn", F.lit(name))
        for name, path in sheets.items()
    ]
    raw = reduce(DataFrame.unionByName, parts)
    text = F.lit("")
    code = F.nullif(F.upper(F.trim(F.col(zone))), text)
    rows = raw.select(
        parsing.normalise_key(F.concat(F.coalesce(F.col(outward), text), F.coalesce(F.col(inward), text))).alias("postcode"),
        parsing.normalise_key(outward).alias("outcode"),
        code.alias("ldz"),
        F.trim(F.col(exit_zone)).alias("exit_zone"),
        "gdn",
    ).filter(F.col("ldz").isNotNull() & (F.length("postcode") >= 5))
    outside = F.col("ldz").isin(*other_codes) if other_codes else F.lit(False)
    flagged = rows.withColumn("is_nts", ~outside)
    require_same_codes(flagged.filter("is_nts"), "ldz", spark.createDataFrame([(c,) for c in codes], "ldz string"))
    return first_per_key(flagged, ["postcode"], order=["gdn", "ldz", "exit_zone", "outcode"],
                         keep=["outcode", "ldz", "exit_zone", "gdn", "is_nts"])
