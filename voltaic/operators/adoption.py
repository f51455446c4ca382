"""Adoption by service area: sums by company for the latest year, bridged by reconciled names, checked against contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import exact_sum
from ..functions.text import column_name, number

#: The published kinds of facilities, the ratio beyond which sources disagree.
FUELS = ("Solar", "Wind", "Water", "Biomass", "Fossil Fuel", "Exporting Storage", "Non-Exporting Storage", "Other")
RATIO = 0.20
COMPANY = "Current_Company_Name"


def latest_year(table: DataFrame, year: str = "Year") -> DataFrame:
    """The rows of the greatest year that is all digits."""
    text = F.trim(F.col(year).cast("string"))
    own = table.where(F.rlike(text, F.lit("^[0-9]+$"))).withColumn("year_", text.cast("int"))
    return own.join(own.agg(F.max("year_").alias("year_")), "year_", "left_semi").drop("year_")


def sums(table: DataFrame, columns: dict[str, str], *keys: str, where: str | None = None, year: str = "Year") -> DataFrame:
    """company (and keys) with the sums of text columns, blank as 0, for the latest year of the table, over the rows that where admits.

    Years are kept apart in one aggregation and chosen from its rows, so the table is read once.
    """
    text = F.trim(F.col(year).cast("string"))
    chosen = F.lit(True) if where is None else F.coalesce(F.expr(where), F.lit(False))
    own = table.where(F.rlike(text, F.lit("^[0-9]+$")))
    totals = [exact_sum(F.when(chosen, number(F.col(f"`{c}`").cast("string")))).alias(n) for n, c in columns.items()]
    per = own.groupBy(F.trim(COMPANY).alias("company"), *keys, text.cast("int").alias("year_")).agg(F.count_if(chosen).alias("rows_"), *totals)
    last = per.agg(F.max("year_").alias("last_"))
    return per.crossJoin(F.broadcast(last)).where("year_ = last_ and rows_ > 0").drop("year_", "rows_", "last_")  # last is one row


def names_of(features: DataFrame, recon: DataFrame, tables: DataFrame) -> DataFrame:
    """licence_no, company: the names whose rows an area sums.

    features(licence_no, legacy_licence_no, merged_licences array); recon(licence_no, rrr_names array); tables(company):
    all that has rows. Names of merged areas count if one of them has rows of its own that aren't the target's.
    """
    names = recon.select("licence_no", F.explode("rrr_names").alias("company"))
    own = features.select("licence_no", F.coalesce("legacy_licence_no", "licence_no").alias("asked")).join(names.withColumnRenamed("licence_no", "asked"), "asked").select("licence_no", "company")
    merged = features.select("licence_no", F.explode("merged_licences").alias("asked")).join(names.withColumnRenamed("licence_no", "asked"), "asked").select("licence_no", "company")
    foreign = merged.join(own, ["licence_no", "company"], "left_anti").join(tables.select("company").distinct(), "company", "left_semi")
    return own.unionByName(merged.join(foreign.select("licence_no"), "licence_no", "left_semi")).distinct()


def adoption(features: DataFrame, recon: DataFrame, t1: DataFrame, t3: DataFrame, t4: DataFrame, customers: DataFrame) -> DataFrame:
    """A row per feature. t1, t3, customers: sums by company; t4 by company and fuel.

    Excluded areas, areas without a name and areas without customers are not reported and have no metrics, never zeros.
    """
    known = t1.select("company").unionByName(t3.select("company")).unionByName(t4.select("company")).unionByName(customers.select("company"))
    names = names_of(features, recon, known)
    fuel = t4.groupBy("company").pivot("fuel", list(FUELS)).agg(F.sum("facilities").alias("facilities"), F.sum("capacity_kw").alias("capacity_kw"))
    wide = names.join(t1.select("company", F.col("customers").alias("nm_customers"), F.col("capacity_kw").alias("nm_kw")), "company", "left")
    wide = wide.join(t3.select("company", F.col("facilities").alias("emb_facilities"), F.col("capacity_kw").alias("emb_kw")), "company", "left")
    wide = wide.join(customers.select("company", F.col("customers").alias("customers_")), "company", "left").join(fuel, "company", "left")

    def total(c: str):
        return F.sum(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)))

    aggs = [total("nm_customers").alias("nm"), total("nm_kw").alias("nm_kw"), total("emb_facilities").alias("ef"), total("emb_kw").alias("emb_kw"), total("customers_").alias("c")]
    aggs += [total(f"{f}_{m}").alias(f"{column_name(f)}_{m}") for f in FUELS for m in ("facilities", "capacity_kw")]
    out = features.select("licence_no", "utility_name", "excluded").join(wide.groupBy("licence_no").agg(*aggs), "licence_no", "left")
    told = ~F.coalesce("excluded", F.lit(False)) & F.coalesce(F.col("c") > 0, F.lit(False))
    mw = (F.col("nm_kw") + F.col("emb_kw")) / 1000
    metrics = {
        "netmetered_customers": F.bround("nm", 0), "netmetered_capacity_mw": F.round(F.col("nm_kw") / 1000, 3), "embedded_facilities": F.bround("ef", 0), "embedded_capacity_mw": F.round(F.col("emb_kw") / 1000, 3),
        "customers": F.bround("c", 0), "total_der_capacity_mw": F.round(mw, 3), "capacity_per_1000_customers_mw": F.round(mw / F.col("c") * 1000, 4),
    }
    metrics |= {f"{column_name(f)}_facilities": F.bround(f"{column_name(f)}_facilities", 0) for f in FUELS}
    metrics |= {f"{column_name(f)}_capacity_mw": F.round(F.col(f"{column_name(f)}_capacity_kw") / 1000, 3) for f in FUELS}
    return out.select("licence_no", "utility_name", told.alias("reported"), *[F.when(told, e).alias(n) for n, e in metrics.items()])


def unexpected(values: DataFrame, column: str, expected: tuple[str, ...]) -> DataFrame:
    """Values outside a published list, with their number of rows: kept out of columns, and logged."""
    return values.where(~F.col(column).isin(*expected)).groupBy(column).count()


def year_ranges(tables: dict[str, DataFrame], year: str = "Year") -> DataFrame:
    """table_name, first_year, last_year of the years that are all digits; a table without one has nulls."""
    parts = []
    for name, table in tables.items():
        text = F.trim(F.col(year).cast("string"))
        y = F.when(F.rlike(text, F.lit("^[0-9]+$")), text.cast("int"))
        parts.append(table.agg(F.min(y).alias("first_year"), F.max(y).alias("last_year")).select(F.lit(name).alias("table_name"), "first_year", "last_year"))
    return reduce(DataFrame.unionByName, parts)


def by_kind(contracts: DataFrame, mapping: DataFrame, value: str) -> DataFrame:
    """kind, n, mw: contracts summed by the kind that mapping(.., kind) gives their other columns; those without one are the row of kind null.

    Callers log that row and leave it out of comparisons. Missing values count as 0.
    """
    keys = [c for c in mapping.columns if c != "kind"]
    return contracts.join(mapping, keys, "left").groupBy("kind").agg(F.count("*").alias("n"), exact_sum(F.coalesce(value, F.lit(0.0))).alias("mw"))


def crosscheck(reported: DataFrame, contracts: DataFrame, kinds: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Per kind of kinds(kind): reported and contracted sums, their ratio (null where nothing is reported), and a flag where it is off by more than ratio.

    The two sources are compared, never added.
    """
    out = kinds.join(reported.select("kind", F.col("mw").alias("reported")), "kind", "left").join(contracts.select("kind", F.col("mw").alias("contracted")), "kind", "left")
    out = out.withColumn("reported", F.coalesce("reported", F.lit(0.0))).withColumn("contracted", F.coalesce("contracted", F.lit(0.0)))
    out = out.withColumn("ratio", F.when(F.col("reported") > 0, F.col("contracted") / F.col("reported")))
    return out.withColumn("flag", F.coalesce(F.abs(F.col("ratio") - 1) > ratio, F.lit(False)))


def extremes(adoption_: DataFrame, metric: str, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """The n least and the n greatest, areas of several zones left out by the caller; licence_no settles ties."""
    own = adoption_.where(F.col(metric).isNotNull())
    return own.orderBy(F.asc(metric), "licence_no").limit(n), own.orderBy(F.desc(metric), "licence_no").limit(n)
