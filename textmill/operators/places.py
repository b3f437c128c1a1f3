"""Places and freight: distance matrices, routes, rates, buckets of rates and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as fx
from textmill.operators.rollup import haversine

#: A place matrix has the square of its places.
MOST_PLACES = 20_000
BASE_RATE = 30.0


#: Country codes of each region.
REGIONS = {
    "EU": tuple("AD AL AT BA BE BG BY CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LT LU LV MC MD ME MK MT NL NO PL PT RO RS RU SE SI SK SM UA VA".split()),
    "AS": tuple("AE AF AM AZ BD BH BN BT CN GE HK ID IL IN IQ IR JO JP KG KH KP KR KW KZ LA LB LK MM MN MO MV MY NP OM PH PK PS QA SA SG SY TH TJ TL TM TR TW UZ VN YE".split()),
    "NA": tuple("AG AI AW BB BL BM BQ BS BZ CA CR CU CW DM DO GD GL GP GT HN HT JM KN KY LC MF MQ MS MX NI PA PM PR SV SX TC TT US VC VG VI".split()),
    "SA": tuple("AR BO BR CL CO EC FK GF GY PE PY SR UY VE".split()),
    "AF": tuple("AO BF BI BJ BW CD CF CG CI CM CV DJ DZ EG EH ER ET GA GH GM GN GQ GW KE KM LR LS LY MA MG ML MR MU MW MZ NA NE NG RE RW SC SD SL SN SO SS ST SZ TD TG TN TZ UG YT ZA ZM ZW".split()),
    "OC": tuple("AS AU CC CK CX FJ FM GU KI MH MP NC NF NR NU NZ PF PG PN PW SB TK TO TV UM VU WF WS".split()),
}


def checked(df: DataFrame, most: int) -> DataFrame:
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows where at most {most} are meant")
    return df


def distance_matrix(places: DataFrame, name: str, lat: str, lon: str) -> DataFrame:
    """(origin, destination, km) of all pairs of places, each computed once and mirrored, 0 on the diagonal."""
    p = checked(places, MOST_PLACES).select(F.col(name).alias("n"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    km = haversine(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon"))
    half = p.alias("x").join(F.broadcast(p.alias("y")), F.col("x.n") < F.col("y.n")).select(F.col("x.n").alias("a"), F.col("y.n").alias("b"), km.alias("km"))
    both = F.array(F.struct(F.col("a").alias("origin"), F.col("b").alias("destination")), F.struct(F.col("b").alias("origin"), F.col("a").alias("destination")))
    same = p.select(F.col("n").alias("origin"), F.col("n").alias("destination"), F.lit(0.0).alias("km"))
    return half.select(F.explode(both).alias("p"), "km").select("p.*", "km").unionByName(same)


def with_distance(df: DataFrame, distances: DataFrame, origin: str, destination: str, proxy: Column) -> DataFrame:
    """df with km between its places: the mean of what ``distances`` (origin, destination, km) says, else ``proxy``."""
    known = distances.groupBy(F.col("origin").alias(origin), F.col("destination").alias(destination)).agg(F.avg("km").alias("km"))
    return df.join(known, [origin, destination], "left").withColumn("km", F.coalesce("km", proxy))


def rate(km: Column, factor: Column | float) -> Column:
    """A base rate and a premium by distance."""
    return F.lit(BASE_RATE) + km / 1000 * factor


def rate_bucket(value: Column) -> Column:
    """Low, mid or high part of a decade: "mid 30s"."""
    whole = F.bround(value, 0).cast("long")
    decade = F.floor(whole / 10) * 10
    rest = whole - decade
    return F.concat_ws(" ", F.when(rest <= 3, "low").when(rest <= 6, "mid").otherwise("high"), F.concat(decade.cast("string"), F.lit("s")))


def parity_deltas(quotes: DataFrame, group: str, is_base: Column, value: str) -> DataFrame:
    """quotes with ``quote``: the rounded value of a group's base row, and for other rows what they differ from it."""
    whole = F.bround(value, 0).cast("long")
    base = quotes.where(is_base).groupBy(group).agg(F.min(whole).alias("__base"))
    return quotes.join(base, group).withColumn("quote", F.when(is_base, whole).otherwise(whole - F.col("__base"))).drop("__base")


def region(code: Column, regions: dict[str, tuple[str, ...]] = REGIONS, other: str = "OT") -> Column:
    """The region whose codes hold the code, the first of them if several do."""
    out = F.lit(other)
    for name, codes in reversed(regions.items()):
        out = F.when(code.isin(*codes), name).otherwise(out)
    return out


def port_facts(function: Column) -> list[Column]:
    """What a place's function code says: digits 1, 4 and 6 stand for port, airport and terminal."""
    return [F.contains(function, F.lit(d)).alias(n) for d, n in (("1", "is_port"), ("4", "is_airport"), ("6", "is_terminal"))]


def place_queries(name: Column, country: Column, others: Column) -> Column:
    """What to look up, in order: the title-cased name without "Anch" and its country, then the alternative names of a printed list, without dashes and blanks."""
    main = F.concat_ws(", ", F.trim(F.replace(fx.title_case(name), F.lit("Anch"), F.lit(""))), fx.title_case(country))
    listed = F.transform(F.split(F.regexp_replace(F.coalesce(others, F.lit("")), r"[\[\]'\"]", ""), ","), lambda x: F.trim(x))
    backups = F.filter(listed, lambda x: (x != "") & (x != "-"))
    return F.concat(F.array(main), F.transform(backups, lambda x: F.concat_ws(", ", x, fx.title_case(country))))
