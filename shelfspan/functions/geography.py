"""Places in market labels: a table of places, joined to the words of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: States and their codes.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "district of columbia": "DC", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN",
    "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM",
    "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI",
    "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
#: Other spellings of states.
STATE_SPELLINGS = {"nyc": "NY", "calif": "CA", "cali": "CA", "penn": "PA", "penna": "PA", "mass": "MA", "conn": "CT", "wash": "WA", "ariz": "AZ", "tex": "TX"}
#: Regions and their states.
REGIONS = {
    "northeast": ["ME", "NH", "VT", "MA", "RI", "CT", "NY", "NJ", "PA"],
    "mid-atlantic": ["NY", "NJ", "PA", "DE", "MD", "DC", "VA", "WV"],
    "southeast": ["FL", "GA", "SC", "NC", "TN", "AL", "MS", "AR", "LA", "KY"],
    "midwest": ["OH", "MI", "IN", "IL", "WI", "MN", "IA", "MO", "ND", "SD", "NE", "KS"],
    "great lakes": ["OH", "MI", "IN", "IL", "WI", "MN", "PA", "NY"],
    "plains": ["ND", "SD", "NE", "KS", "IA", "MO", "MN"],
    "south central": ["TX", "OK", "AR", "LA"],
    "southwest": ["TX", "OK", "NM", "AZ"],
    "mountain": ["MT", "ID", "WY", "CO", "UT", "NV", "AZ", "NM"],
    "west": ["WA", "OR", "CA", "NV", "ID", "MT", "WY", "UT", "CO", "AZ", "NM", "AK", "HI"],
    "west coast": ["CA", "OR", "WA"],
    "pacific": ["CA", "OR", "WA", "AK", "HI"],
    "pacific northwest": ["WA", "OR", "ID"],
    "central": ["IL", "WI", "MN", "IA", "MO", "IN", "OH", "MI"],
    "south": ["FL", "GA", "SC", "NC", "TN", "AL", "MS", "AR", "LA", "KY", "TX", "OK", "VA", "WV"],
    "north": ["ME", "NH", "VT", "MA", "RI", "CT", "NY", "NJ", "PA", "OH", "MI", "WI", "MN", "ND", "SD", "MT", "WA"],
    "east": ["ME", "NH", "VT", "MA", "RI", "CT", "NY", "NJ", "PA", "DE", "MD", "VA", "NC", "SC", "GA", "FL", "DC"],
    **dict.fromkeys(("national", "national account", "total", "total us", "us", "all us"), list(STATES.values())),
    "florida peninsula": ["FL"],
    "florida": ["FL"],
    "carolinas": ["NC", "SC"],
    "tristate": ["NY", "NJ", "CT"],
    "tri state": ["NY", "NJ", "CT"],
    "new england": ["ME", "NH", "VT", "MA", "RI", "CT"],
    "deep south": ["AL", "MS", "GA", "LA", "SC"],
    "appalachia": ["WV", "KY", "TN", "VA"],
    "rust belt": ["OH", "MI", "IN", "IL", "WI", "PA", "WV"],
    "sun belt": ["AZ", "CA", "FL", "GA", "NV", "NM", "NC", "SC", "TX"],
    "rocky mountain": ["MT", "ID", "WY", "CO", "UT"],
}
#: Cities and their states, as measured markets name them.
CITIES = {
    "albany": "NY", "albany syracuse": "NY", "atlanta": "GA", "baltimore": "MD", "birmingham": "AL", "boise": "ID", "boston": "MA", "buffalo": "NY",
    "champaign peoria": "IL", "charleston": "WV", "charlotte": "NC", "chicago": "IL", "cincinnati": "OH", "cleveland": "OH", "columbus": "OH",
    "columbus oh": "OH", "dallas ft worth": "TX", "dallas fort worth": "TX", "dallas": "TX", "denver": "CO", "des moines cedar rapids": "IA",
    "des moines": "IA", "detroit": "MI", "fresno bakersfield": "CA", "fresno": "CA", "bakersfield": "CA", "ft myers": "FL", "fort myers": "FL",
    "palm beach ft myers": "FL", "grand rapids kalamazoo": "MI", "grand rapids": "MI", "kalamazoo": "MI", "hartford providence": "CT", "hartford": "CT",
    "providence": "RI", "harrisburg": "PA", "houston": "TX", "indianapolis": "IN", "jacksonville": "FL", "kansas city": "MO", "knoxville": "TN",
    "lakeland": "FL", "las vegas": "NV", "lexington": "KY", "lexington charleston": "KY", "los angeles": "CA", "la": "CA", "louisville": "KY",
    "memphis": "TN", "miami": "FL", "miami ft lauderdale": "FL", "ft lauderdale": "FL", "milwaukee": "WI", "minneapolis": "MN",
    "minneapolis st paul": "MN", "mobile": "AL", "nashville": "TN", "new orleans": "LA", "new york": "NY", "new york city": "NY",
    "oklahoma city": "OK", "omaha wichita": "NE", "omaha": "NE", "wichita": "KS", "orlando": "FL", "orlando daytona beach": "FL", "daytona": "FL",
    "philadelphia": "PA", "phoenix": "AZ", "pittsburgh": "PA", "portland": "OR", "portland me burlington vt": "ME", "burlington": "VT",
    "raleigh": "NC", "raleigh durham": "NC", "richmond": "VA", "rochester": "NY", "s carolina": "SC", "south carolina": "SC", "sc": "SC",
    "sacramento": "CA", "salt lake": "UT", "salt lake city": "UT", "salt lake boise": "UT", "san diego": "CA", "san francisco": "CA",
    "san fran": "CA", "san fran oakland sj": "CA", "san jose": "CA", "oakland": "CA", "savannah": "GA", "seattle": "WA", "seattle tacoma": "WA",
    "seattle tacoma wa": "WA", "south west texas": "TX", "southwest texas": "TX", "southern tier": "NY", "spokane": "WA", "st louis": "MO",
    "saint louis": "MO", "syracuse": "NY", "tampa": "FL", "tampa st petersburg": "FL", "st petersburg": "FL", "toledo ft wayne": "OH",
    "toledo": "OH", "ft wayne": "IN", "fort wayne": "IN", "washington dc": "DC", "washington": "DC", "virginia maryland": "VA",
}
#: Cities of a part of a state.
PARTS = {
    "western NY": ("buffalo", "rochester", "syracuse", "southern tier", "albany syracuse"),
    "central NY": ("syracuse", "albany syracuse"),
    "eastern NY": ("new york", "albany"),
    "northern NY": ("albany syracuse", "albany"),
    "southern NY": ("new york", "southern tier"),
    "western PA": ("pittsburgh",),
    "eastern PA": ("philadelphia", "harrisburg"),
    "southern CA": ("los angeles", "san diego"),
    "northern CA": ("san francisco", "san fran oakland sj", "sacramento"),
    "central CA": ("fresno bakersfield", "fresno", "bakersfield"),
}


def label_words(label: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(label, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def places(spark: SparkSession) -> DataFrame:
    """(place, kind, states): what names in labels stand for; kind is state, code, region or city."""
    rows = [(n, "state", [c]) for n, c in STATES.items()]
    rows += [(c.lower(), "code", [c]) for c in STATES.values()] + [(n, "code", [c]) for n, c in STATE_SPELLINGS.items()]
    rows += [(n, "region", s) for n, s in REGIONS.items()] + [(n, "city", [c]) for n, c in CITIES.items()]
    return spark.createDataFrame(rows, "place string, kind string, states array<string>")


def _phrases(label: Column) -> Column:
    """All runs of one to four words of a label, as place names could be; a label has a few words."""
    w = label_words(label)
    runs = [F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " ")) for n in range(1, 5)]  # noqa: B023
    return F.array_distinct(F.flatten(F.array(*(F.when(F.size(w) >= n, r).otherwise(F.array().cast("array<string>")) for n, r in enumerate(runs, 1)))))


def expand(labels: DataFrame, label: str) -> DataFrame:
    """(label, states, cities, part_cities): what each distinct label refers to; sorted arrays, empty where nothing is found.

    States come from names, codes, regions and cities. A city name within a longer one that is found doesn't
    count. `part_cities` are those of a named part of a state (`Western NY`). Phrases of labels are equi-joined
    to the place table, which is a constant.
    """
    spark = labels.sparkSession
    distinct = labels.select(F.col(label).alias("label")).where("label is not null").distinct()
    phrase = distinct.select("label", F.explode(_phrases(F.col("label"))).alias("place"))
    hits = phrase.join(F.broadcast(places(spark)), "place").where("kind != 'code' or not place like '% %'")
    found = hits.groupBy("label").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("states")))).alias("states"), F.array_sort(F.collect_set(F.when(F.col("kind") == "city", F.col("place")))).alias("all_cities"))
    inside = lambda c, o: (c != o) & F.concat(F.lit(" "), o, F.lit(" ")).contains(F.concat(F.lit(" "), c, F.lit(" ")))
    cities = F.filter("all_cities", lambda c: ~F.exists("all_cities", lambda o: inside(c, o)))
    words = label_words(F.col("label"))
    code = F.create_map(*(F.lit(v) for pair in ({c.lower(): c for c in STATES.values()} | {n: c for n, c in STATES.items()} | STATE_SPELLINGS).items() for v in pair))
    parts = F.create_map(*(v for k, c in PARTS.items() for v in (F.lit(k), F.array(*map(F.lit, c)))))
    pairs = F.flatten(F.transform(words, lambda w, i: F.transform(F.slice(words, i + 2, 2), lambda s: F.concat_ws(" ", w, F.try_element_at(code, s)))))
    part = F.get(F.filter(F.transform(pairs, lambda p: F.try_element_at(parts, p)), lambda x: x.isNotNull()), 0)
    none = F.array().cast("array<string>")
    out = distinct.join(found, "label", "left")
    return out.select("label", F.coalesce("states", none).alias("states"), F.coalesce(cities, none).alias("cities"), F.coalesce(part, none).alias("part_cities"))
