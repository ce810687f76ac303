"""Vaccination requirements of trips: source tables compiled to one table of rules, evaluated in strata.

A rule: rule_id, stratum and place (their order); destination and departure (null: any); travelling (whether it needs two
countries); origins (null: none needed, else one of the trip's earlier countries must be among them) and stopover (which passing
stopovers count as such); purpose, long_stay (null: any); exempt (regions it isn't for); vaccine, level, reason, note; min_age
in months and age_rule; unless ('present': not if an earlier rule gave the vaccine, an item below age aside; 'ever': those too);
once (of equal ones only the first of a trip counts; null: all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels and vaccines in the order in which they are shown, and hours above which a passing stopover counts.
LEVELS = ("required", "required_exit", "encouraged", "recommended", "consider")
VACCINES = ("yellow_fever", "polio", "menacwy", "hepa", "hepb", "typhoid", "rabies", "je", "tbe", "cholera", "dengue", "chik", "routine")
STOPOVER_HOURS = {"4h": 4, "12h": 12, "24h": 24}
INFANT_MONTHS = 9

_RULE = {
    "stratum": "int", "place": "string", "destination": "string", "departure": "string", "travelling": "boolean", "origins": "array<string>", "stopover": "string", "purpose": "string", "long_stay": "boolean",
    "exempt": "array<string>", "vaccine": "string", "level": "string", "reason": "string", "note": "string", "min_age": "int", "age_rule": "string", "unless": "string", "once": "string",
}


def _rule(rows: DataFrame, stratum: int, **columns: Column) -> DataFrame:
    given = {"stratum": F.lit(stratum), "travelling": F.lit(True), **columns}
    return rows.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in _RULE.items()])


def compile_rules(yf_entry: DataFrame, yf_risk: DataFrame, polio_status: DataFrame, polio_entry: DataFrame, special: DataFrame, recommended: DataFrame, exempt: tuple[str, ...] = ()) -> DataFrame:
    """The rules of the product's source tables.

    yf_entry: place, country, rule (none, all, from_risk, from_list), min_age, stopover (none, any, 4h, 12h, 24h), from_list,
    exit_required, note; yf_risk: place, country, partial, areas; polio_status: place, country, category (severe, cvdpv2, previous); polio_entry:
    place, country, unlisted, origin_category, origin_countries, dose, window, applies, note; special: place, country, purpose, vaccine,
    min_age, note; recommended: place, country, vaccine, most, condition. `place` orders a table's rows; of yf_entry and yf_risk the first of a
    country counts. exempt: regions without yellow fever in countries that have it.
    """
    c, first = F.col, lambda rows: rows.groupBy("country").agg(F.min_by(F.struct(*rows.columns), "place").alias("r")).select("r.*")
    order = F.lpad(c("place").cast("string"), 12, "0")
    entry, risk = first(yf_entry), first(yf_risk)
    of_category = polio_status.groupBy("category").agg(F.collect_set("country").alias("of_category"))
    risky = entry.join(yf_risk.agg(F.collect_set("country").alias("risky")))  # one row
    yf = {"vaccine": F.lit("yellow_fever"), "level": F.lit("required"), "note": c("note"), "min_age": c("min_age"), "age_rule": F.lit("from"), "place": order}
    origins = F.when(c("rule") == "from_risk", c("risky")).when(c("rule") == "from_list", c("from_list"))
    regions = F.array(*map(F.lit, exempt)).cast("array<string>")
    polio = {"vaccine": F.lit("polio"), "place": order}
    listed = polio_entry.where("not coalesce(unlisted, false)").join(of_category.withColumnRenamed("category", "origin_category"), "origin_category", "left")
    from_any = F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in ("origin_countries", "of_category")))
    hajj = F.when(c("applies") == "hajj_umrah", "hajj_umrah")
    same = F.to_json(F.struct("dose", "window", "applies", "note"))
    parts = [
        _rule(risky.where("rule <> 'none'"), 1, destination=c("country"), origins=origins, stopover=c("stopover"), reason=F.concat(F.lit("yf_entry_"), "rule"), **yf),
        _rule(entry.where("exit_required"), 2, departure=c("country"), reason=F.lit("yf_exit"), **{**yf, "level": F.lit("required_exit")}),
        _rule(risk, 3, destination=c("country"), travelling=F.lit(False), exempt=regions, vaccine=F.lit("yellow_fever"), level=F.lit("recommended"), reason=F.lit("yf_destination_risk"), note=F.when(c("partial"), c("areas")), min_age=F.lit(INFANT_MONTHS), age_rule=F.lit("infant"), unless=F.lit("present"), place=order),
        _rule(polio_status.where("category = 'severe'"), 4, departure=c("country"), long_stay=F.lit(True), level=F.lit("required_exit"), reason=F.lit("polio_exit"), once=F.lit("polio_exit"), **polio),
        _rule(polio_status.where("category = 'cvdpv2'"), 5, departure=c("country"), level=F.lit("encouraged"), reason=F.lit("polio_encouraged"), once=F.lit("polio_exit"), **polio),
        _rule(polio_entry.where("unlisted"), 6, destination=c("country"), purpose=hajj, level=F.lit("consider"), reason=F.lit("polio_entry_unlisted"), note=c("note"), **polio),
        _rule(listed, 7, destination=c("country"), origins=from_any, purpose=hajj, level=F.lit("required"), reason=F.lit("polio_entry"), note=c("note"), once=same, **polio),
        _rule(special, 8, destination=c("country"), travelling=F.lit(False), purpose=c("purpose"), vaccine=c("vaccine"), level=F.lit("required"), reason=c("purpose"), note=c("note"), min_age=c("min_age"), age_rule=F.lit("from"), place=order),
        _rule(recommended, 9, destination=c("country"), travelling=F.lit(False), exempt=F.when(c("vaccine") == "yellow_fever", regions), vaccine=c("vaccine"), level=F.when(c("most"), "recommended").otherwise("consider"), reason=F.when(c("most"), "destination_most").otherwise("destination_some"), note=c("condition"), unless=F.when(c("vaccine") == "yellow_fever", "ever").otherwise("present"), place=order),
        _rule(special.sparkSession.range(1), 10, travelling=F.lit(False), vaccine=F.lit("routine"), level=F.lit("recommended"), reason=F.lit("routine")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def origins_of(trips: DataFrame, stops: DataFrame) -> DataFrame:
    """trips with `origins`: earlier countries in order (place, country, hours, passing), each once as a stay and once in passing.

    The departure goes first, then stays and stopovers whose traveller left the airport, then passing stopovers; the destination isn't one.
    stops: trip_id, pos, country, kind ('stay' or 'stopover'), hours, left_airport.
    """
    passing = (F.col("kind") == "stopover") & ~F.coalesce("left_airport", F.lit(False))
    at = F.when(F.col("kind") == "stay", 1).when(~passing, 2).otherwise(3)
    row = F.struct(at.alias("group"), F.col("pos").cast("long").alias("pos"), F.col("country").alias("country"), F.when(passing, F.col("hours")).cast("int").alias("hours"), passing.alias("passing"))
    gathered = stops.where("country is not null").groupBy("trip_id").agg(F.sort_array(F.collect_list(row)).alias("o"))
    home = F.struct(F.lit(0).alias("group"), F.lit(0).cast("long").alias("pos"), F.col("departure").alias("country"), F.lit(None).cast("int").alias("hours"), F.lit(False).alias("passing"))
    found = trips.join(gathered, "trip_id", "left").withColumn("o", F.when(F.col("o").isNull(), F.array(home)).otherwise(F.concat(F.array(home), "o")))
    return found.withColumn("origins", F.filter("o", lambda x: x.country != F.col("destination"))).drop("o")


def requirements(trips: DataFrame, stops: DataFrame, rules: DataFrame) -> DataFrame:
    """(trip_id, vaccine, level, reason, country, hours, stopover, age_note, note): what each trip needs, strata first to last.

    trips: trip_id, departure, destination, region, age (months, may be null), long_stay (more than four weeks at the departure),
    purpose. A rule's origin is the first of the trip's that it names. Below a rule's age the level is 'consider' and the note
    'below_age'; with an unknown age it is 'from_age' (but not for the infants' rule). Rules that look at what came before are
    settled in order within the trip's own few matching rules. Sort by level_rank and vaccine_rank to show.
    """
    from_origins = origins_of(trips, stops).withColumn("travels", F.col("departure") != F.col("destination"))
    r = rules.withColumnsRenamed({c: f"r_{c}" for c in _RULE})
    by_destination = from_origins.join(r.where("r_destination is not null"), F.col("destination") == F.col("r_destination"))
    by_departure = from_origins.join(r.where("r_destination is null and r_departure is not null"), F.col("departure") == F.col("r_departure"))
    always = from_origins.join(r.where("r_destination is null and r_departure is null").groupBy().agg(F.collect_list(F.struct(*r.columns)).alias("w"))).select(*from_origins.columns, F.inline("w"))  # one row of rules
    met = by_destination.where("r_departure is null or r_departure = departure").unionByName(by_departure).unionByName(always)
    met = met.where("(travels or not r_travelling) and (r_purpose is null or r_purpose <=> purpose) and (r_long_stay is null or r_long_stay <=> long_stay)")
    met = met.where(~F.coalesce(F.array_contains("r_exempt", F.col("region")), F.lit(False)))
    limit = F.coalesce(*(F.when(F.col("r_stopover") == k, F.lit(h)) for k, h in STOPOVER_HOURS.items()))
    counts = lambda o: ~o.passing | F.coalesce(F.col("r_stopover") == "any", F.lit(False)) | (limit.isNotNull() & (o.hours.isNull() | (o.hours > limit)))
    trigger = F.get(F.filter("origins", lambda o: F.array_contains(F.col("r_origins"), o.country) & counts(o)), F.lit(0))
    met = met.withColumn("t", F.when(F.col("r_origins").isNotNull(), trigger)).where("r_origins is null or t is not null")
    below = F.col("r_min_age").isNotNull() & F.coalesce(F.col("age") < F.col("r_min_age"), F.lit(False))
    unknown = F.col("r_min_age").isNotNull() & F.col("age").isNull() & (F.col("r_age_rule") == "from")
    where = F.when(F.col("t").isNotNull(), F.col("t.country")).when(F.col("r_reason") == "yf_entry_all", None).when(F.col("r_departure").isNotNull() | F.col("r_destination").isNull(), F.col("departure")).otherwise(F.col("destination"))
    item = F.struct(
        F.col("r_stratum").alias("stratum"), F.col("r_place").alias("place"), F.col("r_vaccine").alias("vaccine"), F.when(below, "consider").otherwise(F.col("r_level")).alias("level"), F.col("r_reason").alias("reason"), where.alias("country"), F.col("t.hours").alias("hours"),
        F.coalesce("t.passing", F.lit(False)).alias("stopover"), F.when(below, "below_age").when(unknown, "from_age").otherwise("none").alias("age_note"), F.col("r_note").alias("note"), F.col("r_unless").alias("unless"), F.col("r_once").alias("once"),
    )
    gathered = met.groupBy("trip_id").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def settle(kept: Column, x: Column) -> Column:
        present = F.exists(kept, lambda k: (k.stratum < x.stratum) & (k.vaccine == x.vaccine) & ((k.age_note != "below_age") | (x.unless == "ever")))
        # of one stratum, rules that repeat a vaccine see each other too
        within = F.exists(kept, lambda k: (k.stratum == x.stratum) & (k.vaccine == x.vaccine))
        said = x.once.isNotNull() & F.exists(kept, lambda k: k.once == x.once)
        return F.when((x.unless.isNotNull() & (present | within)) | F.coalesce(said, F.lit(False)), kept).otherwise(F.concat(kept, F.array(x)))

    settled = gathered.select("trip_id", F.inline(F.aggregate("items", F.filter("items", lambda x: F.lit(False)), settle)))
    rank = lambda column, names: F.array_position(F.array(*map(F.lit, names)), F.col(column)).cast("int")
    return settled.drop("stratum", "place", "unless", "once").withColumns({"level_rank": rank("level", LEVELS), "vaccine_rank": rank("vaccine", VACCINES)})
