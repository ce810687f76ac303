"""Places from map tags: a category by ordered rules, what is shown, and which package it goes to.

Rules are text. A line is a label and its patterns; of all patterns that fit, the one of the first line wins. `key=value` is a tag,
`key=*` any value of a key, `key=*_end` values with that end, `@word` a derived category, `key=value@word` both. They
compile to one map from pattern to line number, and a candidate asks it for the few patterns that it can fit.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the product, in their order.
RULES = """
embassy: @embassy
police: amenity=police
toilets: amenity=toilets
fuel: amenity=fuel
charging: amenity=charging_station
pharmacy: amenity=pharmacy amenity=dispensary
hospital: amenity=hospital
doctors: amenity=clinic amenity=doctors amenity=dentist amenity=health_post
town_hall: amenity=townhall
sport: leisure=sports_centre leisure=fitness_centre leisure=ski_resort leisure=spa leisure=pitch leisure=sports_hall leisure=stadium leisure=swimming_pool leisure=ice_rink leisure=golf_course leisure=miniature_golf leisure=disc_golf_course leisure=track leisure=horse_riding leisure=fitness_station leisure=trampoline_park leisure=sauna amenity=dojo amenity=dive_centre amenity=public_bath amenity=spa amenity=kneipp_water_cure
library: amenity=library
internet_cafe: amenity=internet_cafe
historic: amenity=lavoir amenity=grave_yard amenity=cemetery
nature: leisure=bathing_place leisure=swimming_area leisure=bird_hide
zoo: tourism=aquarium
museum: amenity=planetarium
worship: amenity=mosque amenity=church
toilets: amenity=shower
information: amenity=ranger_station
playground: leisure=indoor_play
harbour: leisure=slipway
bicycle_repair: amenity=bicycle_repair_station
fire_station: amenity=fire_station
veterinary: amenity=veterinary
bank: amenity=bank amenity=money_transfer amenity=mobile_money_agent amenity=payment_centre
atm: amenity=atm
exchange: amenity=bureau_de_change
post_office: amenity=post_office
drinking_water: amenity=drinking_water
picnic: leisure=picnic_table tourism=picnic_site amenity=bbq leisure=firepit
shelter: amenity=shelter tourism=wilderness_hut tourism=lean_to
camper_service: amenity=sanitary_dump_station amenity=water_point amenity=car_wash
playground: leisure=playground
vending: amenity=vending_machine
post_box: amenity=post_box
information: @information_office
rental: amenity=car_rental amenity=bicycle_rental amenity=motorcycle_rental amenity=scooter_rental amenity=boat_rental amenity=ski_rental amenity=car_sharing
private_parking: amenity=parking@parking_private
disabled_parking: amenity=parking_space@parking_disabled
parking: amenity=parking amenity=parking_entrance amenity=*_parking
subway: railway=station@subway_station
train: railway=station railway=halt
bus: amenity=bus_station
taxi: amenity=taxi amenity=shared_taxi
ferry: amenity=ferry_terminal
harbour: leisure=marina
airport: aeroway=aerodrome
entertainment: amenity=cinema amenity=theatre amenity=nightclub amenity=casino leisure=bowling_alley leisure=amusement_arcade amenity=arts_centre amenity=events_venue amenity=conference_centre leisure=dance leisure=escape_game amenity=gambling amenity=karaoke_box leisure=karaoke amenity=hookah_lounge amenity=exhibition_centre amenity=music_venue
shop: shop=* amenity=marketplace
worship: historic=church historic=monastery landuse=religious
nature: boundary=national_park
attraction: man_made=bridge place=square highway=pedestrian type=associatedStreet
historic: type=site
nature: natural=peak natural=mountain_range
historic: historic=*
lodging: @hotel @guest_house @hostel @motel @apartment @camp_site @caravan_site @chalet @alpine_hut @camp_pitch leisure=resort tourism=cabin amenity=love_hotel
food: @restaurant @cafe @bar @pub @fast_food @food_court @ice_cream @biergarten @juice_bar
worship: @place_of_worship @monastery
museum: @museum @gallery @artwork
viewpoint: @viewpoint
nature: @park @garden @nature_reserve
theme_park: @theme_park
zoo: @zoo
water_park: @water_park
attraction: @attraction @fountain
"""
#: Tags that an end pattern leaves alone; tags that are never shown; what is shown without a name; what has details; what
#: goes to the extra package; keys in order of priority; access that makes parking private; information that is an office.
NOT_BY_END = ("amenity=boat_parking",)
HIDDEN = tuple(
    "amenity=waste_basket amenity=waste_disposal amenity=waste_box amenity=bench amenity=parking_space leisure=picnic_table leisure=beach_resort amenity=drinking_water amenity=recycling amenity=photo_booth amenity=driving_school amenity=kindergarten amenity=school amenity=childcare amenity=university amenity=bus_rental amenity=dancing_school amenity=telecommunication leisure=adult_gaming_centre amenity=compressed_air amenity=fish_spa amenity=music_school amenity=surf_school amenity=social_facility amenity=language_school amenity=animal_shelter amenity=mini_storage amenity=parcel_locker amenity=watering_place amenity=public_bookcase".split()
)
NAMELESS = tuple("toilets atm parking fuel charging pharmacy hospital taxi post_office camper_service shelter bicycle_repair disabled_parking".split())
NAMELESS_TAGS = ("amenity=fountain", "tourism=viewpoint", "amenity=bicycle_rental", "tourism=picnic_site")
DETAILED = ("food", "lodging", "embassy", "pharmacy", "hospital", "doctors", "shop")
CONTACTS = ("lodging", "embassy")
EXTRA_TAGS = ("amenity=drinking_water", "leisure=picnic_table", "leisure=playground", "amenity=vending_machine", "amenity=post_box")
EXTRA_NAMELESS = ("food", "shop")
KEYS = tuple("amenity shop tourism leisure historic railway aeroway office man_made landuse boundary place highway natural type".split())
PRIVATE_ACCESS = ("private", "customers", "no", "permit", "residents")
INFORMATION_OFFICE = ("office", "visitor_centre")


@dataclass
class Rules:
    """Patterns with the number of the first line that has them, and the lines' labels."""

    text: str = RULES

    def __post_init__(self):
        lines = [line.split(":", 1) for line in self.text.strip().splitlines() if line.strip()]
        self.labels = [label.strip() for label, _ in lines]
        self.line: dict[str, int] = {}
        for n, (_, patterns) in enumerate(lines):
            for p in patterns.split():
                self.line.setdefault(p, n)

    def number(self, key: Column, value: Column, category: Column) -> Column:
        """The least line number among the patterns that a candidate fits; null if none."""
        known = F.create_map(*chain.from_iterable((F.lit(p), F.lit(n)) for p, n in self.line.items()))
        tag, word = F.concat_ws("=", key, value), F.concat(F.lit("@"), category)
        end = F.when(value.contains("_") & ~tag.isin(*NOT_BY_END), F.concat(key, F.lit("=*_"), F.substring_index(value, "_", -1)))
        return F.least(*(F.try_element_at(known, p) for p in (tag, word, F.concat(tag, word), F.concat(key, F.lit("=*")), F.coalesce(end, F.lit("")))))

    def label(self, number: Column) -> Column:
        return F.when(number.isNotNull(), F.get(F.array(*map(F.lit, self.labels)), number))


def candidate(tags: Column, key: Column, rules: Rules) -> Column:
    """What a place with these tags is by one of its keys: a struct, null for nameless parks and shelters of stops."""
    given = lambda k: F.try_element_at(tags, F.lit(k))
    is_ = lambda c, v: F.coalesce(c == v, F.lit(False))
    raw = F.try_element_at(tags, key)
    value = F.when(is_(key, "boundary") & is_(raw, "protected_area") & is_(given("protect_class"), "2"), "national_park").otherwise(raw)
    at = lambda k, v: is_(key, k) & is_(value, v)
    reserved = is_(given("parking_space"), "disabled") | (F.coalesce(given("capacity:disabled").try_cast("int"), F.lit(0)) > 0)
    category = (
        F.when(at("amenity", "parking") & F.coalesce(given("access").isin(*PRIVATE_ACCESS), F.lit(False)), "parking_private")
        .when(at("amenity", "parking_space") & reserved, "parking_disabled")
        .when(is_(key, "railway") & (is_(given("station"), "subway") | is_(given("subway"), "yes")), "subway_station")
        .when(at("tourism", "information") & F.coalesce(given("information").isin(*INFORMATION_OFFICE), F.lit(False)), "information_office")
        .when(at("office", "diplomatic"), "embassy")
        .otherwise(value)
    )
    left_out = raw.isNull() | (at("leisure", "park") & given("name").isNull()) | (at("amenity", "shelter") & is_(given("shelter_type"), "public_transport"))
    first = F.struct(key.alias("key"), value.alias("value"), category.alias("category"), F.concat_ws("=", key, value).alias("tag"))

    def with_label(c: Column) -> Column:
        label = F.coalesce(rules.label(rules.number(c["key"], c["value"], c["category"])), F.lit("other"))
        return F.struct(c["category"].alias("category"), c["tag"].alias("tag"), c["value"].alias("value"), label.alias("label"))

    def whole(c: Column) -> Column:
        details = c["label"].isin(*DETAILED)
        name = F.coalesce(given("name"), F.when(details, given("brand")), c["value"])
        named = name != c["value"]
        hidden = (
            (c["tag"].isin(*HIDDEN) & (c["category"] != "parking_disabled")) | c["label"].isin("other", "private_parking") | ((c["tag"] == "tourism=information") & (c["category"] != "information_office"))
            | (~named & ~c["label"].isin(*NAMELESS) & ~c["tag"].isin(*NAMELESS_TAGS))
        )
        extra = c["tag"].isin(*EXTRA_TAGS) | ((c["tag"] != "shop=vacant") & ~named & c["label"].isin(*EXTRA_NAMELESS))
        package = F.when(~hidden, "base").when(extra, "extra")
        return F.struct(name.alias("name"), c["category"].alias("category"), c["tag"].alias("tag"), c["label"].alias("label"), package.alias("package"), details.alias("details"), c["label"].isin(*CONTACTS).alias("contacts"))

    bind = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  worked out once
    return F.when(~left_out, bind(bind(first, with_label), whole))


def places(rows: DataFrame, tags: str = "tags", keys: tuple[str, ...] = KEYS, rules: Rules | None = None, to: str = "poi") -> DataFrame:
    """rows with the struct `to`: name, category (the raw value, or what is derived from other tags), tag, label (of the rules, or 'other'),
    package ('base', 'extra' or null: not published), details and contacts (whether hours and address, site and mail are kept).

    tags: a map. Of a place's keys, in order, the first that gives a published place counts, else the first that gives any; rows
    without such a key go. The name is the place's, or its brand where details are kept, or the tag's value. All of it is
    one expression for each row: no join and no shuffle.
    """
    rules = rules or Rules()
    found = F.filter(F.transform(F.filter(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(F.col(tags), k)), lambda k: candidate(F.col(tags), k, rules)), lambda c: c.isNotNull())
    best = F.transform(F.array(found), lambda f: F.coalesce(F.get(F.filter(f, lambda c: c.package.isNotNull()), F.lit(0)), F.get(f, F.lit(0))))
    # a generator's result, so that no filter on it works it out again
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns if c != to), F.explode(F.array(F.get(best, F.lit(0)))).alias(to)).where(F.col(to).isNotNull())


def published(rows: DataFrame, tags: str = "tags", **options) -> DataFrame:
    """Rows of `places` that some package holds, with opening_hours, website and email of those that keep them, and phone."""
    poi = places(rows, tags, **options).where("poi.package is not null")
    given = lambda *names: F.coalesce(*(F.try_element_at(F.col(tags), F.lit(n)) for n in names))
    return poi.withColumns({"phone": given("phone", "contact:phone"), "opening_hours": F.when(F.col("poi.details"), given("opening_hours")), "website": F.when(F.col("poi.contacts"), given("website", "contact:website")), "email": F.when(F.col("poi.contacts"), given("email", "contact:email"))})
