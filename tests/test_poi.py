import pytest

from trekmill.operators import poi

CASES = {
    "embassy by the modern tag": ({"office": "diplomatic", "name": "X"}, ("X", "embassy", "office=diplomatic", "embassy", "base")),
    "brand where details are kept": ({"shop": "supermarket", "brand": "Mart"}, ("Mart", "supermarket", "shop=supermarket", "shop", "base")),
    "no brand without details": ({"amenity": "bank", "brand": "B"}, ("bank", "bank", "amenity=bank", "bank", None)),
    "nameless cafe goes extra": ({"amenity": "cafe"}, ("cafe", "cafe", "amenity=cafe", "food", "extra")),
    "vacant shop goes": ({"shop": "vacant"}, ("vacant", "vacant", "shop=vacant", "shop", None)),
    "nameless toilets stay": ({"amenity": "toilets"}, ("toilets", "toilets", "amenity=toilets", "toilets", "base")),
    "bench is hidden": ({"amenity": "bench", "name": "B"}, ("B", "bench", "amenity=bench", "other", None)),
    "picnic table is extra": ({"leisure": "picnic_table", "name": "T"}, ("T", "picnic_table", "leisure=picnic_table", "picnic", "extra")),
    "private parking": ({"amenity": "parking", "access": "customers", "name": "P"}, ("P", "parking_private", "amenity=parking", "private_parking", None)),
    "open parking": ({"amenity": "parking", "access": "yes"}, ("parking", "parking", "amenity=parking", "parking", "base")),
    "bicycle parking by its end": ({"amenity": "bicycle_parking"}, ("bicycle_parking", "bicycle_parking", "amenity=bicycle_parking", "parking", "base")),
    "boat parking not": ({"amenity": "boat_parking", "name": "P"}, ("P", "boat_parking", "amenity=boat_parking", "other", None)),
    "stall for the disabled": ({"amenity": "parking_space", "capacity:disabled": "2"}, ("parking_space", "parking_disabled", "amenity=parking_space", "disabled_parking", "base")),
    "other stall": ({"amenity": "parking_space", "capacity:disabled": "yes"}, ("parking_space", "parking_space", "amenity=parking_space", "other", None)),
    "subway": ({"railway": "station", "station": "subway", "name": "S"}, ("S", "subway_station", "railway=station", "subway", "base")),
    "information board": ({"tourism": "information", "name": "I", "information": "board"}, ("I", "information", "tourism=information", "other", None)),
    "information office": ({"tourism": "information", "name": "I", "information": "office"}, ("I", "information_office", "tourism=information", "information", "base")),
    "national park by class": ({"boundary": "protected_area", "protect_class": "2", "name": "N"}, ("N", "national_park", "boundary=national_park", "nature", "base")),
    "first published key": ({"tourism": "yes", "leisure": "garden", "name": "G"}, ("G", "garden", "leisure=garden", "nature", "base")),
    "first key if none is published": ({"tourism": "yes", "leisure": "beach_resort", "name": "G"}, ("G", "yes", "tourism=yes", "other", None)),
    "the earlier line wins": ({"historic": "church", "name": "C"}, ("C", "church", "historic=church", "worship", "base")),
    "any historic value": ({"historic": "tank", "name": "T"}, ("T", "tank", "historic=tank", "historic", "base")),
    "nameless viewpoint": ({"tourism": "viewpoint"}, ("viewpoint", "viewpoint", "tourism=viewpoint", "viewpoint", "base")),
    "nameless park": ({"leisure": "park"}, None),
    "shelter of a stop": ({"amenity": "shelter", "shelter_type": "public_transport", "name": "S"}, None),
    "no key": ({"name": "N"}, None),
    "no tags": ({}, None),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, tags, "p") for i, (tags, _) in enumerate(CASES.values())] + [(99, None, "p")], "id int, tags map<string,string>, name string")
    got = poi.places(rows)
    assert got.columns == ["id", "tags", "name", "poi"]
    return {r.id: (r.poi.name, r.poi.category, r.poi.tag, r.poi.label, r.poi.package) for r in got.collect()}


@pytest.mark.parametrize("case", CASES)
def test_cases(found, case):
    assert found.get(list(CASES).index(case)) == CASES[case][1]


def test_every_line_can_be_hit(spark):
    rules = poi.Rules()
    rows = []
    for p in rules.line:
        tag, _, word = p.partition("@")
        key, _, value = (tag or "tourism=").partition("=")
        rows.append((p, key, value.replace("*", "any") or word, word or value.replace("*", "any")))
    df = spark.createDataFrame(rows, "p string, k string, v string, c string")
    got = {r.p: r.n for r in df.select("p", rules.number(df.k, df.v, df.c).alias("n")).collect()}
    assert {rules.labels[n] for n in got.values()} == set(rules.labels) and len(set(rules.labels)) == 51
    assert all(got[p] <= n for p, n in rules.line.items())


def test_own_rules_and_what_is_kept(spark):
    rows = spark.createDataFrame([({"amenity": "cafe", "name": "C", "opening_hours": "24/7", "website": "w", "contact:phone": "1"},), ({"tourism": "hotel", "name": "H", "contact:email": "e"},)], "tags map<string,string>")
    assert [(r.phone, r.opening_hours, r.website, r.email) for r in poi.published(rows).collect()] == [("1", "24/7", None, None), (None, None, None, "e")]
    own = poi.places(rows, keys=("amenity",), rules=poi.Rules("drinks: amenity=cafe\nfood: @cafe")).collect()
    assert [r.poi.label for r in own] == ["drinks"]
