import random

from pyspark.sql import functions as F

from trekmill.functions import markup
from trekmill.operators import matching


def test_a_long_chain_of_stops_is_one_cluster(spark):
    rows = [(i, f"net{i % 2}", "Haupt Bahnhof", 46.0 + 0.0006 * i, 7.0) for i in range(200)] + [(900, "net0", "Haupt Bahnhof", 47.0, 7.0)]
    got = dict(map(tuple, matching.name_clusters(spark.createDataFrame(rows, "stop_id long, network string, name string, lat double, lon double")).select("stop_id", "cluster").collect()))
    assert got == {**dict.fromkeys(range(200), 0), 900: 900}


def test_pairs_by_phone_and_by_names(spark):
    schema = "host string, {0} long, kind string, phone string, name string"
    pois = [("IT", 1, "embassy", "+39 06 1234567", "Embassy of Spain"), ("IT", 2, None, None, "Consulate General Chile"), ("IT", 3, "embassy", None, "Embassy"), ("FR", 4, "embassy", None, "Embassy of Spain")]
    missions = [("IT", 11, "embassy", "06-1234567", "Something else"), ("IT", 12, "consulate", None, "Chile Consulate General Milano"), ("IT", 13, "embassy", None, "Embassy of Spain"), ("FR", 14, "consulate", None, "Embassy of Spain")]
    found = matching.embassy_candidates(spark.createDataFrame(pois, schema.format("poi_id")), spark.createDataFrame(missions, schema.format("mission_id")), ["host"])
    assert sorted(tuple(r)[:4] for r in found.collect()) == [("IT", 1, 11, 0), ("IT", 1, 13, 1), ("IT", 2, 12, 1), ("IT", 3, 13, 1)]


def test_terms_keep_their_places_and_unclosed_tags_hide_nothing(spark):
    got = matching.term_links(spark.createDataFrame([(1, "\u0130\u0130 the end")], "section_id long, body string"), ["the"]).collect()
    assert [(r.start, r.end) for r in got] == [(3, 6)]
    assert markup.html_text("<nav><p>a</p><p>b</p>") == "a\nb"
    assert markup.html_text("<nav>x</nav><p>a</p><nav>y<p>b</p>") == "a\nyb".replace("yb", "y\nb")


def test_rounds_give_the_sequential_pairs(spark):
    rng = random.Random(4)
    rows = [(h, p, m, rng.randrange(2), rng.randrange(1, 4)) for h in range(3) for p in range(40) for m in rng.sample(range(30), rng.randrange(0, 8))]
    rows += [(9, p, m, 0, 1) for p in range(12) for m in range(p, p + 2)]  # a chain in which each taker is sent on by the one before
    got = matching.greedy_pairs(spark.createDataFrame(rows, "host int, poi_id long, mission_id long, rank int, kind int"), ["host"]).collect()
    want = []
    for h in {r[0] for r in rows}:
        used = set()
        for p in sorted({r[1] for r in rows if r[0] == h}):
            free = sorted((rank, kind, m) for host, poi, m, rank, kind in rows if (host, poi) == (h, p) and m not in used)
            if free:
                used.add(free[0][2])
                want.append((h, p, free[0][2]))
    assert sorted(map(tuple, got)) == sorted(want)
    assert matching.greedy_pairs(spark.createDataFrame([], "host int, poi_id long, mission_id long, rank int, kind int"), ["host"]).count() == 0


def test_merged_embassies(spark):
    pois = spark.createDataFrame([("IT", 1, "embassy", "+39 06 1234567", "Embassy of Spain", None), ("IT", 2, None, None, "Chile", "mine")], "host string, poi_id long, kind string, phone string, name string, site string")
    missions = spark.createDataFrame([("IT", 11, "embassy", "06-1234567", "Ambasciata", "a", False), ("IT", 12, "other", None, "Consulate of Chile", "b", False), ("IT", 13, "embassy", None, "Embassy of Spain", "c", True)], "host string, mission_id long, kind string, phone string, name string, site string, local boolean")
    got = matching.merge_embassies(pois, missions, ["host"], ["phone", "site"]).orderBy(F.col("kind").asc_nulls_first(), F.desc("local"), "name_key").collect()
    assert [(r.poi_id, r.mission_id, r.kind, r.phone, r.site, r.local) for r in got] == [(2, None, None, None, "mine", True), (1, 11, 1, "+39 06 1234567", "a", True), (None, 13, 1, None, "c", True), (None, 12, 3, None, "b", False)]


def brute_terms(body, vocabulary):
    """A loop over all terms, each looked for from the start until a place is free."""
    low, taken, out = "".join(c.lower() if len(c.lower()) == 1 else c for c in body or ""), [], []
    for term in sorted(set(vocabulary), key=lambda t: (-len(t), t)):
        at = low.find(term.lower())
        while at >= 0:
            end = at + len(term)
            bounded = (at == 0 or not low[at - 1].isalnum()) and (end == len(low) or not low[end].isalnum())
            if bounded and all(end <= a or at >= b for a, b in taken):
                taken.append((at, end))
                out.append((term, at, end))
                break
            at = low.find(term.lower(), at + 1)
    return out


def test_terms_against_a_loop_over_all_of_them(spark):
    rng = random.Random(6)
    words = ["old", "town", "old town", "town hall", "hall", "a", "old town hall", "\u00fcber", "hall.", "t"]
    bodies = [" ".join(rng.choice([*words, "Old", "TOWN", "halls", "x", "\u0130"]) for _ in range(rng.randrange(0, 12))) for _ in range(200)] + [None, "", "town-hall old_town"]
    got = {}
    for r in matching.term_links(spark.createDataFrame(list(enumerate(bodies)), "section_id long, body string"), words).collect():
        got.setdefault(r.section_id, []).append((r.term, r.start, r.end))
    assert got == {i: found for i, b in enumerate(bodies) if (found := brute_terms(b, words))}
    assert matching.term_links(spark.createDataFrame([(1, "a")], "section_id long, body string"), []).count() == 0
