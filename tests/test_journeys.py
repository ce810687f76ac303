import random
from itertools import groupby

from trekmill.operators import journeys


def brute(calls, foot, access, egress, rounds, change=1):
    """Least arrivals by rides, by plain loops over whole states: (stop, how it was reached)."""
    by_trip = {t: list(g) for t, g in groupby(sorted(calls), key=lambda c: c[0])}
    never = 1 << 30
    state = {(s, "walk"): depart + walk for s, depart, walk in access}
    best, known, out = never, {s: at for (s, _), at in state.items()}, []
    for k in range(1, rounds + 1):
        ride, walked = {}, {}
        for own in by_trip.values():
            for i, (_, _, stop, _, departure) in enumerate(own):
                if any(departure >= at + (change if how == "ride" else 0) for (s, how), at in state.items() if s == stop):
                    for _, _, to, arrival, _ in own[i + 1 :]:
                        if arrival < min(ride.get(to, never), known.get(to, never), best):
                            ride[to] = arrival
        for a, b, walk in foot:
            if a in ride and ride[a] + walk + change < min(walked.get(b, never), ride.get(b, never), known.get(b, never), best):
                walked[b] = ride[a] + walk + change
        state = {(s, "ride"): at for s, at in ride.items() if s not in walked} | {(s, "walk"): at for s, at in walked.items()}
        known |= {s: at for (s, _), at in state.items()}
        ends = [walked.get(s, ride[s]) + walk for s, walk in egress if s in ride]  # alighted there, perhaps walked there sooner
        if ends and min(ends) < best:
            best = min(ends)
            out.append((k, best))
    return out


def frames(spark, calls, foot, ends, board=True):
    c = spark.createDataFrame([(*x, board) for x in calls], "trip_id long, seq int, stop_id long, arrival long, departure long, can_board boolean")
    f = spark.createDataFrame(foot, "from_id long, to_id long, walk long")
    a = spark.createDataFrame([(q, s, d, w) for q, (acc, _) in ends.items() for s, d, w in acc], "query_id int, stop_id long, depart long, walk long")
    e = spark.createDataFrame([(q, s, w) for q, (_, eg) in ends.items() for s, w in eg], "query_id int, stop_id long, walk long")
    return c, f, a, e


def test_legs_against_brute_force(spark):
    rng = random.Random(5)
    calls, foot = [], []
    for t in range(60):
        at = rng.randrange(0, 200)
        for seq, stop in enumerate(rng.sample(range(14), rng.randint(2, 5))):
            calls.append((t, seq, stop, at, at + rng.randrange(3)))
            at = calls[-1][4] + rng.randrange(2, 20)
    foot = [(a, b, rng.randrange(1, 9)) for a in range(14) for b in range(14) if a != b and rng.random() < 0.1]
    ends = {q: ([(s, 10 * q, rng.randrange(4)) for s in rng.sample(range(14), 2)], [(s, rng.randrange(4)) for s in rng.sample(range(14), 2)]) for q in range(6)}
    got = journeys.journeys(*frames(spark, calls, foot, ends), rounds=3).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rides, r.leg)):
        found.setdefault((r.query_id, r.rides), []).append(r)
    want = {(q, k): total for q, (acc, eg) in ends.items() for k, total in brute(calls, foot, acc, eg, 3)}
    assert {key: legs[-1].arrival for key, legs in found.items()} == want and want
    at_call = {(t, seq): c for t, seq, *c in calls}
    for (q, rides), legs in found.items():
        assert legs[0].from_stop is None and legs[-1].to_stop is None and sum(x.kind == "ride" for x in legs) == rides
        assert legs[0].arrival == legs[1].departure and legs[0].departure >= 10 * q  # leaves as late as the first ride allows
        for a, b in zip(legs, legs[1:], strict=False):
            assert a.to_stop == b.from_stop and a.arrival + (1 if a.kind == b.kind == "ride" else 0) <= b.departure
        for x in legs:
            if x.kind == "ride":
                assert at_call[x.trip_id, x.from_seq][0] == x.from_stop and at_call[x.trip_id, x.from_seq][2] == x.departure
                assert at_call[x.trip_id, x.to_seq][:2] == [x.to_stop, x.arrival]
            elif x.from_stop is not None and x.to_stop is not None:
                assert any((a, b, x.arrival - x.departure - 1) == (x.from_stop, x.to_stop, w) for a, b, w in foot)


def test_nothing_to_board_or_to_ask(spark):
    calls, ends = [(1, 0, 1, 5, 5), (1, 1, 2, 9, 9)], {1: ([(1, 0, 0)], [(2, 0)])}
    assert journeys.journeys(*frames(spark, calls, [], ends, board=False), rounds=2).count() == 0
    assert [(r.kind, r.arrival) for r in journeys.journeys(*frames(spark, calls, [], ends), rounds=1).orderBy("leg").collect()] == [("walk", 5), ("ride", 9), ("walk", 9)]
    assert journeys.journeys(*frames(spark, calls, [], {}), rounds=1).count() == 0


def test_minima_are_of_numbers_and_joins_back_are_not_nested(spark, monkeypatch):
    """minima of structs sorted all rows of a task's joins, and the last leg's join held the sorts of all before it."""
    plans, write = [], journeys.written
    monkeypatch.setattr(journeys, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    calls = [(t, seq, (t + 3 * seq) % 7, 10 * seq + t % 5, 10 * seq + t % 5) for t in range(20) for seq in range(4)]
    got = journeys.journeys(*frames(spark, calls, [(1, 2, 3)], {1: ([(0, 0, 0)], [(6, 1)])}), rounds=2).collect()
    want = brute(calls, [(1, 2, 3)], [(0, 0, 0)], [(6, 1)], 2)
    assert {r.rides: r.arrival for r in got if r.to_stop is None} == dict(want) and want
    minima = [line for p in plans for line in p.split("min(struct(")[1:]]
    assert not any("trip_id" in m.split("AS")[0] or "from_seq" in m.split("AS")[0] for m in minima)
    assert max(p.count("Join") for p in plans if "AS kind" in p) <= 1
