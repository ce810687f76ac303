"""The stream of fixes against the same rules over the whole table, and against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest

from trekmill.streaming import navigation
from trekmill.streaming.navigation import Motion

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def brute(fixes, motion, idle):
    """Trips of one user by plain loops. fixes: (at, progress) in order."""
    trips = []
    for at, progress in fixes:
        if not trips or at - trips[-1]["at"] > idle:
            trips.append({"started": at, "fixes": 1, "at": at, "reached": progress, "speed": None, "reach": motion.ahead})
            continue
        t = trips[-1]
        seconds = at - t["at"]
        limit = motion.max_speed if t["speed"] is None else min(t["speed"] * motion.factor + motion.slack, motion.max_speed)
        t["reach"] = min(limit * seconds + motion.error, motion.ahead)
        reached = max(t["reached"], progress)
        if seconds > 0:
            seen = min(max((reached - t["reached"]) / seconds, 0.0), motion.max_speed)
            t["speed"] = seen if t["speed"] is None else t["speed"] + (seen - t["speed"]) * motion.smoothing
        t |= {"fixes": t["fixes"] + 1, "at": at, "reached": reached}
    return trips


def walks(users=6, n=40, seed=2):
    rng = random.Random(seed)
    rows = []
    for u in range(users):
        at, p = rng.randrange(100), 0.0
        for _ in range(n):
            at += rng.choice([0, 1, 5, 20, 20, 90, 4000])
            p += rng.uniform(-20, 200)
            rows.append((u, float(at), p))
    return rows


@pytest.mark.parametrize("motion", [Motion(), Motion(max_speed=3.0, ahead=400.0)])
def test_table_and_steps_against_loops(spark, motion):
    rows = walks()
    got = navigation.tracked(spark.createDataFrame([(u, a, p, i) for i, (u, a, p) in enumerate(rows)], "user_id long, at double, progress double, i int"), motion, tie="i").collect()
    want = {(u, t["started"]): t for u in {r[0] for r in rows} for t in brute([r[1:] for r in rows if r[0] == u], motion, 1800)}
    assert len(got) == len(want)
    for r in got:
        t = want[r.user_id, r.started]
        assert (r.fixes, r.at, r.reached) == (t["fixes"], t["at"], t["reached"])
        assert (r.speed is None) == (t["speed"] is None) and abs((r.speed or 0) - (t["speed"] or 0)) < 1e-9 and abs(r.reach - t["reach"]) < 1e-9
    own = [r[1:] for r in rows if r[0] == 0][:12]
    first = brute(own, motion, 1 << 30)[0]
    for cut in (0, 1, 5, 11, 12):  # however the fixes are dealt to batches
        state = None
        for part in (own[:cut], own[cut:]):
            if part:
                state = navigation.steps(np.array([a for a, _ in part]), np.array([p for _, p in part]), state, motion)
        assert state == pytest.approx(tuple(first[k] for k in ("started", "fixes", "at", "reached", "speed", "reach")))


def test_stream_equals_table(spark, tmp_path):
    rows = [(u, a, p) for u, a, p in walks(users=3, n=25)]
    rows = list({(u, a): (u, a, p) for u, a, p in rows}.values())
    schema = "user_id long, stamp timestamp, progress double"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        seen = []

        def run():
            stream = navigation.tracked_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), late="1 second")
            query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda batch, _: seen.extend(batch.collect())).start()
            query.awaitTermination()

        ordered = sorted(rows, key=lambda r: r[1])
        for part in (ordered[:30], ordered[30:50], ordered[50:], [(9, ordered[-1][1] + 1e5, 0.0)]):  # restarted each time; the last moves the watermark on
            spark.createDataFrame([(u, T0 + dt.timedelta(seconds=a), p) for u, a, p in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    ended = {(r.user_id, round(r.started - T0.timestamp())): r for r in seen if r.ended}
    want = {(u, round(t["started"])): t for u in range(3) for t in brute(sorted(r[1:] for r in rows if r[0] == u), Motion(), 1800)}
    assert set(ended) == set(want)
    for key, t in want.items():
        r = ended[key]
        assert (r.fixes, round(r.at - T0.timestamp())) == (t["fixes"], round(t["at"])) and abs(r.reached - t["reached"]) < 1e-9 and abs((r.speed or 0) - (t["speed"] or 0)) < 1e-6
