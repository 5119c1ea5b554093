"""The expiring counters over a stream against those over the table."""

import datetime as dt
import random

from lexiloom.streaming.rate_limit import rate_limit, rate_limit_stream

EVENTS = "user_id string, event_id long, ts timestamp"


def test_stream_tells_what_the_table_does(spark, tmp_path):
    """Events come out of order over several files; a far one moves the watermark past them all, and then the state is gone."""
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("abc"), i, start + dt.timedelta(seconds=rng.randrange(600), milliseconds=rng.randrange(1000))) for i in range(240)]
    rows.sort(key=lambda r: r[2] + dt.timedelta(seconds=rng.randrange(40)))  # at most 40 seconds out of order
    far = [("z", 1000, start + dt.timedelta(hours=2)), ("z", 1001, start + dt.timedelta(hours=4)), ("z", 1002, start + dt.timedelta(hours=6))]
    parts = [rows[a : a + 60] for a in range(0, 240, 60)] + [[f] for f in far]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"p{k}"))
    # files are taken in the order of their times
    import os

    for k in range(len(parts)):
        for f in (tmp_path / "in" / f"p{k}").glob("part-*"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    out = rate_limit_stream(stream, limit=4, seconds=30, late="1 minute")
    query = out.writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    got = {(r["key"], r["event_id"], r["allowed"]) for r in spark.table("decided").where("key <> 'z'").collect()}
    want = {tuple(r) for r in rate_limit(spark.createDataFrame(rows, EVENTS), limit=4, seconds=30).collect()}
    assert got == want and {a for _, _, a in got} == {True, False}
    sizes = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) >= 6 and sizes[-1] <= 2, sizes  # a row for the counter of a key, one for what waits
