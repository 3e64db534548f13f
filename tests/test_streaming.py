"""The streaming forms give the batch rows once windows close."""

from pyspark.sql import functions as F

from amperic.operators.snapshots import majority_resample, powered_snapshot
from amperic.plans.flows import located_readings
from amperic.streaming.windows import stream_resample, stream_snapshot


def test_stream_equals_batch(spark, tmp_path):
    cols = ["core_id", "time", "is_powered", "location_latitude", "location_longitude"]
    rows = located_readings(spark, "/root/testdata/sf0.001").select(*cols)
    rows.repartition(1).sortWithinPartitions("time").write.parquet(f"{tmp_path}/in")
    # the batch rows of every window closed by the last reading less the lateness
    edge = rows.agg(F.max("time")).first()[0]
    for name, stream_op, batch_op, stamp, width in (
        ("snap", stream_snapshot, powered_snapshot, "minute", 240),
        ("maj", stream_resample, majority_resample, "time", 150),
    ):
        source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        q = (
            stream_op(source).writeStream.format("memory").queryName(name).outputMode("append")
            .option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        )
        try:
            q.awaitTermination(120)
        finally:
            q.stop()
        closed = F.unix_timestamp(stamp) + width <= int(edge.timestamp()) - 600
        want = {tuple(r) for r in batch_op(rows).filter(closed).select(stamp, "core_id").collect()}
        got = {tuple(r) for r in spark.table(name).select(stamp, "core_id").collect()}
        assert want and want <= got
        assert got <= {tuple(r) for r in batch_op(rows).select(stamp, "core_id").collect()}


def _run(stream, name, folder):
    q = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    )
    try:
        q.awaitTermination(240)
    finally:
        q.stop()
    return q


def _batches(spark, rows, schema, folder, n):
    """Files that are read one a micro-batch, in the order of their times."""
    import os
    import time

    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    stamp = time.time() - 1000
    files = sorted((f for f in os.listdir(folder) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{folder}/{f}"))
    for i, f in enumerate(files):
        os.utime(f"{folder}/{f}", (stamp + i, stamp + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_outages_from_shuffled_micro_batches(spark, tmp_path):
    """Out of order within the lateness, repeated, with unknown states: the batch's outages."""
    import datetime as dt
    import random

    from amperic.operators.transitions import outages
    from amperic.streaming.outages import stream_outages

    rng = random.Random(4)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        at = base + dt.timedelta(seconds=rng.choice([20 * i, 20 * i + rng.randint(0, 50)]))
        millis = float(i * 1000)
        edge = rng.choice([None, 0.0, millis - 3000.0, millis + 5.0, float("nan")])
        rows.append((rng.choice([1, 1, 1, 2, 3]), at, i, rng.choice([True, False, True, False, None]), millis, edge, edge))
    end = (9, base + dt.timedelta(days=2), 10_000, True, 0.0, None, None)
    # shuffled within some minutes, and one in five sent twice
    sent = sorted(rows + rng.sample(rows, 120), key=lambda r: r[1] + dt.timedelta(seconds=rng.randint(0, 500))) + [end]
    schema = "core_id long, time timestamp, event_id long, is_powered boolean, millis double, last_unplug_millis double, last_plug_millis double"
    source = _batches(spark, sent, schema, f"{tmp_path}/in", 6)
    _run(stream_outages(source, lateness="20 minutes"), "shuffled_outages", tmp_path)
    cols = ["core_id", "event_id", "time", "outage_time", "restore_time"]
    got = sorted(tuple(r) for r in spark.table("shuffled_outages").select(*cols).collect())
    want = sorted(tuple(r) for r in outages(spark.createDataFrame(rows, schema)).select(*cols).collect())
    assert len(want) > 20 and got == want


def test_clusters_from_a_stream(spark, tmp_path):
    import datetime as dt
    import random

    from amperic.operators.clusters_time import dbscan_time
    from amperic.streaming.outages import stream_clusters

    rng = random.Random(5)
    base = 1704067200
    seconds = [base + x for x in [0, 90, 181, 300, 300, 300, 391, 5000, 5090] + [rng.randint(0, 40_000) for _ in range(250)]]
    rows = [(dt.datetime.fromtimestamp(s, dt.UTC).replace(tzinfo=None) + dt.timedelta(microseconds=rng.randint(0, 999_999)),) for s in seconds]
    sent = sorted(rows, key=lambda r: r[0] + dt.timedelta(seconds=rng.randint(0, 400)))
    sent += [(dt.datetime(2024, 2, 1),)]
    source = _batches(spark, sent, "time timestamp", f"{tmp_path}/in", 4)
    _run(stream_clusters(source, eps=90, lateness="15 minutes"), "stream_clusters", tmp_path)
    got = sorted(tuple(r) for r in spark.table("stream_clusters").collect())
    batch = dbscan_time(spark.createDataFrame([(s,) for s in seconds], "outage_time bigint"), eps=90)
    per: dict = {}
    for r in batch.collect():
        key = r["label"] if r["label"] >= 0 else ("noise", r["outage_time"])
        per.setdefault(key, []).append(r["outage_time"])
    want = sorted((k if not isinstance(k, tuple) else -1, min(v), max(v), len(v)) for k, v in per.items())
    assert got == want and len({w[0] for w in want}) > 10
