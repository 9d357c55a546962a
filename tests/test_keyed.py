"""Keyed state against a plain recomputation: late revisions, replays, restarts and days that expire."""

import random
from datetime import datetime, timedelta

from seastate import schemas
from seastate.session import work_path
from seastate.streaming import ingest as St
from seastate.streaming import keyed as Kd

ORDER = ["ingest_utc", "source", "hs_m", "tp_s", "dp_deg"]
START = datetime(2024, 1, 1)


def land(spark, folder, rows):
    spark.createDataFrame(rows, schemas.OBS).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, table, checkpoint):
    Kd.ingest_latest(St.file_stream(spark, folder, schemas.OBS, files_per_batch=100), table, checkpoint, schemas.OBS, St.OBS_KEYS, "valid_utc", ORDER, 14)


def row(spark, station, hour, part, hs, ingest, source="x"):
    names = [c.split()[0] for c in schemas.OBS.split(",")]
    given = {"station": station, "valid_utc": START + timedelta(hours=hour), "partition": part, "hs_m": hs, "tp_s": None, "dp_deg": float("nan"),
             "source": source, "ingest_utc": START + timedelta(hours=ingest)}
    return tuple(given[n] for n in names)


def best(rows, spark):
    names = [c.split()[0] for c in schemas.OBS.split(",")]
    out = {}
    for r in rows:
        d = dict(zip(names, r, strict=True))
        key = (d["station"], d["valid_utc"], d["partition"])
        rank = Kd.rank([d[c] for c in ORDER])
        if key not in out or rank > out[key][0]:
            out[key] = (rank, d["hs_m"])
    return {k: v[1] for k, v in out.items()}


def stored(spark, table):
    return {(r.station, r.valid_utc, r.partition): r.hs_m for r in St.read_table(spark, table, schemas.OBS).collect()}


def test_late_revisions_replays_restarts_and_expiry(spark):
    rng = random.Random(4)
    folder, table, checkpoint = (work_path(spark, k) for k in ("landed", "latest", "ckpt"))
    first = [row(spark, rng.choice("ab"), rng.randrange(48), rng.randrange(2), rng.choice([None, 1.0, 2.0, float(i)]), i % 7) for i in range(60)]
    land(spark, folder, first)
    run(spark, folder, table, checkpoint)
    assert stored(spark, table) == best(first, spark)

    # A restart with late revisions, older copies and repeats of stored rows.
    late = [row(spark, r[0], 0, 0, 9.0, 50) for r in first[:1]] + [row(spark, "a", 1, 1, 7.0, -5), *first[:10]]
    land(spark, folder, late)
    run(spark, folder, table, checkpoint)
    assert stored(spark, table) == best(first + late, spark)

    # Nothing new: the table's files stay as they are.
    before = spark.read.parquet(f"{table}/data").count()
    land(spark, folder, first[:20])
    run(spark, folder, table, checkpoint)
    assert spark.read.parquet(f"{table}/data").count() == before

    # Fifteen and a half days on, the first day has expired; the second is within reach.
    newest = [row(spark, "a", 24 * 15 + 12, 0, 3.0, 400)]
    land(spark, folder, newest)
    run(spark, folder, table, checkpoint)
    limit = START + timedelta(days=1)
    assert stored(spark, table) == {k: x for k, x in best(first + late + newest, spark).items() if k[1] >= limit}

    # A row of an expired day that comes after all is not taken up again.
    land(spark, folder, [row(spark, "b", 2, 0, 5.0, 500)])
    run(spark, folder, table, checkpoint)
    assert min(k[1] for k in stored(spark, table)) >= limit


def test_ranks_follow_spark():
    nan = float("nan")
    assert Kd.rank([None]) < Kd.rank([-1.0]) < Kd.rank([2.0]) < Kd.rank([nan])
    assert Kd.rank([1, None]) < Kd.rank([1, 0]) and Kd.rank([nan, 1]) < Kd.rank([nan, 2])
