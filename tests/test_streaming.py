"""Weekly features of a stream: equal to those of a batch, with late rows and keys that fall silent."""

import datetime

import pytest
from pyspark.sql import functions as F

from weekloom.operators import features, panel
from weekloom.params import Params
from weekloom.streaming import histories

FIRST = datetime.date(2022, 1, 3)
SCHEMA = "transaction_date timestamp, pdv bigint, internal_product_id bigint, quantity double"


def at(week, day=0, hour=12):
    return datetime.datetime(2022, 1, 3, hour) + datetime.timedelta(days=7 * (week - 1) + day)


def streamed(spark, tmp_path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = histories.weekly_features(stream, FIRST).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.read.parquet(f"{tmp_path}/out")


def test_a_stream_in_batches_equals_the_batch_features(spark, tmp_path):
    rows = [(at(w, d), k, 1, float((w * 7 + k * 3 + d) % 11) - 1) for w in range(1, 40) for k in (1, 2) for d in (0, 3) if (w + k) % 5]
    batches = [[r for r in rows if lo <= (r[0] - at(1, 0, 0)).days // 7 < lo + 10] for lo in range(0, 40, 10)]
    batches[1], late_but_in_time = batches[1][:-2], batches[1][-2:]
    batches[2] = late_but_in_time + batches[2]
    got = streamed(spark, tmp_path, [*batches, [(at(60), -1, -1, 0.0)]]).filter("pdv > 0")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("gross_value", F.lit(0.0)).withColumn("week_of_year", (F.floor(F.datediff("transaction_date", F.lit(FIRST)) / 7) + 1).cast("long"))
    want = features.basic_features(panel.weekly_panel(df), Params()).drop("gross")
    columns = got.columns
    mine, theirs = (sorted(tuple(r) for r in x.select(*columns).collect()) for x in (got, want))
    assert len(mine) == len(theirs) > 50
    assert all(a == pytest.approx(b) for a, b in zip(mine, theirs))


def test_rows_of_closed_weeks_are_left_out_and_silent_keys_close(spark, tmp_path):
    """Batches are taken in the order in which they were written; what is odd about a row doesn't stop the stream."""
    odd = [(None, 1, 1, 5.0), (at(2), None, 1, 5.0), (at(-3), 1, 1, 5.0)]
    batches = [[(at(1), 1, 1, 2.0), (at(1), 9, 9, 4.0), *odd], [(at(2), 1, 1, None)], [(at(20), 1, 1, 1.0)], [(at(1, 2), 1, 1, 100.0), (at(21), 1, 1, 3.0)], [(at(60), -1, -1, 0.0)]]
    got = {(r.pdv, r.week_of_year): (r.qty, r.lag_1) for r in streamed(spark, tmp_path, batches).filter("pdv > 0").collect()}
    assert got == {(1, 1): (2.0, 0.0), (1, 2): (0.0, 2.0), (1, 20): (1.0, 0.0), (1, 21): (3.0, 1.0), (9, 1): (4.0, 0.0)}
