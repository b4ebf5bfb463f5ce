"""k-means peer groups: the users are made once however many fits read them, in few tasks."""
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vigil.operators import features as FT
from vigil.session import release


def test_users_are_made_once_for_all_fits(spark):
    made = spark.sparkContext.accumulator(0)

    def rate(i):
        made.add(1)
        return float(i % 4) * 10 + i / 1000

    u = F.udf(rate, DoubleType())
    users = spark.range(0, 60, 1, 30).select(F.concat(F.lit("u"), "id").alias("user_id"), u("id").alias("file_rate"),
                                             *[F.lit(0.0).alias(c) for c in ("logon_rate", "device_rate", "http_rate")])
    groups = FT.kmeans_peer_groups(users, n_init=2)
    rows = {r.user_id: r.peer_group for r in groups.collect()}
    assert rows == {f"u{i}": i % 4 for i in range(60)} and groups.rdd.getNumPartitions() == 1
    assert made.value <= 60
    release()
