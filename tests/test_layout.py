import pytest

from phasorlake.operators import hmm
from phasorlake.plans import registry


def test_layout_of_a_last_period_that_is_not_full(spark, duck):
    ids = spark.range(57).selectExpr("id AS vec_id")
    got = hmm.sequenced(ids.withColumnRenamed("vec_id", "obs_id"), [10, 20, 20]).toPandas()
    expected = duck.execute(registry.ORACLE_SQL["h1_layout"].replace("FROM embeddings", "FROM (SELECT unnest(range(57)) AS vec_id)")).df()
    assert got[["obs_id", "seq_id", "t"]].values.tolist() == expected[["obs_id", "seq_id", "t"]].sort_values("obs_id").values.tolist()
    with pytest.raises(ValueError):
        hmm.sequenced(ids.withColumnRenamed("vec_id", "obs_id"), [0])
