import numpy as np
from conftest import SF

from phasorlake.functions import vec
from phasorlake.plans import fixtures


def test_the_divisor_is_worked_out_once_a_row(spark):
    o = fixtures.observations(spark, SF)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().set_index("vec_id")
    for r in o.limit(20).collect():
        y = np.array(rows.loc[r["obs_id"], "embedding"], float)
        assert np.allclose(r["x"], y / np.sqrt((y**2).sum()), rtol=1e-15, atol=0)
    plan = spark.range(1).select(vec.divided(vec.literal([1.0, 3.0]), vec.total(vec.literal([1.0, 3.0]))).alias("x"))
    assert plan.first()["x"] == [0.25, 0.75]
