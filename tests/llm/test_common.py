from __future__ import annotations

from types import SimpleNamespace

import pytest

from quire.llm import common


def test_hot_keys_are_dealt_out_and_no_row_is_lost(spark):
    left = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 40)) k", "'x' _salt")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("other", 3)], "k string, v int")
    plain = lambda df: sorted(map(str, df.select("id", "k", "_salt", "v").collect()))
    for how in ("inner", "left"):
        want = plain(left.join(right, "k", how))
        assert plain(common.join_skewed(left, right, "k", how)) == plain(common.join_small(left, common.materialize(right, "r"), "k", how)) == want


def test_a_cluster_must_name_its_shared_folder():
    conf = SimpleNamespace(get=lambda *a: None)
    for master, fine in (("spark://x:1", False), ("local-cluster[2,1,1024]", False), ("yarn", False)):
        session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
        with pytest.raises(ValueError, match="share"):
            common.shared_dir(session)
