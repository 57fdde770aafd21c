"""Importance resampling: held-out separation, exact k, odd rows."""

import math
import zlib

from palimpsest.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    got = quality.resample(docs, labels, 0.8, rows_per_range=100).toPandas()
    assert got["selected"].sum() == math.ceil(0.8 * len(got))
    assert got.loc[got["selected"], "key"].min() >= got.loc[~got["selected"], "key"].max() - 1e-8
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[[zlib.crc32(str(d).encode()) % 4 == 2 for d in both["doc_id"]]]
    a, b = (held.loc[held["quality"] == q, "log_weight"].to_numpy() for q in (1, 0))
    assert (a[:, None] > b).mean() > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c"), (4, ""), (4, "x " * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, None)], "doc_id long, quality int")
    assert quality.resample(docs, labels, 0.5).filter("selected").count() == 3
    assert quality.resample(docs, labels.limit(0), 1.0).filter("selected").count() == 5
    assert quality.resample(docs.limit(0), labels).count() == 0
