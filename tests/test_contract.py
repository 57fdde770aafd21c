"""Descriptions of records: completeness of nested values and where two differ."""

import json
import random

from pyspark.sql import functions as F

from palimpsest.operators import contract
from palimpsest.plans.comparisons import WHOLE


def says(v, depth=0):
    """Walk of a value, part by part."""
    if isinstance(v, str):
        return v.strip().lower() not in ("", "n/a", "unknown", "unavailable")
    if isinstance(v, (dict, list)):
        parts = list(v.values()) if isinstance(v, dict) else v
        return bool(parts) and all(map(says, parts)) and (isinstance(v, list) or all(k.strip() for k in v))
    return v is not None


def some(rng, depth):
    kind = rng.randrange(5 if depth else 3)
    if kind == 3:
        return [some(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 4:
        return {rng.choice(["a", "null", "n/a", 'q":', "[]"] + ["  "] * (rng.random() < 0.2)): some(rng, depth - 1) for _ in range(rng.randrange(4))}
    return rng.choice([1, 0, 2.5, True, False, "x", 'a "null" b', "[],{}", "\\", "null", "-n/a", "ok:"] + [None, "", " \t\n ", "\x0b", " N/A ", "Unknown\n"] * (rng.random() < 0.1))


def test_any_depth(spark):
    rng = random.Random(3)
    values = [some(rng, 4) for _ in range(1500)] + ["x" * 200000, [[[[[[["deep", None]]]]]]]]
    rows = [(i, json.dumps(v, ensure_ascii=rng.random() < 0.5)) for i, v in enumerate(values)]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i long, j string").select("i", contract.tells(F.parse_json("j")).alias("t")).collect()}
    assert [v for i, v in enumerate(values) if got[i] != says(v)] == []
    assert 300 < sum(got.values()) < 1400


def changed(**more):
    out = json.loads(json.dumps(WHOLE))
    for path, v in more.items():
        *above, last = path.split("__")
        at = out
        for p in above:
            at = at[p]
        if v is ...:
            del at[last]
        else:
            at[last] = v
    return out


def test_fields(spark):
    env, config = "benchmark_environment", "effective_ocr_config"
    cpu = {"effective_gpu_backend": " CPU ", f"{config}__gpu_backend": " CPU ", f"{config}__gpu_device_id": None, f"{env}__gpu_devices": [], f"{env}__gpu_runtimes": {}}
    cases = [
        (changed(), []),
        (changed(dpi=True), ["effective_ocr_config", "dpi"]),
        (changed(dpi=300.5), ["effective_ocr_config", "dpi"]),
        (changed(warmup_runs=-1), ["warmup_runs"]),
        (changed(effective_dictionary_sha256=...), ["effective_dictionary_sha256"]),
        (changed(effective_dictionary_sha256="A" * 64), []),
        (changed(effective_font_sha256=None, text_extractor=" unknown"), ["effective_font_sha256", "text_extractor"]),
        (changed(**cpu), []),
        (changed(**cpu | {f"{config}__gpu_device_id": 0}), [config]),
        (changed(**cpu | {f"{config}__gpu_device_id": ...}), [config]),
        (changed(**{f"{env}__gpu_runtimes": {"tensorrt": "1"}}), [env]),
        (changed(**{f"{env}__gpu_runtimes": {"torch": "1", "paddle": None}}), []),
        (changed(**{f"{env}__dependencies__other": ""}), [env]),
        (changed(**{f"{env}__dependencies__onnxruntime": ...}), [env]),
        (changed(**{f"{env}__schema_version": 2}), [env]),
        (changed(**{f"{env}__gpu_devices": ["card"]}), [env]),
        (changed(**{f"{env}__more": None, f"{config}__more": None}), []),
        (changed(peak_rss_sample_interval_seconds="1"), ["peak_rss_sample_interval_seconds"]),
        ([1], list(contract.FIELDS)),
    ]
    rows = [(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, None)]
    x = contract.described(spark.createDataFrame(rows, "i long, j string").withColumn("contract", F.parse_json("j")))
    got = {r.i: r for r in x.select("i", "contract_missing", F.map_keys("contract_values").alias("told")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i].contract_missing == want, i
        assert set(got[i].told) == set(contract.FIELDS) - set(want)
    assert got[99].contract_missing == list(contract.FIELDS)


def test_what_differs(spark):
    env = "benchmark_environment"
    cpu = {"effective_gpu_backend": "off", "effective_ocr_config__gpu_backend": "off", "effective_ocr_config__gpu_device_id": None}
    pairs = [
        (changed(), changed(), []),
        (changed(**{f"{env}__gpu_runtimes": {"torch": "1", "tensorrt": "1"}}), changed(**{f"{env}__gpu_runtimes": {"tensorrt": "2", "torch": "1"}}), []),
        (changed(**cpu), changed(**cpu | {f"{env}__gpu_devices": [], f"{env}__gpu_runtimes": {}}), []),
        (changed(), changed(effective_dictionary_sha256="b" * 64), ["effective_dictionary_sha256"]),
        (changed(), changed(**{f"{env}__cpu_count": 9}), [env]),
        (changed(), changed(text_extractor="unknown"), []),
        (changed(peak_rss_sample_interval_seconds=1), changed(peak_rss_sample_interval_seconds=1.0), []),
    ]
    x = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b, _) in enumerate(pairs)], "i long, a string, b string")
    a, b = (contract.described(x.select("i", F.parse_json(c).alias("contract"))).select("i", F.col("contract_values").alias(c)) for c in "ab")
    got = {r.i: r.d for r in a.join(b, "i").select("i", contract.differing(F.col("a"), F.col("b")).alias("d")).collect()}
    assert [got[i] for i in range(len(pairs))] == [want for *_, want in pairs]
