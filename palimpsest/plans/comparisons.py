"""Queries of comparisons of runs whose records describe how they were made, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import contract, records
from palimpsest.plans.queries import table

SHA = "0123456789abcdef" * 4
#: A whole description; the faults below are put in by replacing parts of its text.
WHOLE = {
    "manifest_sha256": SHA,
    "ground_truth_language": "en",
    "effective_engine_type": "onnxruntime",
    "effective_ocr_version": "v5",
    "effective_model_type": "mobile",
    "effective_rec_batch_num": 6,
    "effective_gpu_backend": "torch",
    "effective_rec_model_sha256": SHA,
    "effective_det_model_sha256": SHA,
    "effective_dictionary_sha256": None,
    "effective_font_sha256": SHA,
    "effective_language_hint": "latin",
    "effective_ocr_config": {**{c: 1 for c in contract.CONFIG}, "language": "latin", "dpi": 300, "engine_type": "onnxruntime", "ocr_version": "v5", "model_type": "mobile", "rec_batch_num": 6, "gpu_backend": "torch", "gpu_device_id": 0, "requested_gpu_device_id": 0},
    "dpi": 300,
    "warmup_runs": 0,
    "benchmark_environment": {
        "schema_version": 1,
        "platform": "linux",
        "machine": "x86_64",
        "python": "3.13",
        "cpu_model": "a model",
        "cpu_count": 8,
        "dependencies": {**{c: "1.0" for c in contract.PACKAGES}, "onnxruntime": "1.2"},
        "gpu_devices": [{c: "x" for c in contract.DEVICE}],
        "gpu_runtimes": {"torch": "2.1", "tensorrt": "10.0"},
    },
    "peak_rss_method": "sampled",
    "peak_rss_sample_interval_seconds": 0.5,
    "text_extractor": "a tool",
    "text_extractor_version": "24.02",
}
TEMPLATE = json.dumps(WHOLE, separators=(",", ":"))
#: Of a run: pairs of runs (k mod 40 of a customer) and orders that a fault meets (parity of
#: the pair over 8, residue of the order over 13), and the change of the text.
FAULTS = {
    "base": [
        (1, 0, '"dpi":300,"warmup_runs":0', '"dpi":"300","warmup_runs":-1'),
        (1, 1, '"effective_dictionary_sha256":null,', ""),
        (1, 2, '"cpu_model":"a model"', '"cpu_model":" Unknown "'),
        (1, 3, '"card":"x"', '"card":[]'),
        (2, 4, '"tensorrt":"10.0"', '"tensorrt":"9.0"'),
        (2, 5, '"text_extractor":"a tool"', '"text_extractor":"a \\"null\\" tool"'),
    ],
    "new": [
        (1, 2, '"torch":"2.1",', ""),
        (1, 5, '"onnxruntime":"1.2"', '"onnxruntime":null'),
        (1, 6, '"gpu_device_id":0', '"gpu_device_id":true'),
        (3, 7, '"python":"3.13"', '"python":"3.12"'),
        (3, 8, '"cpu_count":8', '"cpu_count":8.5'),
        (4, 9, '"torch"', '"cpu"'),
        (4, 10, '"gpu_backend":"torch","gpu_device_id":0', '"gpu_backend":"off","gpu_device_id":null'),
        (4, 11, '"peak_rss_sample_interval_seconds":0.5', '"peak_rss_sample_interval_seconds":0'),
        (4, 12, f'"manifest_sha256":"{SHA}"', f'"manifest_sha256":"{SHA}0"'),
    ],
}


def description(run: str) -> Column:
    """The text of a record: faults of one pair of residues are put in one after another."""
    texts: dict[tuple[int, int], str] = {}
    for group, rest, old, new in FAULTS[run]:
        texts[group, rest] = texts.get((group, rest), TEMPLATE).replace(old, new)
    out = F.when(F.lit(False), TEMPLATE)
    for (group, rest), text in texts.items():
        out = out.when((F.col("pair") % 8 == group) & (F.col("k") % 13 == rest), text)
    return out.otherwise(TEMPLATE)


def described_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Forty pairs of runs of one record for each order. Some pairs have faults in their
    descriptions, some lack records, some have records that became worse."""
    k, pair = F.col("o_orderkey"), F.col("o_custkey") % 40
    o = table(spark, d, "orders").select(
        pair.cast("string").alias("benchmark_profile"),
        F.col("o_orderpriority").alias("dataset"),
        k.cast("string").alias("id"),
        F.lit(0).alias("page_index"),
        pair.alias("pair"),
        k.alias("k"),
        F.lit(0.1).alias("char_error_rate"),
        F.lit(0.1).alias("word_error_rate"),
        F.col("o_totalprice").alias("end_to_end_seconds"),
        F.lit(500.0).alias("peak_rss_mb"),
        F.lit(True).alias("text_layer_ok"),
        F.lit(4).alias("ocr_box_count"),
        F.lit(0).alias("pages_with_zero_boxes"),
    )
    base, new = (o.withColumn("contract", description(run)) for run in ("base", "new"))
    slower = F.when((F.col("pair") % 8 == 5) & (F.col("k") % 13 == 0), 1.5).otherwise(1.0)
    lacks = (F.col("pair") % 8 == 6) & (F.col("k") % 13 == 0)
    return base, new.filter(~lacks).withColumn("end_to_end_seconds", F.col("end_to_end_seconds") * slower)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _steps(run: str) -> str:
    """The descriptions of a run, fault by fault."""
    sql = f"{run}0 AS (SELECT *, {quoted(TEMPLATE)} AS c FROM o)"
    for n, (group, rest, old, new) in enumerate(FAULTS[run], 1):
        sql += f", {run}{n} AS (SELECT * REPLACE (CASE WHEN pair % 8 = {group} AND k % 13 = {rest} THEN replace(c, {quoted(old)}, {quoted(new)}) ELSE c END AS c) FROM {run}{n - 1})"
    return sql


def _tells(x: str) -> str:
    says = "|".join(contract.SAYS_NOTHING)
    tokens = f"""regexp_extract_all(CAST({x} AS VARCHAR), '"(?:[^"\\\\]|\\\\.)*":?|null|\\{{\\}}|\\[\\]')"""
    return f"""coalesce(len(list_filter({tokens}, lambda t: regexp_matches(t, '(?i)^(null|\\{{\\}}|\\[\\]|"\\s*":?|"\\s*({says})\\s*")$'))) = 0, false)"""


def _list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def _described_sql(run: str) -> str:
    """incomplete fields (missing) and values as text (v) of the records of a run."""
    at = lambda path: f"json_extract(c, '$.{path}')"
    text = lambda path: f"json_extract_string(c, '$.{path}')"
    number = lambda path, least: f"coalesce(json_type(c, '$.{path}') IN ('BIGINT', 'UBIGINT') AND CAST({at(path)} AS DOUBLE) >= {least}, false)"
    config, env = "effective_ocr_config", "benchmark_environment"
    cpu, known = _list(contract.CPU), _list(contract.RUNTIMES)
    mine = "CASE backend " + " ".join(f"WHEN {quoted(k)} THEN {_list(v)}" for k, v in contract.RUNTIMES.items()) + " ELSE CAST([] AS VARCHAR[]) END"
    all_of = lambda values, cond: f"len(list_filter({values}, lambda f: NOT ({cond}))) = 0"
    inside = lambda path: f"json_extract(c, '$.{path}.\"' || f || '\"')"
    ok = {f: _tells(at(f)) for f in contract.FIELDS}
    ok |= {f: f"coalesce(json_type(c, '$.{f}') = 'VARCHAR' AND regexp_full_match({text(f)}, '[0-9A-Fa-f]{{64}}'), false)" for f in contract.DIGESTS}
    ok[contract.NULL_DIGEST] = f"({ok[contract.NULL_DIGEST]} OR coalesce(json_type(c, '$.{contract.NULL_DIGEST}') = 'NULL', false))"
    ok |= {f: number(f, least) for f, least in (("effective_rec_batch_num", 1), ("dpi", 1), ("warmup_runs", 0))}
    rate = "peak_rss_sample_interval_seconds"
    ok[rate] = f"coalesce(json_type(c, '$.{rate}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND CAST({at(rate)} AS DOUBLE) > 0, false)"
    same = " AND ".join(f"coalesce({at(f'{config}.{a}')} = {at(b)}, false)" for a, b in contract.REPEATED.items())
    told = all_of(_list(f for f in contract.CONFIG if f != "gpu_device_id"), _tells(inside(config)))
    device = f"CASE WHEN backend IN {cpu} THEN json_type(c, '$.{config}.gpu_device_id') = 'NULL' ELSE backend IN {known} AND {number(f'{config}.gpu_device_id', 0)} END"
    ok[config] = f"coalesce({told} AND {same} AND {number(f'{config}.requested_gpu_device_id', 0)} AND {device}, false)"
    parts = all_of(_list(("platform", "machine", "python", "cpu_model")), _tells(inside(env)))
    installed = f"len(list_filter({_list(contract.PACKAGES)}, lambda f: {inside(f'{env}.dependencies')} IS NULL)) = 0 AND {_tells(at(f'{env}.dependencies'))} AND {at(f'{env}.dependencies.onnxruntime')} IS NOT NULL"
    devices = f"json_array_length(c, '$.{env}.gpu_devices') > 0 AND {_tells(at(f'{env}.gpu_devices'))}"
    used = f"list_filter(json_keys(c, '$.{env}.gpu_runtimes'), lambda f: list_contains({mine}, f))"
    runtimes = f"len({used}) > 0 AND {all_of(used, _tells(inside(f'{env}.gpu_runtimes')))}"
    ok[env] = f"coalesce({parts} AND {number(f'{env}.cpu_count', 1)} AND {at(f'{env}.schema_version')} = '1' AND {installed} AND (backend IN {cpu} OR backend IN {known} AND {devices} AND {runtimes}), false)"
    rest = f"CAST(list_transform(['schema_version', 'platform', 'machine', 'python', 'cpu_model', 'cpu_count', 'dependencies'], lambda f: {inside(env)}) AS VARCHAR)"
    value = {f: f"CAST({at(f)} AS VARCHAR)" for f in contract.FIELDS}
    value[env] = f"{rest} || CASE WHEN backend IN {cpu} THEN '' ELSE CAST({at(f'{env}.gpu_devices')} AS VARCHAR) || CAST(list_transform({used}, lambda f: [f, CAST({inside(f'{env}.gpu_runtimes')} AS VARCHAR)]) AS VARCHAR) END"
    flags = ", ".join(f"{ok[f]}" for f in contract.FIELDS)
    values = ", ".join(f"{value[f]}" for f in contract.FIELDS)
    last = f"{run}{len(FAULTS[run])}"
    return f"""{_steps(run)}, {run}b AS (SELECT *, lower(trim(coalesce({text('effective_gpu_backend')}, ''))) AS backend FROM {last}), {run}k AS (SELECT *, [{flags}] AS ok, [{values}] AS v FROM {run}b)"""


RUNS = f"""o AS (SELECT o_orderkey AS k, o_custkey % 40 AS pair FROM orders), {_described_sql("base")}, {_described_sql("new")},
g AS (SELECT b.k, b.pair, CASE WHEN n.k IS NULL THEN 'baseline' ELSE 'both' END AS side, {_list(contract.FIELDS)} AS f, b.ok AS bo, n.ok AS no, b.v AS bv, n.v AS nv FROM basek b LEFT JOIN (SELECT * FROM newk WHERE NOT (pair % 8 = 6 AND k % 13 = 0)) n ON b.k = n.k),
r AS (SELECT k, pair, side, CASE WHEN side = 'both' THEN array_to_string(list_filter(f, lambda x, i: NOT bo[i]), ',') ELSE '' END AS config_missing_base, CASE WHEN side = 'both' THEN array_to_string(list_filter(f, lambda x, i: NOT no[i]), ',') ELSE '' END AS config_missing_new,
CASE WHEN side = 'both' THEN array_to_string(list_filter(f, lambda x, i: bo[i] AND no[i] AND bv[i] IS DISTINCT FROM nv[i]), ',') ELSE '' END AS settings_differ, CASE WHEN side = 'both' AND pair % 8 = 5 AND k % 13 = 0 THEN 'end_to_end_seconds' ELSE '' END AS regressions FROM g)"""


def contract_gate(spark: SparkSession, d: str) -> DataFrame:
    """What each pair of records lacks in its descriptions and where they differ."""
    x = records.compared(*described_runs(spark, d), contract="contract")
    return x.select("id", "side", *(F.array_join(c, ",").alias(c) for c in ("config_missing_base", "config_missing_new", "settings_differ", "regressions")))


CONTRACT_GATE = f"WITH {RUNS} SELECT CAST(k AS VARCHAR) AS id, side, config_missing_base, config_missing_new, settings_differ, regressions FROM r"


def run_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of each of the forty pairs: some pass, some are comparable only, some neither."""
    x = records.verdict(records.compared(*described_runs(spark, d), contract="contract"), ["benchmark_profile"])
    return x.withColumnRenamed("benchmark_profile", "pair")


RUN_VERDICTS = f"""WITH {RUNS}, v AS (SELECT pair, count(*) AS baseline_records, count(*) FILTER (side = 'both') AS candidate_records, count(*) FILTER (side = 'baseline') AS baseline_only, CAST(0 AS BIGINT) AS candidate_only, count(*) FILTER (false) AS metric_missing,
count(*) FILTER (settings_differ <> '') AS settings_mismatch, count(*) FILTER (regressions <> '') AS record_regressions, count(*) FILTER (config_missing_base <> '') + count(*) FILTER (config_missing_new <> '') AS configuration_missing FROM r GROUP BY pair)
SELECT * REPLACE (CAST(pair AS VARCHAR) AS pair), baseline_only + settings_mismatch + configuration_missing = 0 AS comparable, baseline_only + settings_mismatch + configuration_missing + record_regressions = 0 AS passes FROM v"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"contract_gate": contract_gate, "run_verdicts": run_verdicts}


def oracle_sql() -> dict[str, str]:
    return {"contract_gate": CONTRACT_GATE, "run_verdicts": RUN_VERDICTS}
