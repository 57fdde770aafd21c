"""What a benchmark record tells about how it was made: whether that is complete, and
where two records differ in it.

The description is one VARIANT column, so that a field that is missing, one that is null
and values of any depth can be told apart. A nested value is judged by the tokens of its
canonical JSON text, whatever its depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.document import WS

# The fields of a description, those that are digests, those of the
# configuration and of the environment, and what each backend runs on.
FIELDS = (
    "manifest_sha256",
    "ground_truth_language",
    "effective_engine_type",
    "effective_ocr_version",
    "effective_model_type",
    "effective_rec_batch_num",
    "effective_gpu_backend",
    "effective_rec_model_sha256",
    "effective_det_model_sha256",
    "effective_dictionary_sha256",
    "effective_font_sha256",
    "effective_language_hint",
    "effective_ocr_config",
    "dpi",
    "warmup_runs",
    "benchmark_environment",
    "peak_rss_method",
    "peak_rss_sample_interval_seconds",
    "text_extractor",
    "text_extractor_version",
)
DIGESTS = ("manifest_sha256", "effective_rec_model_sha256", "effective_det_model_sha256", "effective_dictionary_sha256", "effective_font_sha256")
NULL_DIGEST = "effective_dictionary_sha256"
CONFIG = (
    "language",
    "dpi",
    "engine_type",
    "requested_engine_type",
    "openvino_available",
    "ocr_version",
    "model_type",
    "rec_batch_num",
    "use_textline_cls",
    "gpu_backend",
    "requested_gpu_backend",
    "gpu_device_id",
    "requested_gpu_device_id",
    "gpu_fp16",
    "gpu_fallback_to_cpu",
    "detection_limit_side_len",
    "detection_full_resolution",
    "box_thresh",
    "unclip_ratio",
    "text_score_threshold",
    "score_mode",
    "ocr_threads",
    "ocr_workers",
    "chunk_size",
)
#: Fields of the configuration that repeat one of the record.
REPEATED = {
    "engine_type": "effective_engine_type",
    "ocr_version": "effective_ocr_version",
    "model_type": "effective_model_type",
    "rec_batch_num": "effective_rec_batch_num",
    "gpu_backend": "effective_gpu_backend",
    "language": "effective_language_hint",
    "dpi": "dpi",
}
ENVIRONMENT = ("schema_version", "platform", "machine", "python", "cpu_model", "cpu_count", "dependencies", "gpu_devices", "gpu_runtimes")
PACKAGES = ("numpy", "Pillow", "pikepdf", "rapidocr")
DEVICE = ("card", "pci_address", "vendor_id", "device_id", "driver", "driver_version")
CPU = ("off", "none", "cpu")
RUNTIMES = {"paddle": ("paddlepaddle", "paddlepaddle-gpu"), "torch": ("torch",), "tensorrt": ("tensorrt",), "onnxruntime_cuda_experimental": ("onnxruntime-gpu",)}
SAYS_NOTHING = ("n/a", "unknown", "unavailable")

#: Strings (with the colon behind a key), nulls and empty containers of a JSON text.
TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+":?|null|\{\}|\[\]'
_SPACE = rf"(?:{WS}|\\[tnrf]|\\u000b|\\u001[c-f])*"
NOTHING = rf'(?i)^(?:null|\{{\}}|\[\]|"{_SPACE}":?|"{_SPACE}(?:{"|".join(SAYS_NOTHING)}){_SPACE}")$'

VARIANTS = "map<string,variant>"
#: So many different descriptions at most come to the driver.
MOST_LOCAL = 500


def tells(value: Column) -> Column:
    """Whether a value tells something: no part of it, at any depth, is null, empty, blank
    or a word for the unknown. False where it is missing."""
    tokens = F.regexp_extract_all(F.to_json(value), F.lit(TOKEN), F.lit(0))
    return F.coalesce(~F.exists(tokens, lambda t: t.rlike(NOTHING)), F.lit(False))


def whole_number(value: Column, least: int) -> Column:
    """An integer of 64 bits that is not below `least`; numbers in texts and booleans aren't."""
    is_int = F.schema_of_variant(value) == "BIGINT"
    return F.coalesce(is_int & (F.try_variant_get(value, "$", "bigint") >= least), F.lit(False))


def positive(value: Column) -> Column:
    number = F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.coalesce(number & (F.try_variant_get(value, "$", "double") > 0), F.lit(False))


def digest(value: Column) -> Column:
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.coalesce(text.rlike(r"^[0-9A-Fa-f]{64}\z"), F.lit(False))


def names(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def all_tell(entries: Column, required: Sequence[str]) -> Column:
    """Whether the required entries of a map are there and tell something, in one pass over
    their JSON text."""
    return holds(entries, required) & tells(F.map_filter(entries, lambda k, _: k.isin(*required)))


def holds(entries: Column, required: Sequence[str]) -> Column:
    return F.size(F.array_except(names(required), F.map_keys(entries))) == 0


def relevant(backend: Column, runtimes: Column) -> Column:
    """The runtimes that a backend uses."""
    known = F.create_map(*(x for k, v in RUNTIMES.items() for x in (F.lit(k), names(v))))
    return F.map_filter(runtimes, lambda k, _: F.array_contains(F.coalesce(known[backend], F.array().cast("array<string>")), k))


def config_complete(record: Column, config: Column, backend: Column) -> Column:
    same = [F.to_json(config[a]).eqNullSafe(F.to_json(record[b])) for a, b in REPEATED.items()]
    told = all_tell(config, [c for c in CONFIG if c != "gpu_device_id"])
    device = F.when(backend.isin(*CPU), F.is_variant_null(config["gpu_device_id"])).otherwise(backend.isin(*RUNTIMES) & whole_number(config["gpu_device_id"], 0))
    out = holds(config, CONFIG) & told & whole_number(config["requested_gpu_device_id"], 0) & device
    for x in same:
        out = out & x
    return F.coalesce(out, F.lit(False))


def environment_complete(record: Column, env: Column, backend: Column, packages: Sequence[str]) -> Column:
    part = lambda c, kind: F.try_variant_get(env[c], "$", kind)
    dependencies, runtimes, devices = part("dependencies", VARIANTS), part("gpu_runtimes", VARIANTS), part("gpu_devices", "array<variant>")
    engine = F.try_variant_get(record["effective_engine_type"], "$", "string")
    base = holds(env, ENVIRONMENT) & (F.to_json(env["schema_version"]) == "1") & all_tell(env, ("platform", "machine", "python", "cpu_model")) & whole_number(env["cpu_count"], 1)
    installed = holds(dependencies, packages) & tells(dependencies) & (~F.coalesce(engine.isin("openvino", "onnxruntime"), F.lit(False)) | F.array_contains(F.map_keys(dependencies), engine))
    used = relevant(backend, runtimes)
    device_ok = lambda v: all_tell(F.try_variant_get(v, "$", VARIANTS), DEVICE)
    gpu = backend.isin(*RUNTIMES) & (F.size(devices) > 0) & (F.size(used) > 0) & F.forall(devices, device_ok) & tells(used)
    return F.coalesce(base & installed & devices.isNotNull() & runtimes.isNotNull() & (backend.isin(*CPU) | gpu), F.lit(False))


def environment_text(env: Column, backend: Column) -> Column:
    """The environment as it counts in a comparison: without devices and runtimes on a CPU,
    else with the runtimes that the backend uses."""
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("\x01"), F.to_json(e["value"])))), "\x02")
    rest = text(F.map_filter(env, lambda k, _: ~k.isin("gpu_devices", "gpu_runtimes")))
    runtimes = text(relevant(backend, F.try_variant_get(env["gpu_runtimes"], "$", VARIANTS)))
    return F.when(backend.isin(*CPU), rest).otherwise(F.concat_ws("\x03", rest, F.to_json(env["gpu_devices"]), runtimes))


def described(records: DataFrame, contract: str = "contract", packages: Sequence[str] = PACKAGES) -> DataFrame:
    """records with contract_missing, the fields of the description that are incomplete (all,
    where it is null or no object), and contract_values, text by name of those that are
    complete. packages: what an environment must list; a program adds its own."""
    record, config, env, backend = (F.col(c) for c in ("_record", "_config", "_env", "_backend"))
    x = records.withColumn("_record", F.try_variant_get(contract, "$", VARIANTS))
    x = x.withColumns({
        "_config": F.try_variant_get(record["effective_ocr_config"], "$", VARIANTS),
        "_env": F.try_variant_get(record["benchmark_environment"], "$", VARIANTS),
        "_backend": F.lower(F.regexp_replace(F.coalesce(F.try_variant_get(record["effective_gpu_backend"], "$", "string"), F.lit("")), rf"^{WS}+|{WS}+$", "")),
    })
    ok = {c: tells(record[c]) for c in FIELDS}
    ok |= {c: digest(record[c]) for c in DIGESTS}
    ok[NULL_DIGEST] = ok[NULL_DIGEST] | F.coalesce(F.is_variant_null(record[NULL_DIGEST]), F.lit(False))
    ok |= {c: whole_number(record[c], least) for c, least in (("effective_rec_batch_num", 1), ("dpi", 1), ("warmup_runs", 0))}
    ok["peak_rss_sample_interval_seconds"] = positive(record["peak_rss_sample_interval_seconds"])
    ok["effective_ocr_config"] = config_complete(record, config, backend)
    ok["benchmark_environment"] = environment_complete(record, env, backend, packages)
    x = x.withColumn("_ok", F.array(*(F.coalesce(ok[c], F.lit(False)) for c in FIELDS)))
    at = lambda keep: F.filter(F.arrays_zip(names(FIELDS).alias("name"), F.col("_ok").alias("ok")), keep)
    missing = F.transform(at(lambda e: ~e["ok"]), lambda e: e["name"])
    env_text = environment_text(env, backend)
    value = lambda c: F.when(c == "benchmark_environment", env_text).otherwise(F.to_json(record[c]))
    values = F.map_from_entries(F.transform(at(lambda e: e["ok"]), lambda e: F.struct(e["name"].alias("key"), value(e["name"]).alias("value"))))
    return x.withColumns({"contract_missing": missing, "contract_values": values}).drop("_record", "_config", "_env", "_backend", "_ok")


def text_key(contract: str) -> Column:
    """What joins a record to the judgement of its text; null stands for itself."""
    return F.coalesce(F.sha2(F.col(contract).cast("binary"), 256), F.lit(""))


def described_texts(records: DataFrame, contract: str = "contract", packages: Sequence[str] = PACKAGES) -> DataFrame:
    """_told (text_key), contract_missing and contract_values of each different JSON text among
    records. The records of a run mostly share one, so that up to MOST_LOCAL texts come to the
    driver and go to all tasks; more stay a table of their own. A malformed text is an error."""
    texts = records.select(contract).distinct()
    some = texts.limit(MOST_LOCAL + 1).collect()
    few = len(some) <= MOST_LOCAL
    if few:
        texts = records.sparkSession.createDataFrame(some, texts.schema).coalesce(1)
    x = texts.select(text_key(contract).alias("_told"), F.parse_json(contract).alias(contract))
    x = described(x, contract, packages).select("_told", "contract_missing", "contract_values")
    return F.broadcast(x) if few else x


def differing(a: Column, b: Column) -> Column:
    """Names of fields that both describe completely and differently."""
    return F.filter(names(FIELDS), lambda c: F.coalesce(a[c] != b[c], F.lit(False)))
