"""Recognised documents as JSON beside the file they describe, bound to it by digest and
size: written, and read back with a reason where they are refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.document import stripped
from palimpsest.operators.contract import VARIANTS, whole_number

# The version written, the one before without a digest, and the form of a page.
VERSION, LEGACY = 2, 1
WORD = "struct<text string,bbox array<double>,confidence double>"
LINE = f"struct<text string,bbox array<double>,words array<{WORD}>,reading_order int,source string>"
REGION = "struct<text string,box array<array<double>>,confidence double>"
BLOCK = "struct<kind string,text string,rows array<array<string>>,raw_lines array<string>,indent_chars int,y_top double,reading_order int>"
PAGE = f"struct<page_index int,width_px int,height_px int,dpi int,native_text string,text_layer_quality string,retry_level int,text_results array<{REGION}>,lines array<{LINE}>,layout_blocks array<{BLOCK}>>"


def bound_json(pages: Column, sha256: Column, size: Column) -> Column:
    """The JSON of a document: pages (array of PAGE), digest and size of its file."""
    pdf = F.struct(sha256.alias("sha256"), size.cast("long").alias("size_bytes"))
    return F.to_json(F.struct(F.lit(VERSION).alias("version"), pdf.alias("pdf"), F.lit("document").alias("state"), F.struct(pages.alias("pages")).alias("document")))


def part(entries: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(entries[name], "$", kind)


def as_text(value: Column) -> Column:
    """A JSON string; null for anything else."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def bound_documents(sidecars: DataFrame, files: DataFrame, key: str, legacy: bool = False) -> DataFrame:
    """sidecars (key, payload), files (key, sha256, size, n_pages; one row a key) -> a row for
    each sidecar: state, reason, pages (array of PAGE) and covers, whether they are exactly
    pages 1 to n_pages.

    State is document; unavailable (the sidecar says why); stale (it describes other bytes,
    or the file is missing: reason file, size or hash); legacy (a version without a digest,
    unless `legacy` admits it); or refused, with the first rule that it breaks: json (null,
    malformed or no object), version, pdf, fingerprint, size, unavailable, state, document,
    page. Only a document has pages; fields that a page leaves out are null."""
    x = sidecars.join(files.select(key, F.col("sha256").alias("_sha"), F.col("size").alias("_size"), "n_pages"), key, "left")
    x = x.withColumn("_m", F.try_variant_get(F.try_parse_json("payload"), "$", VARIANTS))
    x = x.withColumns({"_pdf": part(F.col("_m"), "pdf", VARIANTS), "_doc": part(F.col("_m"), "document", VARIANTS)})
    m, pdf, doc = F.col("_m"), F.col("_pdf"), F.col("_doc")
    version = F.when(whole_number(m["version"], 0), part(m, "version", "bigint"))
    listed = part(doc, "pages", "array<variant>")
    absent = doc["pages"].isNull() | F.is_variant_null(doc["pages"])
    x = x.withColumns({"_version": version, "_listed": F.when(absent, F.array().cast("array<variant>")).otherwise(listed)})
    x = x.withColumn("_pages", F.transform("_listed", lambda p: F.try_variant_get(p, "$", PAGE)))
    whole = F.forall("_pages", lambda p: p["page_index"].isNotNull() & p["width_px"].isNotNull() & p["height_px"].isNotNull() & p["dpi"].isNotNull())
    sha, size, state, bound = as_text(pdf["sha256"]), part(pdf, "size_bytes", "bigint"), F.coalesce(as_text(m["state"]), F.lit("")), F.col("_version") == VERSION
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rule = (
        F.when(m.isNull(), "refused json")
        .when(no(F.col("_version").isin(VERSION, LEGACY)), "refused version")
        .when(bound & pdf.isNull(), "refused pdf")
        .when(bound & no(sha.rlike(r"^[0-9a-f]{64}\z")), "refused fingerprint")
        .when(bound & ~whole_number(pdf["size_bytes"], 0), "refused size")
        .when(bound & F.col("_sha").isNull(), "stale file")
        .when(bound & (F.col("_size") != size), "stale size")
        .when(bound & (F.col("_sha") != sha), "stale hash")
        .when(bound & (state == "unavailable") & no(as_text(m["reason"]) != ""), "refused unavailable")
        .when(bound & (state == "unavailable"), "unavailable")
        .when(bound & (state != "document"), "refused state")
        .when(doc.isNull(), "refused document")
        .when(no(whole), "refused page")
        .when(~bound & F.lit(not legacy), "legacy")
        .otherwise("document")
    )
    x = x.withColumn("_rule", rule)
    word = F.split("_rule", " ")
    read = F.col("_rule") == "document"
    pages = F.when(read, F.col("_pages"))
    numbers = F.array_sort(F.transform(pages, lambda p: p["page_index"]))
    covers = F.when(read, (F.size(numbers) == F.col("n_pages")) & F.forall(F.transform(numbers, lambda n, i: n == i + 1), lambda t: t))
    reason = F.when(word[0] == "unavailable", as_text(m["reason"])).otherwise(F.get(word, 1))
    return x.select(*sidecars.drop("payload").columns, word[0].alias("state"), reason.alias("reason"), pages.alias("pages"), covers.alias("covers"))


def page_text(page: Column) -> Column:
    """Native text of a page if there is some, else its lines, else its regions."""
    texts = lambda c: F.array_join(F.transform(F.coalesce(page[c], F.array()), lambda v: F.coalesce(v["text"], F.lit(""))), "\n")
    native = F.coalesce(page["native_text"], F.lit(""))
    return F.when(native != "", native).when(F.size(page["lines"]) > 0, texts("lines")).otherwise(texts("text_results"))


def document_text(pages: Column) -> Column:
    """Stripped texts of the pages in the order given, blank ones left out."""
    return F.array_join(F.filter(F.transform(pages, lambda p: stripped(page_text(p))), lambda t: t != ""), "\n\n")
