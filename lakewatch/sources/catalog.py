"""The source catalogue: reading, selection, lint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewatch.operators.filters import strings
from lakewatch.schema import SOURCE, struct

# The lint's words.
GOV_DOMAINS, FEDERAL, CORE = (".gov.br", ".leg.br", ".jus.br"), ("stf", "stj", "trf", "lexml", "cnj", "senado", "camara"), ("ITCMD", "ITCD", "ITD")


def read_catalog(spark: SparkSession, path: str, active_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(catalogue by id, quarantine) of landed JSON with the model's schema. The quarantine has id, reason (malformed, no_id,
    duplicate_id) and the record as it landed, if it is malformed."""
    parsed = F.from_json("value", struct(f"{SOURCE}, _corrupt_record STRING"), {"columnNameOfCorruptRecord": "_corrupt_record"})  # every field, whatever is read of it
    rows = spark.read.text(path).where("trim(value) <> ''").select(parsed.alias("r")).select("r.*")
    repeated = rows.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(True).alias("repeated"))
    reason = F.when(F.col("_corrupt_record").isNotNull(), "malformed").when(F.col("id").isNull(), "no_id").when(F.col("repeated"), "duplicate_id")
    told = rows.join(repeated, "id", "left").withColumn("reason", reason)
    good = told.where("reason IS NULL").drop("_corrupt_record", "repeated", "reason")
    bad = told.where("reason IS NOT NULL").select("id", "reason", F.col("_corrupt_record").alias("record")).distinct()
    return (good.where("ativo") if active_only else good).orderBy("id"), bad


def select_sources(sources: DataFrame, overlay: DataFrame, active_ufs: DataFrame, *, federal: bool = True, skip_geo: bool = False, only_geo: bool = False) -> DataFrame:
    """Sources that are on (the overlay's word over the catalogue's) in active regions; federal ones by their own switch."""
    o = overlay.select("id", F.col("ativo").alias("__on"))
    s = sources.join(o, "id", "left").withColumn("ativo", F.coalesce("__on", "ativo")).drop("__on").where("ativo")
    if skip_geo or only_geo:
        s = s.where(F.coalesce("geo_restricted", F.lit(False)) == only_geo)
    regional = s.where("uf <> '_federal'").join(active_ufs.select("uf").distinct(), "uf", "left_semi").select(*s.columns)
    return regional.unionByName(s.where((F.col("uf") == "_federal") & F.lit(federal))).orderBy("uf", "id")


def lint(sources: DataFrame) -> DataFrame:
    """id and warnings of the sources that have any."""
    gov = F.lit(False)
    for d in GOV_DOMAINS:
        gov = gov | F.contains("url", F.lit(d))
    federal = F.lit(False)
    for p in FEDERAL:
        federal = federal | F.startswith("id", F.lit(p))
    joined = F.upper(F.array_join("keywords_required", " "))
    core = F.exists(strings(CORE), lambda k: F.contains(joined, k))
    rules = {
        "gov_url_not_https": gov & ~F.startswith("url", F.lit("https://")), "federal_uf": federal & (F.col("uf") != "_federal"), "keywords_without_core": (F.size("keywords_required") > 0) & ~core,
        "no_topics": F.size(F.coalesce("topics", F.array())) == 0, "no_geo_flag": F.col("ativo") & F.col("geo_restricted").isNull(), "fragile_without_notes": F.col("fragile") & (F.coalesce("notas", F.lit("")) == ""),
    }
    return sources.select("id", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])).alias("warnings")).where(F.size("warnings") > 0)
