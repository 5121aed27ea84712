"""Rows of the e-mail attachments and of the digest: documents with their source's name. The classification's longer texts and lists
(resumo_completo, pontos_chave, motivo_relevancia, contexto, assuntos_relacionados) are columns that a table may have or lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is shown for act types and tiers.
TYPE_LABELS = {
    "projeto_lei": "Projeto de Lei", "lei_sancionada": "Lei sancionada", "decreto": "Decreto", "instrucao_normativa": "Instrução Normativa", "portaria": "Portaria",
    "noticia": "Notícia", "jurisprudencia": "Jurisprudência", "doutrina": "Doutrina", "outro": "Outro",
}
TIER_LABELS = {"critico": "Crítico", "alta": "Alta", "normal": "Normal", "baixa": "Baixa", "descartado": "Descartado"}
TIER_SIGNS = {"critico": "🔴", "alta": "🟠", "normal": "🟡", "baixa": "🟢", "descartado": "⚪"}
TIER_COLOURS = {"critico": "#d32f2f", "alta": "#f57c00", "normal": "#1976d2", "baixa": "#388e3c", "descartado": "#9e9e9e"}

LISTS = ("pontos_chave", "assuntos_relacionados", "tags", "topics")
LONGER = ("resumo_completo", "motivo_relevancia", "contexto", "pontos_chave", "assuntos_relacionados")


def _whole(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """`docs` with `fonte` (the source's name, else its id) and null for the columns of the classification that it lacks."""
    kind = lambda c: "array<string>" if c in LISTS else "string"
    d = docs.select("*", *[F.lit(None).cast(kind(c)).alias(c) for c in LONGER if c not in docs.columns])
    names = sources.select(F.col("id").alias("source_id"), F.col("nome").alias("fonte"))
    return d.join(names, "source_id", "left").withColumn("fonte", F.coalesce("fonte", "source_id")).withColumn("done", F.col("severity_tier").isNotNull())


def iso(c: Column) -> Column:
    """A timestamp as in ISO 8601, in UTC, with microseconds only where there are any."""
    micro = F.pmod(F.unix_micros(c), F.lit(1_000_000))
    part = F.when(micro > 0, F.concat(F.lit("."), F.lpad(micro.cast("string"), 6, "0"))).otherwise("")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _joined(c: str, mark: str) -> Column:
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), mark)


def csv_export(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """The 13 columns of the CSV attachment, all text; what is missing is empty."""
    d = _whole(docs, sources)
    when = F.coalesce(iso(F.col("data_publicacao")), F.lit(""))
    return d.select(
        F.col("doc_id").cast("string").alias("doc_id"), _text("uf").alias("uf"), _text("tipo").alias("tipo"), _text("severity_tier").alias("tier"), _text("relevancia").alias("relevancia"), when.alias("data_pub"), _text("fonte").alias("fonte"),
        _text("titulo").alias("titulo"), _text("url").alias("url"), _text("resumo").alias("resumo"), _text("resumo_completo").alias("resumo_completo"), _joined("pontos_chave", " | ").alias("pontos_chave"), _joined("assuntos_relacionados", " | ").alias("assuntos_relacionados"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files that each begin with a byte order mark and the header; quotes are doubled and stand where they must."""
    first, *rest = rows.columns
    rows.select(F.col(first).alias("﻿" + first), *rest).write.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def json_export(docs: DataFrame, sources: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The 18 fields of the JSON attachment: null where a document isn't classified, empty lists and maps instead of nulls;
    `search_terms` from an index (doc_id, terms)."""
    d = _whole(docs, sources)
    d = d.withColumn("search_terms", F.lit(None).cast("array<string>")) if index is None else d.join(index.select("doc_id", F.col("terms").alias("search_terms")), "doc_id", "left")
    some = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return d.select(
        "doc_id", "uf", "fonte", "url", "titulo", iso(F.col("data_publicacao")).alias("data_publicacao"), "tipo", "severity_tier", "relevancia", "resumo", "resumo_completo", some("pontos_chave"), "motivo_relevancia",
        some("assuntos_relacionados"), some("tags"), some("topics"), F.coalesce("metadados", F.create_map().cast("map<string,string>")).alias("metadados_extraidos"), some("search_terms"),
    )


def _label(labels: dict[str, str], c: Column, other: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[c], other)


def digest_items(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """The 18 display fields of a digest's item, all text but the id."""
    d, dash = _whole(docs, sources), F.lit("—")
    told = lambda c, other: F.when(F.col("done"), c).otherwise(other)
    kind, tier = F.coalesce("tipo", F.lit("outro")), F.coalesce("severity_tier", F.lit("normal"))
    return d.select(
        "doc_id", _text("titulo").alias("titulo"), _text("url").alias("url"), F.coalesce(F.nullif("resumo_completo", F.lit("")), _text("resumo")).alias("resumo"), _text("resumo").alias("resumo_curto"), _text("uf").alias("uf"),
        _label(TYPE_LABELS, kind, kind).alias("tipo_label"), told(_label(TIER_SIGNS, tier, F.lit("⚪")), F.lit("⚪")).alias("tier_emoji"), told(_label(TIER_LABELS, tier, tier), dash).alias("tier_label"), _label(TIER_COLOURS, tier, F.lit("#666")).alias("tier_color"),
        F.coalesce(F.date_format("data_publicacao", "dd/MM/yyyy"), F.lit("")).alias("data_pub"), "fonte", told(F.col("relevancia").cast("string"), dash).alias("relevancia"), _joined("pontos_chave", " · ").alias("pontos_chave"),
        _text("motivo_relevancia").alias("motivo_relevancia"), _text("contexto").alias("contexto"), _joined("assuntos_relacionados", ", ").alias("assuntos_relacionados"), _joined("topics", ", ").alias("topics"),
    ).withColumnRenamed("fonte", "fonte_nome")
