"""The data model: one flat, typed row for each document, and the tables beside it."""

from __future__ import annotations

from pyspark.sql import types as T

#: A stored document. Nullable llm columns (tipo to metadados) are null together while it is unclassified.
DOCUMENT = (
    "doc_id BIGINT, owner_id STRING, status STRING, cluster_id STRING, user_tags ARRAY<STRING>, source_id STRING, uf STRING, source_tipo STRING, url STRING, "
    "titulo STRING, texto STRING, content_hash STRING, data_publicacao TIMESTAMP, fetched_at TIMESTAMP, tipo STRING, relevancia INT, severity_tier STRING, "
    "llm_model STRING, prompt_version STRING, resumo STRING, tags ARRAY<STRING>, topics ARRAY<STRING>, metadados MAP<STRING,STRING>"
)
#: What a payload parser gives.
RAW_ITEM = "source_id STRING, titulo STRING, url STRING, texto STRING, data_publicacao TIMESTAMP, fetched_at TIMESTAMP, content_hash STRING"
SOURCE = (
    "id STRING, uf STRING, nome STRING, tipo STRING, url STRING, keywords_required ARRAY<STRING>, ativo BOOLEAN, fragile BOOLEAN, trusted BOOLEAN, "
    "geo_restricted BOOLEAN, keywords_bypass BOOLEAN, org_mentions ARRAY<STRING>, topics ARRAY<STRING>, expected_min_items_per_week INT, notas STRING"
)
WATCH = "watch_id STRING, pattern STRING, pattern_type STRING, uf STRING, relevancia_min INT, expires_at TIMESTAMP, cooldown_hours INT, last_triggered TIMESTAMP"
AUDIT = "owner_id STRING, entry_id BIGINT, timestamp TIMESTAMP, action STRING, payload STRING, prev_hash STRING"
DLQ = "entry_id STRING, reason STRING, payload STRING, failed_at TIMESTAMP"

# The enumerations of the model.
ACT_TYPES = ("lei", "decreto", "instrucao_normativa", "portaria", "jurisprudencia", "projeto_lei", "noticia", "doutrina", "outro")
TIERS = ("critico", "alta", "normal", "baixa", "descartado")
STATUSES = ("pending", "classified", "notified", "archived")
TOPICS = ("itcd", "sucessoes", "regime_bens")
DLQ_REASONS = ("parse_error", "validation_error", "llm_error", "storage_error", "notify_error", "unknown")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
