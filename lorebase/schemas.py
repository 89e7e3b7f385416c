"""Table shapes, as DDL strings."""

SOURCE_DOC = (
    "ordinal BIGINT, source_id STRING, source_type STRING, section STRING, title STRING, path STRING, text STRING, "
    "date STRING, author STRING, metadata MAP<STRING,STRING>"
)
CHUNK = (
    "ordinal BIGINT, chunk_id STRING, chunk_index INT, source_id STRING, source_type STRING, section STRING, "
    "title STRING, path STRING, date STRING, author STRING, source_hash STRING, text_hash STRING, text STRING, "
    "metadata MAP<STRING,STRING>, vector ARRAY<FLOAT>"
)
FILE_RECORD = (
    "STRUCT<kind STRING, path STRING, file_name STRING, mime_type STRING, file_size BIGINT, classification STRING, "
    "text_extract STRING, html_preview STRING, text_preview STRING>"
)
CHAT_RECORD = (
    "created_at STRING, source STRING, chat_id STRING, "
    "user STRUCT<id BIGINT, username STRING, first_name STRING, last_name STRING>, "
    "sender STRUCT<open_id STRING, user_id STRING, union_id STRING, sender_type STRING, tenant_key STRING>, "
    f"message_id STRING, chat_type STRING, message_type STRING, kind STRING, text STRING, files ARRAY<{FILE_RECORD}>, "
    "responded BOOLEAN, backfilled BOOLEAN, original_create_time STRING, original_created_at STRING"
)
MAIL_RECORD = (
    "kind STRING, uid STRING, created_at STRING, date STRING, `from` STRING, `to` STRING, cc STRING, subject STRING, "
    "message_id STRING, raw_eml STRING, body_text STRING, body_html STRING, text_preview STRING, html_preview STRING, "
    "attachments ARRAY<STRUCT<filename STRING, path STRING, mime_type STRING, size BIGINT, sha256 STRING, "
    "text_extract STRING, text_preview STRING>>"
)
DISTILLED = (
    "STRUCT<one_sentence_summary STRING, what_happened ARRAY<STRING>, important_facts ARRAY<STRING>, "
    "decisions_or_conclusions ARRAY<STRING>, open_questions_or_next_steps ARRAY<STRING>, "
    "people_organizations_equipment ARRAY<STRING>, tags ARRAY<STRING>, confidence_notes ARRAY<STRING>, "
    "important_assets_or_attachments ARRAY<STRING>>"
)
DISTILLED_PAGE = (
    "section STRING, title STRING, html STRING, source_sha256 STRING, created STRING, updated STRING, "
    f"attachments ARRAY<STRING>, distilled {DISTILLED}"
)
DISTILLATION = f"generated_at STRING, sections ARRAY<STRUCT<section STRING, page_count INT, pages ARRAY<STRUCT<{DISTILLED_PAGE}>>>>"
HTML_MANIFEST = (
    "generated_at STRING, html_root STRING, source STRING, policy STRING, sections ARRAY<STRUCT<section STRING, "
    "index_html STRING, page_count INT, pages ARRAY<STRUCT<`order` INT, title STRING, html STRING, sha256 STRING, "
    "onenote_page_id STRING, created STRING, updated STRING, text_preview STRING>>>>"
)
PAGE_STATE = (
    "key STRING, section STRING, title STRING, html STRING, sha256 STRING, created STRING, updated STRING, "
    "text STRING, last_seen_at STRING"
)
DISTILLED_ROW = (
    "key STRING, section STRING, title STRING, html STRING, sha256 STRING, summary STRING, tags ARRAY<STRING>, "
    "important_facts ARRAY<STRING>, next_steps_or_questions ARRAY<STRING>, text_characters INT"
)
CHANGE = (
    "type STRING, detected_at STRING, key STRING, section STRING, title STRING, html STRING, created STRING, updated STRING, "
    "previous_sha256 STRING, current_sha256 STRING, text_preview STRING, diff ARRAY<STRING>"
)
POLLED_MESSAGE = (
    "message_id STRING, chat_id STRING, chat_type STRING, msg_type STRING, create_time STRING, "
    "sender STRUCT<id STRING, id_type STRING, sender_type STRING, tenant_key STRING>, "
    "mentions ARRAY<STRUCT<key STRING, id STRING, id_type STRING, name STRING>>, body STRUCT<content STRING>"
)
HANDOFF = (
    "session_id STRING, actor STRING, objective STRING, state ARRAY<STRING>, completed ARRAY<STRING>, "
    "decisions ARRAY<STRING>, blockers ARRAY<STRING>, next_actions ARRAY<STRING>, files_to_read ARRAY<STRING>, "
    "changed_files ARRAY<STRING>, notes ARRAY<STRING>"
)
MEMORY_ENTRY = (
    "path STRING, id STRING, title STRING, type STRING, status STRING, date STRING, projects ARRAY<STRING>, "
    "people ARRAY<STRING>, tags ARRAY<STRING>, source_refs ARRAY<STRING>, confidence STRING, summary STRING, "
    "body_text STRING"
)
