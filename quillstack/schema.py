"""Declared schemas of the relational catalog and of the normalized document record.

Ids are opaque strings. JSON columns are strings of JSON, read by path. Field
lists are fixed values of the data model.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

TABLES: dict[str, str] = {
    "users": "id string, email string, password_hash string, full_name string, is_active boolean, created_at timestamp",
    "roles": "id string, name string, description string",
    "user_roles": "id string, user_id string, role_id string",
    "permissions": "id string, role_id string, folder_id string, access_level string",
    "folders": "id string, name string, parent_folder_id string, record_class string",
    "documents": "id string, filename string, original_filename string, file_type string, mime_type string, storage_path string, checksum string, uploaded_by string, folder_id string, current_version_id string, workflow_status_id string, is_deleted boolean, created_at timestamp, updated_at timestamp",
    "document_versions": "id string, document_id string, version_number int, storage_path string, checksum string, created_by string, created_at timestamp",
    "document_metadata": "id string, document_id string, size_bytes bigint, page_count int, ocr_applied boolean, custom_fields string",
    "tags": "id string, name string",
    "document_tags": "id string, document_id string, tag_id string",
    "ocr_results": "id string, document_id string, page_number int, extracted_text string, confidence_score double, processed_at timestamp",
    "extracted_fields": "id string, document_id string, field_name string, field_value string, confidence_score double, human_verified boolean",
    "embedding_index": "id string, document_id string, page_number int, chunk_index int, vector_db_ref string, indexed_at timestamp",
    "fraud_detection_results": "id string, document_id string, is_duplicate boolean, tamper_suspected boolean, risk_score double, details string, checked_at timestamp",
    "workflow_status": "id string, name string, description string",
    "processing_jobs": "id string, document_id string, job_type string, status string, error_message string, started_at timestamp, completed_at timestamp",
    "audit_logs": "id string, document_id string, user_id string, action string, details string, logged_at timestamp",
}

#: Tables of the engine's own beside the model's: the unit of citation, and files that made no document.
OWN: dict[str, str] = {
    "pages": "document_id string, page_number int, text string",
    "raw": "storage_path string, content binary",
    "rejects": "storage_path string, reason string, detail string",
}

#: The one record that every parser makes and every consumer reads.
CONTRACT = (
    "document_id string, source_type string, storage_path string, ocr_applied boolean, "
    "pages array<struct<page_number:int,text:string>>, "
    "metadata struct<filename:string,mime_type:string,size_bytes:bigint,uploaded_by:string,folder:string,created_at:timestamp>"
)

ACCESS_LEVELS = ("read", "write", "admin")
WORKFLOW = ("uploaded", "ocr_pending", "indexed", "under_review", "approved", "rejected")
#: Steps that a document's workflow may take (our reading; the model names only the states).
TRANSITIONS = {
    None: ("uploaded",),
    "uploaded": ("ocr_pending", "indexed"),
    "ocr_pending": ("indexed",),
    "indexed": ("under_review",),
    "under_review": ("approved", "rejected"),
    "approved": (),
    "rejected": (),
}
JOB_TYPES = ("ocr", "embedding", "extraction", "fraud_check")
JOB_STATUSES = ("pending", "running", "done", "failed")
ACTIONS = ("upload", "view", "download", "delete", "permission_change")


def struct(name: str) -> StructType:
    """Schema of one table, or of 'contract'."""
    return StructType.fromDDL(CONTRACT if name == "contract" else (TABLES | OWN)[name])
