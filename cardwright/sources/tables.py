"""Schemas of the stored tables and of the nested extraction document, as DDL, with their closed value sets."""

from pyspark.sql import types as T

ITEM_TAIL = "confidence string, edited_by_user boolean, original_value string"
TABLES = {
    "users": "id string, email string, first_name string, last_name string, profile_image_url string, created_at timestamp, updated_at timestamp",
    "sessions": "sid string, sess string, expire timestamp_ntz",
    "projects": "id long, name string, description string, owner_id string, visibility string, created_at timestamp, updated_at timestamp",
    "source_documents": "id long, project_id long, kind string, filename string, content string, created_at timestamp",
    "extractions": "id long, project_id long, source_document_id long, provider_used string, status string, model_card_title string, domain string, system_description string, problem_statement string, ode_template string, raw_extraction_json string, provider_model string, system_prompt string, prompt_template_summary string, raw_provider_response string, repair_status string, validation_errors string, token_usage string, model_type string, model_type_confidence float, model_type_matched_keywords array<string>, model_type_override string, created_at timestamp, updated_at timestamp",
    "equations": f"id long, extraction_id long, ordinal int, label string, latex string, plaintext string, meaning string, variables_involved array<string>, description string, source_quote string, {ITEM_TAIL}",
    "variables": f"id long, extraction_id long, ordinal int, symbol string, name string, meaning string, unit string, role string, source_quote string, {ITEM_TAIL}",
    "parameters": f"id long, extraction_id long, ordinal int, symbol string, name string, value double, unit string, source_quote string, {ITEM_TAIL}",
    "assumptions": f"id long, extraction_id long, ordinal int, kind string, text string, source_quote string, {ITEM_TAIL}",
}
#: Child table -> (parent table, column, what happens to it when the parent's row goes).
REFERENCES = {
    "source_documents": [("projects", "project_id", "cascade")],
    "extractions": [("projects", "project_id", "cascade"), ("source_documents", "source_document_id", "set null")],
    "equations": [("extractions", "extraction_id", "cascade")], "variables": [("extractions", "extraction_id", "cascade")],
    "parameters": [("extractions", "extraction_id", "cascade")], "assumptions": [("extractions", "extraction_id", "cascade")],
}
CHILDREN = ("equations", "variables", "parameters", "assumptions")
MODEL_TYPES = ("chemostat", "batch_reactor", "fed_batch", "cstr", "gas_liquid_transfer", "microalgae_pbr", "generic_ode")
VALUES = {
    "visibility": ("private", "public"), "kind": ("text", "pdf"), "provider_used": ("mock", "openai", "gemini", "ollama"), "status": ("pending", "ready", "failed"),
    "repair_status": ("not_needed", "repaired", "failed"), "confidence": ("high", "medium", "low"), "role": ("state", "input", "output"), "model_type": MODEL_TYPES,
}

#: The nested document that a provider gives.
EXTRACTION = """
paper_title_or_topic string, system_type string, process_description string,
state_variables array<struct<symbol: string, name: string, meaning: string, unit: string, role: string, source_context: string, confidence: string>>,
parameters array<struct<symbol: string, name: string, value: string, unit: string, source_context: string, confidence: string>>,
equations array<struct<label: string, equation_latex: string, equation_plaintext: string, meaning: string, variables_involved: array<string>, source_context: string, confidence: string>>,
assumptions array<struct<assumption: string, source_context: string, confidence: string>>,
limitations array<struct<limitation: string, source_context: string, confidence: string>>,
model_card struct<short_summary: string, model_type: string, inputs: array<string>, outputs: array<string>, control_variables: array<string>, missing_information: array<string>, can_generate_ode_template: boolean>
"""


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
