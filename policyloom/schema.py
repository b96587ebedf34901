"""Schemas of the core tables, as DDL."""

PAGES = "doc_id string, page_number int, text string"
CHUNKS = (
    "chunk_id string, doc_id string, section_no long, chunk_no int, text string, section_title string, "
    "page_number int, framework string, document_name string, workspace_id string, roles array<string>, "
    "source_type string, embedding array<float>"
)
FRAMEWORKS = (
    "ord int, name string, version string, website string, pdf_url string, checksum string, "
    "roles array<string>, dimensions array<string>, regions array<string>, source_type string"
)
WORKSPACES = "workspace_id string, country string, policy_title string, status string, created_at timestamp"
CITATION = "struct<field: string, chunk_ref: string, quote: string, page: int>"
RAW_VERDICTS = (
    "workspace_id string, dimension string, coverage string, principle_acknowledged boolean, "
    "mechanisms array<string>, recommendations array<string>, opportunities array<string>, "
    "synthesis struct<consensus: string, differences: string, overall_assessment: string>, "
    f"citations array<{CITATION}>, phases array<struct<objective: string, steps: array<string>>>, "
    "agency string, agency_grounding string, "
    "incidents array<struct<incident_name: string, chunk_ref: string, quote: string, source: string>>, "
    "error string"
)
EVIDENCE = (
    "workspace_id string, dimension string, chunk_id string, source string, similarity double, verified boolean"
)
MESSAGES = "conv_id long, turn long, role string, text string"
CALLS = "ts timestamp, key string, tokens int"
