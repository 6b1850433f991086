"""Column types of the tables that operators exchange, as DDL."""

PII_TYPES = ("name", "email", "phone", "company", "address", "ssn", "card", "dob", "ip")

SPAN = "struct<start: int, end: int, pii_type: string, value: string, detector_rank: int>"
SPANS = f"array<{SPAN}>"

PARAGRAPHS = "doc_id bigint, para_idx int, story string, text string"
BLOCKS = (
    "doc_id bigint, element_id string, story string, section int, in_table boolean, "
    "path array<int>, text string"
)
RUNS = "doc_id bigint, para_idx int, run_idx int, start int, end int, style string"
ENTITIES = "doc_id bigint, para_idx int, start int, end int, label string, text string"
CASES = "case_id int, text string, gold_rules array<string>, gold_full array<string>"

MODES = ("rules", "hybrid")

# Paragraphs per chunk. Work that follows paragraph order is split at these bounds, so that one
# document of any length spreads over many tasks.
CHUNK = 32768


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: use one of {', '.join(MODES)}")
    return mode
