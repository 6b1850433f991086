"""For each registered query, what DuckDB computes from the same tables."""

from checks import forms
from checks import oracle as O

DOCS, FORMS = O.DOCUMENT_LINES, O.FORM_LINES
TURNS = """
    lines AS MATERIALIZED (
        SELECT conv_id AS doc_id, text,
               CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS para_idx
        FROM conversations)"""
SOURCE = "source AS ({})".format(
    forms.SOURCE.format(**{t: t for t in forms.TABLES})
)
SPAN = O._SPAN

STORY_ORDER = """
    items AS (
        SELECT *, concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_returnflag) AS item FROM lineitem),
    blocks AS (
        SELECT o_orderkey AS doc_id, 't' AS element, 'body' AS story, 0 AS rank, 0 AS a, 0 AS b, 0 AS c, 0 AS d,
               o_orderstatus AS text FROM orders
        UNION ALL SELECT o_orderkey, 'e', 'body', 0, 1, 0, 0, 0, '' FROM orders
        UNION ALL SELECT o_orderkey, 'h', 'header', 2, 0, 0, 0, 0, 'Order ' || o_orderkey FROM orders
        UNION ALL SELECT o_orderkey, 'f', 'footer', 3, 0, 0, 0, 0, o_orderpriority FROM orders
        UNION ALL SELECT l_orderkey, item || '/0', 'body', 1, l_linenumber, 0, l_partkey, l_suppkey,
                         CAST(l_partkey AS VARCHAR) FROM items
        UNION ALL SELECT l_orderkey, item || '/1', 'body', 1, l_linenumber, 1, l_partkey, l_suppkey,
                         CAST(l_suppkey AS VARCHAR) FROM items
        UNION ALL SELECT l_orderkey, item || (CASE WHEN l_quantity > 25 THEN '/1' ELSE '/2' END), 'body', 1,
                         l_linenumber, 2, l_partkey, l_suppkey,
                         CASE WHEN l_quantity > 25 THEN CAST(l_suppkey AS VARCHAR) ELSE l_returnflag END
                  FROM items),
    once AS (
        SELECT * FROM blocks
        QUALIFY row_number() OVER (PARTITION BY doc_id, element ORDER BY rank, a, b, c, d) = 1)"""

PREVIEW = f"""
    trimmed AS (SELECT doc_id, para_idx, {O.trimmed('text')} AS line FROM lines),
    numbered AS (
        SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS n,
               count(*) OVER (PARTITION BY doc_id) AS total_lines
        FROM trimmed WHERE line <> '')"""

HELPERS = f"""
    SELECT doc_id, para_idx, normalised, CAST('0x' || substr(sha256(normalised), 1, 8) AS BIGINT) AS bucket,
           length({O.digits('text')}) AS n_digits,
           CASE WHEN {O.trimmed('text')} = '' THEN 0 ELSE CAST({O.words('text')} AS BIGINT) END AS n_words,
           coalesce({O.luhn('text')}, FALSE) AS luhn, CASE {O._label_case} END AS label,
           {O.both('text', O._POSTAL)} AS postal, {O.both('text', O._HINT)} AS hint,
           regexp_full_match(text, {O.quote(O._PERSON)}) AS person
    FROM (SELECT *, {O.normalised('text')} AS normalised, text AS previous FROM lines)"""

ENTITY_SPANS = f"""
    entities AS ({forms.ENTITIES}),
    entity_spans AS MATERIALIZED (
        SELECT e.doc_id, CAST(e.para_idx AS INTEGER) AS para_idx, e.start, e.stop AS "end",
               CASE label WHEN 'PERSON' THEN 'name' WHEN 'ORG' THEN 'company' ELSE 'address' END AS pii_type,
               {O.trimmed('e.text')} AS value, 19 AS detector_rank
        FROM entities e JOIN lines l ON l.doc_id = e.doc_id AND l.para_idx = e.para_idx
        WHERE length({O.trimmed('e.text')}) >= 3
          AND (label = 'PERSON' AND regexp_full_match({O.trimmed('e.text')}, {O.quote(O._PERSON)})
               OR label = 'ORG' AND {O.words('e.text')} <= 9
               OR label IN ('GPE', 'LOC', 'FAC') AND ({O.both('l.text', O._HINT)} OR {O.both('l.text', O._POSTAL)}
                  OR regexp_matches(l.text, {O.quote('(?i)(?:^|' + O.NW + ')(?:' + 'residence|address' + ')' + O.S + '*:' + O.S + '*[^' + chr(92) + 'n]')}))))"""

_learned = [*O.candidates(), O.resolve("candidates", "first_pass"), O.LABEL_PAIRS, O.DICTIONARY]
HYBRID = [
    SOURCE, FORMS, ENTITY_SPANS, *O.candidates()[:-1],
    O.candidates()[-1].replace("candidates AS", "rule_candidates AS"),
    f"candidates AS MATERIALIZED (SELECT {SPAN} FROM rule_candidates UNION ALL SELECT {SPAN} FROM entity_spans)",
    O.resolve("candidates", "first_pass"),
]

# Finds of both modes on single lines, for the scores.
CASES = [
    *HYBRID[:-1],
    O.resolve("rule_candidates", "by_rules"),
    O.resolve("candidates", "by_hybrid"),
    """found AS MATERIALIZED (
        SELECT DISTINCT 'rules' AS mode, doc_id, para_idx, pii_type FROM by_rules
        UNION ALL SELECT DISTINCT 'hybrid', doc_id, para_idx, pii_type FROM by_hybrid)""",
    f"""gold AS MATERIALIZED (
        SELECT view, mode, doc_id, para_idx, pii_type FROM (
            SELECT 'rules' AS view, 'rules' AS mode, doc_id, para_idx, unnest(string_split({forms.gold(0)}, ',')) AS pii_type FROM lines
            UNION ALL SELECT 'rules_against_full_gold', 'rules', doc_id, para_idx, unnest(string_split({forms.gold(1)}, ',')) FROM lines
            UNION ALL SELECT 'hybrid', 'hybrid', doc_id, para_idx, unnest(string_split({forms.gold(1)}, ',')) FROM lines)
        WHERE pii_type <> '')""",
    """views AS (SELECT * FROM (VALUES ('rules', 'rules'), ('rules_against_full_gold', 'rules'), ('hybrid', 'hybrid'))
                 AS v(view, mode))""",
    """seen AS MATERIALIZED (SELECT view, doc_id, para_idx, pii_type FROM found JOIN views USING (mode))""",
    """outcome AS MATERIALIZED (
        SELECT coalesce(g.view, s.view) AS view, coalesce(g.doc_id, s.doc_id) AS doc_id,
               coalesce(g.para_idx, s.para_idx) AS para_idx, coalesce(g.pii_type, s.pii_type) AS pii_type,
               g.view IS NOT NULL AS expected, s.view IS NOT NULL AS hit
        FROM gold g FULL JOIN seen s ON g.view = s.view AND g.doc_id = s.doc_id AND g.para_idx = s.para_idx
             AND g.pii_type = s.pii_type)""",
]

_ratio = lambda part, whole: f"round(coalesce(({part}) / nullif({whole}, 0), 0.0) * 100, 1)"
SCORES = f"""
    SELECT view, cases, tp, fp, fn, tn, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall,
           {_ratio('tp + tn', 'tp + tn + fp + fn')} AS accuracy
    FROM (SELECT view, (SELECT count(*) FROM lines) AS cases,
                 count(*) FILTER (expected AND hit) AS tp, count(*) FILTER (hit AND NOT expected) AS fp,
                 count(*) FILTER (expected AND NOT hit) AS fn,
                 (SELECT count(*) FROM lines) - count(DISTINCT doc_id * 100 + para_idx) AS tn
          FROM outcome GROUP BY view)"""

PER_TYPE = """
    SELECT view, pii_type, count(*) FILTER (expected AND hit) AS tp, count(*) FILTER (hit AND NOT expected) AS fp,
           count(*) FILTER (expected AND NOT hit) AS fn
    FROM outcome GROUP BY ALL"""

MODE_DELTA = """
    SELECT l.doc_id * 100 + l.para_idx AS doc_id, count(*) FILTER (mode = 'rules') AS rules,
           count(*) FILTER (mode = 'hybrid') AS hybrid,
           count(*) FILTER (mode = 'hybrid') - count(*) FILTER (mode = 'rules') AS added
    FROM lines l LEFT JOIN (
        SELECT 'rules' AS mode, doc_id, para_idx FROM by_rules UNION ALL SELECT 'hybrid', doc_id, para_idx FROM by_hybrid
    ) USING (doc_id, para_idx)
    GROUP BY l.doc_id, l.para_idx"""

SUMMARY = f"""
    SELECT d.doc_id, 'rules' AS mode, CAST(NULL AS VARCHAR) AS ner_model, coalesce(changed_paragraphs, 0) AS changed_paragraphs,
           coalesce(redactions, '{{}}') AS redactions, coalesce(unique_replacements, 0) AS unique_replacements,
           coalesce(total_redactions, 0) AS total_redactions, coalesce(types_found, 0) AS types_found
    FROM (SELECT DISTINCT doc_id FROM lines) d
    LEFT JOIN (
        SELECT doc_id, count(DISTINCT para_idx) AS changed_paragraphs, count(*) AS total_redactions,
               count(DISTINCT pii_type) AS types_found, count(DISTINCT pii_type || ':' || norm_value) AS unique_replacements
        FROM keyed GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (
        SELECT doc_id, '{{' || string_agg('"' || pii_type || '":' || n, ',' ORDER BY pii_type) || '}}' AS redactions
        FROM (SELECT doc_id, pii_type, count(*) AS n FROM keyed GROUP BY ALL) GROUP BY doc_id) USING (doc_id)"""

_count = lambda pattern: f"CAST(sum(len(regexp_extract_all(redacted, {O.quote(pattern)}))) AS BIGINT)"
AUDIT = f"""
    SELECT count(*) FILTER ({O.trimmed('redacted')} <> '') AS non_blank_paragraphs,
           {_count(r'(?i)[A-Za-z0-9_.+-]+@example\.com')} AS example_com_emails,
           {_count(r'Example Entity [0-9]+ Limited')} AS example_entity_company,
           {_count(r'Example Avenue, Sample City')} AS example_avenue_address,
           {_count(r'\+91' + O.S + '+[0-9]{5}' + O.S + '+[0-9]{5}')} AS synthetic_phone_91,
           {_count(r'\b900-01-[0-9]{4}\b')} AS synthetic_ssn_900,
           {_count(r'\b4111' + O.S + '+1111' + O.S + '+1111' + O.S + r'+[0-9]{4}\b')} AS synthetic_card_4111,
           {_count(r'\b203\.0\.113\.[0-9]{1,3}\b')} AS synthetic_ip_203
    FROM redacted"""

RUN_PIECES = """
    runs AS MATERIALIZED (
        SELECT doc_id, para_idx, run_idx, run_idx * 7 AS run_start, least(run_idx * 7 + 7, n) AS run_end,
               CASE run_idx % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'bold' ELSE 'italic' END AS style
        FROM (SELECT doc_id, para_idx, length(text) AS n, unnest(range((length(text) + 6) // 7)) AS run_idx
              FROM lines WHERE length(text) > 0 AND para_idx <> 13)),
    segments AS (
        SELECT doc_id, para_idx, done AS l, start AS r, text FROM placed
        UNION ALL SELECT doc_id, para_idx, max("end"), length(any_value(text)), any_value(text)
                  FROM placed GROUP BY doc_id, para_idx),
    pieces AS (
        SELECT doc_id, para_idx, greatest(l, run_start) AS spot, 0 AS o,
               substr(text, greatest(l, run_start) + 1, least(r, run_end) - greatest(l, run_start)) AS text, style
        FROM segments JOIN runs USING (doc_id, para_idx) WHERE greatest(l, run_start) < least(r, run_end)
        UNION ALL
        SELECT doc_id, para_idx, start, 1, fake, style
        FROM placed JOIN runs USING (doc_id, para_idx) WHERE run_start <= start AND start < run_end)"""

LEAKS = """
    gone AS (SELECT * FROM (SELECT doc_id, unnest([
        regexp_extract(text, 'paid with ([0-9 ]+)$', 1), regexp_extract(text, 'leave word at (.+)$', 1),
        regexp_extract(text, 'Order ([0-9-]+) stands', 1), regexp_extract(text, 'P(arcel [0-9]+ w)', 1)]) AS value
        FROM lines) WHERE value <> ''),
    kept AS (SELECT * FROM (SELECT doc_id, unnest([
        regexp_extract(text, '^(Parcel [0-9]+ waits)', 1), regexp_extract(text, 'Desk (.+) or', 1)]) AS value
        FROM lines) WHERE value <> '')"""
LEAKS_SELECT = """
    SELECT DISTINCT doc_id, value, 'remains' AS problem
    FROM gone JOIN redacted USING (doc_id) WHERE contains(redacted, value)
    UNION ALL
    SELECT DISTINCT doc_id, value, 'missing' FROM kept k
    WHERE NOT EXISTS (SELECT 1 FROM redacted r WHERE r.doc_id = k.doc_id AND contains(r.redacted, k.value))"""

COVERAGE = """
    SELECT doc_id, coalesce(string_agg(t, ',' ORDER BY t) FILTER (NOT hit), '') AS lacking, bool_and(hit) AS complete
    FROM (SELECT d.doc_id, t, EXISTS (SELECT 1 FROM first_pass f WHERE f.doc_id = d.doc_id AND f.pii_type = t) AS hit
          FROM (SELECT DISTINCT doc_id FROM lines) d
               CROSS JOIN (SELECT unnest(['name', 'email', 'phone', 'company', 'address', 'ssn', 'card', 'dob', 'ip']) AS t))
    GROUP BY doc_id"""

FIRST_PASS = [*O.candidates(), O.resolve("candidates", "first_pass")]
ALONE = [*O.candidates(), O.resolve("candidates", "resolved")]
_text = "SELECT doc_id, para_idx, redacted, changed FROM redacted"
_form_spans = lambda name: O.spans_of(name, FORMS)

SQL: dict[str, str] = {
    "paragraphs": O.with_(DOCS, select="SELECT doc_id, para_idx, 'body' AS story, text FROM lines"),
    "conversation_turns": O.with_(
        TURNS,
        select="SELECT doc_id, para_idx, 'body' AS story, text, lag(text) OVER (PARTITION BY doc_id ORDER BY para_idx) "
        "AS prev_text FROM lines",
    ),
    "story_order": O.with_(
        STORY_ORDER,
        select="SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank, a, b, c, d) - 1 AS INTEGER) "
        "AS para_idx, story, text FROM once",
    ),
    "preview": O.with_(
        DOCS, PREVIEW,
        select="SELECT d.doc_id, CAST(n AS INTEGER) AS line_no, line, coalesce(total_lines, 0) AS total_lines, "
        "coalesce(total_lines, 0) > 48 AS truncated "
        "FROM (SELECT DISTINCT doc_id FROM lines) d LEFT JOIN (SELECT * FROM numbered WHERE n <= 48) USING (doc_id)",
    ),
    "text_helpers": O.with_(FORMS, select=HELPERS),
    "email_spans": O.spans_of("email", DOCS),
    "ip_spans": O.spans_of("ip", DOCS),
    "card_spans": O.spans_of("card", DOCS),
    "phone_spans": O.spans_of("phone_shape", DOCS),
    "email_spans_in_forms": _form_spans("email"),
    "ip_spans_in_forms": _form_spans("ip"),
    "card_spans_in_forms": _form_spans("card"),
    "phone_spans_in_forms": _form_spans("phone_shape"),
    "ssn_spans": _form_spans("ssn"),
    "dob_spans": _form_spans("birth_date"),
    "phone_label": _form_spans("phone_label"),
    "label_names": _form_spans("name_label"),
    "contact_list_names": _form_spans("contact_list"),
    "titled_names": _form_spans("titled_name"),
    "companies": _form_spans("company"),
    "address_label": _form_spans("address_label"),
    "address_line": _form_spans("address_line"),
    "label_pairs": O.with_(FORMS, O.LABEL_PAIRS, select="SELECT doc_id, pii_type, value FROM label_pairs"),
    "dictionary": O.with_(FORMS, *_learned, select="SELECT doc_id, pii_type, value FROM dictionary"),
    "dictionary_hits": O.with_(FORMS, *_learned, O.HITS, select=f"SELECT {SPAN} FROM hits"),
    "dictionary_hits_joined": O.with_(FORMS, *_learned, O.HITS, select=f"SELECT {SPAN} FROM hits"),
    "resolved_spans": O.with_(FORMS, *O.resolved(), select=f"SELECT {SPAN} FROM resolved"),
    "resolved_document_spans": O.with_(DOCS, *ALONE, select=f"SELECT {SPAN} FROM resolved"),
    "entity_spans": O.with_(SOURCE, FORMS, ENTITY_SPANS, select=f"SELECT {SPAN} FROM entity_spans"),
    "ordinals": O.with_(
        DOCS, *ALONE, O.MAPPING, select="SELECT doc_id, pii_type, norm_value, ordinal FROM mapping"
    ),
    "mapping": O.with_(
        FORMS, *O.resolved(), O.MAPPING, select="SELECT doc_id, pii_type, norm_value, ordinal, fake FROM mapping"
    ),
    "redacted_text": O.with_(FORMS, *O.redaction(), select=_text),
    "redacted_documents": O.with_(DOCS, *O.redaction(), select=_text),
    "redacted_turns": O.with_(TURNS, *O.redaction(), select=_text),
    "hybrid_text": O.with_(
        *HYBRID, O.LABEL_PAIRS, O.DICTIONARY, O.HITS,
        f"both_passes AS (SELECT {SPAN} FROM candidates UNION ALL SELECT {SPAN} FROM hits)",
        O.resolve("both_passes", "resolved"), O.MAPPING, O.REDACTED, select=_text,
    ),
    "run_pieces": O.with_(
        FORMS, *O.resolved()[:-1],
        O.resolve("(SELECT * FROM both_passes WHERE para_idx <> 13)", "resolved"), O.MAPPING, O.REDACTED, RUN_PIECES,
        select="SELECT doc_id, para_idx, text, style, CAST(row_number() OVER "
        "(PARTITION BY doc_id, para_idx ORDER BY spot, o) - 1 AS INTEGER) AS piece_idx FROM pieces",
    ),
    "redaction_counts": O.with_(
        DOCS, *ALONE, select="SELECT doc_id, pii_type, count(*) AS redactions FROM resolved GROUP BY ALL"
    ),
    "doc_summary": O.with_(FORMS, *O.redaction(), select=SUMMARY),
    "marker_audit": O.with_(FORMS, *O.redaction(), select=AUDIT),
    "scores": O.with_(*CASES, select=SCORES),
    "per_type": O.with_(*CASES, select=PER_TYPE),
    "leaks": O.with_(FORMS, *O.redaction(), LEAKS, select=LEAKS_SELECT),
    "coverage": "SELECT 'forms' AS corpus, * FROM (" + O.with_(FORMS, *FIRST_PASS, select=COVERAGE)
    + ") UNION ALL SELECT 'documents', * FROM (" + O.with_(DOCS, *FIRST_PASS, select=COVERAGE) + ")",
    "mode_delta": O.with_(*CASES, select=MODE_DELTA),
    "streamed_redaction": O.with_(DOCS, *O.redaction(), select=_text),
}
