"""DuckDB SQL for the registered queries.

RE2 has no lookaround, so matches are found by recursion: each step matches the text after the
previous find, together with the one character before it, and requires a character (or the end)
after it. The lazy prefix makes the match the leftmost one.
"""

from checks import forms
from maskwright import fixed_values as fixed

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
D = r"\p{Nd}"
WS = r"\t-\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
S = f"[{WS}]"
NOT_WORD_AFTER = rf"(?:{NW}|$)"

_DATE = (
    rf"(?:{D}{{1,2}}[/-]{D}{{1,2}}[/-]{D}{{2,4}}|{D}{{4}}[/-]{D}{{1,2}}[/-]{D}{{1,2}}|"
    rf"{D}{{1,2}}{S}+(?:{'|'.join(fixed.MONTHS)}){S}+{D}{{4}})"
)
_OCTET = rf"(?:25[0-5]|2[0-4]{D}|1?{D}?{D})"
_PERSON = rf"(?:Mr\.|Ms\.|Mrs\.|Dr\.)?{S}*[A-Z][a-z]+(?:{S}+[A-Z][a-z]+){{1,3}}"
_POSTAL = rf"(?:^|{NW})(?:{D}{{3}}{S}?{D}{{3}}|{D}{{5}}(?:-{D}{{4}})?)(?:{NW}|$)"
# A word's dot is no word character, so the bound after the word holds without it.
_bare = lambda words: "|".join(w.removesuffix(r"\.?").replace(r"\s", S) for w in words if not w.endswith(r"\."))
_HINT = rf"(?i)(?:^|{NW})(?:{_bare(fixed.ADDRESS_HINTS)})(?:{NW}|$)"
_FORMS = f"(?:{_bare(fixed.LEGAL_FORMS)})"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def both(value: str, *conditions: str) -> str:
    return " AND ".join(f"regexp_matches({value}, {quote(c)})" for c in conditions)


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^\\p{{Nd}}]', '', 'g')"


def trimmed(value: str) -> str:
    return f"regexp_replace(regexp_replace({value}, '^{S}+', ''), '{S}+$', '')"


def normalised(value: str) -> str:
    return f"lower(regexp_replace({trimmed(value)}, '{S}+', ' ', 'g'))"


def words(value: str) -> str:
    return f"len(string_split_regex({trimmed(value)}, '{S}+'))"


def luhn(value: str) -> str:
    only = digits(value)
    listed = f"list_transform(string_split(reverse({only}), ''), lambda c: TRY_CAST(c AS INTEGER))"
    # Positions count from one: the even ones are doubled.
    doubled = "lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END"
    total = f"list_sum(list_transform({listed}, {doubled}))"
    return f"(length({only}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"


class Scan:
    """All matches of one pattern: what stands before, a label, the value, what stands after."""

    def __init__(self, pii_type, rank, pre, body, post="", label="", flags="s", keep="TRUE", need=".", alt=None):
        self.pii_type, self.rank, self.keep, self.need = pii_type, rank, keep, need
        first = f"({pre})({label})({body}){post}"
        second = f"|({alt[0]})()({alt[1]}){post}" if alt else "|()()()$x"
        self.pattern = f"(?{flags})^(.*?)(?:{first}{second})"

    def sql(self, name: str, source: str) -> str:
        found = lambda text: f"regexp_extract({text}, {quote(self.pattern)}, ['a','p','l','c','p2','l2','c2'])"
        value = "(m.c || m.c2)"
        at = "(pos + length(m.a) + length(m.l))"
        # The text is padded by one blank, so that some character always precedes.
        return f"""
        {name}_steps AS (
            SELECT doc_id, para_idx, text, 0 AS pos, {found("' ' || text")} AS m FROM {source}
            WHERE regexp_matches(text, {quote(self.need)})
          UNION ALL
            SELECT doc_id, para_idx, text, npos, {found('substr(text, npos)')}
            FROM (SELECT doc_id, para_idx, text, {at} + length({value}) AS npos FROM {name}_steps
                  WHERE {value} <> '')),
        {name} AS MATERIALIZED (
            SELECT doc_id, para_idx, CAST(start AS INTEGER) AS start,
                   CAST(start + length(value) AS INTEGER) AS "end", '{self.pii_type}' AS pii_type, value,
                   {self.rank} AS detector_rank
            FROM (SELECT *, {at} AS start, {value} AS value FROM {name}_steps WHERE {value} <> '')
            WHERE {self.keep})"""


SCANS = {
    "email": Scan(
        "email", 3, NW, r"[A-Z0-9_][A-Z0-9._%+-]*@[A-Z0-9.-]+\.[A-Z]{2,}", NOT_WORD_AFTER, flags="si", need="@",
        alt=(W, r"[.%+-][A-Z0-9._%+-]*@[A-Z0-9.-]+\.[A-Z]{2,}"),
    ),
    "ssn": Scan("ssn", 4, rf"[^{D}]", rf"{D}{{3}}-{D}{{2}}-{D}{{4}}", rf"(?:[^{D}]|$)", need=rf"{D}-{D}"),
    "ip": Scan("ip", 5, rf"[^{D}.]", rf"{_OCTET}(?:\.{_OCTET}){{3}}", rf"(?:[^{D}.]|$)", need=rf"{D}\.{D}"),
    "card": Scan(
        "card", 6, rf"[^{D}]", rf"(?:{D}[ -]?){{13,19}}{D}", rf"(?:[^{D}]|$)", keep=luhn("value"),
        need=rf"(?:{D}[ -]?){{14}}",
    ),
    "phone_shape": Scan(
        "phone", 7, NW,
        rf"(?:\+?{S}?{D}{{1,3}}[{WS}.-]?)?(?:\(?0?{D}{{2,5}}\)?[{WS}.-]?)?{D}{{3,5}}[{WS}.-]{D}{{4,6}}",
        NOT_WORD_AFTER, keep=f"length({digits('value')}) >= 10 AND regexp_matches(value, '[+ (-]')",
        need=rf"{D}{{3}}[{WS}.-]{D}{{4}}",
    ),
    "phone_label": Scan(
        "phone", 8, NW, rf"\+?{D}[{D}{WS}().-]{{8,}}{D}", flags="si",
        label=rf"(?:phone|mobile|cell|telephone|tel|contact{S}+number|contact{S}+no\.?|whatsapp){S}*[:#-]?{S}*",
        keep=f"length({digits('value')}) BETWEEN 10 AND 15", need=rf"{D}{{2}}",
    ),
    "birth_date": Scan(
        "dob", 9, NW, _DATE, NOT_WORD_AFTER, flags="si", need="(?i)dob|born|birth",
        keep="regexp_matches(lower(substr(text, greatest(start - 45, 0) + 1, start + length(value) + 10 - "
        "greatest(start - 45, 0))), 'date of birth|dob|born|birth date|birthdate')",
    ),
    "name_label": Scan(
        "name", 10, NW, _PERSON, flags="si", need=":",
        label=rf"(?:contact{S}+person|full{S}+name|customer{S}+name|client{S}+name|applicant{S}+name|"
        rf"candidate{S}+name|employee{S}+name|patient{S}+name|student{S}+name|user{S}+name|name|director|"
        rf"managing{S}+director|chief{S}+financial{S}+officer|company{S}+secretary|compliance{S}+officer|partner|"
        rf"promoter|auditor){S}*:{S}*",
    ),
    "contact_values": Scan(
        "name", 11, NW, r"[^;\n]+", flags="si", need=":", label=rf"contact{S}+person{S}*:{S}*"
    ),
    "titled_name": Scan(
        "name", 12, NW, rf"(?:Mr\.|Ms\.|Mrs\.|Dr\.){S}+[A-Z][a-z]+(?:{S}+[A-Z][a-z]+){{1,3}}", NOT_WORD_AFTER,
        need=r"(?:Mr|Ms|Mrs|Dr)\.",
    ),
    # Dotted legal forms need a word character right after the dot; the tables have none such.
    "company": Scan(
        "company", 13, NW, rf"(?:[A-Z][A-Za-z0-9&.'-]*,?{S}+){{1,8}}{_FORMS}", NOT_WORD_AFTER, need=_FORMS,
        keep=f"{words('value')} <= 9 AND NOT starts_with(lower({trimmed('value')}), 'the ')",
    ),
    "address_label": Scan(
        "address", 1, NW, r"[^\n]+", flags="si", need=":",
        label=rf"(?:registered{S}+office|corporate{S}+office|home{S}+address|office{S}+address|"
        rf"billing{S}+address|shipping{S}+address|residence|mailing{S}+address|address){S}*:{S}*",
        keep=f"({both(trimmed('value'), _POSTAL)} OR {both(trimmed('value'), _HINT)})",
    ),
}

DOCUMENT_LINES = """
    lines AS MATERIALIZED (
        SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS para_idx, unnest(l) AS text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
FORM_LINES = f"lines AS MATERIALIZED ({forms.SQL})"

_SPAN = 'doc_id, para_idx, start, "end", pii_type, value, detector_rank'


def detector(name: str, source: str = "lines") -> str:
    """CTEs that end in one named after the detector."""
    if name == "address_line":
        return f"""
        address_line AS MATERIALIZED (
            SELECT doc_id, para_idx, 0 AS start, CAST(length(text) AS INTEGER) AS "end", 'address' AS pii_type,
                   text AS value, 2 AS detector_rank
            FROM {source} WHERE {both('text', _POSTAL, _HINT)})"""
    if name == "contact_list":
        inner = Scan("name", 11, ".", _PERSON)
        return f"""{SCANS['contact_values'].sql('contact_values', source)},
        contact_texts AS (
            SELECT doc_id, para_idx * 100000 + start AS para_idx, value AS text FROM contact_values),
        {inner.sql('contact_inner', 'contact_texts')},
        contact_list AS MATERIALIZED (
            SELECT doc_id, CAST(para_idx // 100000 AS INTEGER) AS para_idx,
                   CAST(start + para_idx % 100000 AS INTEGER) AS start,
                   CAST("end" + para_idx % 100000 AS INTEGER) AS "end", pii_type, value, detector_rank
            FROM contact_inner)"""
    return SCANS[name].sql(name, source)


DETECTORS = (
    "address_label", "address_line", "email", "ssn", "ip", "card", "phone_shape", "phone_label", "birth_date",
    "name_label", "contact_list", "titled_name", "company",
)


def with_(*ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {select}"


def spans_of(name: str, lines: str) -> str:
    return with_(lines, detector(name), select=f"SELECT {_SPAN} FROM {name}")


def candidates() -> list[str]:
    union = " UNION ALL ".join(f"SELECT {_SPAN} FROM {d}" for d in DETECTORS)
    return [detector(d) for d in DETECTORS] + [f"candidates AS MATERIALIZED ({union})"]


_PRIORITY = "(CASE pii_type WHEN 'address' THEN 0 WHEN 'name' THEN 2 WHEN 'company' THEN 3 ELSE 1 END)"


def resolve(source: str, name: str) -> str:
    """Greedy choice, one candidate per step."""
    return f"""
        {name}_ranked AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY doc_id, para_idx
                       ORDER BY {_PRIORITY}, start - "end", start, detector_rank) AS rn
            FROM (SELECT DISTINCT {_SPAN} FROM {source})),
        {name}_steps AS (
            SELECT doc_id, para_idx, rn, [{{'s': start, 'e': "end", 'rn': rn}}] AS kept
            FROM {name}_ranked WHERE rn = 1
          UNION ALL
            SELECT r.doc_id, r.para_idx, r.rn,
                   CASE WHEN len(list_filter(g.kept, lambda x: x.s < r."end" AND r.start < x.e)) > 0 THEN g.kept
                        ELSE list_append(g.kept, {{'s': r.start, 'e': r."end", 'rn': r.rn}}) END
            FROM {name}_steps g JOIN {name}_ranked r
                 ON r.doc_id = g.doc_id AND r.para_idx = g.para_idx AND r.rn = g.rn + 1),
        {name}_kept AS (
            SELECT doc_id, para_idx, unnest(kept).rn AS rn
            FROM (SELECT doc_id, para_idx, arg_max(kept, rn) AS kept FROM {name}_steps GROUP BY doc_id, para_idx)),
        {name} AS MATERIALIZED (
            SELECT {_SPAN} FROM {name}_ranked JOIN {name}_kept USING (doc_id, para_idx, rn))"""


_LABELS = {
    "name": "name|full name|customer name|client name|applicant name|candidate name|employee name|patient name|"
    "student name|contact person",
    "dob": "dob|date of birth|birth date|birthdate",
    "phone": "phone|mobile|telephone|tel|contact number|contact no|whatsapp",
    "address": "address|home address|office address|billing address|shipping address|residence|mailing address|"
    "registered office",
    "company": "company|employer|organisation|organization",
}
_label = "trim(regexp_replace(lower(previous), '[^a-z0-9]+', ' ', 'g'))"
_label_case = " ".join(f"WHEN regexp_full_match({_label}, '{v}') THEN '{k}'" for k, v in _LABELS.items())

LABEL_PAIRS = f"""
        neighbours AS (
            SELECT doc_id, {trimmed('text')} AS value,
                   lag(text) OVER (PARTITION BY doc_id ORDER BY para_idx) AS previous FROM lines),
        labelled AS MATERIALIZED (
            SELECT doc_id, value, CASE {_label_case} END AS pii_type FROM neighbours
            WHERE length(value) BETWEEN 1 AND 180),
        dated AS (
            SELECT doc_id, 0 AS para_idx, value AS text FROM labelled WHERE pii_type = 'dob'),
        {Scan('dob', 0, NW, _DATE, NOT_WORD_AFTER, flags='si').sql('learned_dates', 'dated')},
        label_pairs AS MATERIALIZED (
            SELECT DISTINCT doc_id, pii_type, value FROM labelled
            WHERE (pii_type = 'name' AND regexp_full_match(value, {quote(_PERSON)}))
               OR (pii_type = 'phone' AND length({digits('value')}) BETWEEN 10 AND 15)
               OR (pii_type = 'address' AND ({both('value', _POSTAL)} OR {both('value', _HINT)}))
               OR (pii_type = 'company' AND {words('value')} >= 2)
          UNION
            SELECT DISTINCT doc_id, 'dob', value FROM learned_dates)"""

DICTIONARY = f"""
        dictionary AS MATERIALIZED (
            SELECT DISTINCT doc_id, pii_type, {trimmed('value')} AS value FROM first_pass
            WHERE pii_type = 'name' OR (pii_type = 'company' AND {words('value')} > 1)
          UNION
            SELECT doc_id, pii_type, value FROM label_pairs)"""

_RANK = "(CASE pii_type WHEN 'name' THEN 14 WHEN 'company' THEN 15 WHEN 'dob' THEN 16 WHEN 'phone' THEN 17 ELSE 18 END)"


# Each step goes to the next occurrence; one that touches a word character moves on by one.
HITS = f"""
        hit_steps AS (
            SELECT *, start IS NOT NULL AND NOT regexp_matches(substr(text, start, 1), '{W}')
                      AND NOT regexp_matches(substr(text, start + length(value) + 1, 1), '{W}') AS fits
            FROM (SELECT l.doc_id, l.para_idx, l.text, d.pii_type, d.value, strpos(l.text, d.value) - 1 AS start
                  FROM lines l JOIN dictionary d ON d.doc_id = l.doc_id AND contains(l.text, d.value))
          UNION ALL
            SELECT *, NOT regexp_matches(substr(text, start, 1), '{W}')
                      AND NOT regexp_matches(substr(text, start + length(value) + 1, 1), '{W}') AS fits
            FROM (SELECT doc_id, para_idx, text, pii_type, value,
                         npos + strpos(substr(text, npos + 1), value) - 1 AS start
                  FROM (SELECT *, start + (CASE WHEN fits THEN length(value) ELSE 1 END) AS npos FROM hit_steps)
                  WHERE strpos(substr(text, npos + 1), value) > 0)),
        hits AS MATERIALIZED (
            SELECT doc_id, para_idx, CAST(start AS INTEGER) AS start, CAST(start + length(value) AS INTEGER) AS "end",
                   pii_type, value, {_RANK} AS detector_rank
            FROM hit_steps WHERE fits)"""


def learned() -> list[str]:
    return [*candidates(), resolve("candidates", "first_pass"), LABEL_PAIRS, DICTIONARY]


def resolved() -> list[str]:
    """CTEs that end in ``resolved``, of both passes."""
    return [
        *learned(), HITS,
        f"both_passes AS (SELECT {_SPAN} FROM candidates UNION ALL SELECT {_SPAN} FROM hits)",
        resolve("both_passes", "resolved"),
    ]


_FIRST = "['Aarav', 'Maya', 'Dev', 'Nina', 'Arjun', 'Isha', 'Rohan', 'Tara']"
_LAST = "['Shah', 'Mehta', 'Kapoor', 'Rao', 'Singh', 'Patel', 'Gupta', 'Verma']"


def _card_check(body: str) -> str:
    digit = lambda i: f"CAST(substr({body}, {i}, 1) AS INTEGER)"
    terms = [
        f"(CASE WHEN {digit(i)} > 4 THEN 2 * {digit(i)} - 9 ELSE 2 * {digit(i)} END)" if i % 2 else digit(i)
        for i in range(1, 16)
    ]
    return f"CAST((10 - ({' + '.join(terms)}) % 10) % 10 AS VARCHAR)"


_body = "('411111111111' || substr(printf('%04d', n % 10000), 1, 3))"
_number = f"({_body} || {_card_check(_body)})"

FAKE = f"""CASE pii_type
    WHEN 'name' THEN ({_FIRST})[1 + h % 8] || ' ' || ({_LAST})[1 + (h // 11) % 8]
    WHEN 'email' THEN printf('contact%03d@example.com', n)
    WHEN 'phone' THEN printf('+91 %05d %05d', 70000 + h % 29999, 10000 + (h // 97 + n * 7919) % 90000)
    WHEN 'company' THEN printf('Example Entity %03d Limited', n)
    WHEN 'address' THEN printf('%d Example Avenue, Sample City - 400%03d, India', 100 + n, n % 1000)
    WHEN 'ssn' THEN printf('900-%02d-%04d', n % 100, 1000 + n)
    WHEN 'card' THEN concat_ws(' ', substr({_number}, 1, 4), substr({_number}, 5, 4), substr({_number}, 9, 4),
                               substr({_number}, 13, 4))
    WHEN 'dob' THEN printf('01/01/%d', 1980 + n % 30)
    WHEN 'ip' THEN printf('203.0.113.%d', n % 250 + 1) END"""

MAPPING = f"""
        keyed AS MATERIALIZED (SELECT *, {normalised('value')} AS norm_value FROM resolved),
        firsts AS (
            SELECT doc_id, pii_type, norm_value, min(para_idx * 1000000 + start) AS place
            FROM keyed GROUP BY doc_id, pii_type, norm_value),
        numbered AS (
            SELECT doc_id, pii_type, norm_value,
                   row_number() OVER (PARTITION BY doc_id, pii_type ORDER BY place) AS n,
                   CAST('0x' || substr(sha256(norm_value), 1, 8) AS BIGINT) AS h
            FROM firsts),
        mapping AS MATERIALIZED (
            SELECT doc_id, pii_type, norm_value, CAST(n AS INTEGER) AS ordinal, {FAKE} AS fake FROM numbered)"""

REDACTED = """
        placed AS (
            SELECT k.doc_id, k.para_idx, k.start, k."end", m.fake, l.text,
                   coalesce(lag(k."end") OVER (PARTITION BY k.doc_id, k.para_idx ORDER BY k.start), 0) AS done
            FROM keyed k JOIN mapping m USING (doc_id, pii_type, norm_value) JOIN lines l USING (doc_id, para_idx)),
        changed AS (
            SELECT doc_id, para_idx,
                   string_agg(substr(text, done + 1, start - done) || fake, '' ORDER BY start)
                   || substr(any_value(text), max("end") + 1) AS redacted
            FROM placed GROUP BY ALL),
        redacted AS MATERIALIZED (
            SELECT l.doc_id, l.para_idx, coalesce(c.redacted, l.text) AS redacted, c.redacted IS NOT NULL AS changed
            FROM lines l LEFT JOIN changed c USING (doc_id, para_idx))"""


def redaction() -> list[str]:
    """CTEs that end in ``redacted``."""
    return [*resolved(), MAPPING, REDACTED]
