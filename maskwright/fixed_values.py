"""They must equal the published ones for results to be right.

Patterns are written in Python syntax, where ``\\w \\d \\s \\b`` are Unicode-aware;
``functions.dialect`` turns them into the Java syntax Spark runs.
"""

# Detector patterns.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
IPV4 = r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.])"
CARD = r"(?<!\d)(?:\d[ -]?){13,19}\d(?!\d)"
PHONE = r"(?<!\w)(?:\+?\s?\d{1,3}[\s.-]?)?(?:\(?0?\d{2,5}\)?[\s.-]?)?\d{3,5}[\s.-]\d{4,6}(?!\w)"
MONTHS = (
    "Jan(?:uary)?", "Feb(?:ruary)?", "Mar(?:ch)?", "Apr(?:il)?", "May", "Jun(?:e)?", "Jul(?:y)?", "Aug(?:ust)?",
    "Sep(?:tember)?", "Sept", "Oct(?:ober)?", "Nov(?:ember)?", "Dec(?:ember)?",
)
DATE = (
    r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|"
    rf"\d{{1,2}}\s+(?:{'|'.join(MONTHS)})\s+\d{{4}})\b"
)
POSTAL = r"\b(?:\d{3}\s?\d{3}|\d{5}(?:-\d{4})?)\b"
ADDRESS_HINTS = (
    "road", r"rd\.?", "street", r"st\.?", "avenue", r"ave\.?", "lane", r"ln\.?", "drive", r"dr\.?", "boulevard", r"blvd\.?",
    "suite", r"apt\.?", "apartment", "floor", "building", "tower", "office", r"po\s+box", "village", "taluka", "nagar",
    "mumbai", "pune", "india", "usa", r"united\s+states",
)
ADDRESS_HINT = rf"(?i)\b(?:{'|'.join(ADDRESS_HINTS)})\b"
PERSON = r"(?:Mr\.|Ms\.|Mrs\.|Dr\.)?\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}"
TITLED_NAME = r"\b(?:Mr\.|Ms\.|Mrs\.|Dr\.)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b"
LEGAL_FORMS = (
    r"Private\s+Limited", r"Public\s+Limited", r"Pvt\.?\s+Ltd\.?", "Limited", r"Ltd\.?", "LLP", r"L\.L\.P\.", "LLC", r"L\.L\.C\.",
    r"Inc\.?", "Incorporated", "Corporation", r"Corp\.?", "Company", r"Co\.?", "Bank", "PLC", "GmbH",
)
COMPANY = rf"\b(?:[A-Z][A-Za-z0-9&.'-]*,?\s+){{1,8}}(?:{'|'.join(LEGAL_FORMS)})\b"

# Fixed values: "label, then captured value" patterns, as (label part, value part).
PHONE_LABEL = (
    r"(?i)\b(?:phone|mobile|cell|telephone|tel|contact\s+number|contact\s+no\.?|whatsapp)\s*[:#-]?\s*",
    r"\+?\d[\d\s().-]{8,}\d",
)
NAME_LABEL = (
    r"(?i)\b(?:contact\s+person|full\s+name|customer\s+name|client\s+name|applicant\s+name|candidate\s+name|"
    r"employee\s+name|patient\s+name|student\s+name|user\s+name|name|director|managing\s+director|"
    r"chief\s+financial\s+officer|company\s+secretary|compliance\s+officer|partner|promoter|auditor)\s*:\s*",
    PERSON,
)
ADDRESS_LABEL = (
    r"(?i)\b(?:registered\s+office|corporate\s+office|home\s+address|office\s+address|billing\s+address|"
    r"shipping\s+address|residence|mailing\s+address|address)\s*:\s*",
    r"[^\n]+",
)
CONTACT_LIST = (r"(?i)\bcontact\s+person\s*:\s*", r"[^;\n]+")

# What must stand near a date for it to be a date of birth, and how near.
BIRTH_MARKERS = ("date of birth", "dob", "born", "birth date", "birthdate")
BIRTH_BEFORE, BIRTH_AFTER = 45, 10

# Labels whose next paragraph holds a value, in order of precedence.
LABELS = {
    "name": (
        "name", "full name", "customer name", "client name", "applicant name", "candidate name",
        "employee name", "patient name", "student name", "contact person",
    ),
    "dob": ("dob", "date of birth", "birth date", "birthdate"),
    "phone": ("phone", "mobile", "telephone", "tel", "contact number", "contact no", "whatsapp"),
    "address": (
        "address", "home address", "office address", "billing address", "shipping address",
        "residence", "mailing address", "registered office",
    ),
    "company": ("company", "employer", "organisation", "organization"),
}
LABEL_MAX, VALUE_MAX = 45, 180

# The nine types and who wins when two finds overlap (0 first).
PRIORITY = {
    "address": 0, "email": 1, "ssn": 1, "card": 1, "phone": 1, "ip": 1, "dob": 1, "name": 2, "company": 3,
}

# Parts of the replacements.
FIRST_NAMES = ("Aarav", "Maya", "Dev", "Nina", "Arjun", "Isha", "Rohan", "Tara")
LAST_NAMES = ("Shah", "Mehta", "Kapoor", "Rao", "Singh", "Patel", "Gupta", "Verma")
CARD_PREFIX = "411111111111"

# Shapes of replacements counted by the output audit.
MARKERS = {
    "example_com_emails": r"(?i)\b[\w.+-]+@example\.com\b",
    "example_entity_company": r"Example Entity \d+ Limited",
    "example_avenue_address": r"Example Avenue, Sample City",
    "synthetic_phone_91": r"\+91\s+\d{5}\s+\d{5}",
    "synthetic_ssn_900": r"\b900-01-\d{4}\b",
    "synthetic_card_4111": r"\b4111\s+1111\s+1111\s+\d{4}\b",
    "synthetic_ip_203": r"\b203\.0\.113\.\d{1,3}\b",
}

# What every match of these shapes holds, whatever the letter case (none of the letters has other forms beyond ASCII).
MARKERS_HOLD = {
    "example_com_emails": "@example.com",
    "example_entity_company": "Example Entity ",
    "example_avenue_address": "Example Avenue, Sample City",
    "synthetic_phone_91": "+91",
    "synthetic_ssn_900": "900-01-",
    "synthetic_card_4111": "4111",
    "synthetic_ip_203": "203.0.113.",
}

PREVIEW_LINES = 48
