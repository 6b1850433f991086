"""Filled-in forms, one per customer, derived from the given tables.

The documents hold no labels, titles, legal forms or birth dates, so detectors of those run on
lines built from customers, nations, suppliers and orders. The expressions are SQL that Spark and
DuckDB both read: the two sides build the same rows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIRST = ("Clara", "Felix", "Greta", "Imran", "Jonas", "Keiko", "Lucia", "Milan", "Nadia", "Oscar")
_LAST = ("Archer", "Bennett", "Castro", "Dubois", "Eriksen", "Fischer", "Gallo", "Horvat", "Ito")
_TRADE = ("Southgate Traders", "Red Maple Analytics", "Lotus Savings Group", "Fabrikam Mills")
_FORM = ("Limited", "LLC", "Pvt Ltd", "Corporation", "Private Limited")


def _pick(words: tuple[str, ...], key: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words))
    return f"(CASE {key} % {len(words)} {cases} END)"


def _person(shift: int) -> str:
    return f"{_pick(_FIRST, f'(k * 7 + {shift})')} || ' ' || {_pick(_LAST, f'(k + {shift})')}"


def _text(number: str, width: int = 0) -> str:
    text = f"CAST({number} AS STRING)"
    return f"lpad({text}, {width}, '0')" if width else text


_COMPANY = f"{_pick(_TRADE, 'k')} || ' ' || {_pick(_FORM, 'k')}"
_DATE = f"{_text('day')} || '/' || {_text('month', 2)} || '/' || {_text('year')}"
_SECOND_DATE = f"{_text('month')} || ' Jan ' || {_text('year')}"
_BODY = f"'400000' || {_text('k', 9)}"


def _check_digit() -> str:
    """Of the fifteen digits of the card's body; every second one, from the last on, counts twice."""
    digit = lambda i: f"CAST(substr({_BODY}, {i}, 1) AS INT)"
    terms = [
        f"(CASE WHEN {digit(i)} > 4 THEN {digit(i)} * 2 - 9 ELSE {digit(i)} * 2 END)" if i % 2 else digit(i)
        for i in range(1, 16)
    ]
    return f"((10 - ({' + '.join(terms)}) % 10) % 10)"


# Two of three cards carry the right check digit.
_CARD = f"({_BODY} || {_text(f'(({_check_digit()}) + (CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END)) % 10')})"
_GROUPED = " || ' ' || ".join(f"substr({_CARD}, {i}, 4)" for i in (1, 5, 9, 13))
_LANDLINE = f"'(312) 555-' || {_text('k % 10000', 4)}"

LINES = (
    f"'Parcel ' || {_text('k')} || ' waits, one of ' || {_text('orders_so_far')}",
    f"'Locker opened from 10.' || {_text('k % 300')} || '.' || {_text('k % 100')} || '.7 at dawn'",
    f"'Packed by ' || {_COMPANY} || ', two boxes'",
    f"'Customs keeps it under ' || {_text('100 + k % 800')} || '-' || {_text('k % 100', 2)} || '-' || {_text('k % 10000', 4)}",
    f"'Shipping Address: ' || {_text('1 + k % 900')} || ' Orchard Street, ' || nation || ' ' || {_text('10000 + k % 80000')}",
    f"'Client Name: ' || {_person(0)}",
    f"'Duty was paid with ' || {_GROUPED}",
    f"'The collector, born ' || {_DATE} || ', showed a passport'",
    f"'Ring +1 (' || {_text('200 + k % 700')} || ') 555-' || {_text('k % 10000', 4)} || ' when it rains'",
    f"'Or leave word at ' || lower({_pick(_FIRST, 'k')}) || '.' || {_text('k')} || '@mail' || {_text('k % 7')} || '.example.org'",
    f"'Contact Person: Dr. ' || {_person(2)} || '; ' || {_person(5)}",
    f"'Mr. ' || {_person(4)} || ' met ' || {_pick(_TRADE, '(k + 1)')} || ' Inc. on site.'",
    f"'Mobile: 9' || {_text('k', 9)}",
    f"'Order 2025-' || {_text('k')} || ' stands since ' || {_DATE} || '.'",
    "'Full Name:'",
    f"CASE WHEN k % 5 = 0 THEN ' ' ELSE {_person(6)} END",
    f"{_person(6)} || ' signed.'",
    "'Birth Date'",
    f"{_SECOND_DATE}",
    "'COMPANY'",
    f"'Harbour Goods ' || {_text('supplier')}",
    "''",
    f"'We wrote to ' || {_person(6)} || ' and ' || {_person(0)} || ' (' || {_COMPANY} || ') on ' || {_SECOND_DATE} || '.'",
    "'The Harbour Bank'",
    f"'Residence: Flat 3C, Meadow Court, 41100' || {_text('k % 10')} || ' '",
    "'Director: approved the plan'",
    f"'Desk +44 20 7946 ' || {_text('k % 10000', 4)} || ' or 020-7946 ' || {_text('k % 10000', 4)}",
    "'Contact no.'",
    f"{_LANDLINE}",
    f"'Call ' || {_LANDLINE} || ', or x' || {_LANDLINE} || ', Harbour Goods ' || {_text('supplier')} || '!'",
)

# One form per customer with orders: how many, and date and supplier of the last one.
SOURCE = """
    SELECT c_custkey AS k, n_name AS nation, s_suppkey AS supplier, orders_so_far,
           CAST(extract(DAY FROM last_date) AS INT) AS day,
           CAST(extract(MONTH FROM last_date) AS INT) AS month,
           CAST(extract(YEAR FROM last_date) AS INT) AS year
    FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey
         JOIN (SELECT o_custkey, count(*) AS orders_so_far, max_by(o_orderdate, o_orderkey) AS last_date,
                      max_by(order_supplier, o_orderkey) AS last_supplier
               FROM {orders} JOIN (SELECT l_orderkey, min(l_suppkey) AS order_supplier FROM {lineitem}
                                   GROUP BY l_orderkey) AS items ON l_orderkey = o_orderkey
               GROUP BY o_custkey) AS ordered ON o_custkey = c_custkey
         JOIN {supplier} ON s_suppkey = last_supplier
"""

TABLES = ("customer", "nation", "supplier", "orders", "lineitem")

SQL = f"""
    SELECT k AS doc_id, CAST(unnest(range({len(LINES)})) AS INTEGER) AS para_idx,
           unnest([{', '.join(LINES)}]) AS text
    FROM ({SOURCE.format(**{t: t for t in TABLES})})
"""


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per customer, ``(doc_id, text)``."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return spark.sql(SOURCE, **tables).select(
        F.col("k").alias("doc_id"), F.array_join(F.array(*[F.expr(line) for line in LINES]), "\n").alias("text")
    )

# What an entity model would say about some of the lines: (line, start, text, label).
_ENTITIES = (
    (0, "0", "'Parcel'", "ORG"),
    (4, "length('Shipping Address: ')", "'Orchard Street'", "FAC"),
    (13, "0", "'Order'", "PERSON"),
    (16, "0", _person(6), "PERSON"),
    (20, "0", "'Harbour Goods'", "ORG"),
    (22, "12", _person(6), "PERSON"),
    (23, "4", "'Harbour'", "LOC"),
    (24, "20", "'Meadow Court'", "FAC"),
    (26, "0", "'De'", "ORG"),
    (29, "0", "'Call '", "ORG"),
)

ENTITIES = " UNION ALL ".join(
    f"SELECT k AS doc_id, {line} AS para_idx, CAST({start} AS INT) AS start, "
    f"CAST({start} + length({text}) AS INT) AS stop, '{label}' AS label, {text} AS text FROM source"
    for line, start, text, label in _ENTITIES
)

# The types each line holds: (by its own labels, to a reader who knows).
_GOLD = {
    1: ("ip", "ip"), 2: ("company", "company"), 3: ("ssn", "ssn"), 4: ("address", "address"), 5: ("name", "name"),
    6: ("card", "card"), 7: ("dob", "dob"), 8: ("phone", "phone"), 9: ("email", "email"),
    10: ("name", "name"), 11: ("name,company", "name,company"), 12: ("phone", "phone"), 15: ("", "name"),
    16: ("", "name"), 18: ("", "dob"), 20: ("", "company"), 22: ("company", "name,company,dob"),
    24: ("address", "address"), 26: ("phone", "phone"), 28: ("phone", "phone"), 29: ("phone", "phone,company"),
}


def gold(which: int) -> str:
    """The types of a line, comma-separated."""
    cases = " ".join(f"WHEN {line} THEN '{types[which]}'" for line, types in _GOLD.items())
    return f"(CASE para_idx {cases} ELSE '' END)"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    rows = spark.sql(ENTITIES.replace("FROM source", "FROM {source}"), source=spark.sql(SOURCE, **tables))
    return rows.withColumnRenamed("stop", "end")
