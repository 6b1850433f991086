"""Thirty sentences of our own, labelled; the totals are those published for such a suite."""

from maskwright.plans.evaluate import evaluate
from maskwright.schema import CASES, ENTITIES

# (sentence, type its own shape or label tells, type a reader knows): one type or none each.
SUITE = (
    ("Name: Petra Lang", "name", "name"), ("Dr. Hugo Stein chaired the talk", "name", "name"), ("Contact Person: Mila Novak", "name", "name"),
    ("Write to help@lakeside.example", "email", "email"), ("Bills go to pay@orchard.example today", "email", "email"),
    ("Tel 9812345670", "phone", "phone"), ("Ring +44 7700 900123 after six", "phone", "phone"),
    ("Blue Fir Ltd sent crates", "company", "company"), ("We bank with Harbour Union Bank", "company", "company"),
    ("Registered Office: 4 Mill Road, Leeds", "address", "address"), ("Flat 9, Hill Road, Pune 411001", "address", "address"),
    ("File 234-56-7890 is closed", "ssn", "ssn"), ("The form says 601-22-7345", "ssn", "ssn"),
    ("Charged to 4111 1111 1111 1111", "card", "card"), ("Paid by 5555-5555-5555-4444", "card", "card"),
    ("Born 7 Mar 1969 in Turin", "dob", "dob"), ("DOB 1991-08-30", "dob", "dob"),
    ("Login from 10.44.3.21", "ip", "ip"), ("The host 192.168.4.9 failed", "ip", "ip"),
    ("Lotte Veen called twice", "", "name"), ("Kestrel Lines won the bid", "", "company"), ("Ole Berg has the key", "", "name"),
    ("Lunch is at noon.", "", ""), ("Order 2025-118 is packed.", "", ""), ("Page 12 of 40", "", ""), ("We meet on 12 April 2026.", "", ""),
    ("Ticket 4521 was closed", "", ""), ("The red boat leaves at nine", "", ""), ("Version 2.4 is out", "", ""), ("Totals rose by 8 percent", "", ""),
)
# What a model says: three finds, and four firms that are none.
SAID = (
    (19, "Lotte Veen", "PERSON"), (20, "Kestrel Lines", "ORG"), (21, "Ole Berg", "PERSON"), (28, "Version", "ORG"), (29, "Totals", "ORG"),
    (17, "Login", "ORG"), (4, "Bills", "ORG"), (22, "Lunch", "GPE"), (0, "Na", "ORG"),
)


def test_published_totals(spark):
    kinds = lambda t: [t] if t else []
    cases = spark.createDataFrame([(i, t, kinds(a), kinds(b)) for i, (t, a, b) in enumerate(SUITE)], CASES)
    said = [(i, 0, SUITE[i][0].index(w), SUITE[i][0].index(w) + len(w), label, w) for i, w, label in SAID]
    scores, per_type = evaluate(cases, spark.createDataFrame(said, ENTITIES))
    rows = {r["view"]: r for r in scores.collect()}
    totals = lambda view: tuple(rows[view][c] for c in ("cases", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall"))
    assert totals("rules") == (30, 19, 0, 0, 11, 100.0, 100.0, 100.0)
    assert totals("rules_against_full_gold") == (30, 19, 0, 3, 8, 90.0, 100.0, 86.4)
    assert totals("hybrid") == (30, 22, 4, 0, 6, 87.5, 84.6, 100.0)
    wrong = {r["pii_type"]: r["fp"] for r in per_type.collect() if r["view"] == "hybrid" and r["fp"]}
    assert wrong == {"company": 4}
