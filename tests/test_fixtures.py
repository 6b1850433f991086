"""Whole documents of our own, with the numbers of finds per type that are published for such documents."""

import pytest

from maskwright.operators import score
from maskwright.plans.redact import redact
from maskwright.sources.paragraphs import from_blocks

ONE_EACH = dict.fromkeys(("name", "email", "phone", "company", "address", "ssn", "card", "dob", "ip"), 1)

BRASS = [
    "Minutes of the brass section",
    "Rehearsal fees went to 6011 0009 9013 9424, says the treasurer, Mr. Pavel Horn.",
    "Mrs. Alba Reyes lent the hall; her line is Tel 98450 11223 until Sunday.",
    "Sent from 172.30.1.9, signed Ms. Juno Falk, copy to brass@section.example.",
    "Tubas are insured by Copper Lane Limited under 512-44-9083.",
    "Our oldest player, born 7 Mar 1969, and Dr. Otto Lindqvist share a stand.",
    "Chairs are stored at 12 Quay Road, 30459 Emden, behind the lift.",
    "We play again on 12 April 2026.",
]
VET = [
    "Veterinary clinic, a grey cat",
    "It ate a glove on Monday.",
    "Patient name: Oskar Brandt",
    "Paid with 6011 1111 1111 1117.",
    "The owner drives for Halden Logistics LLC.",
    "Billing address: 4 Mill Terrace, 80331 Munich",
    "DOB 1991-08-30 was noted twice, once wrongly.",
    "His portal login came from 172.20.5.66 at night.",
    "Telephone: 0305 5501 99876",
    "Pet insurance runs under 601-22-7345.",
    "Results go to cats@brandt.example.",
    "Cage 14, one bowl a day.",
]
FERRY = [
    "Ferry crew, summer",
    "Applicant name: Runa Solberg",
    "Post to runa@ferry.example",
    "The radio gateway is 203.0.113.77 this month.",
    "Hired through Northern Tide Corporation.",
    "Date of birth 14/02/1975",
    "The union knows her as 433-21-6677.",
    "Mailing address: 3 Pier Street, 98101 Seattle",
    "Mobile 9345678120",
    "Uniform charged to 3530 1113 3330 0000.",
    "She sails on 3 May 2026.",
]
PLOT = [
    "Garden plot nine",
    "The shed key hangs with Femke Aalders.",
    "For seeds try +1 415-555-0177, then seeds@plot.example if nobody answers.",
    "Water bills now come from Rillgate, as Joris Blom noticed.",
    "Low sun at nine.",
]


@pytest.fixture(scope="module")
def blocks(spark):
    """A dance school's enrolment: two lines, a table of label and value cells, header and footer."""
    table = [
        ("Student Name", "Hedda Lind"), ("Organisation", "Aurora Dance Ltd"), ("Date of birth", "21 Jun 2004"),
        ("Home address", "Flat 9, Birch Avenue, 11122 Stockholm"), ("Writes from", "hedda@lind.example"), ("Signed in at", "192.168.40.5"),
    ]
    rows = [
        (7, "h", "header", 0, False, [0], "Taught by Mrs. Paola Ricci"),
        (7, "f", "footer", 0, False, [0], "Tel 98200 44556"),
        (7, "p0", "body", 0, False, [0], "Enrolment"),
        (7, "p1", "body", 0, False, [1], "Room 3 has the good floor."),
    ]
    rows += [(7, f"c{r}{c}", "body", 0, True, [0, r, c, 0, 0], t) for r, pair in enumerate(table) for c, t in enumerate(pair)]
    return spark.createDataFrame(
        rows[::-1],
        "doc_id bigint, element_id string, story string, section int, in_table boolean, path array<int>, text string",
    )


def counts(result):
    return {r["doc_id"]: r["redactions"] for r in result.summary.collect()}


def test_counts(lines_of):
    result = redact(lines_of(BRASS, VET, FERRY, PLOT))
    assert counts(result) == {
        0: {**ONE_EACH, "name": 4}, 1: ONE_EACH, 2: ONE_EACH, 3: {"email": 1, "phone": 1},
    }
    texts = {(r["doc_id"], r["para_idx"]): r["redacted"] for r in result.redacted.collect()}
    for doc, lines in enumerate((BRASS, VET, FERRY, PLOT)):
        assert texts[doc, len(lines) - 1] == lines[-1]
    # A line address swallows its label; without a hint word the label survives.
    assert texts[0, 6] == "101 Example Avenue, Sample City - 400001, India"
    assert texts[1, 5].startswith("Billing address: 101 Example Avenue")
    assert texts[1, 1] == VET[1]


def test_table_cells(blocks):
    paragraphs = from_blocks(blocks)
    texts = [r["text"] for r in paragraphs.orderBy("para_idx").collect()]
    assert texts[:4] == ["Enrolment", "Room 3 has the good floor.", "Student Name", "Hedda Lind"]
    assert texts[-2:] == ["Taught by Mrs. Paola Ricci", "Tel 98200 44556"]
    result = redact(paragraphs)
    assert counts(result) == {
        7: {"name": 2, "address": 1, "company": 1, "dob": 1, "email": 1, "ip": 1, "phone": 1}
    }


def test_annotations(spark, lines_of):
    said = [(1, "Femke Aalders", "PERSON"), (3, "Rillgate", "ORG"), (3, "Joris Blom", "PERSON"), (4, "nine", "GPE"), (4, "Low", "PERSON")]
    places = [(0, i, PLOT[i].index(t), PLOT[i].index(t) + len(t), label, t) for i, t, label in said]
    entities = spark.createDataFrame(places, "doc_id bigint, para_idx int, start int, end int, label string, text string")
    result = redact(lines_of(PLOT), mode="hybrid", entities=entities)
    assert counts(result) == {0: {"company": 1, "email": 1, "name": 2, "phone": 1}}
    with pytest.raises(ValueError):
        redact(lines_of(PLOT), mode="both")
    with pytest.raises(ValueError):
        redact(lines_of(PLOT), mode="hybrid")


def test_runs_keep_style(spark, lines_of):
    text = FERRY[1]
    cut = [0, 16, 21, len(text)]
    runs = [(0, 1, i, a, b, s) for i, (a, b, s) in enumerate(zip(cut, cut[1:], ("plain", "bold", "plain")))]
    runs += [(0, 2, 0, 0, 8, "plain"), (0, 2, 1, 8, len(FERRY[2]), "italic")]
    table = spark.createDataFrame(runs, "doc_id bigint, para_idx int, run_idx int, start int, end int, style string")
    result = redact(lines_of(FERRY), runs=table)
    pieces = [(r["para_idx"], r["text"], r["style"]) for r in result.pieces.orderBy("para_idx", "piece_idx").collect()]
    fakes = {r["pii_type"]: r["fake"] for r in result.mapping.collect()}
    assert pieces == [
        (1, "Applicant name: ", "plain"), (1, fakes["name"], "bold"),
        (2, "Post to ", "plain"), (2, fakes["email"], "italic"),
    ]
    # Paragraphs without runs are neither rewritten nor counted.
    assert counts(result) == {0: {"email": 1, "name": 1}}


def test_leak_check(spark, lines_of):
    result = redact(lines_of(VET))
    pair = "doc_id bigint, value string"
    gone = spark.createDataFrame([(0, "Oskar Brandt"), (0, "601-22-7345"), (0, "glove")], pair)
    kept = spark.createDataFrame([(0, "Cage 14"), (0, "cats@brandt")], pair)
    found = {(r["value"], r["problem"]) for r in score.leaks(result.redacted, gone, kept).collect()}
    assert found == {("glove", "remains"), ("cats@brandt", "missing")}
