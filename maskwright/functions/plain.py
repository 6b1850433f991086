"""The pattern detectors over one text in plain Python, with the patterns as they are published.

Runs in Python workers, batch by batch: patterns whose gates hold on few lines cost far less here than as expressions
over arrays, which Spark interprets. Needs neither Spark nor tables. Offsets count code points.
"""

import gc
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

import pyarrow as pa

from maskwright import fixed_values as fixed

Place = tuple[int, int, str]


def _labelled(pattern: tuple[str, str]) -> re.Pattern[str]:
    return re.compile(f"{pattern[0]}({pattern[1]})")


_EMAIL, _SSN, _IP, _CARD, _PHONE, _DATE, _PERSON, _TITLED, _COMPANY, _POSTAL, _HINT = (
    re.compile(p) for p in (
        fixed.EMAIL, fixed.SSN, fixed.IPV4, fixed.CARD, fixed.PHONE, fixed.DATE, fixed.PERSON, fixed.TITLED_NAME, fixed.COMPANY,
        fixed.POSTAL, fixed.ADDRESS_HINT,
    )
)
_PHONE_LABEL, _NAME_LABEL, _ADDRESS_LABEL, _CONTACT_LIST = map(
    _labelled, (fixed.PHONE_LABEL, fixed.NAME_LABEL, fixed.ADDRESS_LABEL, fixed.CONTACT_LIST)
)
_LINE, _DIGIT = re.compile(r"[^\n]+"), re.compile(r"\d")
_NOT_DIGITS = re.compile(r"\D+")

# Cheap necessary conditions of the patterns above.
_FIVE_DIGITS = re.compile(r"\d{3}\s?\d{3}|\d{5}")
_SSN_HEAD = re.compile(r"\d{3}-\d{2}-")
_FOURTEEN = re.compile(r"(?:\d[ -]?){14}")
_PHONE_BODY = re.compile(r"\d{3}[\s.-]\d{4}")
_LONG_NUMBER = re.compile(r"\d[\d\s().-]{8,}\d")
_PHONE_SIGN = re.compile(r"[+ (\-]")
_FORM_HEADS = "Co", "L", "Bank", "Inc", "P", "GmbH"
_LEGAL_FORM = re.compile(r"\s(?:P(?:rivate|ublic|vt|LC)|L(?:imited|td|L[PC]|\.L)|Inc|Co|Bank|GmbH)")


def _has(text: str, words: Iterable[str]) -> bool:
    for word in words:
        if word in text:
            return True
    return False


def _said(low: str | None, words: Iterable[str]) -> bool:
    """Whether one of the (lower-case) words may stand in a text in any letter case; texts beyond ASCII, without ``low``, are not judged."""
    return low is None or _has(low, words)


def _groups(pattern: re.Pattern[str], text: str) -> list[Place]:
    return [(m.start(1), m.end(1), m[1]) for m in pattern.finditer(text)]


def _matches(pattern: re.Pattern[str], text: str) -> list[Place]:
    return [(m.start(), m.end(), m[0]) for m in pattern.finditer(text)]


def _digits(text: str) -> str:
    return _NOT_DIGITS.sub("", text)


def _luhn(text: str) -> bool:
    """Check-digit test on 13 to 19 digits of any script."""
    digits = [int(c) for c in _digits(text)]
    if not 13 <= len(digits) <= 19:
        return False
    doubled = [2 * d - 9 if d > 4 else 2 * d for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _near_birth(text: str, start: int, end: int) -> bool:
    return _has(text[max(0, start - fixed.BIRTH_BEFORE) : end + fixed.BIRTH_AFTER].casefold(), fixed.BIRTH_MARKERS)


def _address_label(text: str, low: str | None) -> list[Place]:
    if ":" not in text or not _said(low, ("address", "office", "residence")):
        return []
    places = []
    for _, end, value in _groups(_ADDRESS_LABEL, text):
        stripped = value.strip()
        if _POSTAL.search(stripped) or _HINT.search(stripped):
            value = value.lstrip()
            places.append((end - len(value), end, value))
    return places


def _address_line(text: str, low: str | None) -> list[Place]:
    if not (_FIVE_DIGITS.search(text) and _POSTAL.search(text) and _HINT.search(text)):
        return []
    return [p for p in _matches(_LINE, text) if _POSTAL.search(p[2]) and _HINT.search(p[2])]


def _email(text: str, low: str | None) -> list[Place]:
    return _matches(_EMAIL, text) if "@" in text else []


def _ssn(text: str, low: str | None) -> list[Place]:
    return _matches(_SSN, text) if "-" in text and _SSN_HEAD.search(text) else []


def _ip(text: str, low: str | None) -> list[Place]:
    return _matches(_IP, text) if text.count(".") >= 3 else []


def _card(text: str, low: str | None) -> list[Place]:
    return [p for p in _matches(_CARD, text) if _luhn(p[2])] if _FOURTEEN.search(text) else []


def _phone_shape(text: str, low: str | None) -> list[Place]:
    if not _PHONE_BODY.search(text):
        return []
    return [p for p in _matches(_PHONE, text) if len(_digits(p[2])) >= 10 and _PHONE_SIGN.search(p[2])]


def _phone_label(text: str, low: str | None) -> list[Place]:
    if not (_said(low, ("phone", "mobile", "cell", "tel", "contact", "whatsapp")) and _LONG_NUMBER.search(text)):
        return []
    return [p for p in _groups(_PHONE_LABEL, text) if 10 <= len(_digits(p[2])) <= 15]


def _birth_date(text: str, low: str | None) -> list[Place]:
    if not _has(text.casefold() if low is None else low, ("dob", "born", "birth")):
        return []
    return [p for p in _matches(_DATE, text) if _near_birth(text, p[0], p[1])]


def _name_label(text: str, low: str | None) -> list[Place]:
    words = "name", "person", "director", "officer", "secretary", "partner", "promoter", "auditor"
    return _groups(_NAME_LABEL, text) if ":" in text and _said(low, words) else []


def _contact_list(text: str, low: str | None) -> list[Place]:
    if ":" not in text or not _said(low, ("person",)):
        return []
    return [(at + a, at + b, name) for at, _, value in _groups(_CONTACT_LIST, text) for a, b, name in _matches(_PERSON, value)]


def _titled_name(text: str, low: str | None) -> list[Place]:
    return _matches(_TITLED, text) if _has(text, ("Mr.", "Ms.", "Mrs.", "Dr.")) else []


def _company(text: str, low: str | None) -> list[Place]:
    if not (_has(text, _FORM_HEADS) and _LEGAL_FORM.search(text)):
        return []
    the = lambda value: value.strip()[:5].casefold().startswith("the ")
    return [p for p in _matches(_COMPANY, text) if len(p[2].split()) <= 9 and not the(p[2])]


# A text, and it in lower case if it is ASCII.
FINDERS: dict[str, Callable[[str, str | None], list[Place]]] = {
    "address_label": _address_label, "address_line": _address_line, "email": _email, "ssn": _ssn, "ip": _ip, "card": _card,
    "phone_shape": _phone_shape, "phone_label": _phone_label, "birth_date": _birth_date, "name_label": _name_label,
    "contact_list": _contact_list, "titled_name": _titled_name, "company": _company,
}

SPANS = pa.list_(pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("pii_type", pa.string()), ("value", pa.string()), ("detector_rank", pa.int32()),
]))


def listed(rows: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    """Rows of tuples, in the order of the fields, as an array of lists of structs."""
    ends, flat = [0], []
    for row in rows:
        flat += row
        ends.append(len(flat))
    fields = list(kind.value_type)
    items = pa.StructArray.from_arrays([pa.array([t[i] for t in flat], f.type) for i, f in enumerate(fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, type=kind)


@contextmanager
def uncollected() -> Iterator[None]:
    """The many tuples of a batch hold no cycles: looking for some would take half of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def values(array: pa.Array) -> list:
    """As ``to_pylist``, which builds a scalar for each value; strings and numbers without nulls need none."""
    if pa.types.is_string(array.type) or array.null_count == 0:
        return array.to_numpy(zero_copy_only=False).tolist()
    return array.to_pylist()


def finder(detectors: list[tuple[str, str, int, int]]) -> Callable[[pa.Array], pa.Array]:
    """All finds of the detectors ``(name, type, rank, least_digits)`` in each of a batch of texts, unresolved."""
    known = [(FINDERS[name], kind, rank, least) for name, kind, rank, least in detectors]

    def finds(text: str) -> list[tuple]:
        out = []
        # The digits of a text are counted once.
        digits = len(_digits(text)) if _DIGIT.search(text) else 0
        low = text.lower() if text.isascii() else None
        for find, kind, rank, least in known:
            if digits >= least:
                for start, end, value in find(text, low):
                    if not value.isspace():
                        out.append((start, end, kind, value, rank))
        return out

    def batch(texts: pa.Array) -> pa.Array:
        with uncollected():
            return listed([finds(t) if t else [] for t in values(texts)], SPANS)

    return batch


TYPED = pa.list_(pa.struct([("pii_type", pa.string()), ("value", pa.string())]))
# An earlier type keeps a label it shares with a later one.
_LABELS = {label: kind for kind, labels in reversed(fixed.LABELS.items()) for label in labels if len(label) <= fixed.LABEL_MAX}
_LABEL_WORD = re.compile(r"[a-z0-9]+")
_MOST_WORDS = max(len(label.split()) for label in _LABELS)


def label_type(text: str) -> str | None:
    """The type a paragraph announces for its successor."""
    words = [m[0] for m in islice(_LABEL_WORD.finditer(text.casefold()), _MOST_WORDS + 1)]
    return _LABELS.get(" ".join(words))


def taught_by_label(label: str | None, text: str | None) -> list[tuple[str, str]]:
    """``(type, value)`` of what a paragraph teaches by the label before it."""
    kind = label_type(label) if label and text else None
    value = text.strip() if kind else ""
    if not 1 <= len(value) <= fixed.VALUE_MAX:
        return []
    if kind == "dob":
        return [(kind, m[0]) for m in _DATE.finditer(value)]
    if kind == "name":
        holds = _PERSON.fullmatch(value)
    elif kind == "phone":
        holds = 10 <= len(_digits(value)) <= 15
    elif kind == "address":
        holds = _POSTAL.search(value) or _HINT.search(value)
    else:
        holds = len(value.split()) >= 2 or _COMPANY.search(value)
    return [(kind, value)] if holds else []


def label_batch(labels: pa.Array, texts: pa.Array) -> pa.Array:
    with uncollected():
        return listed([taught_by_label(*row) for row in zip(values(labels), values(texts))], TYPED)


PIECES = pa.list_(pa.struct([("text", pa.string()), ("style", pa.string())]))
_RUN_END, _RUN_START, _SPAN_END, _SPAN_START = range(4)  # in this order at one place


def _first_style(runs: list[tuple]) -> str | None:
    """The style of the run with the smallest number; null numbers come first."""
    return min(runs, key=lambda r: (-1 if r[2] is None else r[2], r[3] is not None, r[3] or ""))[3] if runs else None


def _by_events(text: str | None, spans: list[tuple], runs: list[tuple]) -> list[tuple]:
    """One walk along all bounds of runs and spans, wherever they stand. A bound ends the piece before it."""
    events = []
    for start, end, _, style in runs:
        events += ((start, _RUN_START, style or "", "", style, None), (end, _RUN_END, "", "", None, None))
    for start, end, fake in spans:
        events += ((start, _SPAN_START, "", fake or "", None, fake), (end, _SPAN_END, "", "", None, None))
    events.sort(key=lambda e: (-1 if e[0] is None else e[0], *e[1:4]))
    first = _first_style(runs)
    out, last, styled, style, kept = [], 0, False, None, True
    for at, kind, _, _, own, fake in events:
        if styled and kept and text and last is not None and at is not None and last < at and text[last:at]:
            out.append((text[last:at], style))
        if fake:
            out.append((fake, style if styled else first))
        last = at
        if kind == _RUN_START:
            styled, style = True, own
        elif kind == _RUN_END:
            styled = False
        else:
            kept = kind == _SPAN_END
    return out


def _in_order(places: list[tuple]) -> bool:
    """Whether places ``(start, end, …)`` of at least one character follow one another."""
    reach = 0
    for place in places:
        start, end = place[0], place[1]
        if start is None or end is None or start < reach or end <= start:
            return False
        reach = end
    return True


def pieces(text: str | None, spans: list[tuple], runs: list[tuple]) -> list[tuple]:
    """The text as ``(text, style)``, with spans ``(start, end, fake)`` replaced, of runs ``(start, end, run_idx, style)``.

    A replacement has the style of the run in which its span starts, or of the first run.
    """
    if not (text and spans and _in_order(spans) and _in_order(runs)):
        return _by_events(text, spans, runs)
    out, done, at, n = [], 0, 0, len(runs)
    for start, end, fake in (*spans, (len(text), None, None)):
        under = None
        while at < n:
            first, last, _, style = runs[at]
            low, high = max(first, done), min(last, start)
            if low < high and text[low:high]:
                out.append((text[low:high], style))
            if last > start:
                under = runs[at] if first <= start else None
                break
            at += 1
        if fake:
            out.append((fake, under[3] if under else _first_style(runs)))
        done = end
    return out


def tuples(rows: pa.Array) -> list[list[tuple]]:
    """The structs of lists as tuples; a null list as an empty one."""
    flat = list(zip(*map(values, rows.flatten().flatten())))
    out, at = [], 0
    for size in values(rows.value_lengths()):
        end = at + (size or 0)
        out.append(flat[at:end])
        at = end
    return out


def piece_batch(texts: pa.Array, spans: pa.Array, runs: pa.Array) -> pa.Array:
    with uncollected():
        return listed([pieces(*row) for row in zip(values(texts), tuples(spans), tuples(runs))], PIECES)
