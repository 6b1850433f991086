"""Python regular expressions in Java's dialect.

Python's ``\\w \\d \\s \\b`` follow Unicode categories. Java has a flag for that, but it
counts combining marks and joiners as word characters and its ``\\b`` changed between
JDK releases, so the classes are spelled out instead.
"""

import re

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Letters outside ASCII that ignore-case matching counts as i, s and k.
_FOLDED_LETTERS = r"A-Za-z\u0130\u0131\u017f\u212a"

_OUTSIDE = {
    "w": f"[{WORD}]",
    "d": r"\p{Nd}",
    "D": r"\P{Nd}",
    "s": f"[{SPACE}]",
    "S": f"[^{SPACE}]",
    "b": f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))",
}
_INSIDE = {"w": WORD, "d": r"\p{Nd}", "s": SPACE}
_FLAGS = re.compile(r"^\(\?([im]+)\)")


def java(pattern: str) -> str:
    """``pattern`` (Python syntax, flags only at its start) for Spark's regexp functions."""
    flags = _FLAGS.match(pattern)
    ignore_case = bool(flags) and "i" in flags.group(1)
    body = pattern[flags.end():] if flags else pattern
    out, in_class, i = [], False, 0
    while i < len(body):
        char = body[i]
        if char == "\\":
            known = _INSIDE if in_class else _OUTSIDE
            out.append(known.get(body[i + 1], body[i:i + 2]))
            i += 2
            continue
        if ignore_case and in_class and body[i:i + 3] in ("A-Z", "a-z"):
            out.append(_FOLDED_LETTERS)
            i += 3
            continue
        if char in "[]":
            in_class = char == "["
        elif in_class and char == "&":
            char = r"\&"
        out.append(char)
        i += 1
    # d: only \n ends a line; u: case-blind beyond ASCII.
    java_flags = "d" + ("iu" if ignore_case else "") + ("m" if flags and "m" in flags.group(1) else "")
    return f"(?{java_flags})" + "".join(out)


def label_and_value(label: str, value: str) -> str:
    """Both parts as groups 1 and 2 of one Java pattern; the label's flags hold for both."""
    flags = _FLAGS.match(label)
    head = flags.group(0) if flags else ""
    return java(f"{head}({label[len(head):]})({value})")
