"""Arrays of spans inside one row: literal finds with their offsets (in code points), resolving overlaps.

All of it stays in the JVM and needs no shuffle. Folds hold a state of fixed size
(``functions.sweep``), so that a line with very many finds takes time in proportion.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright import fixed_values as fixed
from maskwright.functions.dialect import java
from maskwright.functions.sweep import groups_at, let, sweep
from maskwright.functions.text import cut, in_blocks
from maskwright.schema import SPAN, SPANS

OPEN, CLOSE = "\ue000", "\ue001"


def _has_marks(text: Column) -> Column:
    return F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, pii_type: str | Column, value: Column, rank: int | Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        as_column(pii_type).alias("pii_type"),
        value.alias("value"),
        as_column(rank).cast("int").alias("detector_rank"),
    ).cast(SPAN)


def find_literal(text: Column, value: Column, pii_type: Column, rank: Column) -> Column:
    """Occurrences of ``value`` that touch no word character on either side.

    The length of a find is known, so the text is split at the finds themselves, whatever characters it holds. A value that
    stands there only once, as most do, needs no pattern: its place and the characters beside it tell.
    """
    size = F.length(value)
    one = lambda at: F.array(span(at - 1, at - 1 + size, pii_type, value, rank))

    def once(at: Column) -> Column:
        beside = F.array(F.when(at > 1, F.substring(text, at - 1, F.lit(1))).otherwise(""), F.substring(text, at + size, F.lit(1)))
        alone = F.call_function("locate", value, text, at + 1) == 0
        # How Java looks back on a character beyond the basic plane is left to the pattern.
        plain = F.forall(beside, lambda c: F.octet_length(c) < 4)
        free = F.when(F.exists(beside, lambda c: c.rlike(java(r"\w"))), no_spans()).otherwise(one(at))
        return F.when(at == 0, no_spans()).when(alone & plain, free).otherwise(_find_pattern(text, value, pii_type, rank))

    found = let(F.call_function("locate", value, text, F.lit(1)), once)
    return F.when(size > 0, found).otherwise(_find_pattern(text, value, pii_type, rank))


def _find_pattern(text: Column, value: Column, pii_type: Column, rank: Column) -> Column:
    quoted = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(java(r"(?<!\w)")), quoted, F.lit(java(r"(?!\w)")))
    between = F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece))
    size = F.length(value)
    step = lambda at, gap: at + gap + size
    found = lambda at, gap: span(at + gap, at + gap + size, pii_type, value, rank)
    return sweep(F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), F.lit(0), step, found, "int", SPAN)


def with_original_values(spans: Column, text: Column) -> Column:
    """Values cut from the text itself where it holds private-use marks, which annotations may have lost."""
    own = lambda blocks: F.transform(
        spans,
        lambda s: span(s["start"], s["end"], s["pii_type"], cut(blocks, s["start"], s["end"]), s["detector_rank"]),
    )
    return F.when((F.size(spans) > 0) & _has_marks(text), let(in_blocks(text), own)).otherwise(spans)


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _priority(pii_type: Column) -> Column:
    rank = F
    for kind, level in fixed.PRIORITY.items():
        rank = rank.when(pii_type == kind, level)
    return rank


def without_doubles(hits: Column, candidates: Column) -> Column:
    """``hits`` but for those at the place, and of the type, of a candidate that comes before them: ``resolve`` never keeps these."""
    same = lambda h, c: (
        (c["start"] == h["start"]) & (c["end"] == h["end"]) & (c["pii_type"] == h["pii_type"]) & (c["detector_rank"] < h["detector_rank"])
    )
    return F.when(F.size(hits) > 0, F.filter(hits, lambda h: ~F.exists(candidates, lambda c: same(h, c)))).otherwise(hits)


def _ranked(candidates: Column) -> Column:
    """Best first: priority, longest, leftmost, detector."""
    return F.sort_array(
        F.transform(
            candidates,
            lambda s: F.struct(
                _priority(s["pii_type"]).alias("priority"),
                (s["start"] - s["end"]).alias("shortness"),
                s["start"].alias("start"),
                s["detector_rank"].alias("detector_rank"),
                s.alias("span"),
            ),
        )
    )


def _greedy(candidates: Column) -> Column:
    """Keeps, best first, what overlaps nothing kept; quadratic, for few candidates."""
    kept = F.aggregate(
        _ranked(candidates),
        no_spans(),
        lambda acc, r: F.when(F.exists(acc, lambda k: overlap(k, r["span"])), acc).otherwise(
            F.flatten(F.array(acc, F.array(r["span"])))
        ),
    )
    return F.array_sort(kept)


_EVENT = f"struct<at: int, kind: int, reach: int, detector_rank: int, span: {SPAN}>"


def _free(members: Column, kept: Column) -> Column:
    """Of ranked candidates of one priority and length, those that are kept beside the disjoint ``kept``.

    One sweep over ends of members and starts of kept spans: how far the spans that begin before
    a member's end reach says whether one of them overlaps it. Members of one length come in the order in which they choose.
    """
    event = lambda at, kind, reach, rank, s: F.struct(
        at.alias("at"), F.lit(kind).alias("kind"), reach.alias("reach"), rank.alias("detector_rank"), s.alias("span")
    ).cast(_EVENT)
    taken = F.transform(kept, lambda k: event(k["start"], 1, k["end"], F.lit(0), F.lit(None)))
    asking = F.transform(members, lambda m: event(m["span"]["end"], 0, F.lit(0), m["detector_rank"], m["span"]))

    fits = lambda reach, e: (e["kind"] == 0) & (reach <= e["span"]["start"])
    step = lambda reach, e: F.greatest(reach, F.when(fits(reach, e), e["at"]).otherwise(e["reach"]))
    chosen = lambda reach, e: F.when(fits(reach, e), e["span"])
    return sweep(F.sort_array(F.concat(taken, asking)), F.lit(0), step, chosen, "int", SPAN)


def _by_class(candidates: Column) -> Column:
    """As ``_greedy``, a priority and length at a time: each is one sweep along what is kept so far."""

    def classes(ranked: Column) -> Column:
        new = lambda i: (i == 0) | ~(
            (F.get(ranked, i)["priority"] == F.get(ranked, i - 1)["priority"])
            & (F.get(ranked, i)["shortness"] == F.get(ranked, i - 1)["shortness"])
        )
        firsts = F.filter(F.sequence(F.lit(0), F.size(ranked) - 1), new)
        return let(firsts, lambda at: groups_at(ranked, at))

    add = lambda kept, members: F.sort_array(F.concat(kept, _free(members, kept)))
    return F.aggregate(let(_ranked(candidates), classes), no_spans(), add)


# Up to this many touching candidates are settled pair by pair; more go class by class. Both keep the same.
FEW = 16


def resolve(candidates: Column, few: int = FEW) -> Column:
    """Non-overlapping spans of one paragraph, by start.

    Candidates are first cut into groups that share no character with one another.
    """

    def settle(group: Column) -> Column:
        size = F.size(group)
        return F.when(size < 2, group).when(size <= few, _greedy(group)).otherwise(_by_class(group))

    def settled(ordered: Column) -> Column:
        places = F.transform(ordered, lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["end"].alias("end")))
        step = lambda reach, p: F.greatest(reach, p["end"])
        begins = lambda reach, p: F.when(p["start"] >= reach, p["i"])
        firsts = sweep(places, F.lit(0), step, begins, "int", "int")
        return F.flatten(F.transform(let(firsts, lambda at: groups_at(ordered, at)), settle))

    def chosen(ordered: Column) -> Column:
        first, second = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
        n = F.size(ordered)
        apart = F.forall(F.sequence(F.lit(1), n - 1), lambda i: F.get(ordered, i)["start"] >= F.get(ordered, i - 1)["end"])
        best = F.array(F.get(_ranked(ordered), F.lit(0))["span"])
        plain = F.coalesce(first["start"] >= 0, F.lit(False))
        return (
            F.when(plain & F.coalesce(apart, F.lit(False)), ordered)
            .when(plain & (n == 2) & F.coalesce(overlap(first, second), F.lit(False)), best)
            .when(plain & (n <= few), _greedy(ordered))
            .otherwise(settled(ordered))
        )

    return F.when(F.size(candidates) < 2, candidates).otherwise(let(F.sort_array(candidates), chosen))
