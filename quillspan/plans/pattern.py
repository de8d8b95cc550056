"""Patterns over token sequences, built from Python calls and turned into Spark columns.

A region (sentence, text, ...) is one row with one array column per token attribute.  A
pattern is compiled to two columns over such a row: a plain boolean for everything up to the
first variable-length part (this stays in generated code), and an array of reachable ends for
the rest.  Keeping the whole set of ends is what makes "shortest match per start" exact: the
nearest second hit may block a third one that a farther second hit allows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

Lookup = Callable[[str], Column]
"""Gives the column holding an attribute's value at the token under test."""


class Pred:
    """A condition on one token.  Undefined values make it false, also under negation."""

    def __init__(self, build: Callable[[Lookup], Column]):
        self._build = build

    def at(self, lookup: Lookup) -> Column:
        return F.coalesce(self._build(lookup), F.lit(False))

    def __and__(self, other: Pred) -> Pred:
        return Pred(lambda at: self.at(at) & other.at(at))

    def __or__(self, other: Pred) -> Pred:
        return Pred(lambda at: self.at(at) | other.at(at))

    def __invert__(self) -> Pred:
        return Pred(lambda at: ~self._build(at))

    def attributes(self) -> set[str]:
        seen: set[str] = set()

        def note(name: str) -> Column:
            seen.add(name)
            return F.col(name)

        self._build(note)
        return seen


def _whole(regex: str, ignore_case: bool) -> str:
    return rf"{'(?iu)' if ignore_case else ''}\A(?:{regex})\z"


class tok:
    """Start of a condition: ``tok("word") == "the"``, ``tok("lex").contains("run")``."""

    def __init__(self, attr: str):
        self.attr = attr

    def __eq__(self, value: str) -> Pred:  # type: ignore[override]
        return Pred(lambda at: at(self.attr) == F.lit(value))

    def __ne__(self, value: str) -> Pred:  # type: ignore[override]
        return Pred(lambda at: at(self.attr) != F.lit(value))

    __hash__ = None  # type: ignore[assignment]

    def equals(self, value: str, ignore_case: bool = False) -> Pred:
        if not ignore_case:
            return self == value
        return Pred(lambda at: F.lower(at(self.attr)) == F.lower(F.lit(value)))

    def matches(self, regex: str, ignore_case: bool = False) -> Pred:
        """Regular expression over the whole value."""
        return Pred(lambda at: at(self.attr).rlike(_whole(regex, ignore_case)))

    def isin(self, *values: str) -> Pred:
        return Pred(lambda at: at(self.attr).isin(*values))

    def contains(self, value: str) -> Pred:
        """A value set holds this value."""
        return Pred(lambda at: F.array_contains(at(self.attr), value))

    def contains_match(self, regex: str, ignore_case: bool = False) -> Pred:
        """A value set holds a value that matches the regular expression as a whole."""
        rx = _whole(regex, ignore_case)
        return Pred(lambda at: F.exists(at(self.attr), lambda x: x.rlike(rx)))


def any_token() -> Pred:
    return Pred(lambda at: F.lit(True))


@dataclass(frozen=True)
class One:
    pred: Pred
    target: bool = False


@dataclass(frozen=True)
class Look:
    pred: Pred


@dataclass(frozen=True)
class Rep:
    pred: Pred
    least: int
    most: int | None


@dataclass(frozen=True)
class Gap:
    least: int
    most: int | None


@dataclass(frozen=True)
class Alt:
    options: tuple[Pattern, ...]

    @property
    def longest(self) -> int | None:
        lengths = [option.longest for option in self.options]
        return None if None in lengths else max(lengths)


@dataclass(frozen=True)
class Pattern:
    parts: tuple[object, ...]

    @property
    def shortest(self) -> int:
        """Least length of a match in tokens."""
        return sum(_shortest(part) for part in self.parts)

    @property
    def longest(self) -> int | None:
        """Greatest length of a match in tokens; None when there is no bound."""
        total = 0
        for part in self.parts:
            n = _longest(part)
            if n is None:
                return None
            total += n
        return total

    def attributes(self) -> set[str]:
        names: set[str] = set()
        for part in self.parts:
            if isinstance(part, Alt):
                for option in part.options:
                    names |= option.attributes()
            elif not isinstance(part, Gap):
                names |= part.pred.attributes()
        return names


def _longest(part) -> int | None:
    if isinstance(part, One):
        return 1
    if isinstance(part, Look):
        return 0
    return part.longest if isinstance(part, Alt) else part.most


def _shortest(part) -> int:
    if isinstance(part, One):
        return 1
    if isinstance(part, Look):
        return 0
    if isinstance(part, Alt):
        return min(option.shortest for option in part.options)
    return part.least


def conditions(pattern: Pattern) -> list[Pred]:
    """The conditions of a pattern that read an attribute, each once."""
    found: dict[int, Pred] = {}
    for part in pattern.parts:
        inner = [c for option in part.options for c in conditions(option)] if isinstance(part, Alt) else [] if isinstance(part, Gap) else [part.pred]
        found.update({id(c): c for c in inner if c.attributes()})
    return list(found.values())


def with_conditions(pattern: Pattern, change: Callable[[Pred], Pred]) -> Pattern:
    """The same pattern over other conditions."""

    def part(p):
        if isinstance(p, Alt):
            return Alt(tuple(with_conditions(o, change) for o in p.options))
        return p if isinstance(p, Gap) else replace(p, pred=change(p.pred))

    return Pattern(tuple(map(part, pattern.parts)))


def first_condition(pattern: Pattern) -> Pred | None:
    """What the first token of every match satisfies; None where that isn't known."""
    part = pattern.parts[0] if pattern.parts else None
    if isinstance(part, One) or isinstance(part, Rep) and part.least > 0:
        return part.pred
    found = [first_condition(o) for o in part.options] if isinstance(part, Alt) else [None]
    if any(c is None for c in found):
        return None
    either = found[0]
    for c in found[1:]:
        either = either | c
    return either


def varies(pattern: Pattern) -> bool:
    """Whether matches may differ in length, or be found in several ways."""
    return any(isinstance(p, (Rep, Alt)) or isinstance(p, Gap) and p.least != p.most for p in pattern.parts)


def is_open(part) -> bool:
    """A gap or repetition without an upper bound."""
    return isinstance(part, (Gap, Rep)) and part.most is None


def without_choice(pattern: Pattern) -> list[Pattern]:
    """Patterns that together match the same, in which no open part stands inside an alternation."""
    for i, part in enumerate(pattern.parts):
        if isinstance(part, Alt) and part.longest is None:
            return [p for o in part.options for p in without_choice(Pattern((*pattern.parts[:i], *o.parts, *pattern.parts[i + 1 :])))]
    return [pattern]


def closed_at_end(pattern: Pattern) -> Pattern:
    """The same matches, as each ends as early as it can: what may be left out at the end is left out."""
    parts = list(pattern.parts)
    if pattern.shortest == 0:  # one token of any part makes a match
        return Pattern(tuple(replace(p, most=1) if is_open(p) else p for p in parts))
    while isinstance(parts[-1], (Gap, Rep)) and parts[-1].least == 0:
        parts.pop()
    if is_open(parts[-1]):
        parts[-1] = replace(parts[-1], most=parts[-1].least)
    return Pattern(tuple(parts))


def one(pred: Pred, target: bool = False) -> One:
    """Exactly one token; ``target`` marks the token that statistics shall use."""
    return One(pred, target)


def look(pred: Pred) -> Look:
    """Condition on the next token without consuming it."""
    return Look(pred)


def rep(pred: Pred, least: int, most: int | None = None) -> Rep:
    """``least`` to ``most`` tokens that all satisfy the condition; None means no upper bound."""
    _check_bounds(least, most)
    return Rep(pred, least, most)


def gap(least: int = 1, most: int | None | str = "same") -> Gap:
    """Any tokens: ``gap()`` one, ``gap(n)`` exactly n, ``gap(n, m)``, ``gap(n, None)`` open."""
    upper = least if most == "same" else most
    _check_bounds(least, upper)
    return Gap(least, upper)


def alt(*options: Pattern | Pred | One) -> Alt:
    """Any of several patterns at this place."""
    return Alt(tuple(o if isinstance(o, Pattern) else seq(o) for o in options))


def seq(*parts) -> Pattern:
    """Parts one after the other.  A bare condition stands for one token; neighbouring gaps merge."""
    out: list[object] = []
    for part in parts:
        if isinstance(part, Pattern):
            new = list(part.parts)
        else:
            new = [One(part) if isinstance(part, Pred) else part]
        for p in new:
            if isinstance(p, Gap) and out and isinstance(out[-1], Gap):
                q = out.pop()
                p = Gap(q.least + p.least, None if None in (q.most, p.most) else q.most + p.most)
            out.append(p)
    if not out:
        raise ValueError("a pattern needs at least one part")
    return Pattern(tuple(out))


def _check_bounds(least: int, most: int | None) -> None:
    if least < 0 or (most is not None and most < least):
        raise ValueError(f"bad repetition bounds {least}, {most}")


@dataclass(frozen=True)
class Compiled:
    """A pattern at one start position.

    ``fixed`` is the test of the fixed-length front.  If the whole pattern has a fixed length,
    ``end`` (exclusive) and ``target`` are plain columns and ``ends`` is None.  Otherwise
    ``ends`` is an array with the shortest reachable end and its target, or with nothing.
    """

    fixed: Column
    end: Column
    target: Column
    ends: Column | None = None


def compile_at(
    pattern: Pattern,
    start: Column,
    limit: Column,
    lookup: Callable[[str, Column, int | None], Column],
    part_of_match: bool = False,
) -> Compiled:
    """Columns telling whether ``pattern`` matches at ``start`` without passing ``limit``.

    ``lookup(attr, position, k)`` gives an attribute at a position; ``k`` is the fixed distance
    from ``start`` when it is known at this point.  A pattern that is only ``part_of_match`` may take no token,
    and all ends it can reach are wanted.
    """
    conds: list[Column] = []
    target: Column = F.lit(None).cast("int")
    parts = list(pattern.parts)
    k = 0
    while parts:
        part = parts[0]
        at = lambda attr, k=k: lookup(attr, start + F.lit(k), k)
        if isinstance(part, One):
            conds.append(part.pred.at(at))
            if part.target:
                target = start + F.lit(k)
            k += 1
        elif isinstance(part, Look):
            conds.append(part.pred.at(at) & (start + F.lit(k) < limit))
        elif isinstance(part, Gap) and part.least == part.most:
            k += part.least
        else:
            break
        parts.pop(0)

    fixed = F.lit(True)
    for cond in [*conds, start + F.lit(k) <= limit]:
        fixed = fixed & cond
    if not parts:
        return Compiled(fixed & F.lit(k > 0 or part_of_match), start + F.lit(k), target)

    state = F.array(F.struct((start + F.lit(k)).alias("e"), target.alias("t")))
    for part in parts:
        state = _advance(state, part, limit, lookup)
    if part_of_match:
        return Compiled(fixed, start, target, state)
    if k == 0:
        state = F.filter(state, lambda s: s["e"] > start)
    return Compiled(fixed, start, target, F.slice(F.array_sort(state), 1, 1))


def _advance(state: Column, part, limit: Column, lookup) -> Column:
    """Ends reachable after ``part`` from the ends in ``state``."""

    def holds(pred: Pred, pos: Column) -> Column:
        return pred.at(lambda attr: lookup(attr, pos, None))

    if isinstance(part, One):
        hit = F.filter(state, lambda s: (s["e"] < limit) & holds(part.pred, s["e"]))
        mark = (lambda s: s["e"]) if part.target else (lambda s: s["t"])
        return F.transform(hit, lambda s: F.struct((s["e"] + 1).alias("e"), mark(s).alias("t")))
    if isinstance(part, Look):
        return F.filter(state, lambda s: (s["e"] < limit) & holds(part.pred, s["e"]))
    if isinstance(part, Gap):
        return _spread(state, part.least, part.most, lambda s: limit)
    if isinstance(part, Rep):

        def stop(s: Column) -> Column:
            last = limit if part.most is None else F.least(limit, s["e"] + part.most)
            run = F.when(s["e"] < last, F.sequence(s["e"], last - 1)).otherwise(F.array().cast("array<int>"))
            return F.coalesce(F.array_min(F.filter(run, lambda j: ~holds(part.pred, j))), last)

        return _spread(state, part.least, part.most, stop)
    if isinstance(part, Alt):
        results = []
        for option in part.options:
            branch = state
            for p in option.parts:
                branch = _advance(branch, p, limit, lookup)
            results.append(branch)
        return F.array_distinct(F.concat(*results))
    raise TypeError(f"not a pattern part: {part!r}")


def _spread(state: Column, least: int, most: int | None, stop: Callable[[Column], Column]) -> Column:
    """From each end e to every end in [e+least, min(e+most, stop(e))]."""
    reach = F.transform(
        state,
        lambda s: F.struct(
            (s["e"] + least).alias("lo"),
            (stop(s) if most is None else F.least(stop(s), s["e"] + most)).alias("hi"),
            s["t"].alias("t"),
        ),
    )
    reach = F.filter(reach, lambda r: r["lo"] <= r["hi"])
    ends = F.transform(
        reach,
        lambda r: F.transform(
            F.sequence(r["lo"], r["hi"]), lambda e: F.struct(e.alias("e"), r["t"].alias("t"))
        ),
    )
    return F.array_distinct(F.flatten(ends))
