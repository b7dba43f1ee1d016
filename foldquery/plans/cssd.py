"""The pattern language: two lines, a bracket string and its positional variables, read into a Model.

A run of n equal symbols is n long; if a variable v stands on it, n - 1 to n - 1 + v long: the marked position stands for
0 to v residues. Helices are the longest stacks of pairs that follow each other without a gap on both strands.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import prod

MAX_LENGTH, MAX_VARIABLE = 200, 25
FREE = "_,-:"
PAIRS = {"<": ">", "(": ")"}
KNOTS = {"[": "]", "{": "}"}
TRIPLE, SINGLE = "~", "."
_CLOSING = {v: k for k, v in (PAIRS | KNOTS).items()}


class PatternError(ValueError):
    """The pattern is refused; the text says why."""


def variable(symbol: str) -> int:
    """1 to 9, then a to p for 10 to 25; 0 for a blank; -1 for anything else."""
    if symbol == " ":
        return 0
    if symbol.isdigit():
        return int(symbol) or -1
    return ord(symbol) - ord("a") + 10 if "a" <= symbol <= "p" else -1


def variable_symbol(v: int) -> str:
    return " " if not v else str(v) if v < 10 else chr(ord("a") + v - 10)


@dataclass(frozen=True)
class Token:
    """A piece of the pattern from left to right. kind: open, close, free, knot5, knot3, triple5, triple3 or single."""

    kind: str
    ref: int = -1  # helix or constraint number
    low: int = 1
    high: int = 1
    symbol: str = ""


@dataclass(frozen=True)
class Helix:
    low: int
    high: int
    symbol: str


@dataclass(frozen=True)
class Constraint:
    kind: str  # pseudoknot or base_triple
    low: int
    high: int
    symbol: str


@dataclass
class Model:
    tokens: list[Token]
    helices: list[Helix]
    constraints: list[Constraint]
    ss: str
    pos_var: str
    spans: dict[int, tuple[int, int]] = field(default_factory=dict)  # distance enclosed by each helix

    @property
    def wrapped(self) -> bool:
        """Nothing encloses the start: the hit's first pair is the empty (0, 0)."""
        return not self.tokens or self.tokens[0].kind != "open"

    def size(self) -> int:
        """How many choices of lengths there are."""
        ways = [t.high - t.low + 1 for t in self.tokens if t.kind == "free"]
        return prod(ways + [x.high - x.low + 1 for x in [*self.helices, *self.constraints]])

    def length(self) -> tuple[int, int]:
        """The least and greatest number of residues."""
        lows, highs = zip(*[(0, 0), *(self._reach(t) for t in self.tokens)], strict=True)
        return sum(lows), sum(highs)

    def _reach(self, t: Token) -> tuple[int, int]:
        if t.kind in ("open", "close"):
            return self.helices[t.ref].low, self.helices[t.ref].high
        if t.kind in ("knot5", "knot3"):
            return self.constraints[t.ref].low, self.constraints[t.ref].high
        return t.low, t.high

    def measure(self) -> Model:
        """Fills in spans: for each helix the least and greatest number of residues that it encloses."""
        for h in range(len(self.helices)):
            a = next(i for i, t in enumerate(self.tokens) if t.kind == "open" and t.ref == h)
            b = next(i for i, t in enumerate(self.tokens) if t.kind == "close" and t.ref == h)
            inside = [self._reach(t) for t in self.tokens[a + 1 : b]]
            self.spans[h] = sum(x for x, _ in inside), sum(y for _, y in inside)
        return self

    def largest(self) -> int:
        """The helix with the greatest least length, the first of them; -1 if there is none."""
        return max(range(len(self.helices)), key=lambda h: (self.helices[h].low, -h), default=-1)

    def limits(self) -> dict[str, tuple[int, int]]:
        """What stands before, inside and after the largest helix, as ranges of residues."""
        h = self.largest()
        if h < 0:
            return {}
        a = next(i for i, t in enumerate(self.tokens) if t.kind == "open" and t.ref == h)
        b = next(i for i, t in enumerate(self.tokens) if t.kind == "close" and t.ref == h)
        total = lambda part: tuple(map(sum, zip(*[(0, 0), *map(self._reach, part)], strict=True)))
        return {"helix": (self.helices[h].low, self.helices[h].high), "lead": total(self.tokens[:a]), "enclosed": self.spans[h], "trail": total(self.tokens[b + 1 :])}

    def variable_range(self, t: Token) -> int:
        """How much longer than its least a piece can be."""
        low, high = self._reach(t)
        return high - low

    def contained(self) -> list[tuple[int, int, int, int]]:
        """(outer helix, inner helix, least, greatest distance between their 5' strands) for helices directly in one another."""
        out, open_ = [], []
        for i, t in enumerate(self.tokens):
            if t.kind == "open":
                if open_:
                    ranges = [self._reach(x) for x in self.tokens[open_[-1][1] + 1 : i]]
                    out.append((open_[-1][0], t.ref, sum(r[0] for r in ranges), sum(r[1] for r in ranges)))
                open_.append((t.ref, i))
            elif t.kind == "close":
                open_.pop()
        return out

    def partitions(self, most: int = 10_000_000) -> list[dict[int, int]]:
        """Choices of fixed lengths (token number to length) that together cover the model, each leaving at most `most` ways.

        The free run with the widest range is fixed first.
        """
        free = {i: t for i, t in enumerate(self.tokens) if t.kind == "free" and t.high > t.low}
        pinned, size = [], self.size()
        while size > most and free:
            i = max(free, key=lambda k: (free[k].high - free[k].low, -k))
            t = free.pop(i)
            pinned.append((i, t))
            size //= t.high - t.low + 1
        out: list[dict[int, int]] = [{}]
        for i, t in pinned:
            out = [{**d, i: n} for d in out for n in range(t.low, t.high + 1)]
        return out

    def unparse(self) -> tuple[str, str]:
        """The pattern again, as written but for variables being put first in their run."""
        ss, var = [], []
        opened = {i for i, t in enumerate(self.tokens) if t.kind in ("free", "open", "knot5")}
        for i, t in enumerate(self.tokens):
            low, high = self._reach(t)
            free = high > low
            n = low + 1 if free else low
            ss.append(t.symbol * n)
            var.append((variable_symbol(high - low) if free and i in opened else " ").ljust(n) if n else "")
        return "".join(ss), "".join(var).rstrip()


def stacks(ss: str) -> list[tuple[int, int]]:
    """The helices' pairs (0-based), checked for balance by the caller."""
    found, waiting = [], {s: [] for s in PAIRS}
    for i, c in enumerate(ss):
        if c in PAIRS:
            waiting[c].append(i)
        elif _CLOSING.get(c) in PAIRS:
            found.append((waiting[_CLOSING[c]].pop(), i))
    return sorted(found)


def _run_variable(pos_var: str, places: list[int]) -> int:
    return next((v for p in places if (v := variable(pos_var[p]))), 0)


def _bounds(n: int, v: int) -> tuple[int, int]:
    return (n - 1, n - 1 + v) if v else (n, n)


def parse(ss: str, pos_var: str = "") -> Model:
    """The model of a valid pattern; PatternError otherwise."""
    if error := validate(ss, pos_var):
        raise PatternError(error)
    pos_var = pos_var.ljust(len(ss))[: len(ss)]
    helices: list[Helix] = []
    owner: dict[int, int] = {}
    last: tuple[int, int, str] | None = None
    members: list[list[int]] = []
    for i, j in stacks(ss):
        if last is not None and (i - 1, j + 1, ss[i]) == last:
            members[-1].append(i)
        else:
            members.append([i])
        owner[i] = owner[j] = len(members) - 1
        last = (i, j, ss[i])
    for places in members:
        low, high = _bounds(len(places), _run_variable(pos_var, places))
        helices.append(Helix(low, high, ss[places[0]]))
    constraints: list[Constraint] = []
    knots: dict[str, int] = {}
    for s in KNOTS:
        places = [i for i, c in enumerate(ss) if c == s]
        if places:
            knots[s] = len(constraints)
            constraints.append(Constraint("pseudoknot", *_bounds(len(places), _run_variable(pos_var, places)), s))
    triple = -1
    if SINGLE in ss:
        triple = len(constraints)
        constraints.append(Constraint("base_triple", 1, 1, SINGLE))
    tokens: list[Token] = []
    at, tildes = 0, 0
    while at < len(ss):
        c, end = ss[at], at + 1
        if c in FREE:
            while end < len(ss) and ss[end] == c:
                end += 1
            tokens.append(Token("free", -1, *_bounds(end - at, _run_variable(pos_var, list(range(at, end)))), c))
        elif c in KNOTS or _CLOSING.get(c) in KNOTS:
            while end < len(ss) and ss[end] == c:
                end += 1
            k = knots[_CLOSING.get(c, c)]
            tokens.append(Token("knot5" if c in KNOTS else "knot3", k, constraints[k].low, constraints[k].high, c))
        elif c == TRIPLE:
            tildes += 1
            tokens.append(Token("triple5" if tildes == 1 else "triple3", triple, 1, 1, c))
        elif c == SINGLE:
            tokens.append(Token("single", triple, 1, 1, c))
        else:
            while end < len(ss) and owner.get(end) == owner[at] and ss[end] == c:
                end += 1
            h = owner[at]
            tokens.append(Token("open" if c in PAIRS else "close", h, helices[h].low, helices[h].high, c))
        at = end
    return Model(tokens, helices, constraints, ss, pos_var.rstrip()).measure()


def close_position(ss: str, place: int) -> int:
    """Where the bracket at a 0-based place closes; -1 for one that doesn't open or never closes."""
    pair = PAIRS | KNOTS
    if not 0 <= place < len(ss) or ss[place] not in pair:
        return -1
    depth = 0
    for i in range(place, len(ss)):
        depth += (ss[i] == ss[place]) - (ss[i] == pair[ss[place]])
        if not depth:
            return i
    return -1


def symbols_match(a: str, b: str) -> bool:
    """Are two bracket strings the same but for the kinds of their free residues and the brackets of stems and junctions?"""
    plain = str.maketrans("()_,:", "<>---")
    return a.translate(plain) == b.translate(plain)


def split(cssd: str) -> tuple[str, str]:
    """A stored pattern at its first line break."""
    ss, _, pos_var = cssd.partition("\n")
    return ss, pos_var


def join(ss: str, pos_var: str) -> str:
    return f"{ss}\n{pos_var}"


def _balance(ss: str, opened: str, closed: str) -> str | None:
    depth = 0
    for c in ss:
        depth += (c == opened) - (c == closed)
        if depth < 0:
            return f"{opened} and {closed} don't balance"
    return f"{opened} and {closed} don't balance" if depth else None


def validate(ss: str, pos_var: str = "") -> str | None:
    """Why a pattern is refused, or None. Checks go from symbols and balance to context and variables."""
    if not ss:
        return "the pattern is empty"
    if len(ss) > MAX_LENGTH:
        return f"the pattern is longer than {MAX_LENGTH} symbols"
    if pos_var[len(ss) :].strip():
        return "variables stand past the end of the pattern"
    pos_var = pos_var.ljust(len(ss))[: len(ss)]
    for i, c in enumerate(pos_var, 1):
        if variable(c) < 0:
            return f"place {i}: {c} is no variable"
    if (ss.count(TRIPLE), ss.count(SINGLE)) not in ((0, 0), (2, 1)):
        return "a triple needs two ~ and one ."
    for s in ("(", "<"):
        if error := _balance(ss, s, PAIRS[s]):
            return error
    for s, e in KNOTS.items():
        if ss.count(s) != ss.count(e):
            return f"there are not as many {s} as {e}"
        if s in ss:
            if ss.index(e) < ss.rindex(s):
                return f"{e} comes before {s}"
            if any(x * ss.count(x) not in ss for x in (s, e)):
                return f"{s} or {e} stands in more than one run"
    return _context(ss) or _variables(ss, pos_var)


def _context(ss: str) -> str | None:
    partner = {}
    for i, j in stacks(ss):
        partner[i], partner[j] = j, i
    brackets = sorted(partner)
    above: list[int] = []  # open brackets
    for i, c in enumerate(ss):
        where = f"place {i + 1}"
        inner = ss[above[-1]] if above else ""
        before = next((ss[k] for k in range(i - 1, -1, -1) if ss[k] in "<>()"), "")
        after = next((ss[k] for k in range(i + 1, len(ss)) if ss[k] in "<>()"), "")
        touching = TRIPLE in ss[max(0, i - 1) : i + 2]
        if c in PAIRS:
            if c == "(" and "<" in {ss[k] for k in above}:
                return f"{where}: a junction can't stand in a stem"
            if c == "(" and inner == "(" and before not in ("(",):
                return f"{where}: a junction can't stand in a junction"
            if c == "<" and inner == "<" and before == ">":
                return f"{where}: a stem can't hold two stems side by side"
            above.append(i)
        elif c in ">)":
            above.pop()
        elif c == ":":
            depth = [k for k in above if ss[k] == "<" or before == "(" == after or before == ")" == after]
            crossed = any(x in ss[: i + 1] for x in "[{") or any(x in ss for x in "[{")
            if depth and not crossed:
                return f"{where}: a free residue can't stand inside a helix"
        elif c == "_":
            if not (before == "<" and after == ">"):
                return f"{where}: _ stands outside of a stem's loop"
        elif c == ",":
            if inner != "(":
                return f"{where}: a comma stands outside of a junction"
        elif c == "-":
            if not (above or touching):
                return f"{where}: - stands outside of a helix"
            if above and not touching and (before, after) not in (("<", "<"), (">", ">"), ("(", "("), (")", ")"), ("(", "<"), (">", ")"), ("<", ">")):
                return f"{where}: - stands outside of a helix"
        elif c not in "[]{}~.":
            return f"{where}: {c} is no symbol"
    del brackets
    return None


def _variables(ss: str, pos_var: str) -> str | None:
    groups: dict[int, tuple] = {}
    last = None
    for n, (i, j) in enumerate(stacks(ss)):
        groups[i] = groups[last[0]] if last is not None and (i - 1, j + 1, ss[i]) == (last[0], last[1], ss[last[0]]) else ("helix", n)
        last = (i, j)
    seen: dict[tuple, int] = {}
    run = 0
    for i, c in enumerate(ss):
        if i and ss[i - 1] != c:
            run += 1
        if pos_var[i] == " ":
            continue
        if c in (TRIPLE, SINGLE):
            return f"place {i + 1}: a triple takes no variable"
        if c in _CLOSING:
            return f"place {i + 1}: the closing side takes no variable"
        key = groups.get(i, ("run", run))
        if key in seen:
            return f"place {i + 1}: the run has a variable already"
        seen[key] = i
    return None
