"""Search plans: a model becomes a chain of generators and filters over the rows of a sequence table.

A row of the plan is a partial hit: the sequence's residues, the position reached so far and the places of the pieces laid.
Each helix is one generator over its lengths and enclosed distances (both small literal ranges) that emits only placements
all of whose pairs hold; free runs shift the position; a helix's close demands that its inside was filled exactly. So the
plan needs no join and no shuffle. Sequences are first cut into windows that overlap by the longest match, each of which
finds the hits that begin in its own part: rows stay small however long a sequence is, and one sequence spreads over tasks.
The join form of the same step, for tables of helices that exist already, is in operators.helices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldquery.functions.nucleotides import codes
from foldquery.plans.cssd import Model, Token, parse

HIT = "hit"
#: The bitwise or of two residues' codes that pair: gc, au, gu.
PAIRED = "(6, 9, 12)"
#: Up to so many placements of a helix at one position are spelled out.
UNROLLED = 40


def _paired(i: str, j: str) -> str:
    """Do the residues at the 1-based positions i and j pair?"""
    return f"(get(b, {i} - 1) | get(b, {j} - 1)) in {PAIRED}"


def stack_holds(fp: str, last: str, length: str) -> str:
    """Do fp.., and last.. backwards, pair over length?"""
    return f"({length} = 0 or forall(sequence(0, greatest({length} - 1, 0)), r -> {_paired(f'({fp} + r)', f'({last} - r)')}))"


def _placements(low: int, high: int, near: int, far: int, optional: bool) -> str:
    """All placements of a helix that starts at cur: array of (len, tp), tp being the innermost 3' residue."""
    low = max(1, low)
    parts = []
    if high >= low and (high - low + 1) * (far - near + 1) <= UNROLLED:
        # few enough to spell out: plain conditions are compiled, lambdas are interpreted
        each = []
        for n in range(low, high + 1):
            for d in range(near, far + 1):
                last = f"(cur + {2 * n + d - 1})"
                holds = " and ".join(_paired(f"(cur + {r})", f"({last} - {r})") for r in range(n))
                each.append(f"if({last} <= size(b) and {holds}, named_struct('len', {n}, 'tp', cur + {n + d}), null)")
        parts.append(f"array_compact(array({', '.join(each)}))")
    elif high >= low:
        span = f"sequence({near}, least({far}, size(b) - cur + 1 - 2 * l))"
        holds = stack_holds("cur", "(cur + 2 * l + d - 1)", "l")
        lengths = f"filter(sequence({low}, {high}), l -> cur + 2 * l + {near} - 1 <= size(b))"
        parts.append(f"flatten(transform({lengths}, l -> transform(filter({span}, d -> {holds}), d -> named_struct('len', l, 'tp', cur + l + d))))")
    if optional:
        parts.append("array(named_struct('len', 0, 'tp', cast(null as int)))")
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def _steps(model: Model) -> list[Token]:
    """The tokens that matter: free runs at either end need no room, neighbouring free runs are one."""
    tokens = list(model.tokens)
    while tokens and tokens[0].kind == "free":
        tokens.pop(0)
    while tokens and tokens[-1].kind == "free":
        tokens.pop()
    out: list[Token] = []
    for t in tokens:
        if t.kind == "free" and out and out[-1].kind == "free":
            out[-1] = Token("free", -1, out[-1].low + t.low, out[-1].high + t.high, out[-1].symbol)
        else:
            out.append(t)
    return out


def _enclosable(model: Model, ref: int) -> str:
    """Could the helix `ref`, if it were there, enclose each helix that stands directly in it?

    Known results ask this of helices that a hit leaves out, too: the helices inside of an absent one must leave room for a
    pairing placement of it.
    """
    a = next(i for i, t in enumerate(model.tokens) if t.kind == "open" and t.ref == ref)
    b = next(i for i, t in enumerate(model.tokens) if t.kind == "close" and t.ref == ref)
    reach = lambda part: tuple(map(sum, zip(*[(0, 0), *map(model._reach, part)], strict=True)))
    out, depth = [], 0
    for i in range(a + 1, b):
        t = model.tokens[i]
        if t.kind == "open" and depth == 0:
            end = next(j for j in range(i, b) if model.tokens[j].kind == "close" and model.tokens[j].ref == t.ref)
            (lead, lead_far), (tail, tail_far) = reach(model.tokens[a + 1 : i]), reach(model.tokens[end + 1 : b])
            c, high = t.ref, model.helices[ref].high
            fp, last = f"fp{c} - x - l", f"tp{c} + len{c} - 1 + y + l"
            fits = f"{fp} >= 1 and {last} <= size(b) and {stack_holds(f'({fp})', f'({last})', 'l')}"
            out.append(f"(len{c} = 0 or exists(sequence(1, {high}), l -> exists(sequence({lead}, {lead_far}), x -> exists(sequence({tail}, {tail_far}), y -> {fits}))))")
        depth += (t.kind == "open") - (t.kind == "close")
    return " and ".join(out) or "true"


def _triple(p5: str, p3: str, single: str) -> str:
    """c.g.c, u.g.c or u.a.u, counted from the pair's strand that is nearer to the start unless the single comes before."""
    ok = lambda x, y: f"(get(b, {x} - 1) * 100 + get(b, {y} - 1) * 10 + get(b, {single} - 1)) in (242, 842, 818)"
    return f"if({single} < {p5}, {ok(p3, p5)}, {ok(p5, p3)})"


def windows(sequences: DataFrame, span: int, margin: int = 0, step: int | None = None, id_col: str = "seq_id", nt_col: str = "nt") -> DataFrame:
    """(id, b, off, cur): residue codes of a window, what to add to its positions, and each position of its own part.

    A window holds `step` positions of its own, `margin` before them and `span` - 1 after; it ends with the sequence.
    """
    step = step or min(512, max(64, 2 * (span + margin)))  # each position's row carries its window
    cut = f"""transform(sequence(0, (size(a) - 1) div {step}), k -> named_struct('left', least({margin}, k * {step}), 'k', k))"""
    part = f"""transform({cut}, x -> named_struct('b', slice(a, x.k * {step} - x.left + 1, x.left + {step} + {max(0, span - 1)}), 'off', cast(x.k * {step} - x.left as int), 'left', cast(x.left as int)))"""
    df = sequences.select(F.col(id_col), codes(F.col(nt_col)).alias("a"))
    df = df.select(id_col, F.explode(F.expr(f"if(size(a) > 0, {part}, array())")).alias("w")).select(id_col, "w.b", "w.off", "w.left")
    return df.select(id_col, "b", "off", F.explode(F.expr(f"sequence(left + 1, least(left + {step}, size(b)))")).alias("cur"))


def search(sequences: DataFrame, model: Model | tuple[str, str] | str, id_col: str = "seq_id", nt_col: str = "nt", context: int | None = None) -> DataFrame:
    """Every placement of the pattern in every sequence.

    Columns: the id, fp and tp of the outermost pair (0, 0 where nothing encloses the start), position (the first residue
    of a helix or constraint), end_position, chain (array of el, fp, tp, len by helix; an absent helix is left out) and
    constraints (array of constraint, role, start, len). Null sequences have no hits; residues other than acgu pair with none.
    With context, also around (the hit's residues and up to so many on either side, n for others than acgu) and
    around_start (the place of its first); they come from the hit's window, so nobody has to join sequences to hits.

    The rows of `sequences` stay in the tasks that read them. Where a few tasks read many short sequences, spread them first
    (sources.files.spread); long ones are cut into windows anyway.
    """
    if not isinstance(model, Model):
        model = parse(*((model, "") if isinstance(model, str) else model))
    steps = _steps(model)
    reach = [model._reach(t)[1] for t in steps]
    margin = sum(reach) if any(h.low == 0 for h in model.helices) else 0
    df = windows(sequences, sum(reach) + margin + (context or 0), margin + (context or 0), id_col=id_col, nt_col=nt_col)
    optional = False
    laid: set[str] = set()
    first = True
    for n, t in enumerate(steps):
        if t.kind == "open":
            h = model.helices[t.ref]
            skip = h.low == 0 and not first
            optional |= skip
            near, far = model.spans[t.ref]
            if h.low == h.high and near == far:
                last = f"(cur + {2 * h.low + near - 1})"
                df = df.where(f"cur + {2 * h.low + near - 1} <= size(b) and " + " and ".join(_paired(f"(cur + {r})", f"({last} - {r})") for r in range(h.low)))
                df = df.withColumns({f"fp{t.ref}": F.col("cur"), f"tp{t.ref}": F.expr(f"cur + {h.low + near}"), f"len{t.ref}": F.lit(h.low), "cur": F.expr(f"cur + {h.low}")})
                first = False
                continue
            df = df.withColumn("g", F.explode(F.expr(_placements(h.low, h.high, near, far, skip))))
            df = df.withColumns({f"fp{t.ref}": F.col("cur"), f"tp{t.ref}": F.col("g.tp"), f"len{t.ref}": F.col("g.len"), "cur": F.expr("cur + g.len")}).drop("g")
        elif t.kind == "close":
            absent = _enclosable(model, t.ref) if model.helices[t.ref].low == 0 else "true"
            df = df.where(f"if(tp{t.ref} is null, {absent}, cur = tp{t.ref})").withColumn("cur", F.expr(f"cur + len{t.ref}"))
        elif t.kind == "free":
            after = steps[n + 1]
            if after.kind == "close" and model.helices[after.ref].low > 0:
                df = df.where(f"tp{after.ref} - cur between {t.low} and {t.high}").withColumn("cur", F.col(f"tp{after.ref}"))
            elif t.low == t.high:
                df = df.withColumn("cur", F.expr(f"cur + {t.low}"))
            else:
                df = df.withColumn("g", F.explode(F.expr(f"sequence({t.low}, {t.high})"))).withColumn("cur", F.expr("cur + g")).drop("g")
        elif t.kind == "knot5":
            c = model.constraints[t.ref]
            optional |= c.low == 0
            df = df.withColumns({f"k{t.ref}_5": F.col("cur"), f"k{t.ref}_n": F.explode(F.expr(f"sequence({c.low}, {c.high})")) if c.low < c.high else F.lit(c.low)})
            df = df.withColumn("cur", F.expr(f"cur + k{t.ref}_n"))
        elif t.kind == "knot3":
            k = t.ref
            df = df.withColumn(f"k{k}_3", F.col("cur")).withColumn("cur", F.expr(f"cur + k{k}_n")).where("cur - 1 <= size(b)")
            df = df.where(stack_holds(f"k{k}_5", "(cur - 1)", f"k{k}_n"))
        else:
            df = df.withColumn(t.kind, F.col("cur")).withColumn("cur", F.expr("cur + 1"))
            laid.add(t.kind)
            if len(laid) == 3:
                df = df.where("cur - 1 <= size(b)").where(_triple("triple5", "triple3", "single"))
        if n == len(steps) - 1:
            df = df.where("cur - 1 <= size(b)")
        first = False
    pair = lambda h: f"if(len{h} > 0, array(named_struct('el', {h}, 'fp', fp{h} + off, 'tp', tp{h} + off, 'len', len{h})), array())"
    hs = [t.ref for t in steps if t.kind == "open"]
    chain = f"concat({', '.join(map(pair, hs))})" if hs else "cast(array() as array<struct<el:int,fp:int,tp:int,len:int>>)"
    parts = [(t, f"named_struct('constraint', {t.ref}, 'role', '{r}', 'start', {s} + off, 'len', {n})") for t in steps if (x := _part(t)) for r, s, n in [x]]
    constraints = f"array({', '.join(p for _, p in parts)})" if parts else "cast(array() as array<struct<constraint:int,role:string,start:int,len:int>>)"
    df = df.withColumn("chain", F.expr(chain)).withColumn("constraints", F.expr(constraints))
    starts = "concat(transform(chain, x -> x.fp), transform(filter(constraints, x -> x.len > 0), x -> x.start))"
    ends = "concat(transform(chain, x -> x.tp + x.len - 1), transform(filter(constraints, x -> x.len > 0), x -> x.start + x.len - 1))"
    outer = [F.lit(0), F.lit(0)] if model.wrapped else [F.expr(f"fp{hs[0]} + off"), F.expr(f"tp{hs[0]} + off")]
    out = df.select(id_col, outer[0].alias("fp"), outer[1].alias("tp"), F.expr(f"array_min({starts})").alias("position"), F.expr(f"array_max({ends})").alias("end_position"), "chain", "constraints", *(["b", "off"] if context is not None else []))
    if context is not None:
        out = out.withColumn("around_start", F.expr(f"greatest(position - off - {context}, 1)"))
        letters = "array_join(transform(slice(b, around_start, end_position - off + {0} - around_start + 1), x -> case x when 1 then 'a' when 2 then 'c' when 4 then 'g' when 8 then 'u' else 'n' end), '')".format(context)
        out = out.withColumn("around", F.expr(letters)).withColumn("around_start", F.expr("around_start + off")).drop("b", "off")
    return out.distinct() if optional else out


def _part(t: Token) -> tuple[str, str, str] | None:
    if t.kind in ("knot5", "knot3"):
        return ("fp" if t.kind == "knot5" else "tp"), f"k{t.ref}_{t.kind[-1]}", f"k{t.ref}_n"
    return {"triple5": ("fp", "triple5", "1"), "triple3": ("tp", "triple3", "1"), "single": ("single", "single", "1")}.get(t.kind)


def hit_counts(hits: DataFrame, id_col: str = "seq_id") -> DataFrame:
    return hits.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_hits"))
