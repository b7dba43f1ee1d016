"""The engine's operators as registered queries over the driver's tables, each with its SQL where SQL can say it.

Sequences are made from documents: the letters of a whole text, dealt to a, c, g, u. `results` are events (job user_id,
position event_id % 60, energy -value), `jobs` are orders, and `sequences` records are documents without their text.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldquery.functions import energy, nucleotides, render
from foldquery.operators import helices, records, regions, store, strands
from foldquery.plans import cssd
from foldquery.plans.search import _steps, hit_counts, search
from foldquery.sources.files import collection, literal, rna_from_documents

HAIRPIN = ("<<<___>>>", "")
#: Patterns of each kind, as registered.
PATTERNS = {
    "search_hairpin": HAIRPIN,
    "search_variable": ("<<<<____>>>>", "1   1"),
    "search_bulge": ("<<<-<<___>>>>>", ""),
    "search_interior": ("<<<--<<____>>-->>>", "   1          1"),
    "search_junction": ("((((<<<___>>><<<___>>>))))", ""),
    "search_pseudoknot": ("<<<_[[[_>>>:::]]]", ""),
    "search_two_pseudoknots": ("<<{{[[__>>}}::]]", ""),
    "search_triple": ("<~<<___>>~>:.", ""),
    "search_wrapped": (".::((~<<___>>~))", " 1  1"),
    "search_side_by_side": ("<<<___>>>::<<<___>>>", "         1"),
}

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---- what the SQL starts from ---------------------------------------------------------------

RNA = "rna AS (SELECT doc_id AS seq_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'acguacguacguacguacguacguac') AS nt FROM documents)"
POS = f"{RNA}, lists AS (SELECT seq_id, string_split(nt, '') AS b FROM rna WHERE nt <> ''), pos AS (SELECT seq_id, unnest(b) AS c, generate_subscripts(b, 1) AS p FROM lists)"
SEQS = "sequences AS (SELECT doc_id AS _id, 'D' || doc_id AS accession, source AS definition, lang AS grp, doc_id % 5 AS ref_id, n_chars FROM documents)"
RESULTS = "results AS (SELECT event_id AS _id, user_id AS job_id, CAST(event_id % 60 AS INTEGER) AS position, -value AS fe, value AS time, event_type AS hit_string FROM events)"
CANON = "('gc', 'gu', 'au', 'cg', 'ug', 'ua')"


def sequences_of(spark: SparkSession, d: str) -> DataFrame:
    docs = collection(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("_id"), F.concat(F.lit("D"), "doc_id").alias("accession"), F.col("source").alias("definition"), F.col("lang").alias("grp"), F.expr("doc_id % 5").alias("ref_id"), "n_chars")


def results_of(spark: SparkSession, d: str) -> DataFrame:
    e = collection(spark, d, "events")
    return e.select(F.col("event_id").alias("_id"), F.col("user_id").alias("job_id"), F.expr("cast(event_id % 60 as int)").alias("position"), (-F.col("value")).alias("fe"), F.col("value").alias("time"), F.col("event_type").alias("hit_string"))


def told(hits: DataFrame) -> DataFrame:
    """Hits with their chain and constraints as text."""
    parts = F.array_join(F.transform("constraints", lambda s: F.concat(s["role"], F.lit(":"), s["start"].cast("string"), F.lit("("), s["len"].cast("string"), F.lit(")"))), " ")
    return hits.select("seq_id", "fp", "tp", "position", "end_position", render.hit_dump().alias("chain"), parts.alias("constraints"))


def variants_sql(ss: str, pos_var: str) -> str:
    """The hits of a pattern without absent helices: each choice of lengths spelled out as residues at fixed distances."""
    model = cssd.parse(ss, pos_var)
    steps = _steps(model)
    free = [i for i, t in enumerate(steps) if t.kind == "free"]
    ways = [range(steps[i].low, steps[i].high + 1) for i in free]
    ways += [range(h.low, h.high + 1) for h in model.helices] + [range(c.low, c.high + 1) for c in model.constraints]
    selects, deepest = [], 0
    for choice in product(*ways):
        frees = dict(zip(free, choice, strict=False))
        hel = choice[len(free) : len(free) + len(model.helices)]
        con = choice[len(free) + len(model.helices) :]
        at, start, close, strands = 0, {}, {}, []
        for i, t in enumerate(steps):
            n = frees[i] if t.kind == "free" else hel[t.ref] if t.kind in ("open", "close") else con[t.ref]
            if t.kind == "open":
                start[t.ref] = at
            elif t.kind == "close":
                close[t.ref] = at
            elif t.kind != "free":
                strands.append((t.kind, t.ref, at, n))
            at += n
        pairs = [(start[h] + r, close[h] + n - 1 - r) for h, n in enumerate(hel) for r in range(n)]
        for k, c in enumerate(model.constraints):
            own = {kind: (s, n) for kind, ref, s, n in strands if ref == k}
            if c.kind == "pseudoknot":
                (a, n), (b, _) = own["knot5"], own["knot3"]
                pairs += [(a + r, b + n - 1 - r) for r in range(n)]
        where = [f"c{i} || c{j} IN {CANON}" for i, j in pairs]
        triple = {kind: s for kind, _, s, _ in strands if not kind.startswith("knot")}
        if triple:
            a, b = ("triple5", "triple3") if triple["single"] > triple["triple5"] else ("triple3", "triple5")
            where.append(f"c{triple[a]} || c{triple[b]} || c{triple['single']} IN ('cgc', 'ugc', 'uau')")
        deepest = max(deepest, at - 1)
        chain = " || ' -> ' || ".join(f"(p + {start[t.ref]}) || ',' || (p + {close[t.ref]}) || '({hel[t.ref]})'" for t in steps if t.kind == "open") or "''"
        role = {"knot5": "fp", "knot3": "tp", "triple5": "fp", "triple3": "tp", "single": "single"}
        parts = " || ' ' || ".join(f"'{role[kind]}:' || (p + {s}) || '({n})'" for kind, _, s, n in strands) or "''"
        first = next((t.ref for t in steps if t.kind == "open"), None)
        outer = "0 AS fp, 0 AS tp" if model.wrapped else f"p + {start[first]} AS fp, p + {close[first]} AS tp"
        selects.append(f"SELECT seq_id, {outer}, p AS position, p + {at - 1} AS end_position, {chain} AS chain, {parts} AS constraints FROM w WHERE {' AND '.join(where)} AND c{at - 1} IS NOT NULL")
    leads = ", ".join(f"lead(c, {k}) OVER s AS c{k}" for k in range(1, deepest + 1))
    ints = "seq_id, CAST(fp AS INTEGER) AS fp, CAST(tp AS INTEGER) AS tp, CAST(position AS INTEGER) AS position, CAST(end_position AS INTEGER) AS end_position, chain, constraints"
    return f"WITH {POS}, w AS MATERIALIZED (SELECT seq_id, p, c AS c0, {leads} FROM pos WINDOW s AS (PARTITION BY seq_id ORDER BY p)) SELECT {ints} FROM ({' UNION ALL '.join(selects)})"


def _register_searches() -> None:
    for name, pattern in PATTERNS.items():
        query(name, variants_sql(*pattern))(lambda spark, d, p=pattern: told(search(rna_from_documents(spark, d), p)))


_register_searches()


@query("hairpin_counts", f"SELECT seq_id, count(*) AS n_hits FROM ({variants_sql(*HAIRPIN)}) GROUP BY seq_id")
def hairpin_counts(spark, d):
    return hit_counts(search(rna_from_documents(spark, d), HAIRPIN))


def _optional_sql() -> str:
    """With the pair: stem of four around three, two free, a pair around one free, a stem of three around four, one free.
    Without it the same residues but for the pair's first; it must still be able to form around the free ones."""
    stem = [(r, 10 - r) for r in range(4)]
    there = [*stem, (13, 26), *((15 + r, 24 - r) for r in range(3))]
    absent = [*stem, *((14 + r, 23 - r) for r in range(3)), (12, 25)]
    select = lambda pairs, end, chain: f"SELECT seq_id, p AS fp, p + 7 AS tp, p AS position, p + {end} AS end_position, (p || ',' || (p + 7) || '(4)'{chain}) AS chain, '' AS constraints FROM w WHERE " + " AND ".join(f"c{i} || c{j} IN {CANON}" for i, j in pairs)
    one = select(there, 26, " || ' -> ' || (p + 13) || ',' || (p + 26) || '(1)' || ' -> ' || (p + 15) || ',' || (p + 22) || '(3)'")
    none = select(absent, 23, " || ' -> ' || (p + 14) || ',' || (p + 21) || '(3)'")
    leads = ", ".join(f"lead(c, {k}) OVER s AS c{k}" for k in range(1, 27))
    ints = "seq_id, CAST(fp AS INTEGER) AS fp, CAST(tp AS INTEGER) AS tp, CAST(position AS INTEGER) AS position, CAST(end_position AS INTEGER) AS end_position, chain, constraints"
    return f"WITH {POS}, w AS MATERIALIZED (SELECT seq_id, p, c AS c0, {leads} FROM pos WINDOW s AS (PARTITION BY seq_id ORDER BY p)) SELECT {ints} FROM ({one} UNION ALL {none})"


@query("search_optional_helix", _optional_sql())
def search_optional_helix(spark, d):
    """A helix of no or one pair around a stem: hits with and without it."""
    return told(search(rna_from_documents(spark, d), ("<<<<___>>>>::<-<<<____>>>->", "             1")))


# ---- scans, projections, sinks ----------------------------------------------------------------


@query("scan_seq_literal", "SELECT * FROM (VALUES (0, 'gggaaaccc'), (1, 'acgu')) t(seq_id, nt)")
def scan_seq_literal(spark, d):
    return literal(spark, "GGG AAA CCC 9", "acgt").withColumn("seq_id", F.col("seq_id").cast("int"))


@query("scan_collection", f"WITH {SEQS} SELECT _id, accession, definition, grp, ref_id FROM sequences")
def scan_collection(spark, d):
    return sequences_of(spark, d).drop("n_chars")


@query("scan_window", f"WITH {RNA} SELECT seq_id, k * 200 + 1 AS start, substr(nt, CAST(k * 200 + 1 AS INTEGER), 250) AS nt FROM (SELECT *, unnest(range(0, (length(nt) - 1) // 200 + 1)) AS k FROM rna WHERE length(nt) > 0)")
def scan_window(spark, d):
    return regions.segments(rna_from_documents(spark, d), 200, 50).withColumn("start", F.col("start").cast("long"))


@query("sink_json", f"""WITH {SEQS} SELECT _id, '{{"_id":"' || _id || '","accession":"' || accession || '","grp":"' || grp || '"}}' AS json FROM sequences""")
def sink_json(spark, d):
    df = sequences_of(spark, d).select("_id", "accession", "grp")
    return df.select("_id", store.to_json_rows(df).alias("json"))


@query("sink_hit_line", f"WITH {RESULTS} SELECT _id, job_id || chr(9) || position || chr(9) || format('{{:.5f}}', fe) || chr(9) || hit_string AS line FROM results")
def sink_hit_line(spark, d):
    return results_of(spark, d).select("_id", render.hit_line("job_id", "position", "fe", "hit_string").alias("line"))


@query("sink_result", f"WITH {RESULTS} SELECT job_id, position, hit_string, count(*) AS n FROM (SELECT DISTINCT job_id, position, hit_string FROM results) GROUP BY ALL")
def sink_result(spark, d):
    """Hit lines parsed again, one row for each unique key."""
    r = results_of(spark, d).select("job_id", F.concat_ws("\t", F.col("time").cast("string"), F.col("position").cast("string"), F.col("fe").cast("string"), "hit_string").alias("value"))
    return store.parse_results(r).dropDuplicates(["job_id", "position", "hit_string"]).groupBy("job_id", "position", "hit_string").agg(F.count(F.lit(1)).alias("n"))


@query("project_fields", f"WITH {RESULTS} SELECT job_id, position, fe FROM results")
def project_fields(spark, d):
    return records.project(results_of(spark, d), "results")


@query("merge_objects", "SELECT o_orderkey, o_custkey, c_name, c_nationkey, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey")
def merge_objects(spark, d):
    jobs = collection(spark, d, "orders").select("o_orderkey", F.col("o_custkey"), F.col("o_orderstatus").alias("status"))
    side = collection(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey", F.lit("side").alias("status"))
    return store.lookup(jobs, side, "o_custkey")


@query("cssd_join_split", "SELECT p_partkey, p_name || chr(10) || p_brand AS cs, p_name AS ss, p_brand AS pos_var FROM part")
def cssd_join_split(spark, d):
    df = collection(spark, d, "part").select("p_partkey", nucleotides.cssd_join("p_name", "p_brand").alias("cs"))
    ss, pos_var = nucleotides.cssd_split("cs")
    return df.select("p_partkey", "cs", ss.alias("ss"), pos_var.alias("pos_var"))


@query("substr", "SELECT doc_id, substr(text, 5, 12) AS part FROM documents")
def substr(spark, d):
    return collection(spark, d, "documents").select("doc_id", nucleotides.substr(F.col("text"), 4, 12).alias("part"))


@query("oid_convert", "SELECT doc_id, lpad(to_hex(doc_id), 24, '0') AS oid, doc_id AS back FROM documents")
def oid_convert(spark, d):
    return collection(spark, d, "documents").select("doc_id", records.hex_id(F.col("doc_id")).alias("oid")).withColumn("back", records.decimal_id(F.col("oid")))


@query("seq_normalize", "SELECT doc_id, translate(lower(regexp_replace(text, '[ \\t\\n\\r\\f\\v0-9]+', '', 'g')), 't', 'u') AS nt FROM documents")
def seq_normalize(spark, d):
    return collection(spark, d, "documents").select("doc_id", nucleotides.normalize(F.col("text")).alias("nt"))


def _crc_sql() -> str:
    """CRC-32 by its definition: a table of 256 remainders, then a byte at a time."""
    bit = "CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END"
    rounds = "SELECT k, k AS r FROM range(0, 256) t(k)"
    for _ in range(8):
        rounds = f"SELECT k, {bit} AS r FROM ({rounds})"
    step = "lambda a, b: xor(a >> 8, rem[(xor(a, b) & 255) + 1])"
    return f"WITH {RNA}, rems AS (SELECT list(CAST(r AS BIGINT) ORDER BY k) AS rem FROM ({rounds})) SELECT seq_id, xor(CASE WHEN nt = '' THEN 4294967295 ELSE list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(nt, ''), lambda x: CAST(ascii(x) AS BIGINT))), {step}) END, 4294967295) AS crc FROM rna, rems"


@query("seq_hash", _crc_sql())
def seq_hash(spark, d):
    return rna_from_documents(spark, d).select("seq_id", nucleotides.sequence_hash(F.col("nt")).alias("crc"))


@query("hit_span", f"SELECT h.seq_id, h.position || ' - ' || h.end_position AS span, substr(rna.nt, h.position, h.end_position - h.position + 1) AS matched FROM ({variants_sql(*PATTERNS['search_junction'])}) h JOIN (SELECT doc_id AS seq_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'acguacguacguacguacguacguac') AS nt FROM documents) rna USING (seq_id)")
def hit_span(spark, d):
    """Each hit with its place and the residues there, which come with the hit."""
    hits = search(rna_from_documents(spark, d), PATTERNS["search_junction"], context=0)
    return hits.select("seq_id", F.concat_ws(" - ", F.col("position").cast("string"), F.col("end_position").cast("string")).alias("span"), F.col("around").alias("matched"))


@query("fe_round", f"WITH {RESULTS} SELECT _id, round(fe, 2) AS fe FROM results")
def fe_round(spark, d):
    return results_of(spark, d).select("_id", records.shown_energy("fe").alias("fe"))


@query("stats_clamp", f"WITH {RESULTS} SELECT _id, greatest(least(fe, 5.0), -50.0) AS fe FROM results")
def stats_clamp(spark, d):
    return results_of(spark, d).select("_id", records.plotted_energy("fe").alias("fe"))


# ---- filters -----------------------------------------------------------------------------------


@query("filter_eq", f"WITH {SEQS} SELECT _id, accession FROM sequences WHERE ref_id = 3 AND definition = 'src3'")
def filter_eq(spark, d):
    return records.equal(sequences_of(spark, d), ref_id=3, definition="src3").select("_id", "accession")


@query("filter_seq_text", "SELECT max(d.doc_id) AS _id FROM documents d WHERE d.text = (SELECT text FROM documents ORDER BY doc_id LIMIT 1)")
def filter_seq_text(spark, d):
    """The newest record whose text equals the first record's."""
    docs = collection(spark, d, "documents")
    first = docs.orderBy("doc_id").limit(1).select(F.col("text").alias("wanted"))  # one row
    return store.newest(docs.join(F.broadcast(first), F.col("text") == F.col("wanted"), "left_semi").select(F.col("doc_id").alias("_id")))


@query("filter_cssd_text", "SELECT max(p_partkey) AS _id FROM part WHERE p_brand = 'Brand#13'")
def filter_cssd_text(spark, d):
    return records.newest_equal(collection(spark, d, "part").withColumnRenamed("p_partkey", "_id"), "p_brand", "Brand#13")


@query("filter_published", "SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def filter_published(spark, d):
    return store.published(collection(spark, d, "part").withColumn("published", F.col("p_size") > 25)).select("p_partkey", "p_size")


@query("filter_search_term", f"WITH {SEQS} SELECT _id FROM sequences WHERE contains(upper(accession), 'D1') OR contains(upper(definition), 'D1') OR contains(upper(grp), 'D1')")
def filter_search_term(spark, d):
    return store.search_term(sequences_of(spark, d), "d1", "accession", "definition", "grp").select("_id")


@query("pred_lt_gte", f"WITH {RESULTS} SELECT _id, position, fe FROM results WHERE fe < -20 AND position >= 30 AND hit_string <> ''")
def pred_lt_gte(spark, d):
    return records.between(results_of(spark, d), {"fe": -20}, {"position": 30}).where("hit_string <> ''").select("_id", "position", "fe")


@query("pred_pair", f"WITH {POS} SELECT seq_id, count(*) FILTER (WHERE c || n IN {CANON}) AS n_pairs FROM (SELECT seq_id, c, lead(c) OVER (PARTITION BY seq_id ORDER BY p) AS n FROM pos) GROUP BY seq_id")
def pred_pair(spark, d):
    """How many neighbouring residues could pair, of each sequence."""
    rna = rna_from_documents(spark, d).where("nt <> ''").withColumn("b", nucleotides.codes(F.col("nt")))
    return rna.select("seq_id", F.expr("cast(size(filter(arrays_zip(b, slice(b, 2, size(b))), x -> (x.b | x.`1`) in (6, 9, 12))) as long)").alias("n_pairs"))


@query("pred_triple", "SELECT a, b, c, a || b || c IN ('cgc', 'ugc', 'uau') AS holds, b || a || c IN ('cgc', 'ugc', 'uau') AS holds_before FROM (SELECT unnest(['a','c','g','u']) AS a) CROSS JOIN (SELECT unnest(['a','c','g','u']) AS b) CROSS JOIN (SELECT unnest(['a','c','g','u']) AS c)")
def pred_triple(spark, d):
    """All 64 triples of residues."""
    four = spark.range(64).select(*(F.expr(f"substring('acgu', cast(id div {k} % 4 as int) + 1, 1)").alias(n) for n, k in (("a", 16), ("b", 4), ("c", 1))))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return four.select("a", "b", "c", nucleotides.is_triple(a, b, c, F.lit(False)).alias("holds"), nucleotides.is_triple(a, b, c, F.lit(True)).alias("holds_before"))


@query("valid_sequence", f"WITH {RNA} SELECT seq_id, regexp_matches(nt, '^[acgu]+$') AND length(nt) BETWEEN 5 AND 3000 AS valid FROM rna")
def valid_sequence(spark, d):
    return rna_from_documents(spark, d).select("seq_id", nucleotides.is_sequence(F.col("nt")).alias("valid"))


def _field_sql(col: str, name: str, least: int, most: int, marks: str) -> str:
    marks = marks.replace("'", "''")
    return f"CASE WHEN {col} IS NULL OR length({col}) < {least} THEN '{name} has fewer than {least} characters' WHEN length({col}) > {most} THEN '{name} has more than {most} characters' WHEN NOT regexp_matches({col}, '^[A-Za-z0-9{marks}]*$') THEN '{name} holds an invalid character' END"


@query("valid_fields", f"SELECT doc_id, {_field_sql('text', 'definition', 10, 200, nucleotides.DEFINITION_MARKS)} AS definition_error, {_field_sql('source', 'accession', 3, 20, nucleotides.ACCESSION_MARKS)} AS accession_error, {_field_sql('lang', 'group', 3, 12, nucleotides.GROUP_MARKS)} AS group_error FROM documents")
def valid_fields(spark, d):
    return collection(spark, d, "documents").select("doc_id", nucleotides.definition_error(F.col("text")).alias("definition_error"), nucleotides.accession_error(F.col("source")).alias("accession_error"), nucleotides.group_error(F.col("lang")).alias("group_error"))


#: Patterns with why they are refused, worked out by hand from the rules of the language.
VERDICTS = [
    ("<<<___>>>", None), ("((,,<<<___>>>,<<__>>,))", None), ("<<<_[[[_>>>:::]]]", None), ("<~<<___>>~>:.", None), ("((((,,,,))))", None), ("<<___>", "< and > don't balance"), ("", "the pattern is empty"), ("<<a__>>", "place 3: a is no symbol"),
    ("<~<___>>", "a triple needs two ~ and one ."), ("<<_[[_>>", "there are not as many [ as ]"), ("<<<___>>>_", "place 10: _ stands outside of a stem's loop"), ("<<:__>>", "place 3: a free residue can't stand inside a helix"),
]


def _verdicts_sql() -> str:
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(ss)}, {quoted(why)})" for i, (ss, why) in enumerate(VERDICTS))
    return f"SELECT p_partkey, ss, error FROM part JOIN (VALUES {rows}) t(k, ss, error) ON p_partkey % {len(VERDICTS)} = k"


@query("valid_cssd", _verdicts_sql())
def valid_cssd(spark, d):
    """Bulk validation of patterns: every different one is looked at once."""
    which = F.element_at(F.array(*(F.lit(ss) for ss, _ in VERDICTS)), (F.col("p_partkey") % len(VERDICTS) + 1).cast("int"))
    return records.validated(collection(spark, d, "part").select("p_partkey", which.alias("ss")), "ss", cssd.validate)


@query("fe_threshold", f"WITH {RESULTS} SELECT _id, fe FROM results WHERE fe <= -90 ORDER BY fe, _id LIMIT 500")
def fe_threshold(spark, d):
    """The cut keeps 500 hits at most."""
    return records.energy_cut(results_of(spark, d).select("_id", "fe"), -90)


# ---- patterns compiled on the driver ---------------------------------------------------------------


# Checked by hand against the patterns above: name, ways, least and greatest length, largest helix, wrapped, and what stands
# before it, in it and after it.
_CATALOG = """
('search_hairpin', 1, 9, 9, 0, false, 0, 0, 3, 3, 0, 0), ('search_variable', 4, 9, 12, 0, false, 0, 0, 3, 4, 0, 0), ('search_bulge', 1, 14, 14, 0, false, 0, 0, 8, 8, 0, 0),
('search_interior', 4, 16, 18, 0, false, 0, 0, 10, 12, 0, 0), ('search_junction', 1, 26, 26, 0, false, 0, 0, 18, 18, 0, 0), ('search_pseudoknot', 1, 17, 17, 0, false, 0, 0, 5, 5, 6, 6),
('search_two_pseudoknots', 1, 16, 16, 0, false, 0, 0, 6, 6, 6, 6), ('search_triple', 1, 13, 13, 1, false, 2, 2, 3, 3, 4, 4), ('search_wrapped', 4, 13, 16, 1, true, 4, 6, 3, 3, 2, 3),
('search_side_by_side', 2, 19, 20, 0, false, 0, 0, 3, 3, 10, 11)"""


@query("model_limits", f"SELECT * FROM (VALUES {_CATALOG}) t(name, size, least, most, largest, wrapped, lead_least, lead_most, inside_least, inside_most, trail_least, trail_most)")
def model_limits(spark, d):
    """Size, reach, largest helix and wrapper of each registered pattern, and what stands around that helix."""
    rows = [(n, m.size(), *m.length(), m.largest(), m.wrapped, *m.limits()["lead"], *m.limits()["enclosed"], *m.limits()["trail"]) for n, p in PATTERNS.items() for m in [cssd.parse(*p)]]
    return spark.createDataFrame(rows, "name string, size int, least int, most int, largest int, wrapped boolean, lead_least int, lead_most int, inside_least int, inside_most int, trail_least int, trail_most int")


# Checked by hand against the patterns: name, helix, its least and greatest length, the residues it encloses at least and at most.
_DISTANCES = """
('search_hairpin', 0, 3, 3, 3, 3), ('search_variable', 0, 3, 4, 3, 4), ('search_bulge', 0, 3, 3, 8, 8), ('search_bulge', 1, 2, 2, 3, 3), ('search_interior', 0, 3, 3, 10, 12), ('search_interior', 1, 2, 2, 4, 4),
('search_junction', 0, 4, 4, 18, 18), ('search_junction', 1, 3, 3, 3, 3), ('search_junction', 2, 3, 3, 3, 3), ('search_pseudoknot', 0, 3, 3, 5, 5), ('search_two_pseudoknots', 0, 2, 2, 6, 6),
('search_triple', 0, 1, 1, 9, 9), ('search_triple', 1, 2, 2, 3, 3), ('search_wrapped', 0, 1, 2, 9, 9), ('search_wrapped', 1, 2, 2, 3, 3), ('search_side_by_side', 0, 3, 3, 3, 3), ('search_side_by_side', 1, 3, 3, 3, 3)"""


@query("stack_distances", f"SELECT * FROM (VALUES {_DISTANCES}) t(name, helix, low, high, near, far)")
def stack_distances(spark, d):
    """The lengths of each helix of each registered pattern and the range of residues that it encloses."""
    rows = [(n, h, m.helices[h].low, m.helices[h].high, *m.spans[h]) for n, p in PATTERNS.items() for m in [cssd.parse(*p)] for h in range(len(m.helices))]
    return spark.createDataFrame(rows, "name string, helix int, low int, high int, near int, far int")


# Checked by hand against the patterns: where each constraint's strands lie about each helix, counted from its nearer edge.
_OFFSETS = """
('search_pseudoknot', 0, 0, 'fp', 'inside', 1, 1), ('search_pseudoknot', 0, 0, 'tp', 'after', 3, 3), ('search_two_pseudoknots', 0, 1, 'fp', 'inside', 0, 0), ('search_two_pseudoknots', 0, 0, 'fp', 'inside', 2, 2),
('search_two_pseudoknots', 0, 1, 'tp', 'after', 0, 0), ('search_two_pseudoknots', 0, 0, 'tp', 'after', 4, 4), ('search_triple', 0, 0, 'fp', 'inside', 0, 0), ('search_triple', 0, 0, 'tp', 'inside', 8, 8), ('search_triple', 0, 0, 'single', 'after', 1, 1),
('search_triple', 1, 0, 'fp', 'before', 1, 1), ('search_triple', 1, 0, 'tp', 'after', 0, 0), ('search_triple', 1, 0, 'single', 'after', 3, 3), ('search_wrapped', 0, 0, 'single', 'before', 2, 3), ('search_wrapped', 0, 0, 'fp', 'inside', 0, 0),
('search_wrapped', 0, 0, 'tp', 'inside', 8, 8), ('search_wrapped', 1, 0, 'single', 'before', 4, 6), ('search_wrapped', 1, 0, 'fp', 'before', 1, 1), ('search_wrapped', 1, 0, 'tp', 'after', 0, 0)"""


@query("constraint_offsets", f"SELECT * FROM (VALUES {_OFFSETS}) t(name, helix, part, role, side, low, high)")
def constraint_offsets(spark, d):
    rows = [(n, h, k, role, *where) for n, p in PATTERNS.items() for m in [cssd.parse(*p)] for h in range(len(m.helices)) for (k, role), where in helices.offsets(m, h).items()]
    return spark.createDataFrame(rows, "name string, helix int, part int, role string, side string, low int, high int")


# ---- pairs and helices ---------------------------------------------------------------------------


@query("explode_positions", f"WITH {POS} SELECT seq_id, c AS nt, count(*) AS n, CAST(sum(p) AS BIGINT) AS places FROM pos GROUP BY ALL")
def explode_positions(spark, d):
    """Counts of residues by sequence, from the exploded positions."""
    return helices.explode_positions(rna_from_documents(spark, d)).groupBy("seq_id", "nt").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


def _pairs_sql(near: int, far: int) -> str:
    return f"pairs AS (SELECT a.seq_id, a.p AS i, b.p AS j FROM pos a JOIN (SELECT *, unnest(range({near}, {far + 1})) AS k FROM pos) b ON a.seq_id = b.seq_id AND a.p = b.p - b.k WHERE a.c || b.c IN {CANON})"


@query("pair_self_join", f"WITH {POS}, {_pairs_sql(4, 7)} SELECT seq_id, j - i AS distance, count(*) AS n FROM pairs GROUP BY ALL")
def pair_self_join(spark, d):
    return helices.pair_self_join(rna_from_documents(spark, d), 4, 7).groupBy("seq_id", (F.col("j") - F.col("i")).cast("long").alias("distance")).agg(F.count(F.lit(1)).alias("n"))


def _helix_sql(low: int, high: int, near: int, far: int) -> str:
    parts = []
    for n in range(low, high + 1):
        for e in range(near, far + 1):
            last = 2 * n + e - 1
            parts.append(f"SELECT seq_id, p AS fp, p + {n + e} AS tp, {n} AS len FROM w WHERE " + " AND ".join(f"c{r} || c{last - r} IN {CANON}" for r in range(n)))
    leads = ", ".join(f"lead(c, {k}) OVER s AS c{k}" for k in range(1, 2 * high + far))
    return f"w AS MATERIALIZED (SELECT seq_id, p, c AS c0, {leads} FROM pos WINDOW s AS (PARTITION BY seq_id ORDER BY p)), helices AS MATERIALIZED ({' UNION ALL '.join(parts)})"


H34 = _helix_sql(4, 5, 3, 5)
_H_COLS = "seq_id, CAST(fp AS INTEGER) AS fp, CAST(tp AS INTEGER) AS tp, CAST(len AS INTEGER) AS len"


@query("enum_helices", f"WITH {POS}, {H34} SELECT {_H_COLS} FROM helices")
def enum_helices(spark, d):
    return helices.enum_helices(rna_from_documents(spark, d), 4, 5, 3, 5)


@query("enum_helices_ext", f"WITH {POS}, {_helix_sql(5, 5, 2, 2)} SELECT seq_id, CAST(fp + 1 AS INTEGER) AS fp, CAST(tp AS INTEGER) AS tp, 3 AS len FROM (SELECT seq_id, fp, tp + 1 AS tp FROM helices)")
def enum_helices_ext(spark, d):
    """Helices of three pairs around four residues that pair on for one pair inside and one outside: five pairs around two."""
    return helices.enum_helices_ext(rna_from_documents(spark, d), 3, 3, 4, 4, 1, 1)


@query("helix_runs", f"WITH {POS}, {_pairs_sql(4, 20)}, g AS (SELECT *, i - row_number() OVER (PARTITION BY seq_id, i + j ORDER BY i) AS island FROM pairs), r AS (SELECT seq_id, i, j, row_number() OVER (PARTITION BY seq_id, i + j, island ORDER BY i DESC) AS run FROM g) SELECT seq_id, run, count(*) AS n FROM r GROUP BY ALL")
def helix_runs(spark, d):
    """Runs of pairs on anti-diagonals, counted by length."""
    return strands.run_counts(rna_from_documents(spark, d), 4, 20)


@query("helix_cap", f"WITH {POS}, {H34} SELECT {_H_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, len, tp - fp - len ORDER BY fp, tp) AS n FROM helices) WHERE n <= 10")
def helix_cap(spark, d):
    """The optional cap on placements, the feature itself."""
    return helices.cap(enum_helices(spark, d), 10)


_INNER, _OUTER = (4, 4, 3, 3), (2, 2, 11, 14)


def _nested(spark, d, keep):
    return strands.nested(rna_from_documents(spark, d), _OUTER, _INNER, (0, 2), (0, 1), keep)


def _two_sql() -> str:
    inner, outer = _helix_sql(*_INNER), _helix_sql(*_OUTER)
    inner = inner.replace("w AS MATERIALIZED", "wi AS MATERIALIZED").replace("helices AS", "inner_ AS").replace("FROM w ", "FROM wi ")
    outer = outer.replace("w AS MATERIALIZED", "wo AS MATERIALIZED").replace("helices AS", "outer_ AS").replace("FROM w ", "FROM wo ")
    return f"WITH {POS}, {inner}, {outer}"


_TWO = _two_sql()
_IN = "i.seq_id = o.seq_id AND i.fp BETWEEN o.fp + o.len AND o.fp + o.len + 2 AND o.tp - (i.tp + i.len) BETWEEN 0 AND 1"


@query("join_containment", f"{_TWO} SELECT o.seq_id, CAST(o.fp AS INTEGER) AS o_fp, CAST(o.tp AS INTEGER) AS o_tp, CAST(i.fp AS INTEGER) AS fp, CAST(i.tp AS INTEGER) AS tp FROM outer_ o JOIN inner_ i ON {_IN}")
def join_containment(spark, d):
    return _nested(spark, d, "both").select("seq_id", "o_fp", "o_tp", "fp", "tp")


@query("semi_join_up", f"{_TWO} SELECT {_H_COLS} FROM inner_ i WHERE EXISTS (SELECT 1 FROM outer_ o WHERE {_IN})")
def semi_join_up(spark, d):
    return _nested(spark, d, "inner")


@query("semi_join_down", f"{_TWO} SELECT {_H_COLS} FROM outer_ o WHERE EXISTS (SELECT 1 FROM inner_ i WHERE {_IN})")
def semi_join_down(spark, d):
    return _nested(spark, d, "outer")


_H5 = (5, 5, 3, 4)


@query("list_advance", f"WITH {POS}, {_helix_sql(*_H5)} SELECT a.seq_id, CAST(a.fp AS INTEGER) AS first_fp, CAST(b.fp AS INTEGER) AS fp, CAST(a.skip AS INTEGER) AS skip FROM (SELECT *, tp + len + skip AS cur FROM (SELECT *, unnest(range(0, 21)) AS skip FROM helices)) a JOIN helices b ON a.seq_id = b.seq_id AND b.fp = a.cur")
def list_advance(spark, d):
    """Stems followed by a stem up to 20 residues on: an equality join over the exploded skips."""
    h = helices.enum_helices(rna_from_documents(spark, d), *_H5)
    partial = h.select("seq_id", F.col("fp").alias("first_fp"), F.expr("tp + len").alias("cur"))
    return helices.advance(partial, h, 0, 20).select("seq_id", "first_fp", "fp", "skip")


@query("list_null_advance", f"WITH {POS}, {_helix_sql(*_H5)} SELECT a.seq_id, CAST(a.fp AS INTEGER) AS first_fp, CAST(b.fp AS INTEGER) AS fp FROM helices a JOIN helices b ON a.seq_id = b.seq_id AND b.fp BETWEEN a.tp + a.len AND a.tp + a.len + 5 UNION ALL SELECT seq_id, CAST(fp AS INTEGER), NULL FROM helices")
def list_null_advance(spark, d):
    h = helices.enum_helices(rna_from_documents(spark, d), *_H5)
    partial = h.select("seq_id", F.col("fp").alias("first_fp"), F.expr("tp + len").alias("cur"))
    return helices.null_advance(partial, h, 0, 5).select("seq_id", "first_fp", "fp")


@query("list_advance_wrapper", f"WITH {POS}, {_helix_sql(6, 6, 3, 3)} SELECT seq_id, CAST(fp AS INTEGER) AS fp, CAST(fp + len AS INTEGER) AS cur FROM helices")
def list_advance_wrapper(spark, d):
    rna = rna_from_documents(spark, d)
    return helices.all_helices(rna.select("seq_id"), helices.enum_helices(rna, 6, 6, 3, 3)).select("seq_id", "fp", "cur")


_H35 = (4, 5, 4, 6)


@query("distinct_hits", f"WITH {POS}, {H34}, {_helix_sql(*_H35).replace('w AS MAT', 'v AS MAT').replace('FROM w ', 'FROM v ').replace('helices AS', 'others AS')} SELECT seq_id, CAST(fp AS INTEGER) AS fp, CAST(last AS INTEGER) AS last FROM (SELECT seq_id, fp, tp + len - 1 AS last FROM helices UNION SELECT seq_id, fp, tp + len - 1 FROM others)")
def distinct_hits(spark, d):
    """Union without duplicates of two lists of extents that share some."""
    ends = lambda h: h.select("seq_id", "fp", F.expr("tp + len - 1").alias("last"))
    return records.union_distinct(ends(enum_helices(spark, d)), ends(helices.enum_helices(rna_from_documents(spark, d), *_H35)))


@query("member", f"WITH {POS}, {H34}, {_helix_sql(*_H35).replace('w AS MAT', 'v AS MAT').replace('FROM w ', 'FROM v ').replace('helices AS', 'others AS')} SELECT {_H_COLS} FROM helices h WHERE EXISTS (SELECT 1 FROM others o WHERE o.seq_id = h.seq_id AND o.fp = h.fp AND o.tp = h.tp AND o.len = h.len)")
def member(spark, d):
    """The helices of one list that another holds too."""
    return records.present(enum_helices(spark, d), helices.enum_helices(rna_from_documents(spark, d), *_H35), "seq_id", "fp", "tp", "len")


@query("union_distinct_counts", "SELECT p_size + k AS n FROM part, (SELECT unnest(range(0, 3)) AS k) GROUP BY 1")
def union_distinct_counts(spark, d):
    p = collection(spark, d, "part").select(F.col("p_size").cast("long").alias("n")).distinct()
    return records.union_distinct(p, records.list_sum(p, "n", 1), records.list_sum(p, "n", 2))


@query("list_sum_combine", "SELECT DISTINCT a.p_size + b.p_size AS n FROM (SELECT DISTINCT p_size FROM part) a, (SELECT DISTINCT p_size FROM part) b")
def list_sum_combine(spark, d):
    """All sums of two sets of lengths; at most 50 different ones each."""
    p = collection(spark, d, "part").select(F.col("p_size").alias("n"))
    return store.sum_combine(p, p)


@query("union_all_guest", f"WITH {SEQS} SELECT _id, accession FROM sequences WHERE ref_id = 1 UNION ALL SELECT _id, accession FROM sequences WHERE ref_id = 0")
def union_all_guest(spark, d):
    return records.own_and_guests(sequences_of(spark, d), 1).select("_id", "accession")


@query("dedup_results", f"WITH {RESULTS} SELECT DISTINCT job_id, position, hit_string FROM results")
def dedup_results(spark, d):
    return records.distinct_results(results_of(spark, d))


# ---- lookups, summaries, orders -------------------------------------------------------------------


@query("lookup_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def lookup_inner(spark, d):
    jobs = collection(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    one = store.lookup(jobs, collection(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    return store.lookup(one, collection(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("o_orderkey", "c_name", "n_name")


@query("fe_distribution", f"WITH {RESULTS} SELECT job_id, position, min(fe) AS min_fe, max(fe) AS max_fe, round(avg(fe), 6) AS avg_fe, round(stddev_samp(fe), 6) AS std_fe, count(*) AS n FROM results GROUP BY job_id, position")
def fe_distribution(spark, d):
    return store.fe_distribution(results_of(spark, d), "job_id").withColumns({"avg_fe": F.round("avg_fe", 6), "std_fe": F.round("std_fe", 6)})


@query("total_time", f"WITH {RESULTS} SELECT job_id, round(sum(time), 4) AS total_time FROM results GROUP BY job_id")
def total_time(spark, d):
    return records.total_time(results_of(spark, d)).withColumn("total_time", F.round("total_time", 4))


@query("result_count", f"WITH {RESULTS} SELECT job_id, count(*) AS n FROM results GROUP BY job_id")
def result_count(spark, d):
    return records.result_count(results_of(spark, d))


@query("collection_count", "SELECT (SELECT count(*) FROM documents) AS sequences, (SELECT count(*) FROM part) AS cs, (SELECT count(*) FROM orders) AS jobs, (SELECT count(*) FROM events) AS results")
def collection_count(spark, d):
    return records.collection_counts({n: collection(spark, d, t) for t, n in (("documents", "sequences"), ("part", "cs"), ("orders", "jobs"), ("events", "results"))})


@query("next_counter", f"WITH {SEQS} SELECT _id, 1000 + row_number() OVER (ORDER BY _id) AS seq FROM sequences")
def next_counter(spark, d):
    return store.next_ids(sequences_of(spark, d).select("_id"), 1000, "_id")


@query("window_counters", "SELECT o_custkey AS job_id, count(*) AS num_windows, count(*) FILTER (WHERE o_orderstatus = 'F') AS num_windows_success, count(*) FILTER (WHERE o_orderstatus = 'O') AS num_windows_fail FROM orders GROUP BY o_custkey")
def window_counters(spark, d):
    return store.window_counters(_windows(spark, d))


def _windows(spark, d):
    ok = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return collection(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), ok.alias("ok"))


@query("job_state", "SELECT job_id, CASE WHEN job_id % 3 = 0 THEN CASE WHEN n > 0 THEN 1 ELSE 0 END WHEN n = ok + fail THEN 3 ELSE 2 END AS status FROM (SELECT o_custkey AS job_id, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS ok, count(*) FILTER (WHERE o_orderstatus = 'O') AS fail FROM orders GROUP BY o_custkey)")
def job_state(spark, d):
    c = store.window_counters(_windows(spark, d))
    return c.select("job_id", store.job_state(F.expr("job_id % 3 <> 0"), F.col("num_windows"), F.col("num_windows_success"), F.col("num_windows_fail")).alias("status"))


@query("mean_time", f"WITH {RESULTS} SELECT job_id, round(least(sum(time) / count(*), 999), 6) AS mean_time FROM results GROUP BY job_id")
def mean_time(spark, d):
    return records.mean_time(results_of(spark, d)).withColumn("mean_time", F.round("mean_time", 6))


@query("list_sum", f"WITH {RESULTS} SELECT _id, position + 7 AS position FROM results")
def list_sum(spark, d):
    return records.list_sum(results_of(spark, d).select("_id", "position"), "position", 7)


@query("fe_percentile", "WITH h AS (SELECT p_size AS len, round(p_retailprice) AS fe, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT len, sum(n) AS total FROM h GROUP BY len) SELECT p_partkey, round(100.0 * (SELECT sum(h.n) FROM h WHERE h.len = p.p_size AND h.fe <= p.p_retailprice) / t.total, 6) AS percentile FROM part p JOIN t ON t.len = p.p_size")
def fe_percentile(spark, d):
    p = collection(spark, d, "part").select("p_partkey", F.col("p_size").alias("len"), F.col("p_retailprice").alias("fe"))
    hist = p.groupBy("len", F.round("fe").alias("fe")).agg(F.count(F.lit(1)).alias("n"))
    return store.fe_percentile(p, hist).select("p_partkey", F.round(F.when(F.col("percentile") > 0, F.col("percentile")), 6).alias("percentile"))


@query("sort_results", f"WITH {RESULTS} SELECT _id, job_id, position, fe FROM results ORDER BY position, fe")
def sort_results(spark, d):
    return results_of(spark, d).select("_id", "job_id", "position", "fe").orderBy(*store.by_results())


@query("sort_sequences", f"WITH {SEQS} SELECT _id, grp, definition, accession FROM sequences ORDER BY grp COLLATE NOCASE.NOACCENT, definition COLLATE NOCASE.NOACCENT, accession COLLATE NOCASE.NOACCENT LIMIT 50 OFFSET 20")
def sort_sequences(spark, d):
    """The page of 50 from the 21st, in the order that ignores case and accents."""
    s = sequences_of(spark, d).select("_id", "grp", "definition", "accession")
    return store.page(s.orderBy(*store.by_text("grp", "definition", "accession")), 21, 50)


@query("sort_cssds", "SELECT p_partkey, p_name FROM part ORDER BY p_name COLLATE NOCASE.NOACCENT, p_partkey")
def sort_cssds(spark, d):
    return collection(spark, d, "part").select("p_partkey", "p_name").orderBy(*store.by_text("p_name"), "p_partkey")


@query("sort_jobs", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC")
def sort_jobs(spark, d):
    return records.newest_jobs(collection(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("page", f"WITH {RESULTS} SELECT _id, position, fe FROM results ORDER BY position, fe, _id LIMIT 25 OFFSET 100")
def page(spark, d):
    return store.page(results_of(spark, d).select("_id", "position", "fe").orderBy("position", "fe", "_id"), 101, 25)


@query("latest_one", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def latest_one(spark, d):
    return store.newest(collection(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query("result_index", f"WITH {RESULTS} SELECT count(*) FILTER (WHERE position < 30 OR (position = 30 AND fe < -50.01)) AS result_index FROM results")
def result_index(spark, d):
    return store.result_index(results_of(spark, d), 30, -50.0)


# ---- regions of interest -----------------------------------------------------------------------------

_ROI = ("((,,<<<<___>>>>,,))", "")


@query("segment_sequence", f"WITH {RNA} SELECT seq_id, CAST(k * 1000 + 1 AS INTEGER) AS start, CAST(length(substr(nt, CAST(k * 1000 + 1 AS INTEGER), 1018)) AS INTEGER) AS n FROM (SELECT *, unnest(range(0, (length(nt) - 1) // 1000 + 1)) AS k FROM rna WHERE length(nt) > 0)")
def segment_sequence(spark, d):
    return regions.segments(rna_from_documents(spark, d), 1000, 18).select("seq_id", F.col("start").cast("int").alias("start"), F.length("nt").alias("n"))


def _roi_sql() -> str:
    return f"WITH {POS}, n AS (SELECT seq_id, max(p) AS n FROM pos GROUP BY seq_id), {_helix_sql(4, 4, 3, 3)}, seeds AS (SELECT h.seq_id, fp, tp, len, fp - 4 AS start, tp + len + 3 AS e FROM helices h JOIN n USING (seq_id) WHERE fp - 4 >= 1 AND tp + len + 3 <= n)"


@query("roi_seed", f'{_roi_sql()} SELECT {_H_COLS}, CAST(start AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM seeds')
def roi_seed(spark, d):
    return regions.seeds(rna_from_documents(spark, d), cssd.parse(*_ROI), constraints=False)


@query("roi_subsume", f'{_roi_sql()}, x AS (SELECT DISTINCT seq_id, start, e FROM seeds), y AS (SELECT *, max(e) OVER (PARTITION BY seq_id ORDER BY start, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x) SELECT seq_id, CAST(start AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM y WHERE reach IS NULL OR reach < e')
def roi_subsume(spark, d):
    return regions.subsume(regions.seeds(rna_from_documents(spark, d), cssd.parse(*_ROI), constraints=False))


@query("roi_emit", f'{_roi_sql()}, f AS (SELECT DISTINCT seq_id, start, e FROM seeds) SELECT rna.seq_id, CAST(coalesce(f.start, 0) AS INTEGER) AS start, CAST(coalesce(f.e, 0) AS INTEGER) AS "end" FROM rna LEFT JOIN f ON f.seq_id = rna.seq_id')
def roi_emit(spark, d):
    rna = rna_from_documents(spark, d)
    found = regions.seeds(rna, cssd.parse(*_ROI), constraints=False).select("seq_id", "start", "end").distinct()
    return regions.emit(rna, found)


def _roi_constraint_sql() -> str:
    """Stems of four pairs around four or five residues whose loop's second to fourth residues pair with the three that end
    six past the stem."""
    parts = []
    for e in (4, 5):
        last = 2 * 4 + e - 1
        pairs = [(r, last - r) for r in range(4)] + [(5 + r, last + 6 - r) for r in range(3)]
        parts.append(f"SELECT seq_id, p AS fp, p + {4 + e} AS tp, 4 AS len, p AS start, p + {last + 6} AS e FROM w WHERE " + " AND ".join(f"c{i} || c{j} IN {CANON}" for i, j in pairs))
    leads = ", ".join(f"lead(c, {k}) OVER s AS c{k}" for k in range(1, 19))
    return f'WITH {POS}, w AS MATERIALIZED (SELECT seq_id, p, c AS c0, {leads} FROM pos WINDOW s AS (PARTITION BY seq_id ORDER BY p)) SELECT {_H_COLS}, CAST(start AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM ({" UNION ALL ".join(parts)})'


@query("roi_constraint", _roi_constraint_sql())
def roi_constraint(spark, d):
    """Seeds of a stem around which its pseudoknot could stand."""
    return regions.seeds(rna_from_documents(spark, d), cssd.parse("<<<<_[[[_>>>>:::]]]", "        1"))


# ---- energy, painting, changes ---------------------------------------------------------------------------


def _simple_sql() -> str:
    cells = " ".join(f"WHEN '{p}{q}' THEN {e}" for p, row in energy.STACKS.items() for q, e in zip(energy.STACK_PAIRS, row, strict=True))
    one = lambda a, b: f"CASE c{a} || c{8 - a} || c{b} || c{8 - b} {cells} ELSE 0 END"
    leads = ", ".join(f"lead(c, {k}) OVER s AS c{k}" for k in range(1, 9))
    return f"WITH {POS}, w AS (SELECT seq_id, p, c AS c0, {leads} FROM pos WINDOW s AS (PARTITION BY seq_id ORDER BY p)) SELECT seq_id, CAST(p AS INTEGER) AS fp, round(CAST({one(0, 1)} AS DOUBLE) + CAST({one(1, 2)} AS DOUBLE), 2) AS fe FROM w WHERE " + " AND ".join(f"c{r} || c{8 - r} IN {CANON}" for r in range(3))


@query("fe_simple", _simple_sql())
def fe_simple(spark, d):
    """Stacking energy of each hairpin hit; residues are read from the hit's own window of the sequence."""
    hits = _with_residues(spark, d, HAIRPIN)
    return hits.select("seq_id", F.col("first_fp").alias("fp"), F.round(energy.fe_simple(), 2).alias("fe"))


def _with_residues(spark, d, pattern) -> DataFrame:
    """Hits with nt, the residues about the hit, and chain and constraints counted from there."""
    hits = search(rna_from_documents(spark, d), pattern, context=4)
    return render.counted_from(hits.withColumnsRenamed({"fp": "first_fp", "around": "nt"}), "around_start")


def _hairpin_sql() -> str:
    """Two stacks, the loop of three (special ones by their own energy), weak ends, and symmetry if both strands read the same."""
    cells = " ".join(f"WHEN '{p}{q}' THEN {e}" for p, row in energy.STACKS.items() for q, e in zip(energy.STACK_PAIRS, row, strict=True))
    one = lambda a, b: f"CASE c{a} || c{8 - a} || c{b} || c{8 - b} {cells} ELSE 0 END"
    weak = ", ".join(f"'{p}'" for p in sorted(energy.WEAK))
    special = " ".join(f"WHEN '{k}' THEN {e}" for k, e in energy.SPECIAL_HAIRPINS.items() if len(k) == 5)
    loop = f"{energy.HAIRPIN[3]} + CASE WHEN c3 || c4 || c5 = 'ccc' THEN {energy.ALL_C_3} ELSE 0 END"
    loop = f"CASE c2 || c3 || c4 || c5 || c6 {special} ELSE {loop} END" if special else loop
    ends = f"CASE WHEN c0 || c8 IN ({weak}) THEN {energy.AU_GU_END} ELSE 0 END + CASE WHEN c2 || c6 IN ({weak}) THEN {energy.AU_GU_END} ELSE 0 END"
    same = f"CASE WHEN c0 || c1 || c2 = c6 || c7 || c8 THEN {energy.SYMMETRY} ELSE 0 END"
    leads = ", ".join(f"lead(c, {k}) OVER s AS c{k}" for k in range(1, 9))
    return f"WITH {POS}, w AS (SELECT seq_id, p, c AS c0, {leads} FROM pos WINDOW s AS (PARTITION BY seq_id ORDER BY p)) SELECT seq_id, CAST(p AS INTEGER) AS fp, round(CAST({one(0, 1)} AS DOUBLE) + CAST({one(1, 2)} AS DOUBLE) + CAST({loop} AS DOUBLE) + CAST({ends} AS DOUBLE) + CAST({same} AS DOUBLE), 2) AS fe FROM w WHERE " + " AND ".join(f"c{r} || c{8 - r} IN {CANON}" for r in range(3))


@query("fe_hairpin", _hairpin_sql())
def fe_hairpin(spark, d):
    """Full energy of each hairpin hit: stacks, loop, weak ends and symmetry."""
    hits = _with_residues(spark, d, HAIRPIN)
    return hits.select("seq_id", F.col("first_fp").alias("fp"), F.round(energy.fe_turner(F.col("nt"), F.col("chain"), F.col("constraints")), 2).alias("fe"))


@query("fe_turner")
def fe_turner(spark, d):
    """Full nearest-neighbour energy of each junction hit."""
    hits = _with_residues(spark, d, PATTERNS["search_junction"])
    return hits.select("seq_id", "position", F.round(energy.fe_turner(F.col("nt"), F.col("chain"), F.col("constraints")), 5).alias("fe"))


@query("hit_paint", f"SELECT seq_id, position, '{PATTERNS['search_pseudoknot'][0]}' AS hit_string FROM ({variants_sql(*PATTERNS['search_pseudoknot'])})")
def hit_paint(spark, d):
    hits = search(rna_from_documents(spark, d), PATTERNS["search_pseudoknot"])
    return hits.select("seq_id", "position", render.hit_string(F.col("chain"), F.col("constraints")).alias("hit_string"))


@query("update_fields", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_fields(spark, d):
    return store.update(collection(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "P", o_orderstatus="F")


@query("delete_by_key", f"WITH {SEQS} SELECT _id, ref_id FROM sequences WHERE NOT (ref_id = 2)")
def delete_by_key(spark, d):
    return store.delete(sequences_of(spark, d).select("_id", "ref_id"), F.col("ref_id") == 2)


@query("cascade_delete", f"WITH {RESULTS} SELECT _id, job_id FROM results WHERE job_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(spark, d):
    gone = collection(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("job_id")).distinct()
    return store.delete_keys(results_of(spark, d).select("_id", "job_id"), gone, ["job_id"])


@query("insert_unique", f"WITH {RESULTS} SELECT job_id, position, hit_string FROM (SELECT DISTINCT job_id, position, hit_string FROM results) EXCEPT SELECT job_id, position, hit_string FROM results WHERE position < 10")
def insert_unique(spark, d):
    """What an insert adds to a table that holds the hits of the first ten positions."""
    keys = ["job_id", "position", "hit_string"]
    r = results_of(spark, d).select(*keys)
    return store.new_only(r, r.where("position < 10").distinct(), keys)


@query("project_drop", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def project_drop(spark, d):
    return records.without(collection(spark, d, "orders"), "o_orderdate", "o_orderpriority")


@query("array_elem_at", "SELECT c_custkey, first_order FROM customer JOIN (SELECT o_custkey AS c_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey) USING (c_custkey)")
def array_elem_at(spark, d):
    """The first match of a lookup with several; rows without any go."""
    orders = collection(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return records.first_match(collection(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "o_orderkey", "first_order")


@query("sink_dataset_print", f"WITH {RESULTS} SELECT job_id || chr(9) || position || chr(9) || hit_string AS line FROM results")
def sink_dataset_print(spark, d):
    return records.printed(results_of(spark, d).select("job_id", "position", "hit_string"))


@query("cap_hits", f"WITH {RESULTS} SELECT _id, fe FROM results ORDER BY fe, _id LIMIT 500")
def cap_hits(spark, d):
    """The feature is the cap."""
    return records.cap_hits(results_of(spark, d).select("_id", "fe"))


@query("pred_stack", f"WITH {POS}, {_helix_sql(5, 5, 4, 4)} SELECT seq_id, count(*) AS n FROM helices GROUP BY seq_id")
def pred_stack(spark, d):
    """How many stacks of five pairs around four residues each sequence has."""
    return helices.enum_helices(rna_from_documents(spark, d), 5, 5, 4, 4).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))


@query("constraint_text", f"SELECT h.seq_id, h.position, substr(rna.nt, h.position + 4, 3) AS five, substr(rna.nt, h.position + 14, 3) AS three FROM ({variants_sql(*PATTERNS['search_pseudoknot'])}) h JOIN (SELECT doc_id AS seq_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'acguacguacguacguacguacguac') AS nt FROM documents) rna USING (seq_id)")
def constraint_text(spark, d):
    """The residues of a pseudoknot's strands."""
    hits = search(rna_from_documents(spark, d), PATTERNS["search_pseudoknot"], context=0)
    strand = lambda role: F.expr(f"substring(around, filter(constraints, s -> s.role = '{role}')[0].start - around_start + 1, filter(constraints, s -> s.role = '{role}')[0].len)")
    return hits.select("seq_id", "position", strand("fp").alias("five"), strand("tp").alias("three"))


@query("roi_extend", f'''{_roi_sql().replace("WITH rna", "WITH RECURSIVE rna", 1)}, x AS (SELECT seq_id, start, e, row_number() OVER (PARTITION BY seq_id ORDER BY start, e) AS k FROM (SELECT DISTINCT seq_id, start, e FROM seeds)),
walk AS (
  SELECT seq_id, k, start, start + 18 AS reach, true AS kept FROM x WHERE k = 1
  UNION ALL SELECT x.seq_id, x.k, x.start, CASE WHEN x.e <= walk.reach THEN walk.reach ELSE x.start + 18 END, x.e > walk.reach FROM walk JOIN x ON x.seq_id = walk.seq_id AND x.k = walk.k + 1)
SELECT seq_id, CAST(start AS INTEGER) AS start, CAST(start + 18 AS INTEGER) AS "end" FROM walk WHERE kept''')
def roi_extend(spark, d):
    """The regions of a pattern, stretched from left to right."""
    model = cssd.parse(*_ROI)
    found = regions.seeds(rna_from_documents(spark, d), model, constraints=False)
    return regions.extend(found, model.length()[1])
