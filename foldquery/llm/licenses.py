"""Licence scans by sentence rules, in DataFrame expressions alone.

1. Wrapped lines are joined: a line of 40 characters or more that ends no sentence goes on in the next line, unless that has
   neither letters nor digits. So a comment's leaders don't matter, and an empty comment line ends a paragraph.
2. The text is cut into sentences (line breaks that are left, and . ! ? before white space). Each is normalised: lower
   case, one spelling of `license`, runs of anything but letters, digits and dots between digits become one space.
3. Normalised sentences that are known get an identifier: by their words, or as `... licensed under NAME`, or for each
   licence of an SPDX expression. Others that hold a licence word get `unknown`; the rest none.
4. The text's identifiers in order are matched against ordered rules, each a sequence of identifiers. A rule takes what it
   matches, so a longer licence listed first keeps its sentences from the shorter ones after it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldquery.llm.common import ascii_lower, table

_FREE = "this {0} is free software you can redistribute it and or modify it under the terms of the gnu {1}general public license as published by the free software foundation either version {2} of the license or at your option any later version"
_HOPE = "this {0} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
#: The notices of the GNU licences, from their common words.
_GNU = {_FREE.format(what, kind, v): f"{name}{v}later" for what in ("program", "library", "software") for kind, name, versions in (("", "gpl", "23"), ("lesser ", "lgpl", ("2.1", "3")), ("affero ", "agpl", "3")) for v in versions}

# Normalised sentences of public licence texts and notices, and their identifiers.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2.0 the license": "apache2",
    "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license": "apachenotice",
    "you may not use this file except in compliance with the license": "apachecompliance",
    "you may obtain a copy of the license at": "apachecopy",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "apachecopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apachebasis",
    "see the license for the specific language governing permissions and limitations under the license": "apachesee",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mitgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mitnotice",
    "the software is provided as is without warranty of any kind express or implied": "asis",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "asis",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mitliable",
    **_GNU,
    **{_HOPE.format(what): "gplnowarranty" for what in ("program", "library", "software")},
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsdgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsdsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsdbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsdendorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsddisclaimer",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsdliable",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "iscgrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "iscgrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "iscasis",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mpl2",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "mpl2copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "mpl2copy",
    "this software is provided as is without any express or implied warranty": "zlibasis",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlibgrant",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "distributed under the boost software license version 1.0": "bsl1",
    "all rights reserved": "reserved",
}
# What a notice calls a licence after `licensed under`, and its identifier.
NAMES: dict[str, str] = {
    "mit license": "mit", "mit": "mit", "apache license version 2.0": "apache2", "apache license 2.0": "apache2", "apache 2.0 license": "apache2", "apache 2.0": "apache2",
    "gnu general public license version 3": "gpl3", "gnu general public license v3.0": "gpl3", "gpl v3": "gpl3", "gplv3": "gpl3", "gnu general public license version 2": "gpl2", "gplv2": "gpl2", "gpl v2": "gpl2",
    "gnu lesser general public license version 3": "lgpl3", "lgplv3": "lgpl3", "gnu lesser general public license version 2.1": "lgpl2.1", "gnu affero general public license version 3": "agpl3", "agplv3": "agpl3",
    "bsd 3 clause license": "bsd3", "3 clause bsd license": "bsd3", "bsd 2 clause license": "bsd2", "2 clause bsd license": "bsd2", "isc license": "isc", "mozilla public license version 2.0": "mpl2", "mozilla public license 2.0": "mpl2",
    "cc by 4.0": "ccby4", "cc by sa 4.0": "ccbysa4", "cc by nc 4.0": "ccbync4", "cc by nc sa 4.0": "ccbyncsa4", "cc0 1.0": "cc0", "cc0": "cc0",
    "creative commons attribution 4.0 international license": "ccby4", "a creative commons attribution 4.0 international license": "ccby4", "creative commons attribution sharealike 4.0 international license": "ccbysa4", "a creative commons attribution sharealike 4.0 international license": "ccbysa4",
    "creative commons attribution noncommercial 4.0 international license": "ccbync4", "a creative commons attribution noncommercial 4.0 international license": "ccbync4",
}
# SPDX identifiers in lower case, the licences' names as given out, and the identifiers of NAMES that mean them.
SPDX: dict[str, tuple[str, str]] = {
    "mit": ("MIT", "mit"), "apache-2.0": ("Apache-2.0", "apache2"), "gpl-2.0-only": ("GPL-2.0-only", "gpl2"), "gpl-2.0": ("GPL-2.0-only", "gpl2"), "gpl-2.0-or-later": ("GPL-2.0-or-later", "gpl2later"), "gpl-2.0+": ("GPL-2.0-or-later", "gpl2later"),
    "gpl-3.0-only": ("GPL-3.0-only", "gpl3"), "gpl-3.0": ("GPL-3.0-only", "gpl3"), "gpl-3.0-or-later": ("GPL-3.0-or-later", "gpl3later"), "gpl-3.0+": ("GPL-3.0-or-later", "gpl3later"), "lgpl-2.1-only": ("LGPL-2.1-only", "lgpl2.1"), "lgpl-2.1-or-later": ("LGPL-2.1-or-later", "lgpl2.1later"),
    "lgpl-3.0-only": ("LGPL-3.0-only", "lgpl3"), "lgpl-3.0-or-later": ("LGPL-3.0-or-later", "lgpl3later"), "agpl-3.0-only": ("AGPL-3.0-only", "agpl3"), "agpl-3.0-or-later": ("AGPL-3.0-or-later", "agpl3later"), "bsd-2-clause": ("BSD-2-Clause", "bsd2"), "bsd-3-clause": ("BSD-3-Clause", "bsd3"),
    "isc": ("ISC", "isc"), "mpl-2.0": ("MPL-2.0", "mpl2"), "zlib": ("Zlib", "zlib"), "unlicense": ("Unlicense", "unlicense"), "bsl-1.0": ("BSL-1.0", "bsl1"), "cc0-1.0": ("CC0-1.0", "cc0"),
    "cc-by-4.0": ("CC-BY-4.0", "ccby4"), "cc-by-sa-4.0": ("CC-BY-SA-4.0", "ccbysa4"), "cc-by-nc-4.0": ("CC-BY-NC-4.0", "ccbync4"), "cc-by-nc-sa-4.0": ("CC-BY-NC-SA-4.0", "ccbyncsa4"),
}
# Fixed values: (licence, identifiers in order) of licences told in several sentences, the most specific first.
LONG_RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("apachenotice", "apachecopy", "apachebasis", "apachesee")),
    ("Apache-2.0", ("apachenotice", "apachecopy")),
    ("Apache-2.0", ("apachenotice",)),
    ("Apache-2.0", ("apache2", "apachecompliance", "apachecopy")),
    ("MIT", ("mitgrant", "mitnotice", "asis", "mitliable")),
    ("MIT", ("mitgrant", "mitnotice", "asis")),
    ("MIT", ("mitgrant", "mitnotice")),
    ("BSD-3-Clause", ("bsdgrant", "bsdsource", "bsdbinary", "bsdendorse", "bsddisclaimer", "bsdliable")),
    ("BSD-3-Clause", ("bsdgrant", "bsdsource", "bsdbinary", "bsdendorse")),
    ("BSD-2-Clause", ("bsdgrant", "bsdsource", "bsdbinary", "bsddisclaimer", "bsdliable")),
    ("BSD-2-Clause", ("bsdgrant", "bsdsource", "bsdbinary")),
    ("ISC", ("iscgrant", "iscasis")),
    ("ISC", ("iscgrant",)),
    ("Zlib", ("zlibasis", "zlibgrant")),
    ("Zlib", ("zlibgrant",)),
    ("MPL-2.0", ("mpl2", "mpl2copy")),
    ("GPL-3.0-or-later", ("gpl3later", "gplnowarranty")),
    ("GPL-2.0-or-later", ("gpl2later", "gplnowarranty")),
    ("LGPL-2.1-or-later", ("lgpl2.1later", "gplnowarranty")),
    ("LGPL-3.0-or-later", ("lgpl3later", "gplnowarranty")),
    ("AGPL-3.0-or-later", ("agpl3later", "gplnowarranty")),
]
#: These, then one for each identifier that names a licence by itself.
RULES = [*LONG_RULES, *dict.fromkeys((name, (i,)) for name, i in SPDX.values()), ("All-Rights-Reserved", ("reserved",))]
# A sentence that holds one of these speaks of a licence.
LICENCE_WORDS = ("license", "licensed", "copyright", "spdx")
_UNDER = "^(this (project|software|work|code|file|program|library|document|package|repository) is )?(licensed|released|distributed|available|published) under (the )?(terms of the )?"
_SPDX_LINE = "SPDX-License-Identifier:"
WRAP = 40
_ENDS = "[.!?:][\"')\\]]*[ \\t\\r]*$"


def unwrapped(text: Column) -> Column:
    """The text with its wrapped lines joined; null as empty."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    after = F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.lit("")))
    goes_on = lambda x, y: (F.length(F.trim(x)) >= WRAP) & y.rlike("[A-Za-z0-9]") & ~x.rlike(_ENDS) & ~x.contains(_SPDX_LINE) & ~y.contains(_SPDX_LINE)
    return F.array_join(F.zip_with(lines, after, lambda x, y: F.concat(x, F.when(goes_on(x, y), F.lit(" ")).otherwise(F.lit("\n")))), "")


def sentences(text: Column) -> Column:
    """The sentences of a text as an array; null has none."""
    marked = F.regexp_replace(unwrapped(text), r"([.!?])[ \t\r]+", "$1\n")
    return F.filter(F.split(marked, "\n", -1), lambda s: F.length(s) > 0)


def normalised(sentence: Column) -> Column:
    plain = F.regexp_replace(F.replace(ascii_lower(sentence), F.lit("licence"), F.lit("license")), r"[^a-z0-9.]+", " ")
    dots = F.regexp_replace(F.regexp_replace(plain, r"\.([^0-9]|$)", " $1"), r"(^|[^0-9])\.", "$1 ")
    return F.trim(F.regexp_replace(dots, " +", " "))


def _looked_up(of: dict[str, str], key: Column) -> Column:
    return F.element_at(F.map_from_arrays(F.array(*map(F.lit, of)), F.array(*map(F.lit, of.values()))), key)


def _identified(raw: Column) -> Column:
    """The identifiers of a sentence, comma-separated; empty for none."""
    n = normalised(raw)
    by_name = F.when(n.rlike(_UNDER), _looked_up(NAMES, F.regexp_replace(n, _UNDER, "")))
    speaks = reduce(lambda a, b: a | b, (F.concat(F.lit(" "), n, F.lit(" ")).contains(f" {w} ") for w in LICENCE_WORDS))
    expression = F.split(F.regexp_replace(F.substring_index(ascii_lower(raw), _SPDX_LINE.lower(), -1), "[^a-z0-9.+-]+", " "), " ")
    spdx = F.when(raw.contains(_SPDX_LINE), F.array_join(F.filter(F.transform(expression, lambda x: F.coalesce(_looked_up({k: v[1] for k, v in SPDX.items()}, F.regexp_replace(x, "[.]+$", "")), F.lit(""))), lambda x: x != ""), ","))
    return F.coalesce(F.nullif(spdx, F.lit("")), _looked_up(SENTENCES, n), by_name, F.when(speaks, F.lit("unknown")), F.lit(""))


def _candidates() -> str:
    """What a raw sentence must hold for its normal form to be worth computing: the longest word of a known sentence, a
    licence word, or ` under `."""
    longest = {max(re.findall("[a-z]+", s), key=len) for s in SENTENCES}
    return "(?i)" + "|".join(sorted((longest - {"license"}) | {"licen[cs]e", "copyright", "spdx", " under "}))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_sentences, identifiers, licenses and unmatched in place of the text.

    identifiers: of the licence sentences in order, comma-separated; licenses: of the rules that matched, in the order of
    their first rules, each once; unmatched: identifiers that no rule took. Null and empty texts have no sentences and empty strings. Equal texts
    have equal results, repeated rows all stay. Columns with these names are replaced, others stay whatever their names; an
    empty table gives no rows.
    """
    docs = docs.drop("n_sentences", "identifiers", "licenses", "unmatched")
    kept = [c for c in docs.columns if c != text_col]
    own = "_"
    while any(c.lower().startswith(own) for c in kept):
        own += "_"
    keep = [F.col(f"`{c}`") for c in kept]
    parts = docs.withColumn(f"{own}s", sentences(F.col(f"`{text_col}`")))
    likely = F.filter(f"{own}s", lambda s: s.rlike(_candidates()))
    ids = F.filter(F.transform(likely, _identified), lambda x: x != "")
    out = parts.select(*keep, F.size(f"{own}s").cast("long").alias("n_sentences"), F.array_join(ids, ",").alias("identifiers"))
    # each identifier stands between commas; a rule's hit is taken out
    left = F.when(F.col("identifiers") == "", F.lit("")).otherwise(F.concat(F.lit(","), F.replace("identifiers", F.lit(","), F.lit(",,")), F.lit(",")))
    out = out.withColumn(f"{own}left", left)
    for i, (_, sequence) in enumerate(RULES):
        text = "".join(f",{x}," for x in sequence)
        out = out.withColumn(f"{own}m{i}", F.col(f"{own}left").contains(text)).withColumn(f"{own}left", F.replace(f"{own}left", F.lit(text), F.lit("")))
    held = {name: reduce(lambda a, b: a | b, (F.col(f"{own}m{i}") for i, (other, _) in enumerate(RULES) if other == name)) for name, _ in RULES}
    names = F.array_compact(F.array(*(F.when(m, F.lit(name)) for name, m in held.items())))
    rest = F.replace(F.trim(F.translate(f"{own}left", ",", " ")), F.lit("  "), F.lit(","))
    return out.select(*keep, "n_sentences", "identifiers", F.array_join(names, ",").alias("licenses"), rest.alias("unmatched"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's licence sentences and licences."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    quoted = lambda s: s.replace("'", "''")
    cases = lambda of: " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in of.items())
    speaks = " OR ".join(f"contains(' ' || n || ' ', ' {w} ')" for w in LICENCE_WORDS)
    lower = "translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    plain = f"regexp_replace(replace({lower}, 'licence', 'license'), '[^a-z0-9.]+', ' ', 'g')"
    norm = f"trim(regexp_replace(regexp_replace(regexp_replace({plain}, '\\.([^0-9]|$)', ' \\1', 'g'), '(^|[^0-9])\\.', '\\1 ', 'g'), ' +', ' ', 'g'))"
    goes_on = f"length(trim(x)) >= {WRAP} AND regexp_matches(coalesce(l[i + 1], ''), '[A-Za-z0-9]') AND NOT regexp_matches(x, '{quoted(_ENDS)}') AND NOT contains(x, '{_SPDX_LINE}') AND NOT contains(coalesce(l[i + 1], ''), '{_SPDX_LINE}')"
    tokens = f"string_split(regexp_replace(string_split({lower}, '{_SPDX_LINE.lower()}')[-1], '[^a-z0-9.+-]+', ' ', 'g'), ' ')"
    spdx = f"array_to_string(list_filter(list_transform({tokens}, lambda x: CASE regexp_replace(x, '[.]+$', '') {cases({k: v[1] for k, v in SPDX.items()})} ELSE '' END), lambda x: x <> ''), ',')"
    steps, last = [], "base"
    for i, (_, sequence) in enumerate(RULES):
        text = "".join(f",{x}," for x in sequence)
        steps.append(f"r{i} AS (SELECT * EXCLUDE (l), contains(l, '{text}') AS m{i}, replace(l, '{text}', '') AS l FROM {last})")
        last = f"r{i}"
    names = ", ".join(f"CASE WHEN m{i} THEN '{name}' END" for i, (name, _) in enumerate(RULES))
    order = list(dict.fromkeys(name for name, _ in RULES))
    listed = " || ".join(f"CASE WHEN list_contains(x, '{n}') THEN ',{n}' ELSE '' END" for n in order)
    return f"""
WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
joined AS (SELECT doc_id, array_to_string(list_transform(l, lambda x, i: x || CASE WHEN {goes_on} THEN ' ' ELSE chr(10) END), '') AS t FROM lines),
s AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS all_s FROM joined),
u AS (SELECT doc_id, unnest(all_s) AS s, generate_subscripts(all_s, 1) AS k FROM s),
n AS (SELECT doc_id, k, s, {norm} AS n FROM u WHERE s <> ''),
i AS (
  SELECT doc_id, k, coalesce(
    CASE WHEN contains(s, '{_SPDX_LINE}') THEN nullif({spdx}, '') END, CASE n {cases(SENTENCES)} END,
    CASE WHEN regexp_matches(n, '{_UNDER}') THEN CASE regexp_replace(n, '{_UNDER}', '') {cases(NAMES)} END END, CASE WHEN {speaks} THEN 'unknown' END) AS id FROM n),
g AS (SELECT doc_id, count(*) AS n_sentences, coalesce(string_agg(id, ',' ORDER BY k) FILTER (WHERE id IS NOT NULL), '') AS identifiers FROM i GROUP BY doc_id),
base AS (
  SELECT d.doc_id, coalesce(g.n_sentences, 0) AS n_sentences, coalesce(g.identifiers, '') AS identifiers,
    CASE WHEN coalesce(g.identifiers, '') = '' THEN '' ELSE ',' || replace(g.identifiers, ',', ',,') || ',' END AS l
  FROM documents d LEFT JOIN g USING (doc_id)),
{", ".join(steps)},
z AS (SELECT doc_id, n_sentences, identifiers, [{names}] AS x, l FROM {last})
SELECT doc_id, n_sentences, identifiers, ltrim({listed}, ',') AS licenses, replace(trim(translate(l, ',', ' ')), '  ', ',') AS unmatched FROM z"""


SQL = _sql()
