"""Licence scans by sentence rules, in DataFrame operations only.

A text is cut into sentences at sentence ends and blank lines; a line break within a sentence is white space, as are
comment marks and bullets around it. A sentence is normalised (lower case, runs of anything but letters and digits
become one space, "licence" is spelt "license") and looked up among known licence sentences, then among patterns for
those that name their owner. Of a sentence that isn't known, its lines and its ends that begin with
a line are looked up, so that titles and notices without a full stop are found too; words that open known sentences
begin a line there. The identifiers found, in text
order, form a sequence, and ordered rules are matched against it: a rule names a licence by a run of identifiers, and
takes its run out of the sequence, so that a later, shorter rule doesn't count it again. Sentences that speak of
licences but aren't known are counted, as are known ones that no rule took.

Defined cases: null and empty texts have no sentences; a licence named twice is reported once; repeated rows are
scanned alike; an empty table gives an empty result; extra columns stay out; texts are read whole, however long; a
sentence that two entries know has the first one's identifier. Not found: a known sentence over several lines that
other text without a full stop follows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import let


def plain(sentence: str) -> str:
    """A sentence as it is looked up."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip().replace("licence", "license")


_GNU = (("Gpl", "GNU General Public License", ("2", "3")), ("Lgpl", "GNU Lesser General Public License", ("2.1", "3")), ("Lgpl", "GNU Library General Public License", ("2",)), ("Agpl", "GNU Affero General Public License", ("3",)))
#: Identifiers that may be named as such.
_SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "MPL-2.0", "EPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0") + tuple(
    f"{name}-{v}{end}" for name, versions in (("GPL", ("2.0", "3.0")), ("LGPL", ("2.1", "3.0")), ("AGPL", ("3.0",))) for v in versions for end in ("", "-only", "-or-later")
)


def _gnu_sentences() -> list[tuple[str, str]]:
    """Titles, names and notices of the GNU licences, by family and version."""
    out = []
    for key, name, versions in _GNU:
        out += [(f"{key}Terms", f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"), (f"{key}Name", f"licensed under the {name}")]
        out += [("GnuSee", f"see the {name} for more details"), ("GnuCopy", f"you should have received a copy of the {name} along with this program")]
        for v in versions:
            n = v.replace(".", "")
            later, either = f"{key}{n}Later", f"either version {v} of the License, or (at your option) any later version"
            out += [(later, f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {either}"), (f"Either{n}", either)]
            out += [(f"{key}{n}Only", f"you can redistribute it and/or modify it under the terms of the {name} {x}") for x in (f"version {v} as published by the Free Software Foundation", f"as published by the Free Software Foundation, version {v}")]
            out += [(f"{key}{n}Name", f"{start}licensed under the {name}{x} {v}") for start in ("", "this work is ", "this program is ", "this project is ") for x in (" version", " v")]
            out += [(f"{key}{n}Title", f"{name} version {v}")]
        out.append((f"{key}Title", name))
    out += [("Gpl3Title", "GNU General Public License version 3, 29 June 2007"), ("Lgpl3Title", "GNU Lesser General Public License version 3, 29 June 2007")]
    out += [("Gpl2Title", "GNU General Public License version 2, June 1991"), ("Agpl3Title", "GNU Affero General Public License version 3, 19 November 2007")]
    return out


#: Identifiers of known licence sentences and their text.
_SENTENCES = (
    ("ApacheVer2", "Licensed under the Apache License, Version 2.0"),
    ("ApacheVer2", "Licensed under the Apache License, Version 2.0 (the License)"),
    ("ApacheTitle", "Apache License"),
    ("ApacheTitle", "Apache License Version 2.0, January 2004"),
    ("ApacheTitle", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("ApacheNotUse", "you may not use this file except in compliance with the License"),
    ("ApacheCopyAt", "You may obtain a copy of the License at"),
    ("ApacheCopyAt", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheCopyAt", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheUrl", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheUrl", "https://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheAsIs", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("ApacheSee", "See the License for the specific language governing permissions and limitations under the License"),
    ("MitName", "released under the MIT license"),
    ("MitName", "licensed under the MIT license"),
    ("MitName", "this project is licensed under the MIT license"),
    ("MitName", "this software is released under the MIT license"),
    ("MitTitle", "MIT License"),
    ("MitTitle", "The MIT License"),
    ("MitTitle", "The MIT License (MIT)"),
    ("MitGrant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MitGrant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("Mit0Grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("MitNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MitNotice", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    ("IscTitle", "ISC License"),
    ("IscName", "licensed under the ISC license"),
    ("IscGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("IscGrant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ZeroBsdGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("IscAsIs", "The software is provided AS IS and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("BsdRedist", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BsdSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BsdBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BsdAdvert", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BsdName", "licensed under the BSD license"),
    ("Bsd2Name", "licensed under the BSD 2-Clause license"),
    ("Bsd3Name", "licensed under the BSD 3-Clause license"),
    ("Bsd2Title", "BSD 2-Clause License"),
    ("Bsd3Title", "BSD 3-Clause License"),
    ("MplForm", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),  # the full stop after v ends the sentence
    ("MplForm", "This Source Code Form is subject to the terms of the Mozilla Public License, v2.0"),
    ("MplForm", "This Source Code Form is subject to the terms of the Mozilla Public License, v 2.0"),
    ("MplForm", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("MplName", "licensed under the Mozilla Public License, version 2.0"),
    ("MplTitle", "Mozilla Public License Version 2.0"),
    ("EplTerms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CcByNc4", "licensed under CC BY-NC 4.0"),
    ("CcBy4", "licensed under CC BY 4.0"),
    ("CcBySa4", "licensed under CC BY-SA 4.0"),
    ("CcByNc4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CcBy4", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CcBySa4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("Cc0Name", "released under CC0"),
    ("Cc0Name", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("PublicDomain", "This work is in the public domain"),
    ("AllRights", "All rights reserved"),
    ("Proprietary", "This document is proprietary and confidential"),
)
SENTENCES = tuple((name, plain(s)) for name, s in (*_SENTENCES, *_gnu_sentences(), *((f"Spdx:{x}", f"SPDX-License-Identifier {x}") for x in _SPDX)))
#: Identifiers of known sentences that name their owner, as patterns of the normalised sentence.
PATTERNS = (
    ("Copyright", "^(portions )?copyright (c |copyright )*([0-9]{4}|by |the )"),
    ("BsdNoEndorse", "^(neither the names? of .* )?nor the names of (its|their|any|other|contributors) .*be used to endorse or promote products derived from this software without (specific )?prior written permission$"),
    ("BsdNoEndorse", "^(neither )?the names? of .* may (not )?be used to endorse or promote products derived from this software without (specific )?prior written permission$"),
    ("BsdAsIs", "^this software is provided (by .* )?as is and any express or implied warranties .*are disclaimed$"),
    ("BsdLiable", "^in no event shall .*be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("MitAsIs", "^the software is provided as is without warranty of any kind express or implied( including but not limited to .*)?$"),
    ("MitLiable", "^in no event shall .*be liable for any claim damages or other liability"),
    ("IscLiable", "^in no event shall .*be liable for any special direct indirect or consequential damages or any damages whatsoever"),
    ("GnuNoWarranty", "^(this|the) (program|library|software|file) is distributed in the hope that it will be useful but without any warranty$"),
    ("GnuImplied", "^without even the implied warranty of merchantability or fitness for a particular purpose$"),
    ("GnuSee", "^see the gnu .*general public license for more details$"),
    ("GnuCopy", "^you should have received a copy of the gnu .*general public license( |$)"),
)


def _gnu_rules() -> list[tuple[str, tuple[str, ...]]]:
    """Of each family and version, its notice with what commonly follows, the notice alone, its title, its name."""
    out: dict[tuple[str, tuple[str, ...]], None] = {}
    rest = ("GnuNoWarranty", "GnuImplied", "GnuSee", "GnuCopy")
    for key, _, versions in _GNU:
        for v in versions:
            n, name = v.replace(".", ""), f"{key.upper()}-{v if '.' in v else v + '.0'}"
            for licence, run in ((f"{name}-or-later", (f"{key}{n}Later",)), (f"{name}-or-later", (f"{key}Terms", f"Either{n}")), (f"{name}-only", (f"{key}{n}Only",))):
                for k in (4, 3, 0):
                    out[licence, (*run, *rest[:k])] = None
            out[name, (f"{key}{n}Title",)] = out[name, (f"{key}{n}Name",)] = None
    for key, _, _ in _GNU:
        out |= {(key.upper(), (f"{key}{x}",)): None for x in ("Terms", "Name", "Title")}
    return list(out)


#: Licence and the run of identifiers that names it; longer runs stand before the shorter ones in them.
RULES = (
    ("Apache-2.0", ("ApacheVer2", "ApacheNotUse", "ApacheCopyAt", "ApacheUrl", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheVer2", "ApacheNotUse", "ApacheCopyAt", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheVer2", "ApacheNotUse", "ApacheAsIs")),
    ("Apache-2.0", ("ApacheVer2", "ApacheNotUse")),
    ("Apache-2.0", ("ApacheVer2",)),
    ("Apache-2.0", ("ApacheTitle",)),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs", "MitLiable")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("MIT-0", ("Mit0Grant", "MitAsIs", "MitLiable")),
    ("MIT-0", ("Mit0Grant",)),
    ("MIT", ("MitGrant",)),
    ("MIT", ("MitTitle",)),
    ("MIT", ("MitName",)),
    ("ISC", ("IscGrant", "IscAsIs", "IscLiable")),
    ("ISC", ("IscGrant",)),
    ("ISC", ("IscTitle",)),
    ("ISC", ("IscName",)),
    ("0BSD", ("ZeroBsdGrant", "IscAsIs", "IscLiable")),
    ("0BSD", ("ZeroBsdGrant",)),
    ("BSD-4-Clause", ("BsdRedist", "BsdSource", "BsdBinary", "BsdAdvert", "BsdNoEndorse", "BsdAsIs", "BsdLiable")),
    ("BSD-4-Clause", ("BsdRedist", "BsdSource", "BsdBinary", "BsdAdvert")),
    ("BSD-3-Clause", ("BsdRedist", "BsdSource", "BsdBinary", "BsdNoEndorse", "BsdAsIs", "BsdLiable")),
    ("BSD-3-Clause", ("BsdRedist", "BsdSource", "BsdBinary", "BsdNoEndorse")),
    ("BSD-2-Clause", ("BsdRedist", "BsdSource", "BsdBinary", "BsdAsIs", "BsdLiable")),
    ("BSD-2-Clause", ("BsdRedist", "BsdSource", "BsdBinary")),
    ("BSD", ("BsdRedist",)),
    ("BSD-3-Clause", ("Bsd3Title",)),
    ("BSD-3-Clause", ("Bsd3Name",)),
    ("BSD-2-Clause", ("Bsd2Title",)),
    ("BSD-2-Clause", ("Bsd2Name",)),
    ("BSD", ("BsdName",)),
    *_gnu_rules(),
    ("MPL-2.0", ("MplForm",)),
    ("MPL-2.0", ("MplName",)),
    ("MPL-2.0", ("MplTitle",)),
    ("EPL-2.0", ("EplTerms",)),
    ("Unlicense", ("Unlicense",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("CC0-1.0", ("Cc0Name",)),
    ("Public-Domain", ("PublicDomain",)),
    ("Proprietary", ("Proprietary",)),
    *((x, (f"Spdx:{x}",)) for x in _SPDX),
)
#: A sentence that has none of these is neither known nor counted, as long as each known sentence has one.
CUES = "licen[sc]e|copyright|permission|redistribut|warrant|public domain|rights reserved|proprietary|under cc|liable|advertising materials"
_CUT = "[.!?;:]+[ \\t-\\r]+|\\r?\\n[ \\t]*[-#*/;%!]*[ \\t]*\\r?\\n"
_LINES = "[\\n\\r]+"
#: Words that begin a known sentence wherever they stand; a line is made of them in a sentence that isn't known.
_OPENINGS = "(?i)[^a-z0-9]((?:permission is hereby|permission to use|redistribution and use|redistributions (?:of|in)|licensed under|released under|the above copyright|(?:the|this) software is provided|unless required by|neither the name|this work is|this source code form))"
#: A colon that ends no sentence.
_LABEL = "License-Identifier"


def normalised(sentence: Column) -> Column:
    return F.replace(F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " ")), F.lit("licence"), F.lit("license"))


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), sentences=SENTENCES, rules=RULES, cues: str = CUES, patterns=PATTERNS) -> DataFrame:
    """`keep`, sentence_ids array<string>, licenses array<string> (in order of the rules), n_known, n_unclaimed, n_unknown long.

    One pass without a shuffle; the tables of sentences, patterns and rules are literals of the plan. If a sentence of the caller's
    has no cue, all sentences of a text are looked up (n_unknown still counts those with a cue).
    """
    sentences = tuple((name, plain(s)) for name, s in sentences)
    table = dict(reversed([(s, name) for name, s in sentences]))
    known = F.create_map(*[F.lit(x) for s, name in table.items() for x in (s, name)])
    longest = max((len(s.split()) for s in table), default=1)
    no_ids = F.expr("cast(array() as array<string>)")

    def name_of(s: Column) -> Column:
        found = F.lit(None).cast("string")
        for name, pattern in reversed(patterns):
            found = F.when(s.rlike(pattern), name).otherwise(found)
        return F.coalesce(known[s], found)

    def parts(lines: Column) -> Column:
        """Identifiers of lines, or of the end that begins with one; such an end has at most as many lines as a sentence has words."""
        n = F.size(lines)  # of a bound variable
        end = lambda i: F.when((i > 0) & (n - i <= longest), known[F.array_join(F.slice(lines, i + 1, n), " ")])
        return F.filter(F.transform(lines, lambda line, i: F.coalesce(end(i), name_of(line))), lambda x: x.isNotNull())

    def ids_of(s: Column) -> Column:
        lines = F.filter(F.transform(F.split(F.regexp_replace(s, _OPENINGS, "\n$1"), _LINES, -1), normalised), lambda x: x != "")
        in_parts = let(lines, lambda x: F.when(F.size(x) > 1, parts(x)).otherwise(no_ids))
        return let(let(normalised(s), name_of), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(in_parts))

    cut = F.split(F.replace(F.col(text_col), F.lit(f"{_LABEL}:"), F.lit(_LABEL)), _CUT, -1)
    has_cue = lambda s: F.lower(s).rlike(cues)
    if all(re.search(cues, s) for s in table):
        cut = F.filter(cut, has_cue)
    found = F.transform(cut, lambda s: F.struct(ids_of(s).alias("ids"), has_cue(s).alias("cue")))
    base = docs.select(*keep, F.coalesce(found, F.expr("cast(array() as array<struct<ids:array<string>,cue:boolean>>)")).alias("__said"))
    unknown = F.size(F.filter("__said", lambda s: s["cue"] & (F.size(s["ids"]) == 0))).cast("long")
    base = base.select(*keep, unknown.alias("__n"), F.flatten(F.transform("__said", lambda s: s["ids"])).alias("sentence_ids"))
    runs = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",".join(run) + ",").alias("run")) for name, run in rules])
    # each identifier stands between commas of its own, so that taken runs leave a mark that no later run spans
    start = F.struct(F.concat(F.lit(","), F.array_join("sentence_ids", ",,"), F.lit(",")).alias("seq"), no_ids.alias("found"))

    def match(acc: Column, rule: Column) -> Column:
        run = F.replace(rule["run"], F.lit(","), F.lit(",,"))
        run = F.substring(run, F.lit(2), F.length(run) - 2)
        return F.struct(F.replace(acc["seq"], run, F.lit("/")).alias("seq"), F.when(F.contains(acc["seq"], run), F.array_union(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"))

    done = F.when(F.size("sentence_ids") > 0, F.aggregate(runs, start, match)).otherwise(F.struct(F.lit("").alias("seq"), no_ids.alias("found")))
    left = F.size(F.filter(F.split("__done.seq", "[,/]+"), lambda x: x != "")).cast("long")
    return base.withColumn("__done", done).select(
        *keep, "sentence_ids", F.col("__done.found").alias("licenses"), F.size("sentence_ids").cast("long").alias("n_known"), left.alias("n_unclaimed"), F.col("__n").alias("n_unknown")
    )


def summary(scanned: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return scanned.select(*keep, F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "n_known", "n_unclaimed", "n_unknown")


def oracle(sentences=SENTENCES, rules=RULES, cues: str = CUES, patterns=PATTERNS) -> str:
    """The same scan as DuckDB SQL: candidates as rows, a join with the known sentences, a recursion over the ordered rules."""
    table = dict(reversed([(s, name) for name, s in sentences]))
    longest = max(len(s.split()) for s in table)
    values = ", ".join(f"('{s}', '{name}')" for s, name in table.items())
    by_pattern = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{name}'" for name, p in patterns) + " END"
    norm = "replace(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), 'licence', 'license')"
    ordered = ", ".join(f"({i}, '{name}', ',{',,'.join(run)},')" for i, (name, run) in enumerate(rules))
    return f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(replace(coalesce(text, ''), '{_LABEL}:', '{_LABEL}'), '{_CUT}'), lambda s: regexp_matches(lower(s), '{cues}')) AS said FROM documents),
sentences AS (SELECT r, generate_subscripts(said, 1) AS k, unnest(said) AS s FROM docs),
cut AS (SELECT r, k, {norm.format("s")} AS s, list_filter(list_transform(regexp_split_to_array(regexp_replace(s, '{_OPENINGS}', chr(10) || '\\1', 'g'), '{_LINES}'), lambda l: {norm.format("l")}), lambda l: l <> '') AS lines FROM sentences),
known(s, name) AS (VALUES {values}),
whole AS (SELECT r, k, lines, coalesce(name, {by_pattern.replace("(s,", "(cut.s,")}) AS name FROM cut LEFT JOIN known ON cut.s = known.s),
rows_ AS (SELECT r, k, generate_subscripts(lines, 1) AS i, unnest(lines) AS s, lines FROM whole WHERE name IS NULL AND len(lines) > 1),
parts AS (SELECT r, k, i, coalesce(e.name, f.name, {by_pattern.replace("(s,", "(rows_.s,")}) AS name FROM rows_ LEFT JOIN known f ON rows_.s = f.s
  LEFT JOIN known e ON i > 1 AND len(lines) - i < {longest} AND e.s = array_to_string(lines[i:], ' ')),
ids AS (SELECT r, k, 0 AS i, name FROM whole WHERE name IS NOT NULL UNION ALL SELECT * FROM parts WHERE name IS NOT NULL),
listed AS (SELECT r, list(name ORDER BY k, i) AS ids, count(DISTINCT k) AS said FROM ids GROUP BY r),
rules(step, name, run) AS (VALUES {ordered}),
folded AS (SELECT r, 0 AS step, ',' || array_to_string(ids, ',,') || ',' AS seq, CAST([] AS VARCHAR[]) AS found FROM listed UNION ALL
  SELECT r, folded.step + 1, replace(seq, run, '/'), CASE WHEN contains(seq, run) AND NOT list_contains(found, name) THEN list_append(found, name) ELSE found END FROM folded JOIN rules ON rules.step = folded.step)
SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(found, ','), '') AS licenses, coalesce(len(ids), 0)::BIGINT AS n_known,
       coalesce(len(list_filter(regexp_split_to_array(seq, '[,/]+'), lambda x: x <> '')), 0)::BIGINT AS n_unclaimed, (len(docs.said) - coalesce(listed.said, 0))::BIGINT AS n_unknown
FROM docs LEFT JOIN listed USING (r) LEFT JOIN folded ON folded.r = docs.r AND step = {len(rules)}
"""
