"""Licence scans by sentence rules, in Spark expressions only.

A text is normalised to words in small letters and split into sentences; a map takes known licence
sentences to identifiers. What is found, in order, is a sequence, and rules are sequences too: at each
place the longest rule that fits names the licence. Sentences that are not known are passed over.
SPDX tags are read as expressions. The tables are fixed and become literals of the plan: no join, no shuffle.

A sentence ends at . ! ? ; : before white space and at a line without words; numbers and letters
that count clauses are no part of it. As headings stand above sentences and lines wrap, a known
sentence is a run of whole lines between two marks: runs are looked up only from lines that open as
some known sentence does. Places for names are slots, so a clause that names an organisation is the
clause. The map is split by the sentences' hashes, so a lookup compares a few of them however many
there are. Two clauses of a licence never stand for three: its rule has the sentence after them.

Edge cases: a null or empty text has no sentences; repeated rows each give a row; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

APACHE, GPL, LGPL, AGPL, LIBRARY = "the apache license version 2 0", "gnu general public license", "gnu lesser general public license", "gnu affero general public license", "gnu library general public license"
REDISTRIBUTE = "you can redistribute it and or modify it under the terms of the"
FOUNDATION = "as published by the free software foundation"
LATER = "or at your option any later version"

#: Known licence sentences, normalised, _ for a name, and the licences that sequences of
#: them make.
SENTENCES = {
    "A02": f"licensed under {APACHE} the license",
    "A03": "you may not use this file except in compliance with the license",
    "A04": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "A05": "see the license for the specific language governing permissions and limitations under the license",
    "B01": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "B02": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "B03": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "B04": "neither the name of _ may be used to endorse or promote products derived from this software",
    "B05": "this software is provided by _ as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "B06": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "B07": "in no event shall _ be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
    "G03": "this program is free software",
    "I01": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "I02": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "K01": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "L01": "this library is free software",
    "M03": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "M04": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "M05": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "P01": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "P02": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "P03": "the contents of this file are subject to the mozilla public license version 1 1 the license",
    "U01": "this is free and unencumbered software released into the public domain",
    "Z01": "this software is provided as is without any express or implied warranty",
    "Z02": "in no event will _ be held liable for any damages arising from the use of this software",
    "Z03": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}
RULES = [
    ("Apache-2.0", "A02 A03 A04 A05"), ("Apache-2.0", "A02 A03"), ("Apache-2.0", "A02"), ("BSD-4-Clause", "B01 B02 B03 B06 B04"), ("BSD-3-Clause", "B01 B02 B03 B04"), ("BSD-2-Clause", "B01 B02 B03 B05"),
    ("ISC", "I01"), ("0BSD", "I02"), ("BSL-1.0", "K01"), ("MIT", "M03 M04"), ("MPL-2.0", "P01 P02"), ("MPL-2.0", "P01"), ("MPL-1.1", "P03"), ("Unlicense", "U01"), ("Zlib", "Z01 Z02 Z03"), ("Zlib", "Z03"),
]
#: Headings of whole licence texts.
TITLES = {
    "Apache-2.0": ("apache license version 2 0 january 2004",), "GPL-2.0-only": (f"{GPL} version 2 june 1991",), "GPL-3.0-only": (f"{GPL} version 3 29 june 2007",), "LGPL-2.0-only": (f"{LIBRARY} version 2 june 1991",),
    "LGPL-2.1-only": (f"{LGPL} version 2 1 february 1999",), "LGPL-3.0-only": (f"{LGPL} version 3 29 june 2007",), "AGPL-3.0-only": (f"{AGPL} version 3 19 november 2007",), "MPL-2.0": ("mozilla public license version 2 0",),
    "MPL-1.1": ("mozilla public license version 1 1",), "EPL-1.0": ("eclipse public license v 1 0",), "EPL-2.0": ("eclipse public license v 2 0",), "BSL-1.0": ("boost software license version 1 0 august 17th 2003",),
    "CC0-1.0": ("cc0 1 0 universal", "creative commons cc0 1 0 universal"), "CC-BY-4.0": ("attribution 4 0 international", "creative commons attribution 4 0 international"), "CC-BY-SA-4.0": ("attribution sharealike 4 0 international",),
    "OFL-1.1": ("sil open font license version 1 1 26 february 2007",), "Artistic-2.0": ("the artistic license 2 0",), "EUPL-1.2": ("european union public licence v 1 2",), "CDDL-1.0": ("common development and distribution license cddl version 1 0",),
    "WTFPL": ("do what the fuck you want to public license version 2 december 2004",), "PSF-2.0": ("python software foundation license version 2",), "MS-PL": ("microsoft public license ms pl",),
}
#: The notices of the GNU licences.
for _i, (_id, _name, _begin, _versions) in enumerate((("GPL", GPL, "G03", ("2", "3")), ("LGPL", LGPL, "L01", ("2 1", "3")), ("AGPL", AGPL, "G03", ("3",)), ("LGPL", LIBRARY, "L01", ("2",)))):
    SENTENCES[f"N{_i}"] = f"{REDISTRIBUTE} {_name} {FOUNDATION}"
    for _v in _versions:
        _k, _full = _v.replace(" ", ""), f"{_id}-{_v.replace(' ', '.') if ' ' in _v else _v + '.0'}"
        SENTENCES[f"V{_k}"], SENTENCES[f"W{_k}"] = f"either version {_v} of the license {LATER}", f"version {_v} of the license"
        SENTENCES[f"N{_i}V{_k}"] = f"{SENTENCES[f'N{_i}']} {SENTENCES[f'V{_k}']}"
        SENTENCES[f"N{_i}W{_k}"] = f"{SENTENCES[f'N{_i}']} {SENTENCES[f'W{_k}']}"
        SENTENCES[f"N{_i}X{_k}"] = f"{REDISTRIBUTE} {_name} version {_v} {FOUNDATION}"
        for _kind, _last in (("or-later", "V"), ("only", "W"), ("only", "X")):
            RULES += [(f"{_full}-{_kind}", f"{_begin} N{_i}{_last}{_k}"), *([] if _last == "X" else [(f"{_full}-{_kind}", f"{_begin} N{_i} {_last}{_k}")])]
#: How short statements begin, and the names that licences have in them.
STATEMENTS = ("licensed under", "released under", "distributed under", "available under", *(f"this {what} is {how} under" for what in ("project", "work", "software") for how in ("licensed", "released")))
NAMES = {
    "MIT": ("the mit license", "mit license"), "Apache-2.0": (APACHE, "apache license 2 0", "the apache license 2 0", "apache 2 0"), "BSD-2-Clause": ("the bsd 2 clause license",), "BSD-3-Clause": ("the bsd 3 clause license",),
    "ISC": ("the isc license",), "Unlicense": ("the unlicense",), "MPL-2.0": ("the mozilla public license version 2 0", "the mozilla public license 2 0"), "MPL-1.1": ("the mozilla public license version 1 1",),
    "GPL-2.0-only": (f"the {GPL} version 2", "the gpl version 2", "gplv2", "the gplv2"), "GPL-3.0-only": (f"the {GPL} version 3", "the gpl version 3", "gplv3", "the gplv3"), "LGPL-2.1-only": (f"the {LGPL} version 2 1",), "LGPL-3.0-only": (f"the {LGPL} version 3",),
    "AGPL-3.0-only": (f"the {AGPL} version 3",), "BSL-1.0": ("the boost software license version 1 0",), "Zlib": ("the zlib license",), "EPL-2.0": ("the eclipse public license 2 0", "the eclipse public license v 2 0"),
    "CC-BY-4.0": ("cc by 4 0", "a creative commons attribution 4 0 international license"), "CC-BY-SA-4.0": ("cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license"), "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "a creative commons attribution noncommercial sharealike 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "a creative commons attribution noderivatives 4 0 international license"), "CC0-1.0": ("cc0 1 0",),
}
for _i, (_name, _said) in enumerate(NAMES.items()):
    for _k, _form in enumerate(_said):
        for _j, _start in enumerate(STATEMENTS):
            SENTENCES[f"S{_i:02}{_k}{_j}"] = f"{_start} {_form}"
            RULES.append((_name, f"S{_i:02}{_k}{_j}"))
for _i, (_name, _said) in enumerate(TITLES.items()):
    for _k, _form in enumerate(_said):
        SENTENCES[f"T{_i:02}{_k}"] = _form
        RULES.append((_name, f"T{_i:02}{_k}"))
#: Identifiers of SPDX expressions; others are kept as they are written.
SPDX = sorted({*NAMES, *TITLES, *(name for name, _ in RULES), "GPL-1.0-only", "MIT-0", "X11", "PostgreSQL", "NCSA", "EUPL-1.1", "CC-BY-3.0", "CC-BY-SA-3.0", "Artistic-1.0", "Python-2.0", "W3C"})

#: Names in sentences: what opens a clause and what closes it, and the clause with its slot.
SLOTS = (
    (r"^(?:neither the names?|the names?|no names?) .{1,400}? to endorse or promote products derived from th.*$", SENTENCES["B04"]),
    (r"^this software is provided by .{1,200}? as is and any (?:express or implied|expressed or implied) warranties", "this software is provided by _ as is and any express or implied warranties"),
    (r"^in no event (shall|will) .{1,200}? be (liable for any direct|held liable)", "in no event $1 _ be $2"),
)
#: Each known sentence holds one of these; a text with none of them is not read at all.
HINTS = ("licen", "software", "redistribut", "copyright", "mpl", "gpl", "cc0", "cc by", "attribution", "apache", "unlicense")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK, BREAK = "\x01", "\x02"
#: Sentence marks and line breaks become control characters; `v. 2` and `Inc. and` end none.
STEPS = (
    (r"\b(v|inc|ltd|corp|llc)\. ?(?=[0-9a-z])", "$1 "),
    (r"\bco\. ", "co "),
    (r"(^|\n)[^a-z0-9\n]*(?:[0-9]{1,2}|[a-h])[.)][ \t]+(?=[a-z])", "$1"),
    (r"[.!?;:][ \t\r\n]+", MARK),
    (rf"\n[^a-z0-9\n{MARK}]*\n", MARK),
    (r"\n", BREAK),
    (rf"[^a-z0-9{MARK}{BREAK}]+", " "),
    (rf" *([{MARK}{BREAK}]) *", "$1"),
    (rf"{BREAK}{{2,}}", BREAK),
    (rf"{BREAK}*{MARK}{BREAK}*", MARK),
)
#: A known sentence takes as many lines as it has words at most.
LINES = max(len(s.split()) for s in SENTENCES.values()) + 200
BUCKETS = 64


def opening(sentence: str) -> str:
    return " ".join(sentence.split()[:2])


#: How clauses open, beside the known sentences' own two first words, before their slots are found.
OPENINGS = sorted({*map(opening, SENTENCES.values()), "the name", "the names", "neither the", "no name", "no names"})


def longest_first() -> list[tuple[str, str]]:
    return sorted(RULES, key=lambda r: (-len(r[1]), r[1]))


def rule_pattern() -> str:
    """Alternation of the rules' sequences, longest first, each identifier ended by a space."""
    return "|".join(f"{ids} " for _, ids in longest_first())


def normalised(text: Column) -> Column:
    """Words of a text, MARK between sentences and BREAK where a line breaks."""
    out = F.translate(text, f"{UPPER}{MARK}{BREAK}", LOWER)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def lookup(pairs: list[tuple[str, str]], key: Column) -> Column:
    """The value of a key among constants, in buckets by the key's hash."""
    import xxhash

    buckets: list[list[tuple[str, str]]] = [[] for _ in range(BUCKETS)]
    for k, v in pairs:
        signed = (xxhash.xxh64_intdigest(k.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
        buckets[signed % BUCKETS].append((k, v))
    maps = F.array(*(F.create_map(*(F.lit(x) for kv in b for x in kv)) if b else F.create_map().cast("map<string,string>") for b in buckets))
    return F.try_element_at(F.get(maps, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")), key)


def with_slots(run: Column) -> Column:
    for pattern, to in SLOTS:
        run = F.regexp_replace(run, pattern, to)
    return run


def known(read: Column) -> Column:
    """Identifiers of the known sentences in a normalised text, in order.

    Of the runs of lines that begin at a line the longest known one counts, and none inside of one
    that began before.
    """
    sentences = [(s, i) for i, s in SENTENCES.items()]
    opens = "|".join(o.replace(" ", f"[ {BREAK}]") for o in OPENINGS)
    told = F.filter(F.split(read, MARK), lambda s: F.rlike(s, F.lit(f"(?:^|{BREAK})(?:{opens})(?:[ {BREAK}]|$)")))

    def of_segment(lines: Column) -> Column:
        last = F.size(lines) - 1
        run = lambda i, j: F.array_join(F.slice(lines, i + 1, j - i + 1), " ")
        named = lambda i, j: F.struct(i.alias("i"), j.alias("j"), lookup(sentences, with_slots(run(i, j))).alias("id"))
        longest = lambda i: F.try_element_at(F.filter(F.transform(F.sequence(i, F.least(i + LINES, last)), lambda j: named(i, j)), lambda x: x["id"].isNotNull()), F.lit(-1))
        starts = F.filter(F.sequence(F.lit(0), last), lambda i: F.rlike(run(i, F.least(i + 1, last)), F.lit(f"^(?:{'|'.join(OPENINGS)})(?: |$)")))
        found = F.array_compact(F.transform(starts, longest))
        return F.transform(F.array(found), lambda all_: F.transform(F.filter(all_, lambda x: ~F.exists(all_, lambda y: (y["i"] < x["i"]) & (x["i"] <= y["j"]))), lambda x: x["id"]))[0]

    return F.flatten(F.transform(told, lambda s: F.flatten(F.transform(F.array(F.split(s, BREAK)), of_segment))))


def licences(ids: Column) -> Column:
    """Licences that a sequence of identifiers makes, in order."""
    sequence = F.array_join(F.transform(ids, lambda i: F.concat(i, F.lit(" "))), "")
    return F.transform(F.regexp_extract_all(sequence, F.lit(f"({rule_pattern()})"), F.lit(1)), lambda m: lookup([(f"{ids} ", name) for name, ids in RULES], m))


def expressions(text: Column) -> Column:
    """The licences, and exceptions after WITH, of a text's SPDX tags, in order."""
    tags = F.regexp_extract_all(text, F.lit(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)"), F.lit(1))
    names = F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9.+-]+)"), F.lit(1))))
    words = F.filter(names, lambda n: ~n.isin("AND", "OR", "WITH", "and", "or", "with") & F.rlike(n, F.lit("[A-Za-z0-9]")))
    return F.transform(words, lambda n: F.coalesce(lookup([(s.lower(), s) for s in SPDX], F.lower(n)), n))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids and licences, arrays in the order of the text, those of SPDX tags last."""
    text = text_or_empty()
    hinted = F.rlike(text, F.lit("(?i)" + "|".join(HINTS).replace(" ", "[^a-z0-9]+")))
    empty = F.array().cast("array<string>")
    found = docs.select("doc_id", F.when(hinted, known(normalised(text))).otherwise(empty).alias("sentence_ids"), F.when(hinted, expressions(text)).otherwise(empty).alias("tagged"))
    return found.select("doc_id", "sentence_ids", F.concat(licences(F.col("sentence_ids")), "tagged").alias("licences"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", " ").alias("sentence_ids"),
        F.size("licences").cast("long").alias("n_licences"),
        F.array_join("licences", ";").alias("licences"),
    )


def _values(rows) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join(f"({', '.join(map(quoted, row))})" for row in rows)


#: The tables are the operator's; normalisation, slots and the choice of runs are told anew, in joins.
OP8_SQL = rf"""
WITH sentence(said, id) AS ({_values((s, i) for i, s in SENTENCES.items())}),
spdx(small, name) AS ({_values((s.lower(), s) for s in SPDX)}),
opens(said) AS ({_values((o,) for o in OPENINGS)}),
lowered AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}' || chr(1) || chr(2), '{LOWER}') AS t FROM documents),
shortened AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\b(v|inc|ltd|corp|llc)\. ?([0-9a-z])', '\1 \2', 'g'), '\bco\. ', 'co ', 'g') AS t FROM lowered),
unnumbered AS (SELECT doc_id, regexp_replace(t, '(^|\n)[^a-z0-9\n]*([0-9][0-9]?|[a-h])[.)][ \t]+([a-z])', '\1\3', 'g') AS t FROM shortened),
marked AS (SELECT doc_id, string_split_regex(regexp_replace(t, '[.!?;:][ \t\r\n]+', chr(1), 'g'), '\x01|\n[^a-z0-9\n\x01]*\n') AS s FROM unnumbered),
segmented AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS k FROM marked),
lined AS (SELECT doc_id, k, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS l FROM segmented),
begun AS (SELECT doc_id, k, l, unnest(range(1, len(l) + 1)) AS i FROM lined),
starts AS (SELECT doc_id, k, l, i FROM begun WHERE array_to_string(string_split(array_to_string(l[i : i + 1], ' '), ' ')[1 : 2], ' ') IN (SELECT said FROM opens)),
ended AS (SELECT *, unnest(range(i, least(i + {LINES}, len(l)) + 1)) AS j FROM starts),
runs AS (SELECT doc_id, k, i, j, array_to_string(l[i : j], ' ') AS r FROM ended),
slotted AS (SELECT doc_id, k, i, j, CASE
  WHEN regexp_matches(r, '^(neither the names?|the names?|no names?) .+ to endorse or promote products derived from th') THEN '{SENTENCES["B04"]}'
  WHEN r LIKE 'this software is provided by %' THEN regexp_replace(r, '^this software is provided by .*? as is and any express(ed)? or implied', 'this software is provided by _ as is and any express or implied')
  WHEN r LIKE 'in no event %' THEN regexp_replace(r, '^in no event (shall|will) .*? be (held liable|liable for any direct)', 'in no event \1 _ be \2') ELSE r END AS r FROM runs),
longest AS (SELECT doc_id, k, i, max(j) AS j, arg_max(id, j) AS id FROM slotted JOIN sentence ON r = said GROUP BY doc_id, k, i),
kept AS (SELECT * FROM longest a WHERE NOT EXISTS (FROM longest b WHERE a.doc_id = b.doc_id AND a.k = b.k AND b.i < a.i AND a.i <= b.j)),
named AS (SELECT doc_id, list(id ORDER BY k, i) AS ids FROM kept GROUP BY doc_id),
tags AS (SELECT doc_id, regexp_extract_all(text, 'SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)', 1) AS g FROM documents),
tag AS (SELECT doc_id, unnest(g) AS tag, generate_subscripts(g, 1) AS o FROM tags),
parts AS (SELECT doc_id, o, list_filter(string_split_regex(tag, '[ \t()]+'), lambda x: x NOT IN ('', 'AND', 'OR', 'WITH', 'and', 'or', 'with') AND regexp_matches(x, '[A-Za-z0-9]')) AS w FROM tag),
part AS (SELECT doc_id, o, unnest(w) AS n, generate_subscripts(w, 1) AS p FROM parts),
tagged AS (SELECT doc_id, list(coalesce(name, n) ORDER BY o, p) AS names FROM part LEFT JOIN spdx ON small = lower(n) GROUP BY doc_id),
ruled AS (SELECT d.doc_id, coalesce(n.ids, []) AS ids, coalesce(t.names, []) AS by_tag, list_transform(regexp_extract_all(array_to_string(list_transform(coalesce(n.ids, []), lambda i: i || ' '), ''), '{rule_pattern()}'),
  lambda m: (map_from_entries([{", ".join(f"('{ids} ', '{name}')" for name, ids in RULES)}]))[m]) AS by_rule
  FROM documents d LEFT JOIN named n USING (doc_id) LEFT JOIN tagged t USING (doc_id))
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ' ') AS sentence_ids, (len(by_rule) + len(by_tag))::BIGINT AS n_licences, array_to_string(list_concat(by_rule, by_tag), ';') AS licences FROM ruled
"""
