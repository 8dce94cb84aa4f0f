"""License scans by recognising sentences.

Each sentence that speaks of licensing is normalised and mapped to the
identifier of a known licence sentence, or to ``UNKNOWN``. The identifiers of a
document, in order, are matched against ordered rules: a rule names a licence
by a sequence of identifiers; rules are tried from the most specific on, and a
match uses up its identifiers.

Between the sentences of a rule there may be copyright notices and sentences
that are not known, but no sentence of another licence.

Defined cases: null and empty texts have no sentences; an empty table gives no
rows; a document may name several licences, or one twice; sentences may be
wrapped over lines and carry comment marks; texts of any length are read whole;
ties between rules go to the earlier rule; rows that repeat or share an id are
scanned each; other columns are not read, so none can clash.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"
#: Substrings of sentences that may be about licensing (lower case).
TRIGGERS = ("licens", "licenc", "copyright", "permission", "redistribut", "warrant", "public domain", "liable", "rights reserved", "endorse")
#: Substrings of known sentences that have none of these; alone they make no sentence one about licensing.
ALSO = ("origin of this software", "copies of the work", "do what the")
#: Known sentences as patterns over normalised text.
SENTENCES: list[tuple[str, str]] = [
    ("spdx", r"spdx license identifier (?P<name>[a-z0-9.+ ]+)"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files\b.*"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-warranty", r"the software is provided as is without warranty of any kind express or implied\b.*"),
    ("mit-liability", r"in no event shall the authors or copyright holders be liable\b.*"),
    ("mit-ref", r"(?:this \w+ is |\w+ is )?(?:released|licensed|distributed|available) under (?:the )?mit license"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that\b.*"),
    ("isc-warranty", r"the software is provided as is and the author disclaims all warranties\b.*"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted\b.*"),
    ("bsd-source", r"(?:\d )?redistributions of source code must retain\b.*"),
    ("bsd-binary", r"(?:\d )?redistributions in binary form must reproduce\b.*"),
    ("bsd-endorse", r"(?:\d )?neither the name of\b.*\bmay be used to endorse or promote products\b.*"),
    ("bsd-warranty", r"this software is provided by\b.*\bas is\b.*"),
    ("bsd-ref", r"(?:this \w+ is |\w+ is )?(?:released|licensed|distributed) under (?:the )?(?:(?P<name>[23]) clause )?bsd license"),
    ("apache2-ref", r"(?:this \w+ is |\w+ is )?(?:released|licensed|distributed) under (?:the )?apache license version 2\.0(?: the license)?"),
    ("apache2-use", r"you may not use this file except in compliance with the license"),
    ("apache2-copy", r"you may obtain a copy of the license at\b.*"),
    ("apache2-warranty", r"unless required by applicable law or agreed to in writing software distributed under the license\b.*"),
    ("gpl-header", r"this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu (?P<name>(?:lesser |affero |)general public license(?: as published by the free software foundation)?(?:(?: either)? version [\d.]+)?(?: of the license)?(?: as published by the free software foundation)?(?: or at your option any later version)?)\b.*"),
    ("gpl-ref", r"(?:this \w+ is |\w+ is )?(?:released|licensed|distributed) under (?:the )?(?:terms of the )?gnu (?P<name>(?:lesser |affero |)general public license(?: version [123](?:\.\d)?)?(?: or later)?)"),
    ("mpl-ref", r"this source code form is subject to the terms of the mozilla public license v 2\.0"),
    ("cc-ref", r"(?:this \w+ is |\w+ is )?(?:released|licensed|distributed|available) under (?:a |the )?(?:creative commons |cc )(?P<name>by(?: nc)?(?: sa| nd)? \d\.\d|0(?: \d\.\d)?)"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", r"(?:this \w+ is )?(?:placed |released )?in(?:to)? the public domain"),
    ("apache2-title", r"(?:apache license )?version 2\.0 january 2004\b.*"),
    ("apache2-copyright", r"(?:2 )?grant of copyright license subject to the terms and conditions of this license each contributor hereby grants\b.*|subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license\b.*"),
    ("apache2-patent", r"(?:3 )?grant of patent license subject to the terms and conditions of this license each contributor hereby grants\b.*|subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:except as stated in this section )?patent license\b.*"),
    ("apache2-redistribution", r"(?:4 )?(?:redistribution )?you may reproduce and distribute copies of the work or derivative works thereof in any medium\b.*"),
    ("gpl-title", r"gnu general public license version (?P<name>[123])\b.*"),
    ("lgpl-title", r"gnu lesser general public license version (?P<name>[23](?:\.1)?)\b.*"),
    ("agpl-title", r"gnu affero general public license version (?P<name>3)\b.*"),
    ("gnu-verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl3-preamble", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl2-preamble", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("mpl-title", r"mozilla public license version (?P<name>1\.1|2\.0)\b.*"),
    ("epl-title", r"eclipse public license v (?P<name>[12]\.0)\b.*"),
    ("epl-accompanying", r"the accompanying program is provided under the terms of this eclipse public license\b.*"),
    ("zlib-warranty", r"this software is provided as is without any express or implied warranty"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely\b.*"),
    ("zlib-origin", r"(?:1 )?the origin of this software must not be misrepresented\b.*"),
    ("boost-grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license\b.*"),
    ("boost-title", r"boost software license version 1\.0\b.*"),
    ("wtfpl", r"(?:0 )?you just do what the fuck you want to"),
    ("zero-bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("reserved", r"(?:copyright .*)?all rights reserved"),
    ("notice", r"copyright (?:c )?(?:\d{4}\b).*"),
]
#: Ordered rules, the most specific first.
RULES: list[tuple[tuple[str, ...], str]] = [
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"), "BSD-2-Clause"),
    (("mit-grant", "mit-notice", "mit-warranty", "mit-liability"), "MIT"),
    (("mit-grant", "mit-notice", "mit-warranty"), "MIT"),
    (("isc-grant", "isc-warranty"), "ISC"),
    (("zero-bsd", "isc-warranty"), "0BSD"),
    (("boost-title", "boost-grant"), "BSL-1.0"),
    (("boost-grant",), "BSL-1.0"),
    (("zlib-warranty", "zlib-grant", "zlib-origin"), "Zlib"),
    (("zlib-warranty", "zlib-grant"), "Zlib"),
    (("apache2-title", "apache2-copyright", "apache2-patent", "apache2-redistribution"), "Apache-2.0"),
    (("apache2-copyright", "apache2-patent", "apache2-redistribution"), "Apache-2.0"),
    (("gpl-title", "gnu-verbatim", "gpl3-preamble"), "GPL-{name}.0"),
    (("gpl-title", "gnu-verbatim", "gpl2-preamble"), "GPL-{name}.0"),
    (("agpl-title", "gnu-verbatim"), "AGPL-{name}.0"),
    (("lgpl-title", "gnu-verbatim"), "LGPL-{name}"),
    (("gpl-title", "gnu-verbatim"), "GPL-{name}.0"),
    (("epl-title", "epl-accompanying"), "EPL-{name}"),
    (("epl-accompanying",), "EPL"),
    (("mpl-title",), "MPL-{name}"),
    (("apache2-ref", "apache2-use", "apache2-copy", "apache2-warranty"), "Apache-2.0"),
    (("spdx",), "{name}"),
    (("apache2-ref",), "Apache-2.0"),
    (("mit-ref",), "MIT"),
    (("bsd-ref",), "BSD-{name}-Clause"),
    (("gpl-header",), "{name}"),
    (("gpl-ref",), "{name}"),
    (("mpl-ref",), "MPL-2.0"),
    (("cc-ref",), "CC-{name}"),
    (("unlicense",), "Unlicense"),
    (("wtfpl",), "WTFPL"),
    (("public-domain",), "public-domain"),
    (("reserved",), "all-rights-reserved"),
]
_PATTERNS = [(k, re.compile(p)) for k, p in SENTENCES]
#: Words from the start of a line within which a wrapped sentence is known; many times the longest pattern.
RUN_WORDS = 256
RUN_LINES = 12
#: (identifier, whole pattern, its beginning, whether any end may follow that, whether it has a gap)
_WRAPPED = [(k, re.compile(p), re.compile(p.removesuffix(".*").replace(".*", ".*?")), p.endswith(".*"), ".*" in p.removesuffix(".*")) for k, p in SENTENCES]
_END = re.compile(r"[.!?;](?=\s|$)|(?<![Ii]dentifier):(?=\s|$)|\n\s*\n")
#: End marks inside known sentences.
_INSIDE = re.compile(r"(?i)\bfree\s+software[;:](?=\s+you\s+can\s+redistribute)|\bsoftware\s+foundation[;:](?=\s+(?:either\s+)?version)|\bv\.(?=\s+\d)")
#: A tag ends with its line, whatever follows.
_SPDX = re.compile(r"(?im)^(.*spdx-license-identifier:.*)$")
_COMMENT = re.compile(r"^[ \t]*(?://+|/?\*+/?|#+|;+|--+|<!--|rem\b)?", re.M)


def normalised(sentence: str) -> str:
    """Lower case, British spelling folded, only letters, digits and inner dots."""
    s = sentence.lower().replace("licence", "license")
    s = re.sub(r"[^\w.+]+", " ", s)
    return " ".join(w.strip(".") for w in s.split() if w.strip("."))


def sentence_id(sentence: str) -> tuple[str, str] | None:
    """(identifier, name it states), or None if no known sentence is this one."""
    for key, p in _PATTERNS:
        if m := p.fullmatch(sentence):
            return key, (m.groupdict().get("name") or "").strip()
    return None


def wrapped(lines: list[str]) -> list[tuple[str, str]]:
    """Known sentences that begin and end with lines, from normalised lines.

    A sentence may take any number of lines within ``RUN_WORDS`` words. One
    whose end is open takes the line in which what is known of it ends.
    """
    text = " ".join(lines)
    ends = list(itertools.accumulate(len(x) + 1 for x in lines))
    words = list(itertools.accumulate(x.count(" ") + 1 for x in lines))
    found, i = [], 0
    while i < len(lines):
        at = ends[i] - len(lines[i]) - 1
        last = max(bisect.bisect_right(words, (words[i - 1] if i else 0) + RUN_WORDS), min(len(lines), i + RUN_LINES))
        for key, pattern, head, is_open, gap in _WRAPPED:
            m = head.match(text, at, ends[last - 1] - 1)
            if not m:
                continue
            j = bisect.bisect_left(ends, m.end() + 1)
            if not is_open:
                # the longest run that is the whole sentence, or the shortest if anything may stand inside
                runs = range(i, last) if gap else range(j, i - 1, -1)
                j, m = next(((j, m) for j in runs if (m := pattern.fullmatch(text, at, ends[j] - 1))), (j, None))
            if m:
                found.append((key, (m.groupdict().get("name") or "").strip()))
                i = j
                break
        i += 1
    return found


def recognised(text: str) -> list[tuple[str, str]]:
    """Identifiers of a text's sentences about licensing, in order.

    A line that is a sentence without an end mark counts as one; what is left
    of a sentence's lines is tried together, for sentences that are wrapped.
    """
    low = text.lower()
    if not any(t in low for t in (*TRIGGERS, *ALSO)):
        return []
    out = []
    text = _SPDX.sub(r"\n\n\1\n\n", _COMMENT.sub("", text))
    inside = {m.end() - 1 for m in _INSIDE.finditer(text)}
    at = 0
    for m in [*(m for m in _END.finditer(text) if m.start() not in inside), None]:
        part = text[at : m.start() if m else len(text)]
        at = m.end() if m else len(text)
        low = part.lower()
        about = any(t in low for t in TRIGGERS)
        if not about and not any(t in low for t in ALSO):
            continue
        lines = [x for x in map(normalised, part.split("\n")) if x]
        whole = sentence_id(" ".join(lines))
        # a copyright line ends with its line
        if whole and (whole[0] != "notice" or len(lines) == 1):
            out.append(whole)
            continue
        found = wrapped(lines)
        out += found or ([(UNKNOWN, "")] if about else [])
    return out


def _name(template: str, stated: str) -> str:
    if template == "{name}":
        m = re.fullmatch(r"(lesser |affero |)(?:general public license)?(?: as published by the free software foundation)?(?:(?: either)? version ([\d.]+))?(?: of the license)?(?: as published by the free software foundation)?( or later| or at your option any later version)?", stated)
        if m:
            kind = {"lesser ": "LGPL", "affero ": "AGPL", "": "GPL", "lesser": "LGPL", "affero": "AGPL"}[m[1]]
            return kind + (f"-{m[2] if '.' in m[2] else m[2] + '.0'}" if m[2] else "") + ("-or-later" if m[3] else "")
        return {"lesser": "LGPL", "affero": "AGPL"}.get(stated, stated.replace(" ", "-").upper())
    stated = stated.upper().replace(" ", "-")
    return template.replace("{name}", stated).replace("BSD--Clause", "BSD")


#: Identifiers that may stand between those of a rule.
BETWEEN = {UNKNOWN, "notice", "reserved"}


def _match(ids: list[tuple[str, str]], free: list[bool], rule: tuple[str, ...], i: int) -> list[int] | None:
    """Places of a rule's identifiers from the one at ``i`` on."""
    places: list[int] = []
    for key in rule:
        while places and i < len(ids) and ids[i][0] != key and (ids[i][0] in BETWEEN or not free[i]):
            i += 1
        if i == len(ids) or ids[i][0] != key or not free[i]:
            return None
        places.append(i)
        i += 1
    return places


def matched(ids: list[tuple[str, str]]) -> list[str]:
    """Licences by the ordered rules, in the order of their first sentence."""
    free, found = [True] * len(ids), []
    at: dict[str, list[int]] = {}
    for i, (key, _) in enumerate(ids):
        at.setdefault(key, []).append(i)
    for rule, template in RULES:
        for i in at.get(rule[0], ()):
            places = _match(ids, free, rule, i)
            if places:
                for p in places:
                    free[p] = False
                found.append((places[0], _name(template, ids[places[0]][1])))
    return [name for _, name in sorted(found)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``licenses`` and ``sentences`` (identifiers), in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [recognised(t or "") for t in b.column(1).to_pylist()]
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([matched(f) for f in found], kind), pa.array([[k for k, _ in f] for f in found], kind)], names=[id_col, "licenses", "sentences"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(scan, f"`{id_col}` {kind}, licenses array<string>, sentences array<string>")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    x = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    unknown = F.size(F.filter("sentences", lambda s: s == UNKNOWN)).cast("long")
    return x.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentences", ">").alias("sentences"), F.size("licenses").cast("long").alias("n_licenses"), unknown.alias("n_unknown"))
