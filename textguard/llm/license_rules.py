"""License scan: ordered signature rules behind a keyword prefilter.

Each licence has a name pattern, and forms of reference multiply the names into some three hundred rules, each with a priority and a confidence.
A rule's regex runs only on texts that hold its keyword. Overlapping detections are settled at the end: one that lies within
another of higher priority (or of the same priority, and longer) is dropped.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import texts_of, worker_cache

# label, keyword of the name, pattern of the name, pattern of the short identifier (or of the deed's address)
LICENSES = [
    ("gpl", "general public licen", r"(?:gnu )?general public licen[cs]e", r"gpl(?:[- ]?v?[123](?:\.0)?)?(?:-only|-or-later|\+)?"),
    ("gpl-1.0", "general public licen", r"(?:gnu )?general public licen[cs]e,? v(?:ersion|\.)? ?1(?:\.0)?", r"gpl[- ]?v?1(?:\.0)?(?:-only|-or-later|\+)?"),
    ("gpl-2.0", "general public licen", r"(?:gnu )?general public licen[cs]e,? v(?:ersion|\.)? ?2(?:\.0)?", r"gpl[- ]?v?2(?:\.0)?(?:-only|-or-later|\+)?"),
    ("gpl-3.0", "general public licen", r"(?:gnu )?general public licen[cs]e,? v(?:ersion|\.)? ?3(?:\.0)?", r"gpl[- ]?v?3(?:\.0)?(?:-only|-or-later|\+)?"),
    ("lgpl", "lesser general public licen", r"(?:gnu )?lesser general public licen[cs]e(?:,? v(?:ersion|\.)? ?[23](?:\.[01])?)?", r"lgpl(?:[- ]?v?[23](?:\.[01])?)?(?:-only|-or-later|\+)?"),
    ("lgpl-library", "library general public licen", r"(?:gnu )?library general public licen[cs]e", r"lgpl-2\.0"),
    ("agpl", "affero general public licen", r"(?:gnu )?affero general public licen[cs]e(?:,? v(?:ersion|\.)? ?[13](?:\.0)?)?", r"agpl(?:[- ]?v?[13](?:\.0)?)?(?:-only|-or-later|\+)?"),
    ("gfdl", "free documentation licen", r"(?:gnu )?free documentation licen[cs]e(?:,? v(?:ersion|\.)? ?1\.[123])?", r"gfdl(?:-1\.[123])?"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e", r"apache"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e,? v(?:ersion|\.)? ?1\.1", r"apache-1\.1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e,? v(?:ersion|\.)? ?2(?:\.0)?", r"apache-2\.0"),
    ("mit", "mit licen", r"mit licen[cs]e", r"mit"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: licen[cs]e)?", r"mit-0"),
    ("x11", "x11 licen", r"x11 licen[cs]e", r"x11"),
    ("isc", "isc licen", r"isc licen[cs]e", r"isc"),
    ("bsd", "bsd", r"bsd(?:[- ]style)? licen[cs]e", r"bsd"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2[- ]clause|two[- ]clause) bsd licen[cs]e", r"bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3[- ]clause|three[- ]clause) bsd licen[cs]e", r"bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4[- ]clause|four[- ]clause) bsd licen[cs]e", r"bsd-4-clause"),
    ("0bsd", "bsd", r"(?:zero[- ]clause|0[- ]clause) bsd licen[cs]e", r"0bsd"),
    ("mpl", "mozilla public licen", r"mozilla public licen[cs]e", r"mpl(?:[- ]?v?[12]\.[01])?"),
    ("mpl-1.1", "mozilla public licen", r"mozilla public licen[cs]e,? v(?:ersion|\.)? ?1\.1", r"mpl-1\.1"),
    ("mpl-2.0", "mozilla public licen", r"mozilla public licen[cs]e,? v(?:ersion|\.)? ?2(?:\.0)?", r"mpl-2\.0"),
    ("epl", "eclipse public licen", r"eclipse public licen[cs]e(?:,? v(?:ersion|\.)? ?[12](?:\.0)?)?", r"epl(?:-[12]\.0)?"),
    ("edl", "eclipse distribution licen", r"eclipse distribution licen[cs]e(?:,? v(?:ersion|\.)? ?1(?:\.0)?)?", r"edl-1\.0"),
    ("cddl", "common development and distribution licen", r"common development and distribution licen[cs]e(?:,? v(?:ersion|\.)? ?1\.[01])?", r"cddl(?:-1\.[01])?"),
    ("cpl", "common public licen", r"common public licen[cs]e(?:,? v(?:ersion|\.)? ?1(?:\.0)?)?", r"cpl-1\.0"),
    ("eupl", "european union public licen", r"european union public licen[cs]e(?:,? v(?:ersion|\.)? ?1\.[012])?", r"eupl(?:-1\.[012])?"),
    ("cecill", "cecill", r"cecill(?:-[bc])?(?: free software)? licen[cs]e", r"cecill(?:-[bc]|-[12]\.[01])?"),
    ("artistic", "artistic licen", r"(?:perl )?artistic licen[cs]e(?:,? (?:v(?:ersion|\.)? ?)?[12](?:\.0)?)?", r"artistic-[12]\.0"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e", r"zlib"),
    ("libpng", "libpng licen", r"libpng licen[cs]e", r"libpng(?:-2\.0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense\b(?! agreement)", r"unlicense"),
    ("wtfpl", "do what the f", r"do what the f\S{1,4} you want to public licen[cs]e", r"wtfpl"),
    ("boost", "boost software licen", r"boost software licen[cs]e(?:,? v(?:ersion|\.)? ?1(?:\.0)?)?", r"bsl-1\.0"),
    ("busl", "business source licen", r"business source licen[cs]e(?: 1\.1)?", r"busl-1\.1"),
    ("sspl", "server side public licen", r"server side public licen[cs]e(?:,? v(?:ersion|\.)? ?1)?", r"sspl-1\.0"),
    ("elastic", "elastic licen", r"elastic licen[cs]e(?: 2\.0)?", r"elastic-2\.0"),
    ("python", "python software foundation licen", r"python software foundation licen[cs]e(?:,? v(?:ersion|\.)? ?2)?", r"(?:psf|python)-2\.0"),
    ("php", "php licen", r"php licen[cs]e(?:,? v(?:ersion|\.)? ?3\.0[01]?)?", r"php-3\.0[01]?"),
    ("ruby", "ruby licen", r"ruby licen[cs]e", r"ruby"),
    ("openssl", "openssl licen", r"openssl licen[cs]e", r"openssl"),
    ("postgresql", "postgresql licen", r"postgresql licen[cs]e", r"postgresql"),
    ("ncsa", "open source licen", r"(?:university of illinois/)?ncsa open source licen[cs]e", r"ncsa"),
    ("ofl", "open font licen", r"(?:sil )?open font licen[cs]e(?:,? v(?:ersion|\.)? ?1\.[01])?", r"ofl(?:-1\.[01])?"),
    ("odbl", "open database licen", r"open database licen[cs]e(?:,? v(?:ersion|\.)? ?1(?:\.0)?)?", r"odbl(?:-1\.0)?"),
    ("odc-by", "open data commons attribution licen", r"open data commons attribution licen[cs]e", r"odc-by(?:-1\.0)?"),
    ("pddl", "public domain dedication and licen", r"public domain dedication and licen[cs]e", r"pddl(?:-1\.0)?"),
    ("afl", "academic free licen", r"academic free licen[cs]e(?:,? v(?:ersion|\.)? ?[123]\.[012])?", r"afl-[123]\.[012]"),
    ("osl", "open software licen", r"open software licen[cs]e(?:,? v(?:ersion|\.)? ?[123]\.[01])?", r"osl-[123]\.[01]"),
    ("ms-pl", "microsoft public licen", r"microsoft public licen[cs]e", r"ms-pl"),
    ("ms-rl", "microsoft reciprocal licen", r"microsoft reciprocal licen[cs]e", r"ms-rl"),
    ("upl", "universal permissive licen", r"universal permissive licen[cs]e(?:,? v(?:ersion|\.)? ?1(?:\.0)?)?", r"upl-1\.0"),
    ("vim", "vim licen", r"vim licen[cs]e", r"vim"),
    ("json", "json licen", r"json licen[cs]e", r"json"),
    ("mulan", "mulan", r"mulan (?:permissive software|public) licen[cs]e(?:,? v(?:ersion|\.)? ?[12])?", r"mulanpsl-[12]\.0"),
    ("cc-by", "cc", r"cc[- ]by(?![- ](?:nc|sa|nd))(?: ?[1-4]\.0)?", r"cc-by-[1-4]\.0"),
    ("cc-by", "creative commons", r"creative commons attribution(?![- ](?:non|share|no))(?: [1-4]\.0)?(?: international)?(?: licen[cs]e)?", r"cc-by"),
    ("cc-by-sa", "cc", r"cc[- ]by[- ]sa(?: ?[1-4]\.0)?", r"cc-by-sa-[1-4]\.0"),
    ("cc-by-sa", "creative commons", r"creative commons attribution[- ]share ?alike(?: [1-4]\.0)?(?: international)?(?: licen[cs]e)?", r"cc-by-sa"),
    ("cc-by-nd", "cc", r"cc[- ]by[- ]nd(?: ?[1-4]\.0)?", r"cc-by-nd-[1-4]\.0"),
    ("cc-by-nd", "creative commons", r"creative commons attribution[- ]no ?deriv(?:ative)?s?(?: [1-4]\.0)?(?: international)?(?: licen[cs]e)?", r"cc-by-nd"),
    ("cc-by-nc", "cc", r"cc[- ]by[- ]nc(?![- ](?:sa|nd))(?: ?[1-4]\.0)?", r"cc-by-nc-[1-4]\.0"),
    ("cc-by-nc", "creative commons", r"creative commons attribution[- ]non-?commercial(?![- ](?:share|no))(?: [1-4]\.0)?(?: international)?(?: licen[cs]e)?", r"cc-by-nc"),
    ("cc-by-nc-sa", "cc", r"cc[- ]by[- ]nc[- ]sa(?: ?[1-4]\.0)?", r"cc-by-nc-sa-[1-4]\.0"),
    ("cc-by-nc-nd", "cc", r"cc[- ]by[- ]nc[- ]nd(?: ?[1-4]\.0)?", r"cc-by-nc-nd-[1-4]\.0"),
    ("cc0", "cc0", r"cc0(?: ?1\.0)?(?: universal)?", r"cc0-1\.0"),
    ("cc0", "creative commons zero", r"creative commons zero(?: v?1\.0)?(?: universal)?", r"cc0"),
]
# label, keyword, pattern, priority, confidence: sentences that stand for themselves
NOTICES = [
    ("mit", "permission is hereby granted, free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy", 5, 0.95),
    ("isc", "permission to use, copy, modify", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", 5, 0.9),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms", 5, 0.9),
    ("bsd-3-clause", "neither the name", r"neither the name of .{1,80}? nor the names of its contributors", 5, 0.9),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software", 5, 0.9),
    ("zlib", "this software is provided 'as-is'", r"this software is provided 'as-is', without any express or implied warranty", 5, 0.8),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain", 5, 0.95),
    ("boost", "boost software license", r"distributed under the boost software license", 5, 0.9),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", 1, 0.6),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 1, 0.7),
    ("proprietary", "no part of this", r"no part of this (?:publication|work|book|document) may be reproduced", 1, 0.7),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file,? via any medium", 1, 0.7),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain", 2, 0.7),
    ("non-commercial", "non-commercial", r"for non-commercial (?:use|purposes) only", 2, 0.6),
    ("copyright", "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)[0-9]{2}", 0, 0.4),
    ("copyright", "©", r"© ?(?:19|20)[0-9]{2}", 0, 0.4),
    ("copyright", "(c)", r"\(c\) ?(?:19|20)[0-9]{2}", 0, 0.4),
]
# keyword (or "" for the licence's own), pattern around {name} or {id}, priority, confidence
FORMS = [
    ("", r"{name}", 3, 0.8),
    ("under", r"(?:licen[cs]ed|released|distributed|available|published|provided|made available|redistribute it) under (?:the )?(?:terms of (?:the )?)?{name}", 4, 0.95),
    ("see the", r"see the {name} for (?:more )?details", 4, 0.9),
    ("spdx-license-identifier", r"spdx-license-identifier: ?\(?(?:[a-z0-9.+-]+ (?:or|and) )*{id}(?![a-z0-9.+-])", 6, 1.0),
    ("licen", r"licen[cs]e: ?[\"']?{id}(?![a-z0-9.+-])", 5, 0.9),
]
# phrase of words -> label, as the contract fixes them
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Confidence of a base phrase by itself.
BASE_CONFIDENCE = 0.75
#: One byte to one: A-Z lowered; digits, letters and bytes of other scripts are word characters, all else is space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Rule(NamedTuple):
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """All rules, highest priority first; built once for each worker."""
    held = worker_cache("licenses")
    if "rules" not in held:
        def compiled(pattern: str) -> re.Pattern:  # a blank stands for any white space, a rule starts and ends with a word
            return re.compile(r"(?<![a-z0-9])(?:" + pattern.replace(" ?", r"\s?").replace(" ", r"\s+") + r")(?![a-z0-9])")

        made = [Rule(label, tuple(k for k in (keyword, *([own] if "{name}" in form else [])) if k), compiled(form.replace("{name}", f"(?:{name})").replace("{id}", f"(?:{short})")), rank, sure)
                for label, own, name, short in LICENSES for keyword, form, rank, sure in FORMS]
        made += [Rule(label, (keyword,), compiled(pattern), rank, sure) for label, keyword, pattern, rank, sure in NOTICES]
        held["rules"] = sorted(made, key=lambda r: -r.priority)
        held["keywords"] = sorted({k for r in made for k in r.keywords})
    return held["rules"]


def detect(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, label, confidence) of the detections that survive, in code points; ``text`` has A-Z lowered already."""
    every = rules()
    # A keyword's blanks may be any white space in the text.
    plain = " ".join(text.split())
    there = {k for k in worker_cache("licenses")["keywords"] if k in plain}
    found = [(m.start(), m.end(), r) for r in every if there.issuperset(r.keywords) for m in r.pattern.finditer(text)] if there else []
    # By start, longest and highest first: a detection can only lie within one that starts no later.
    found.sort(key=lambda d: (d[0], -d[1], -d[2].priority))
    return list(dict.fromkeys((a, b, r.label, r.confidence) for a, b, r in settle(found)))


def settle(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that lie in no stronger one, in one sweep: only what came before and reaches over a detection can contain it."""
    kept, active = [], []
    for d in found:
        active = [o for o in active if o[1] > d[0]]
        if not any(o[1] >= d[1] and (o[2].priority, o[1] - o[0]) > (d[2].priority, d[1] - d[0]) for o in active):
            kept.append(d)
        active.append(d)
    return kept


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(index of the first word, label) wherever a base phrase's words stand one after the other."""
    line, places = b" " + b" ".join(words) + b" ", []
    for phrase, label in BASE.items():
        needle, at, index = b" " + phrase.encode() + b" ", 0, 0
        while (hit := line.find(needle, at)) >= 0:
            index += line.count(b" ", at, hit)
            places.append((index, label))
            at, index = hit + 1, index + 1
    return places


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "detections array<struct<start:int,end:int,label:string,confidence:double>>")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, places of the base phrases (first and last start, null without one), base labels, all labels, a
    score and the detections with their spans (code points, end exclusive).

    score: the greatest confidence among detections and base phrases, 0 without any. Null or empty text: no words, empty labels,
    score 0. Rows without doc_id are dropped, repeated rows give repeated rows, other columns are ignored. Map-only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8")
                words = raw.translate(WORDS).split()
                places = base_places(words)
                found = detect(raw.lower().decode("utf-8"))
                base, at = {x for _, x in places}, [k for k, _ in places]
                rows.append({"doc_id": doc, "n_words": len(words), "n_base": len(places), "first_word": min(at, default=None), "last_word": max(at, default=None),
                             "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {x[2] for x in found})),
                             "score": max([x[3] for x in found] + [BASE_CONFIDENCE] * bool(places), default=0.0),
                             "detections": [dict(zip(("start", "end", "label", "confidence"), x, strict=True)) for x in found]})
            kind = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                              ("detections", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("confidence", pa.float64())])))])
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return texts_of(docs).mapInArrow(run, SCHEMA)


def digest(docs: DataFrame) -> DataFrame:
    """The scan's columns without the spans, and how many detections there are."""
    return scan(docs).withColumn("n_detections", F.size("detections")).drop("detections")
