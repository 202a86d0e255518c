"""License scans by ordered signature rules.

A text is read as its words (letters, digits and characters beyond ASCII, A-Z lower-cased) joined
by single spaces, so punctuation and line breaks do not matter. Each rule is a regular expression
over that form with a label, a priority and keywords, of which every match holds one as a whole
word; it runs only on texts that hold one of them. Detections of a higher priority come first, of equal
priority the longer ones. A detection that lies within an accepted detection is suppressed (interval
containment): "bsd 3 clause license" is not also "bsd license", and the name of the lesser general
public license is not also that of the general one. The three base phrases are rules that are never suppressed.

The rules are written per family of licenses below; each family's name, forms and identifiers give
several rules: its identifier tag, "licensed under", a grant or header sentence, its title, its
address on the web, and its bare name.

Results for odd input: null, empty and wordless texts have no words, no labels and score 0;
overlapping places of a base phrase all count; repeated rows score alike; a null doc_id is carried
through; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ticketmill.llm import common as c

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

LICENSE = r"licen[cs]e"
VERSION = r"(?: version| v)? ?"

# Families: label, keywords (each form of the name holds one), name as it is written in words, identifiers, and words of its address.
FAMILIES = (
    ("apache-1.1", "apache", rf"apache (?:software )?{LICENSE}{VERSION}1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2.0", "apache", rf"apache (?:software )?{LICENSE}{VERSION}2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("mit", "mit", rf"mit (?:x11 )?{LICENSE}", "mit", "opensource org licenses mit"),
    ("mit-0", "mit", rf"mit no attribution(?: {LICENSE})?", "mit 0", "opensource org licenses mit 0"),
    ("bsd-2-clause", "bsd", rf"(?:simplified bsd|bsd (?:2|two) clause|(?:2|two) clause bsd)(?: {LICENSE})?", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", rf"(?:new bsd|modified bsd|revised bsd|bsd (?:3|three) clause|(?:3|three) clause bsd)(?: {LICENSE})?", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", rf"(?:original bsd|bsd (?:4|four) clause|(?:4|four) clause bsd)(?: {LICENSE})?", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("0bsd", "bsd", rf"(?:zero clause bsd|bsd zero clause|0 clause bsd)(?: {LICENSE})?", "0bsd", "opensource org licenses 0bsd"),
    ("gpl-1.0", "general", rf"(?:gnu )?general public {LICENSE}{VERSION}1(?: 0)?", r"gpl (?:v)?1(?: 0)?(?: only| or later)?", "gnu org licenses old licenses gpl 1 0"),
    ("gpl-2.0", "general", rf"(?:gnu )?general public {LICENSE}{VERSION}2(?: 0)?", r"gpl (?:v)?2(?: 0)?(?: only| or later)?", "gnu org licenses old licenses gpl 2 0"),
    ("gpl-3.0", "general", rf"(?:gnu )?general public {LICENSE}{VERSION}3(?: 0)?", r"gpl (?:v)?3(?: 0)?(?: only| or later)?", "gnu org licenses gpl 3 0"),
    ("lgpl-2.0", "general", rf"(?:gnu )?library general public {LICENSE}{VERSION}2(?: 0)?", r"lgpl (?:v)?2 0(?: only| or later)?", "gnu org licenses old licenses lgpl 2 0"),
    ("lgpl-2.1", "general", rf"(?:gnu )?lesser general public {LICENSE}{VERSION}2 1", r"lgpl (?:v)?2 1(?: only| or later)?", "gnu org licenses old licenses lgpl 2 1"),
    ("lgpl-3.0", "general", rf"(?:gnu )?lesser general public {LICENSE}{VERSION}3(?: 0)?", r"lgpl (?:v)?3(?: 0)?(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "general", rf"(?:gnu )?affero general public {LICENSE}{VERSION}3(?: 0)?", r"agpl (?:v)?3(?: 0)?(?: only| or later)?", "gnu org licenses agpl 3 0"),
    ("gfdl-1.3", "documentation", rf"(?:gnu )?free documentation {LICENSE}{VERSION}1 3", "gfdl 1 3", "gnu org licenses fdl 1 3"),
    ("gfdl-1.2", "documentation", rf"(?:gnu )?free documentation {LICENSE}{VERSION}1 2", "gfdl 1 2", "gnu org licenses old licenses fdl 1 2"),
    ("mpl-1.1", "mozilla", rf"mozilla public {LICENSE}{VERSION}1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public {LICENSE}{VERSION}2(?: 0)?", "mpl 2 0", "mozilla org mpl 2 0"),
    ("epl-1.0", "eclipse", rf"eclipse public {LICENSE}{VERSION}1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", rf"eclipse public {LICENSE}{VERSION}2(?: 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("cddl-1.0", "distribution", rf"common development and distribution {LICENSE}{VERSION}1(?: 0)?", "cddl 1 0", "opensource org licenses cddl1"),
    ("cddl-1.1", "distribution", rf"common development and distribution {LICENSE}{VERSION}1 1", "cddl 1 1", "glassfish dev java net public cddl gplv2"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-nc-nd", "nd noderivatives noderivs derivatives", r"(?:creative commons |cc )(?:by|attribution) (?:nc|noncommercial|non commercial) (?:nd|noderivatives|noderivs|no derivatives)", r"cc by nc nd [1-4] [05]", "creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", "sa sharealike alike", r"(?:creative commons |cc )(?:by|attribution) (?:nc|noncommercial|non commercial) (?:sa|sharealike|share alike)", r"cc by nc sa [1-4] [05]", "creativecommons org licenses by nc sa"),
    ("cc-by-nc", "nc noncommercial commercial", r"(?:creative commons |cc )(?:by|attribution) (?:nc|noncommercial|non commercial)", r"cc by nc [1-4] [05]", "creativecommons org licenses by nc"),
    ("cc-by-nd", "nd noderivatives noderivs derivatives", r"(?:creative commons |cc )(?:by|attribution) (?:nd|noderivatives|noderivs|no derivatives)", r"cc by nd [1-4] [05]", "creativecommons org licenses by nd"),
    ("cc-by-sa", "sa sharealike alike", r"(?:creative commons |cc )(?:by|attribution) (?:sa|sharealike|share alike)", r"cc by sa [1-4] [05]", "creativecommons org licenses by sa"),
    ("cc-by-4.0", "cc commons", r"(?:creative commons |cc )(?:by|attribution)(?: international)? 4 0(?: international)?", "cc by 4 0", "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "cc commons", r"(?:creative commons |cc )(?:by|attribution)(?: unported)? 3 0(?: unported)?", "cc by 3 0", "creativecommons org licenses by 3 0"),
    ("cc-by-2.0", "cc commons", r"(?:creative commons |cc )(?:by|attribution)(?: generic)? 2 [05](?: generic)?", "cc by 2 [05]", "creativecommons org licenses by 2 [05]"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", rf"wtfpl(?: public {LICENSE})?", "wtfpl", "wtfpl net"),
    ("isc", "isc", rf"isc {LICENSE}", "isc", "opensource org licenses isc"),
    ("zlib", "zlib", rf"zlib(?: libpng)? {LICENSE}", "zlib", "opensource org licenses zlib"),
    ("libpng", "libpng liblibpng", rf"(?:lib)?libpng {LICENSE}(?: version 2)?", "libpng 2 0", "libpng org pub png src libpng license"),
    ("boost-1.0", "boost", rf"boost software {LICENSE}{VERSION}1(?: 0)?", "bsl 1 0", "boost org license 1 0"),
    ("artistic-1.0", "artistic", rf"artistic {LICENSE}{VERSION}1(?: 0)?", "artistic 1 0", "opensource org licenses artistic license 1 0"),
    ("artistic-2.0", "artistic", rf"artistic {LICENSE}{VERSION}2(?: 0)?", "artistic 2 0", "opensource org licenses artistic license 2 0"),
    ("afl-3.0", "academic", rf"academic free {LICENSE}{VERSION}3(?: 0)?", "afl 3 0", "opensource org licenses afl 3 0"),
    ("osl-3.0", "open", rf"open software {LICENSE}{VERSION}3(?: 0)?", "osl 3 0", "opensource org licenses osl 3 0"),
    ("ofl-1.1", "font", rf"(?:sil )?open font {LICENSE}{VERSION}1 1", "ofl 1 1", "scripts sil org ofl"),
    ("eupl-1.1", "european", rf"european union public licen[cs]e{VERSION}1 1", "eupl 1 1", "joinup ec europa eu software page eupl licence eupl"),
    ("eupl-1.2", "european", rf"european union public licen[cs]e{VERSION}1 2", "eupl 1 2", "eupl eu 1 2"),
    ("ms-pl", "microsoft", rf"microsoft public {LICENSE}", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft", rf"microsoft reciprocal {LICENSE}", "ms rl", "opensource org licenses ms rl"),
    ("python-2.0", "python", rf"python software foundation {LICENSE}(?: version 2)?", "psf 2 0", "docs python org 3 license"),
    ("php-3.01", "php", rf"php {LICENSE}{VERSION}3 01", "php 3 01", "php net license 3 01"),
    ("postgresql", "postgresql", rf"postgresql {LICENSE}", "postgresql", "postgresql org about licence"),
    ("openssl", "openssl", rf"openssl(?: ssleay)? {LICENSE}", "openssl", "openssl org source license"),
    ("odbl-1.0", "database", rf"(?:odc )?open database {LICENSE}(?: odbl)?", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "commons", rf"open data commons attribution {LICENSE}", "odc by 1 0", "opendatacommons org licenses by"),
    ("pddl-1.0", "commons", rf"open data commons public domain dedication and {LICENSE}", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("ncsa", "illinois", rf"university of illinois(?: ncsa)?(?: open source)? {LICENSE}", "ncsa", "opensource org licenses ncsa"),
    ("upl-1.0", "permissive", rf"universal permissive {LICENSE}{VERSION}1(?: 0)?", "upl 1 0", "opensource org licenses upl"),
    ("vim", "vim", rf"vim {LICENSE}", "vim", "vimhelp org uganda txt"),
    ("ecl-2.0", "educational", rf"educational community {LICENSE}{VERSION}2(?: 0)?", "ecl 2 0", "opensource org licenses ecl 2 0"),
    ("cpl-1.0", "common", rf"common public {LICENSE}{VERSION}1(?: 0)?", "cpl 1 0", "opensource org licenses cpl1"),
    ("ijg", "jpeg", rf"independent jpeg group {LICENSE}", "ijg", "ijg org files readme"),
    ("x11", "x11", rf"x11 {LICENSE}", "x11", "xfree86 org 3 3 6 copyright2"),
    ("ruby", "ruby", rf"ruby {LICENSE}", "ruby", "ruby lang org en about license"),
    ("bsl-1.1", "business", rf"business source {LICENSE}{VERSION}1 1", "busl 1 1", "mariadb com bsl11"),
    ("sspl-1.0", "server", rf"server side public {LICENSE}{VERSION}1(?: 0)?", "sspl 1 0", "mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic", rf"elastic {LICENSE}{VERSION}2(?: 0)?", "elastic 2 0", "elastic co licensing elastic license"),
    ("openrail", "rail openrail", rf"(?:creative ml |bigscience )?open ?rail(?: m)?(?: {LICENSE})?", "openrail(?: m)?", "huggingface co spaces bigscience license"),
    ("blueoak-1.0", "oak", rf"blue oak model {LICENSE}(?: 1 0 0)?", "blueoak 1 0 0", "blueoakcouncil org license 1 0 0"),
)

# Sentences of license texts and notices that belong to no form above: label, keywords, expression, priority, weight.
SENTENCES = (
    ("mit", "charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 90, 1.0),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 90, 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 85, 0.9),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software", 86, 0.9),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software", 87, 0.9),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 90, 1.0),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser |library |affero )?general public license", 60, 0.9),
    ("boost-1.0", "organization", r"granted free of charge to any person or organization obtaining a copy of the software", 90, 1.0),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 90, 1.0),
    ("public-domain", "domain", r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain", 40, 0.7),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)", 40, 0.7),
    ("proprietary", "reproduced", r"no part of this (?:publication|document|work|book) may be reproduced", 40, 0.7),
    ("proprietary", "permission", r"without (?:the )?(?:prior |express )?written permission", 30, 0.5),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d", 20, 0.3),
    ("gpl", "gpl", r"gpl", 10, 0.5),
    ("lgpl", "lgpl", r"lgpl", 10, 0.5),
    ("agpl", "agpl", r"agpl", 10, 0.5),
    ("lgpl", "general", rf"(?:lesser|library) general public {LICENSE}", 15, 0.7),
    ("agpl", "affero", rf"affero general public {LICENSE}", 15, 0.7),
    ("bsd", "bsd", rf"bsd(?: style)? {LICENSE}", 15, 0.6),
    ("apache", "apache", rf"apache(?: software)? {LICENSE}", 15, 0.6),
    ("mpl", "mozilla", rf"mozilla public {LICENSE}", 15, 0.6),
    ("epl", "eclipse", rf"eclipse public {LICENSE}", 15, 0.6),
    ("cc", "commons", rf"creative commons(?: {LICENSE})?", 12, 0.5),
    ("gfdl", "documentation", rf"free documentation {LICENSE}", 15, 0.6),
    ("artistic", "artistic", rf"artistic {LICENSE}", 15, 0.6),
    # the standard notices name the version after the license
    ("gpl-2.0", "general", rf"gnu general public {LICENSE} as published by the free software foundation either version 2 of the {LICENSE}", 65, 1.0),
    ("gpl-3.0", "general", rf"gnu general public {LICENSE} as published by the free software foundation either version 3 of the {LICENSE}", 65, 1.0),
    ("gpl-2.0", "general", rf"gnu general public {LICENSE} as published by the free software foundation version 2", 64, 1.0),
    ("gpl-3.0", "general", rf"gnu general public {LICENSE} as published by the free software foundation version 3", 64, 1.0),
    ("lgpl-2.1", "general", rf"gnu lesser general public {LICENSE} as published by the free software foundation either version 2 1 of the {LICENSE}", 65, 1.0),
    ("lgpl-3.0", "general", rf"gnu lesser general public {LICENSE} as published by the free software foundation either version 3 of the {LICENSE}", 65, 1.0),
    ("lgpl-2.0", "general", rf"gnu library general public {LICENSE} as published by the free software foundation either version 2 of the {LICENSE}", 65, 1.0),
    ("agpl-3.0", "general", rf"gnu affero general public {LICENSE} as published by the free software foundation either version 3 of the {LICENSE}", 65, 1.0),
    # versions written into the name's word
    ("gpl-2.0", "gplv2", r"gplv2(?: 0)?(?: only| or later)?", 45, 0.8),
    ("gpl-3.0", "gplv3", r"gplv3(?: 0)?(?: only| or later)?", 45, 0.8),
    ("lgpl-2.1", "lgplv2", r"lgplv2 1(?: only| or later)?", 46, 0.8),
    ("lgpl-2.0", "lgplv2", r"lgplv2(?: 0)?(?: only| or later)?", 45, 0.8),
    ("lgpl-3.0", "lgplv3", r"lgplv3(?: 0)?(?: only| or later)?", 45, 0.8),
    ("agpl-3.0", "agplv3", r"agplv3(?: 0)?(?: only| or later)?", 45, 0.8),
    ("mpl-1.1", "mplv1", r"mplv1 1", 45, 0.8),
    ("mpl-2.0", "mplv2", r"mplv2(?: 0)?", 45, 0.8),
    ("apache-2.0", "apachev2 apache2", r"apache(?:v2|2)(?: 0)?", 45, 0.8),
    ("mit", "licensed licenced", r"mit licen[cs]ed", 45, 0.8),
    ("bsd", "licensed licenced", r"bsd licen[cs]ed", 15, 0.6),
    ("apache", "licensed licenced", r"apache licen[cs]ed", 15, 0.6),
    ("gpl", "licensed licenced", r"gpl licen[cs]ed", 15, 0.6),
)

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"
_RESULT = pa.schema(
    [("doc_id", pa.int64())]
    + [(x, pa.int64()) for x in ("n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_detections", pa.int64())]
)


class Rule(NamedTuple):
    label: str
    keywords: frozenset
    pattern: re.Pattern
    priority: int
    weight: float


def _rule(label: str, keywords: str, pattern: str, priority: int, weight: float) -> Rule:
    return Rule(label, frozenset(keywords.split()), re.compile(rf"(?<= ){pattern}(?= )"), priority, weight)


def _family_rules() -> Iterator[Rule]:
    granted = r"(?:licen[cs]ed|released|distributed|available|published|provided|covered|made available)"
    for label, keywords, name, identifier, address in FAMILIES:
        # an identifier's own first word gates it, as it need not hold one of the family's keywords
        tag = re.match(r"\w+", identifier)[0]
        yield _rule(label, "spdx", rf"spdx licen[cs]e identifier {identifier}", 100, 1.0)
        yield _rule(label, keywords, rf"{granted} under (?:the )?(?:terms of )?(?:the )?{name}", 80, 1.0)
        yield _rule(label, keywords, rf"subject to (?:the )?(?:terms of )?(?:the )?{name}", 78, 0.95)
        yield _rule(label, keywords, rf"(?:terms|conditions|copy) of the {name}", 76, 0.95)
        yield _rule(label, tag, rf"{granted} under (?:the )?(?:terms of )?(?:the )?{identifier}", 75, 0.95)
        yield _rule(label, address.split()[0], rf"(?:http|https)(?: www)? {address}", 70, 0.95)
        yield _rule(label, keywords, name, 50, 0.9)
        if " " in identifier:
            yield _rule(label, tag, identifier, 45, 0.8)


def all_rules() -> list[Rule]:
    """All rules in the order in which they are tried: by priority, then as written."""
    rules = [*_family_rules(), *(_rule(*x) for x in SENTENCES)]
    return sorted(rules, key=lambda r: -r.priority)


RULES = all_rules()
BASE_RULES = [(label, re.compile(rf"(?<= )(?={phrase} )")) for phrase, label in BASE]
KEYWORDS = frozenset().union(*(r.keywords for r in RULES)) | {phrase.split()[0] for phrase, _ in BASE}
#: The numbers of the rules that a keyword lets run.
GATED = {k: [n for n, r in enumerate(RULES) if k in r.keywords] for k in KEYWORDS}


def detections(joined: str, present: frozenset | set) -> list[tuple[int, int, Rule]]:
    """Accepted detections: (start, end, rule) in the form of words joined by spaces, best rules first."""
    rules = [RULES[n] for n in sorted({n for k in present for n in GATED[k]})]
    found = [(m.start(), m.end(), rule) for rule in rules for m in rule.pattern.finditer(joined)]
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1]))  # equal ones stay in the order of the rules
    starts = sorted({s for s, _, _ in found})
    # furthest[i]: the furthest end of some accepted detections that start at or before starts[i - 1], as a Fenwick tree
    furthest, accepted = [0] * (len(starts) + 1), []
    for start, end, rule in found:
        at = i = bisect_left(starts, start) + 1
        held = 0
        while i:
            held, i = max(held, furthest[i]), i & (i - 1)
        if held >= end:
            continue
        accepted.append((start, end, rule))
        while at < len(furthest):
            furthest[at] = max(furthest[at], end)
            at += at & -at
    return accepted


def scan(text: bytes) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections) of a text."""
    words = WORD.findall(text.lower().decode("utf-8", "replace"))
    present = KEYWORDS.intersection(words)
    if not present:
        return len(words), 0, None, None, "", "", 0.0, 0
    joined = f" {' '.join(words)} "
    places, base = [], set()
    for label, pattern in BASE_RULES:
        found = [m.start() for m in pattern.finditer(joined)]
        if found:
            base.add(label)
            places += found
    found = detections(joined, present)
    labels = base | {rule.label for _, _, rule in found}
    score = max([0.8 * bool(base), *(rule.weight for _, _, rule in found)])
    number = [joined.count(" ", 0, p) - 1 for p in (min(places), max(places))] if places else [None, None]
    return len(words), len(places), *number, ",".join(sorted(base)), ",".join(sorted(labels)), score, len(found)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = c.text_bytes(batch.column(1))
        raw = data.tobytes()
        rows = [scan(raw[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        columns = zip(*rows, strict=True) if rows else [()] * (len(_RESULT) - 1)
        arrays = [pa.array(list(x), f.type) for x, f in zip(columns, list(_RESULT)[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=_RESULT)


def license_scan(docs: DataFrame) -> DataFrame:
    """Per document: words, base places and labels, all labels, a confidence and n_detections."""
    return c.texts_of(docs).mapInArrow(_scan_batches, RESULT)
