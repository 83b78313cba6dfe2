"""License scan by ordered signature rules.

Rules are regular expressions over the words of a text (joined by one space),
ordered by priority.  A rule is tried only if its literal keyword occurs, and
no rule is tried in a text that holds none of a few stems that every keyword
contains.  Of overlapping detections a lower-priority one that lies inside an
accepted one is suppressed.

The rule table is made from license names (one line each, with the versions
they come in) and sentence templates, plus signatures of license texts.

Null and empty texts have no words, no labels and score 0.  Repeated rows are
scanned each on its own; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attrition.llm.common import LOWER, row_blocks, spans_of, utf8

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases that are always counted, with their labels.
BASE = ((("mit", "license"), "mit"), (("apache", "license"), "apache"),
        (("general", "public", "license"), "gpl"))

#: label | name in words (regular expression) | literal keyword | versions
NAMES = """
mit | mit (?:x11 |expat )?licen[cs]e | mit licen |
mit | expat licen[cs]e | expat licen |
mit-0 | mit no attribution licen[cs]e | mit no attribution licen |
apache | apache (?:software )?licen[cs]e | apache | 1 0,1 1,2 0
gpl | (?:gnu )?general public licen[cs]e | general public licen | 1,2,3,1 0,2 0,3 0
lgpl | (?:gnu )?(?:lesser|library) general public licen[cs]e | general public licen | 2,2 0,2 1,3,3 0
agpl | (?:gnu )?affero general public licen[cs]e | affero general public licen | 1,3,1 0,3 0
gfdl | (?:gnu )?free documentation licen[cs]e | free documentation licen | 1 1,1 2,1 3
bsd | (?:(?:new|modified|simplified|revised|original) )?bsd licen[cs]e | bsd licen | 2,3,4
bsd-2-clause | (?:bsd )?(?:2|two) clause (?:bsd )?licen[cs]e | clause |
bsd-3-clause | (?:bsd )?(?:3|three) clause (?:bsd )?licen[cs]e | clause |
bsd-4-clause | (?:bsd )?(?:4|four) clause (?:bsd )?licen[cs]e | clause |
isc | isc licen[cs]e | isc licen |
mpl | mozilla public licen[cs]e | mozilla public licen | 1 0,1 1,2 0
epl | eclipse public licen[cs]e | eclipse public licen | 1 0,2 0
eupl | european union public licen[cs]e | european union public licen | 1 0,1 1,1 2
cddl | common development and distribution licen[cs]e | common development and distribution licen | 1 0,1 1
cpl | common public licen[cs]e | common public licen | 1 0
cpal | common public attribution licen[cs]e | common public attribution licen | 1 0
ipl | ibm public licen[cs]e | ibm public licen | 1 0
artistic | artistic licen[cs]e | artistic licen | 1 0,2 0
bsl | boost software licen[cs]e | boost software licen | 1 0
busl | business source licen[cs]e | business source licen | 1 0,1 1
zlib | zlib(?: libpng)? licen[cs]e | zlib |
libpng | libpng licen[cs]e | libpng licen | 2 0
wtfpl | do what the fuck you want to public licen[cs]e | you want to public licen | 1,2
unlicense | (?:the )?unlicense | unlicense |
cc0 | (?:creative commons )?(?:cc0|zero) (?:1 0 )?(?:universal|public domain dedication) | universal,public domain |
cc-by | creative commons attribution(?: (?:international|unported|generic))?(?: public)? licen[cs]e | creative commons attribution | 1 0,2 0,2 5,3 0,4 0
cc-by-sa | creative commons attribution share ?alike | creative commons attribution | 1 0,2 0,2 5,3 0,4 0
cc-by-nd | creative commons attribution no ?deriv(?:s|atives|ative works) | creative commons attribution | 1 0,2 0,2 5,3 0,4 0
cc-by-nc | creative commons attribution non ?commercial | creative commons attribution | 1 0,2 0,2 5,3 0,4 0
cc-by-nc-sa | creative commons attribution non ?commercial share ?alike | creative commons attribution | 1 0,2 0,2 5,3 0,4 0
cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:s|atives) | creative commons attribution | 1 0,2 0,2 5,3 0,4 0
ofl | (?:sil )?open font licen[cs]e | open font licen | 1 0,1 1
odbl | open (?:data commons )?(?:open )?database licen[cs]e | database licen | 1 0
odc-by | open data commons attribution licen[cs]e | open data commons attribution licen | 1 0
pddl | public domain dedication and licen[cs]e | public domain dedication and licen | 1 0
python | python software foundation licen[cs]e | python software foundation licen | 2
php | php licen[cs]e | php licen | 3 0,3 01
ruby | ruby licen[cs]e | ruby licen |
openssl | openssl licen[cs]e | openssl licen |
afl | academic free licen[cs]e | academic free licen | 1 1,1 2,2 0,2 1,3 0
osl | open software licen[cs]e | open software licen | 1 0,2 0,2 1,3 0
ecl | educational community licen[cs]e | educational community licen | 1 0,2 0
ms-pl | microsoft public licen[cs]e | microsoft public licen |
ms-rl | microsoft reciprocal licen[cs]e | microsoft reciprocal licen |
upl | universal permissive licen[cs]e | universal permissive licen | 1 0
ncsa | university of illinois(?: ncsa)? open source licen[cs]e | open source licen |
sspl | server side public licen[cs]e | server side public licen | 1
elastic | elastic licen[cs]e | elastic licen | 2 0
cecill | cecill(?: free software)? licen[cs]e | cecill | 1 0,1 1,2 0,2 1
mulan | mulan (?:permissive software|psl) licen[cs]e | mulan | 1,2
openrail | (?:creativeml |bigscience )?open ?rail(?: m| s)? licen[cs]e | rail |
"""

#: label | words of the short form after "under" or an SPDX tag
SHORT = """
cc-by | cc by | 1 0,2 0,2 5,3 0,4 0
cc-by-sa | cc by sa | 1 0,2 0,2 5,3 0,4 0
cc-by-nd | cc by nd | 1 0,2 0,2 5,3 0,4 0
cc-by-nc | cc by nc | 1 0,2 0,2 5,3 0,4 0
cc-by-nc-sa | cc by nc sa | 1 0,2 0,2 5,3 0,4 0
cc-by-nc-nd | cc by nc nd | 1 0,2 0,2 5,3 0,4 0
cc0 | cc0 | 1 0
gpl | gpl | 1,2,3,1 0,2 0,3 0
lgpl | lgpl | 2,2 0,2 1,3,3 0
agpl | agpl | 1,3,1 0,3 0
apache | apache | 1 0,1 1,2 0
mpl | mpl | 1 0,1 1,2 0
epl | epl | 1 0,2 0
bsl | bsl | 1 0
ofl | ofl | 1 0,1 1
bsd | bsd | 2 clause,3 clause,4 clause
mit | mit |
isc | isc |
zlib | zlib |
unlicense | unlicense |
wtfpl | wtfpl |
artistic | artistic | 1 0,2 0
"""

#: label | signature of a license text (regular expression) | literal keyword
TEXTS = """
mit | permission is hereby granted free of charge to any person obtaining a copy | permission is hereby granted free of charge
mit | the above copyright notice and this permission notice shall be included in all copies | this permission notice shall be
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | permission to use copy modify
bsd | redistribution and use in source and binary forms with or without modification are permitted | redistribution and use in source
bsd-3-clause | neither the name of .{1,80}? nor the names of its contributors may be used to endorse .{0,200}?permission | permission
zlib | permission is granted to anyone to use this software for any purpose including commercial applications | permission is granted to anyone
public-domain | (?:released|dedicated|placed|donated) (?:in|into|to) the public domain | the public domain
public-domain | this (?:work|text|file|software|document) is in the public domain | the public domain
proprietary | all rights reserved .{0,80}?without (?:prior )?(?:written )?permission | permission
proprietary | may not be (?:copied|reproduced|redistributed) .{0,80}?without (?:prior )?(?:written )?permission | permission
"""

#: Every detection holds one of these, so a text without any is never scanned.
STEMS = (b"licen", b"permission", b"redistribution", b"domain", b"spdx", b"universal", b"commons", b"under")
UNDER = r"(?:licen[cs]ed|released|distributed|published|available|provided|shared) under (?:the )?(?:terms of (?:the )?)?"


@dataclass(frozen=True)
class Rule:
    priority: int       # a higher one wins
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]   # one of them has to occur


def rows(table: str):
    for line in table.strip().splitlines():
        yield [x.strip() for x in line.split("|")]


def rules() -> list[Rule]:
    """All rules, the highest priority first: notices with a version, notices,
    SPDX tags, names with a version, texts, names."""
    out: list[Rule] = []

    def add(priority: int, label: str, pattern: str, *keywords: str) -> None:
        out.append(Rule(priority, label, re.compile(rf"(?<![^ ]){pattern}(?![^ ])"), keywords))

    def split_names(table: str) -> list[list[str]]:
        # a name may hold "|" inside brackets: label first, versions and keyword last
        got = []
        for line in table.strip().splitlines():
            label, rest = (x.strip() for x in line.split("|", 1))
            name, keyword, versions = (x.strip() for x in rest.rsplit("|", 2))
            got.append([label, name, keyword, versions])
        return got

    for label, name, keyword, versions in split_names(NAMES):
        keys = tuple(keyword.split(","))
        for v in filter(None, versions.split(",")):
            named = rf"{name} (?:(?:version|v) ?)?{v}"
            add(60, f"{label}-{v.replace(' ', '.')}", rf"{UNDER}{named}(?: only| or (?:any )?later(?: version)?)?", *keys)
            add(40, f"{label}-{v.replace(' ', '.')}", named, *keys)
        add(50, label, rf"{UNDER}{name}", *keys)
        add(10, label, name, *keys)
    for label, name, versions in rows(SHORT):
        for v in filter(None, versions.split(",")):
            add(58, f"{label}-{v.replace(' ', '.')}", rf"{UNDER}{name} (?:v ?)?{v}(?: licen[cs]e)?", "licen", "under")
            add(45, f"{label}-{v.replace(' ', '.')}", rf"spdx licen[cs]e identifier {name} {v}(?: only| or later)?", "spdx")
        add(48, label, rf"{UNDER}(?:an? |the )?{name}(?: licen[cs]e)?", "under")
        add(44, label, rf"spdx licen[cs]e identifier {name}", "spdx")
    for line in TEXTS.strip().splitlines():
        label, rest = (x.strip() for x in line.split("|", 1))
        pattern, keyword = (x.strip() for x in rest.rsplit("|", 1))
        add(30, label, pattern, keyword)
    return sorted(out, key=lambda r: -r.priority)


@dataclass(frozen=True)
class Detection:
    start: int          # character of the joined words
    end: int
    priority: int
    label: str


class Scanner:
    """Finds and resolves detections in one text's joined words."""

    def __init__(self):
        self.rules = rules()
        self.gate = ahocorasick.Automaton()
        for word in {k for r in self.rules for k in r.keywords}:
            self.gate.add_word(word, word)
        self.gate.make_automaton()

    def detections(self, joined: str) -> list[Detection]:
        present = {k for _, k in self.gate.iter(joined)}
        if not present:
            return []
        return [Detection(m.start(), m.end(), r.priority, r.label)
                for r in self.rules if not present.isdisjoint(r.keywords) for m in r.pattern.finditer(joined)]

    @staticmethod
    def resolve(found: list[Detection]) -> list[Detection]:
        """Highest priority first; one that lies inside an accepted interval
        is dropped.  Accepted intervals are kept in order of their starts with
        the running maximum of their ends; within a priority the longer of two
        that start together comes first."""
        kept: list[Detection] = []
        starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, group in _by_priority(found):
            reach = -1
            for d in sorted(group, key=lambda d: (d.start, -d.end, d.label)):
                i = int(np.searchsorted(starts, d.start, side="right"))
                if d.end > reach and not (i and ends[i - 1] >= d.end):
                    kept.append(d)
                    reach = d.end
            both = sorted((d.start, d.end) for d in kept)
            starts = np.array([s for s, _ in both], np.int64)
            ends = np.maximum.accumulate(np.array([e for _, e in both], np.int64)) if both else ends
        return sorted(kept, key=lambda d: (d.start, d.end, d.label))


def _by_priority(found: list[Detection]):
    groups: dict[int, list[Detection]] = {}
    for d in found:
        groups.setdefault(d.priority, []).append(d)
    return sorted(groups.items(), reverse=True)


def scan_text(scanner: Scanner, text: str) -> dict:
    """Base places, resolved detections and labels of one text."""
    words = WORDS.findall(text.translate(ASCII_LOWER))
    places = [(i, label) for phrase, label in BASE for i in range(len(words) - len(phrase) + 1)
              if words[i] == phrase[0] and tuple(words[i:i + len(phrase)]) == phrase]
    kept = scanner.resolve(scanner.detections(" ".join(words)))
    base = {label for _, label in places}
    best = max((d.priority for d in kept), default=0)
    return {"n_base": len(places), "first_word": min((i for i, _ in places), default=None),
            "last_word": max((i for i, _ in places), default=None), "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {d.label for d in kept})),
            "score": max(best / 60.0, 0.5 if base else 0.0), "n_detections": len(kept)}


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x41:0x5B] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, n_detections long")


def scan_batches(batches):
    """Arrow batches of (doc_id, text) to one row per document.  Words are
    counted for all; the rules see the texts that hold a stem."""
    scanner = Scanner()
    empty = scan_text(scanner, "")
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        n_words, found = [], []
        for i, j in row_blocks(offsets):
            block = data[offsets[i]:offsets[j]]
            start, _, before = spans_of(WORD_BYTE[block], offsets[i:j + 1] - offsets[i])
            n_words.append(np.diff(before))
            for r in range(i, j):
                raw = LOWER[data[offsets[r]:offsets[r + 1]]].tobytes()
                found.append(scan_text(scanner, raw.decode()) if any(s in raw for s in STEMS) else empty)
        if not found:
            continue
        cols = [batch.column(0).cast(pa.int64()), pa.array(np.concatenate(n_words).astype(np.int64))]
        kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        cols += [pa.array([f[k] for f in found], kinds.get(k, pa.int64())) for k in names[2:]]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document; no shuffle."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan_batches, SCHEMA)
