"""License scan: ordered signature rules behind a keyword gate.

The rules are written by hand: sentences of the licenses, identifiers, short names where one is
declared, and license names times the phrasings in which they are granted or mentioned. A rule runs only on texts that hold its gate keywords.
Every hit is an interval of words with the priority of its phrasing; a hit that lies
inside the interval of another hit of equal or higher priority is dropped, and of equal
intervals the first rule in order stays. What remains gives the labels.

The base scan counts the places where the words of a base phrase stand consecutively.
Null text counts as empty: no words, no labels, score 0. One row out per row in; only
``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.ragged import ALNUM, LOWER, row_slices, utf8, words

#: Fixed values of the base scan.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_W = rb"0-9a-z\x80-\xff"
_VERSION = r"(?:(?:[\s,(-]|\xe2\x80[\x90-\x95])*(?:version|ver\.?|v\.?)?\s*"  # a group that a number and ")" close; dashes in UTF-8
#: license id, its names as a regex over lower-cased text, and keywords of which any of its names holds one.
NAMES: tuple[tuple[str, str, str], ...] = (
    ("agpl-1.0", rf"(?:gnu )?affero general public licen[sc]e{_VERSION}1(?:\.0)?)", "affero"),
    ("agpl-3.0", rf"(?:gnu )?(?:affero general public licen[sc]e|agpl){_VERSION}3(?:\.0)?)", "affero|agpl"),
    ("lgpl-2.0", rf"(?:gnu )?(?:library general public licen[sc]e|lgpl){_VERSION}2(?:\.0)?)(?!\.?1)", "library|lesser|lgpl"),
    ("lgpl-2.1", rf"(?:gnu )?(?:lesser general public licen[sc]e|lgpl){_VERSION}2\.1)", "library|lesser|lgpl"),
    ("lgpl-3.0", rf"(?:gnu )?(?:lesser general public licen[sc]e|lgpl){_VERSION}3(?:\.0)?)", "library|lesser|lgpl"),
    ("gpl-1.0", rf"(?:gnu )?(?:general public licen[sc]e|gpl){_VERSION}1(?:\.0)?)", "general|gpl"),
    ("gpl-2.0", rf"(?:gnu )?(?:general public licen[sc]e|gpl){_VERSION}2(?:\.0)?)", "general|gpl"),
    ("gpl-3.0", rf"(?:gnu )?(?:general public licen[sc]e|gpl){_VERSION}3(?:\.0)?)", "general|gpl"),
    ("gfdl", rf"(?:gnu )?free documentation licen[sc]e(?:{_VERSION}1\.[1-3]))?", "documentation"),
    ("apache-1.0", rf"apache(?: software)? licen[sc]e{_VERSION}1\.0)", "apache"),
    ("apache-1.1", rf"apache(?: software)? licen[sc]e{_VERSION}1\.1)", "apache"),
    ("apache-2.0", rf"apache(?: software)?(?: licen[sc]e)?{_VERSION}2(?:\.0)?)", "apache"),
    ("mit", r"(?:the )?mit(?: \(expat\))? licen[sc]e", "mit"),
    ("expat", r"expat licen[sc]e", "expat"),
    ("bsd-2-clause", r"(?:bsd[ -]2[ -]clause|simplified bsd|freebsd)(?: licen[sc]e)?", "bsd"),
    ("bsd-3-clause", r"(?:bsd[ -]3[ -]clause|(?:new|revised|modified) bsd)(?: licen[sc]e)?", "bsd"),
    ("bsd-4-clause", r"(?:bsd[ -]4[ -]clause|original bsd)(?: licen[sc]e)?", "bsd"),
    ("bsd", r"bsd(?:[ -]style)? licen[sc]e", "bsd"),
    ("isc", r"isc licen[sc]e", "isc"),
    ("mpl-1.1", rf"mozilla public licen[sc]e{_VERSION}1\.1)", "mozilla"),
    ("mpl-2.0", rf"(?:mozilla public licen[sc]e|mpl){_VERSION}2(?:\.0)?)", "mozilla|mpl"),
    ("epl-1.0", rf"eclipse public licen[sc]e{_VERSION}1(?:\.0)?)", "eclipse"),
    ("epl-2.0", rf"eclipse public licen[sc]e{_VERSION}2(?:\.0)?)", "eclipse"),
    ("cddl-1.0", rf"common development and distribution licen[sc]e(?:{_VERSION}1\.0))?", "development"),
    ("cpl-1.0", rf"common public licen[sc]e{_VERSION}1\.0)", "common"),
    ("eupl", r"european union public licen[sc]e", "european"),
    ("artistic", r"(?:the )?artistic licen[sc]e(?:[\s,]*2\.0)?", "artistic"),
    ("bsl-1.0", r"boost software licen[sc]e(?:[\s,-]*(?:version )?1\.0)?", "boost"),
    ("zlib", r"zlib(?:/libpng)? licen[sc]e", "zlib"),
    ("unlicense", r"(?:the )?unlicen[sc]e", "unlicen"),
    ("wtfpl", r"do what the f\S+ you want to public licen[sc]e|wtfpl", "want|wtfpl"),
    ("postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("ofl-1.1", rf"(?:sil )?open font licen[sc]e(?:{_VERSION}1\.1))?", "font"),
    ("openssl", r"openssl licen[sc]e", "openssl"),
    ("python-2.0", r"(?:python software foundation|psf) licen[sc]e", "python|psf"),
    ("php-3.01", rf"php licen[sc]e(?:{_VERSION}3\.0?1))?", "php"),
    ("odbl", r"open (?:data commons open )?database licen[sc]e", "database"),
    ("cc0-1.0", r"(?:creative commons zero|cc0)(?:[ -](?:v?1\.0)(?: universal)?)?", "zero|cc0"),
    ("cc-by-nc-nd", r"(?:cc|creative commons)(?: |-)(?:by|attribution)[ -](?:nc|non-?commercial)[ -](?:nd|no-?deriv(?:ative)?s?)(?:(?: |-)v?\d\.\d)?", "cc|creative"),
    ("cc-by-nc-sa", r"(?:cc|creative commons)(?: |-)(?:by|attribution)[ -](?:nc|non-?commercial)[ -](?:sa|share-?alike)(?:(?: |-)v?\d\.\d)?", "cc|creative"),
    ("cc-by-nc", r"(?:cc|creative commons)(?: |-)(?:by|attribution)[ -](?:nc|non-?commercial)(?:(?: |-)v?\d\.\d)?", "cc|creative"),
    ("cc-by-nd", r"(?:cc|creative commons)(?: |-)(?:by|attribution)[ -](?:nd|no-?deriv(?:ative)?s?)(?:(?: |-)v?\d\.\d)?", "cc|creative"),
    ("cc-by-sa", r"(?:cc|creative commons)(?: |-)(?:by|attribution)[ -](?:sa|share-?alike)(?:(?: |-)v?\d\.\d)?", "cc|creative"),
    ("cc-by", r"(?:cc|creative commons)(?: |-)(?:by|attribution)(?:(?: |-)v?\d\.\d)?", "cc|creative"),
    ("proprietary", r"(?:proprietary|commercial) licen[sc]e", "licen"),
)

#: phrasing, priority (1 is best), confidence, regex around the name, gate keywords (one must be there).
PHRASINGS: tuple[tuple[str, int, float, str, str], ...] = (
    ("granted", 1, 0.95, r"(?:is |are |be )?(?:dual[- ])?(?:re)?licen[sc]ed (?:to you )?under (?:the )?(?:terms of )?(?:the |an? )?{name}(?: licen[sc]e)?", "under"),
    ("released", 1, 0.95, r"(?:released|distributed|published|available|provided|made available) under (?:the )?(?:terms of )?(?:the |an? )?{name}(?: licen[sc]e)?", "under"),
    ("terms", 1, 0.9, r"(?:terms|conditions|provisions) of (?:the |an? )?{name}(?: licen[sc]e)?", "of"),
    ("declared", 2, 0.9, r"licen[sc]e\s*[:=]\s*(?:the )?{name}", "licen"),
    ("subject", 2, 0.8, r"(?:subject to|governed by|covered by|according to|in accordance with) (?:the |an? )?{name}(?: licen[sc]e)?", "subject|governed|covered|accord"),
    ("see", 3, 0.7, r"(?:see|read|refer to) (?:the )?{name}", "see|read|refer"),
    ("mention", 4, 0.5, r"{name}", ""),
)

#: Texts and tags that name a license by themselves: id, priority, confidence, regex, gate keyword.
SINGLE: tuple[tuple[str, int, float, str, str], ...] = (
    ("mit", 1, 0.99, r"permission is hereby granted,? free of charge,? to any person obtaining a copy.{0,600}?without restriction", "hereby"),
    ("isc", 1, 0.95, r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose", "permission"),
    ("bsd", 1, 0.9, r"redistribution and use in source and binary forms, with or without modification", "redistribution"),
    ("gpl", 1, 0.9, r"this program is free software[:;,]? you can redistribute it and/or modify", "redistribute"),
    ("gpl", 3, 0.6, r"(?:under (?:the )?)?(?:gnu )?general public licen[sc]e", "general"),
    ("apache", 3, 0.6, r"apache(?: software)? licen[sc]e", "apache"),
    ("apache-2.0", 1, 0.95, r"https?://www\.apache\.org/licenses/license-2\.0", "apache.org"),
    ("gpl", 2, 0.8, r"https?://www\.gnu\.org/(?:licenses|copyleft)/\S*gpl\S*", "gnu.org"),
    ("mit", 2, 0.9, r"https?://(?:www\.)?opensource\.org/licenses/mit\S*", "opensource.org"),
    ("mpl-2.0", 2, 0.9, r"https?://(?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0", "mozilla.org"),
    ("cc-by", 2, 0.8, r"https?://creativecommons\.org/licenses/by/\d\.\d", "creativecommons.org"),
    ("cc0-1.0", 2, 0.9, r"https?://creativecommons\.org/publicdomain/zero/1\.0", "creativecommons.org"),
    ("unlicense", 1, 0.95, r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", 3, 0.7, r"(?:released (?:in)?to|placed in(?:to)?|dedicated to|in) the public domain", "domain"),
    ("all-rights-reserved", 4, 0.6, r"all rights reserved", "reserved"),
    # sentences of the licenses themselves and of the notices they ask for
    ("apache-2.0", 1, 0.95, r"unless required by applicable law or agreed to in writing,? software distributed under the licen[sc]e is distributed on an .{0,6}as is", "applicable"),
    ("apache-2.0", 1, 0.95, r"you may not use this file except in compliance with the licen[sc]e", "compliance"),
    ("bsd-3-clause", 1, 0.95, r"neither the names? of .{1,200}?nor the names of (?:its|their|any) contributors may be used to endorse", "endorse"),
    ("bsd-4-clause", 1, 0.95, r"all advertising materials mentioning features or use of this software must display", "advertising"),
    ("bsl-1.0", 1, 0.95, r"to any person or organization obtaining a copy of the software and accompanying documentation", "accompanying"),
    ("zlib", 1, 0.95, r"this software is provided .{0,6}as-is.{0,6} without any express or implied warranty", "as-is"),
    ("mpl-2.0", 1, 0.95, r"this source code form is subject to the terms of the mozilla public licen[sc]e", "mozilla"),
    ("mpl-1.1", 1, 0.9, r"the contents of this file are subject to the mozilla public licen[sc]e", "mozilla"),
    ("gpl-2.0", 1, 0.95, r"gnu general public licen[sc]e as published by the free software foundation[;,]? (?:either )?version 2", "general"),
    ("gpl-3.0", 1, 0.95, r"gnu general public licen[sc]e as published by the free software foundation[;,]? (?:either )?version 3", "general"),
    ("lgpl-2.1", 1, 0.95, r"gnu lesser general public licen[sc]e as published by the free software foundation[;,]? (?:either )?version 2\.1", "lesser"),
    ("lgpl-3.0", 1, 0.95, r"gnu lesser general public licen[sc]e as published by the free software foundation[;,]? (?:either )?version 3", "lesser"),
    ("agpl-3.0", 1, 0.95, r"gnu affero general public licen[sc]e as published by the free software foundation[;,]? (?:either )?version 3", "affero"),
    ("epl-1.0", 1, 0.9, r"made available under the terms of the eclipse public licen[sc]e v1\.0", "eclipse"),
    ("epl-2.0", 1, 0.9, r"made available under the terms of the eclipse public licen[sc]e 2\.0", "eclipse"),
    ("cddl-1.0", 1, 0.9, r"subject to the terms of the common development and distribution licen[sc]e", "development"),
    ("artistic", 1, 0.9, r"the intent of this document is to state the conditions under which a package may be copied", "intent"),
    ("postgresql", 1, 0.9, r"permission to use, copy, modify, and distribute this software and its documentation for any purpose,? without fee", "permission"),
    ("python-2.0", 1, 0.9, r"psf hereby grants licen[sc]ee a nonexclusive", "psf"),
    ("openssl", 1, 0.9, r"this product includes software developed by the openssl project", "openssl"),
    ("php-3.01", 1, 0.9, r"this product includes php software", "php"),
    ("wtfpl", 1, 0.95, r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document", "verbatim"),
    ("cc0-1.0", 1, 0.9, r"the person who associated a work with this deed has dedicated the work to the public domain", "deed"),
    ("ofl-1.1", 1, 0.9, r"this font software is licen[sc]ed under the sil open font licen[sc]e", "font"),
    ("cc-by-sa", 1, 0.9, r"https?://creativecommons\.org/licenses/by-sa/\d\.\d", "creativecommons.org"),
    ("cc-by-nc", 1, 0.9, r"https?://creativecommons\.org/licenses/by-nc/\d\.\d", "creativecommons.org"),
    ("cc-by-nd", 1, 0.9, r"https?://creativecommons\.org/licenses/by-nd/\d\.\d", "creativecommons.org"),
    ("cc-by-nc-sa", 1, 0.9, r"https?://creativecommons\.org/licenses/by-nc-sa/\d\.\d", "creativecommons.org"),
    ("cc-by-nc-nd", 1, 0.9, r"https?://creativecommons\.org/licenses/by-nc-nd/\d\.\d", "creativecommons.org"),
    # identifiers that stand alone
    ("0bsd", 3, 0.7, r"0bsd", "0bsd"),
    ("bsl-1.0", 3, 0.7, r"bsl-1\.0", "bsl-"),
    ("epl-1.0", 3, 0.7, r"epl-1\.0", "epl-"),
    ("epl-2.0", 3, 0.7, r"epl-2\.0", "epl-"),
    ("mpl-1.1", 3, 0.7, r"mpl-1\.1", "mpl-"),
    ("cddl-1.0", 3, 0.7, r"cddl-1\.[01]", "cddl"),
    ("eupl", 3, 0.7, r"eupl-1\.[0-2]", "eupl"),
    ("ofl-1.1", 3, 0.7, r"ofl-1\.1", "ofl-"),
    ("artistic", 3, 0.7, r"artistic-[12]\.0", "artistic"),
    ("odbl", 3, 0.7, r"odbl-1\.0", "odbl"),
    ("afl-3.0", 3, 0.7, r"(?:afl-3\.0|academic free licen[sc]e)", "afl-|academic"),
    ("osl-3.0", 3, 0.7, r"(?:osl-3\.0|open software licen[sc]e)", "osl-|open"),
    ("ms-pl", 3, 0.7, r"(?:ms-pl|microsoft public licen[sc]e)", "ms-pl|microsoft"),
)

#: Short names that mean a license only where one is declared (package metadata, headers, badges).
SHORT: tuple[tuple[str, str], ...] = (
    ("mit", "mit"), ("expat", "expat"), ("isc", "isc"), ("zlib", "zlib"), ("bsd", r"bsd"), ("gpl", r"gpl"), ("lgpl", r"lgpl"), ("agpl", r"agpl"),
    ("apache", r"apache"), ("mpl", r"mpl"), ("eupl", r"eupl"), ("artistic", r"artistic"), ("postgresql", r"postgresql"), ("python-2.0", r"psf"),
    ("wtfpl", r"wtfpl"), ("openssl", r"openssl"), ("ofl-1.1", r"ofl"), ("bsl-1.0", r"boost"), ("public-domain", r"public domain"),
    ("proprietary", r"(?:proprietary|commercial|closed source|all rights reserved)"),
)
#: Ways to declare one: priority, confidence, regex around the name, gate keyword.
DECLARED: tuple[tuple[int, float, str, str], ...] = (
    (2, 0.9, r"licen[sc]es?[\"'\]]?\s*[:=]+\s*[\"'\[(]{{0,2}}(?:the )?{name}", "licen"),
    (2, 0.9, r"licen[sc]e\s*::\s*osi approved\s*::\s*{name}(?: licen[sc]e)?", "approved"),
    (3, 0.7, r"badge/licen[sc]e-{name}", "badge"),
)
_SPDX = re.compile(rb"spdx-license-identifier:\s*([0-9a-z.+-]+(?:\s+(?:or|and|with)\s+[0-9a-z.+-]+)*)")
#: One of these is part of every rule's text. Gates are single words, as any white space may be between two.
GATES = (b"licen", b"gpl", b"wtfpl", b"cc0", b"cc", b"creative", b"apache", b"bsd", b"mpl", b"permission", b"redistribut",
         b"domain", b"gnu.org", b"opensource.org", b"mozilla.org", b"creativecommons.org", b"unencumbered", b"reserved", b"spdx-",
         b"endorse", b"advertising", b"accompanying", b"as-is", b"intent", b"psf", b"openssl", b"php", b"bsl-", b"epl-", b"cddl", b"eupl", b"ofl-",
         b"artistic", b"odbl", b"afl-", b"osl-", b"ms-pl")


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    pattern: re.Pattern[bytes]
    gates: tuple[tuple[bytes, ...], ...]  # of each, one must be in the text


def _bounded(body: str) -> re.Pattern[bytes]:
    spaced = body.replace(" ", r"\s+")
    return re.compile(rb"(?<![" + _W + rb"])(?:" + spaced.encode("latin-1") + rb")(?![" + _W + rb"])", re.DOTALL)


def _any(gate: str) -> tuple[bytes, ...]:
    return tuple(gate.encode().split(b"|"))


def rules() -> list[Rule]:
    """All rules, best priority first."""
    out = [Rule(label, p, conf, _bounded(body), (_any(gate),)) for label, p, conf, body, gate in SINGLE]
    for label, name in SHORT:
        out += [Rule(label, p, conf, _bounded(around.format(name=name)), (_any(gate),)) for p, conf, around, gate in DECLARED]
    for label, name, word in NAMES:
        for _, p, conf, around, gate in PHRASINGS:
            out.append(Rule(label, p, conf, _bounded(around.replace("{name}", f"(?:{name})")), (_any(word), _any(gate))))
    return sorted(out, key=lambda r: r.priority)


class Hit(NamedTuple):
    start: int
    end: int
    priority: int
    order: int
    label: str
    confidence: float


def resolve(hits: list[Hit]) -> list[Hit]:
    """Drop hits contained in a hit that is at least as strong (priority, then length, then rule order).

    In order of their start, longer ones first, a hit is inside an earlier one of some priority
    if the farthest end of that priority is not before its own: one pass, whatever overlaps.
    """
    kept: list[Hit] = []
    reach: dict[int, int] = {}
    for h in sorted(hits, key=lambda h: (h.start, -h.end, h.priority, h.order)):
        if not any(p <= h.priority and end >= h.end for p, end in reach.items()):
            kept.append(h)
        reach[h.priority] = max(reach.get(h.priority, -1), h.end)
    return kept


def scan(text: bytes, ruleset: list[Rule]) -> list[Hit]:
    """Kept hits (byte intervals) of one lower-cased text."""
    if not any(g in text for g in GATES):
        return []
    hits = [Hit(*m.span(), r.priority, i, r.label, r.confidence) for i, r in enumerate(ruleset) if all(any(g in text for g in gate) for gate in r.gates) for m in r.pattern.finditer(text)]
    if b"spdx-" in text:
        for m in _SPDX.finditer(text):
            hits += [
                Hit(m.start(1) + one.start(), m.start(1) + one.end(), 1, -1, one[0].rstrip(b".").decode("ascii"), 0.99)
                for one in re.finditer(rb"[0-9a-z.+-]+", m[1])
                if one[0] not in (b"or", b"and", b"with")
            ]
    return resolve(hits)


_base = [(label, re.compile(rb"(?<![" + _W + rb"])" + (rb"[^" + _W + rb"]+").join(p.encode() for p in phrase.split()) + rb"(?![" + _W + rb"])"), phrase.split()[0].encode()) for phrase, label in BASE]
_ruleset: list[Rule] = []


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, base places, labels, kept detections (word intervals) and score of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _ruleset:
            _ruleset.extend(rules())
        for rb in row_slices(batches):
            data, offsets = utf8(rb.column("text"))
            data = LOWER[data]
            w = words(data, offsets, ALNUM)
            raw = data.tobytes()
            cols: dict[str, list] = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                text = raw[a:b]
                own = w.start[w.first[i] : w.first[i + 1]] - a
                at = [(int(np.searchsorted(own, m.start())), label) for label, p, key in _base if key in text for m in p.finditer(text)]
                base = {label for _, label in at}
                hits = scan(text, _ruleset)
                cols["n_base"].append(len(at))
                cols["first_word"].append(min(at)[0] if at else None)
                cols["last_word"].append(max(at)[0] if at else None)
                cols["base_labels"].append(",".join(sorted(base)))
                cols["labels"].append(",".join(sorted(base | {h.label for h in hits})))
                cols["score"].append(max([0.6 * bool(at), *(h.confidence for h in hits)]))
                cols["detections"].append([{"label": h.label, "priority": h.priority, "first_word": int(np.searchsorted(own, h.start, "right")) - 1, "end_word": int(np.searchsorted(own, h.end))} for h in hits])
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array(w.per_row.astype(np.int64)), *(pa.array(v, k) for v, k in zip(cols.values(), kinds))], ["doc_id", "n_words", *cols]
            )

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(
        run,
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "detections array<struct<label: string, priority: int, first_word: bigint, end_word: bigint>>",
    )
