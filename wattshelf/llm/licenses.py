"""License scan: ordered regex rules behind a keyword prefilter, with overlap suppression; base phrases on words."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame

from wattshelf.llm.common import map_rows, plain_words

#: Phrases (words in sequence) and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


class SignatureRule(NamedTuple):
    """A signature: the regex is tried only where a keyword occurs (each match must hold one); lower priority numbers win overlaps."""

    label: str
    keywords: tuple[str, ...]
    pattern: str
    priority: int
    weight: float


#: License families: label, short names (regex), long names (regex), web places (regex), keywords of the names.
FAMILIES = (
    ("apache-2.0", r"apache-2\.0", r"apache (?:software )?licen[sc]e,? (?:version|v)?\.? ?2(?:\.0)?", r"apache\.org/licenses/license-2\.0", ("apache",)),
    ("apache-1.1", r"apache-1\.1", r"apache (?:software )?licen[sc]e,? (?:version|v)?\.? ?1\.1", r"apache\.org/licenses/license-1\.1", ("apache",)),
    ("mit", r"mit", r"(?:the )?mit licen[sc]e", r"opensource\.org/licenses?/mit", ("mit",)),
    ("mit-0", r"mit-0", r"mit no attribution(?: licen[sc]e)?", r"opensource\.org/licenses?/mit-0", ("mit-0", "mit no attribution")),
    ("bsd-2-clause", r"bsd-2-clause", r"(?:simplified|freebsd|2-clause|two-clause) bsd licen[sc]e|bsd 2-clause", r"opensource\.org/licenses?/bsd-2-clause", ("bsd",)),
    ("bsd-3-clause", r"bsd-3-clause", r"(?:new|revised|modified|3-clause|three-clause) bsd licen[sc]e|bsd 3-clause", r"opensource\.org/licenses?/bsd-3-clause", ("bsd",)),
    ("bsd-4-clause", r"bsd-4-clause", r"(?:original|old|4-clause) bsd licen[sc]e|bsd 4-clause", r"directory\.fsf\.org/wiki/license:bsd-4", ("bsd",)),
    ("isc", r"isc", r"isc licen[sc]e", r"opensource\.org/licenses?/isc", ("isc",)),
    ("zlib", r"zlib", r"zlib(?:/libpng)? licen[sc]e", r"opensource\.org/licenses?/zlib", ("zlib",)),
    ("gpl-2.0-only", r"gpl-2\.0(?:-only)?", r"gnu general public licen[sc]e,? (?:version|v)?\.? ?2(?:\.0)? only", r"gnu\.org/licenses/old-licenses/gpl-2\.0", ("gpl", "general public")),
    ("gpl-2.0-or-later", r"gpl-2\.0(?:-or-later|\+)", r"gnu general public licen[sc]e,? (?:version|v)?\.? ?2(?:\.0)?,? or (?:\(at your option\) )?any later", r"gnu\.org/licenses/gpl-2\.0", ("gpl", "general public")),
    ("gpl-3.0-only", r"gpl-3\.0(?:-only)?", r"gnu general public licen[sc]e,? (?:version|v)?\.? ?3(?:\.0)? only", r"gnu\.org/licenses/gpl-3\.0", ("gpl", "general public")),
    ("gpl-3.0-or-later", r"gpl-3\.0(?:-or-later|\+)", r"gnu general public licen[sc]e,? (?:version|v)?\.? ?3(?:\.0)?,? or (?:\(at your option\) )?any later", r"gnu\.org/licenses/gpl\.html", ("gpl", "general public")),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"gnu (?:lesser|library) general public licen[sc]e,? (?:version|v)?\.? ?2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", ("lgpl", "lesser general", "library general")),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu lesser general public licen[sc]e,? (?:version|v)?\.? ?3", r"gnu\.org/licenses/lgpl-3\.0", ("lgpl", "lesser general")),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu affero general public licen[sc]e(?:,? (?:version|v)?\.? ?3)?", r"gnu\.org/licenses/agpl-3\.0", ("agpl", "affero")),
    ("mpl-1.1", r"mpl-1\.1", r"mozilla public licen[sc]e,? (?:version|v)?\.? ?1\.1", r"mozilla\.org/mpl/1\.1|mozilla\.org/mpl/mpl-1\.1", ("mpl", "mozilla")),
    ("mpl-2.0", r"mpl-2\.0", r"mozilla public licen[sc]e,? (?:version|v)?\.? ?2(?:\.0)?", r"mozilla\.org/mpl/2\.0", ("mpl", "mozilla")),
    ("epl-1.0", r"epl-1\.0", r"eclipse public licen[sc]e,? (?:version|v|-)?\.? ?(?:v )?1(?:\.0)?", r"eclipse\.org/legal/epl-v10", ("epl", "eclipse")),
    ("epl-2.0", r"epl-2\.0", r"eclipse public licen[sc]e,? (?:version|v|-)?\.? ?(?:v )?2(?:\.0)?", r"eclipse\.org/legal/epl-2\.0", ("epl", "eclipse")),
    ("cddl-1.0", r"cddl-1\.0", r"common development and distribution licen[sc]e,? (?:version|v)?\.? ?1\.0", r"opensource\.org/licenses?/cddl-1\.0", ("cddl", "common development")),
    ("cddl-1.1", r"cddl-1\.1", r"common development and distribution licen[sc]e,? (?:version|v)?\.? ?1\.1", r"glassfish[^\s]{0,200}/cddl\+gpl_1_1", ("cddl", "common development")),
    ("eupl-1.1", r"eupl-1\.1", r"european union public licen[sc]e,? (?:version|v)?\.? ?1\.1", r"joinup\.ec\.europa\.eu/[^\s]{0,200}eupl/1\.1", ("eupl", "european union public")),
    ("eupl-1.2", r"eupl-1\.2", r"european union public licen[sc]e,? (?:version|v)?\.? ?1\.2", r"joinup\.ec\.europa\.eu/[^\s]{0,200}eupl/1\.2", ("eupl", "european union public")),
    ("artistic-1.0", r"artistic-1\.0", r"artistic licen[sc]e,? (?:version|v)?\.? ?1(?:\.0)?", r"opensource\.org/licenses?/artistic-1\.0", ("artistic",)),
    ("artistic-2.0", r"artistic-2\.0", r"artistic licen[sc]e,? (?:version|v)?\.? ?2(?:\.0)?", r"opensource\.org/licenses?/artistic-2\.0", ("artistic",)),
    ("bsl-1.0", r"bsl-1\.0", r"boost software licen[sc]e(?:,? (?:version|v)?\.? ?1\.0)?", r"boost\.org/license_1_0", ("bsl-1", "boost")),
    ("busl-1.1", r"busl-1\.1", r"business source licen[sc]e(?:,? (?:version|v)?\.? ?1\.1)?", r"mariadb\.com/bsl11", ("busl", "business source", "bsl11")),
    ("unlicense", r"unlicense", r"(?:the )?unlicense", r"unlicense\.org", ("unlicense",)),
    ("wtfpl", r"wtfpl", r"do what the fuck you want to public licen[sc]e", r"wtfpl\.net", ("wtfpl", "what the fuck")),
    ("0bsd", r"0bsd", r"(?:zero-clause|bsd zero clause) (?:bsd )?licen[sc]e", r"opensource\.org/licenses?/0bsd", ("0bsd", "zero-clause", "zero clause")),
    ("postgresql", r"postgresql", r"postgresql licen[sc]e", r"opensource\.org/licenses?/postgresql", ("postgresql",)),
    ("python-2.0", r"(?:python|psf)-2\.0", r"python software foundation licen[sc]e|psf licen[sc]e", r"docs\.python\.org/[^\s]{0,200}/license", ("python", "psf")),
    ("ofl-1.1", r"ofl-1\.1", r"sil open font licen[sc]e(?:,? (?:version|v)?\.? ?1\.1)?", r"scripts\.sil\.org/ofl|openfontlicense\.org", ("ofl", "open font", "openfont")),
    ("openssl", r"openssl", r"openssl licen[sc]e", r"openssl\.org/source/license", ("openssl",)),
    ("ms-pl", r"ms-pl", r"microsoft public licen[sc]e", r"opensource\.org/licenses?/ms-pl", ("ms-pl", "microsoft public")),
    ("ms-rl", r"ms-rl", r"microsoft reciprocal licen[sc]e", r"opensource\.org/licenses?/ms-rl", ("ms-rl", "microsoft reciprocal")),
    ("osl-3.0", r"osl-3\.0", r"open software licen[sc]e,? (?:version|v)?\.? ?3", r"opensource\.org/licenses?/osl-3\.0", ("osl-3", "open software")),
    ("afl-3.0", r"afl-3\.0", r"academic free licen[sc]e,? (?:version|v)?\.? ?3", r"opensource\.org/licenses?/afl-3\.0", ("afl-3", "academic free")),
    ("ncsa", r"ncsa", r"university of illinois/ncsa open source licen[sc]e", r"opensource\.org/licenses?/ncsa", ("ncsa",)),
    ("upl-1.0", r"upl-1\.0", r"universal permissive licen[sc]e", r"oss\.oracle\.com/licenses/upl", ("upl", "universal permissive")),
    ("sspl-1.0", r"sspl-1\.0", r"server side public licen[sc]e", r"mongodb\.com/licensing/server-side-public-license", ("sspl", "server side public", "server-side-public")),
    ("elastic-2.0", r"elastic-2\.0", r"elastic licen[sc]e(?:,? (?:version|v)?\.? ?2\.0)?", r"elastic\.co/licensing/elastic-license", ("elastic",)),
    ("cc0-1.0", r"cc0-1\.0", r"cc0(?: 1\.0)?(?: universal)?|creative commons zero", r"creativecommons\.org/publicdomain/zero", ("cc0", "creative commons zero", "publicdomain/zero")),
    ("cc-by-4.0", r"cc[- ]by[- ]4\.0", r"creative commons attribution 4\.0", r"creativecommons\.org/licenses/by/4\.0", ("cc by", "cc-by", "creative commons", "creativecommons")),
    ("cc-by-3.0", r"cc[- ]by[- ]3\.0", r"creative commons attribution 3\.0", r"creativecommons\.org/licenses/by/3\.0", ("cc by", "cc-by", "creative commons", "creativecommons")),
    ("cc-by-sa-4.0", r"cc[- ]by-sa[- ]4\.0", r"creative commons attribution[- ]share ?-?alike 4\.0", r"creativecommons\.org/licenses/by-sa/4\.0", ("cc by", "cc-by", "creative commons", "creativecommons")),
    ("cc-by-sa-3.0", r"cc[- ]by-sa[- ]3\.0", r"creative commons attribution[- ]share ?-?alike 3\.0", r"creativecommons\.org/licenses/by-sa/3\.0", ("cc by", "cc-by", "creative commons", "creativecommons")),
    ("cc-by-nc-4.0", r"cc[- ]by-nc[- ]4\.0", r"creative commons attribution[- ]non-?commercial 4\.0", r"creativecommons\.org/licenses/by-nc/4\.0", ("cc by", "cc-by", "creative commons", "creativecommons")),
    ("cc-by-nd-4.0", r"cc[- ]by-nd[- ]4\.0", r"creative commons attribution[- ]no ?-?deriv(?:ative)?s? 4\.0", r"creativecommons\.org/licenses/by-nd/4\.0", ("cc by", "cc-by", "creative commons", "creativecommons")),
    ("cc-by-nc-sa-4.0", r"cc[- ]by-nc-sa[- ]4\.0", r"creative commons attribution[- ]non-?commercial[- ]share ?-?alike 4\.0", r"creativecommons\.org/licenses/by-nc-sa/4\.0", ("cc by", "cc-by", "creative commons", "creativecommons")),
    ("cc-by-nc-nd-4.0", r"cc[- ]by-nc-nd[- ]4\.0", r"creative commons attribution[- ]non-?commercial[- ]no ?-?deriv(?:ative)?s? 4\.0", r"creativecommons\.org/licenses/by-nc-nd/4\.0", ("cc by", "cc-by", "creative commons", "creativecommons")),
    ("odbl-1.0", r"odbl-1\.0", r"open database licen[sc]e", r"opendatacommons\.org/licenses/odbl", ("odbl", "open database")),
    ("odc-by-1.0", r"odc-by-1\.0", r"open data commons attribution licen[sc]e", r"opendatacommons\.org/licenses/by", ("odc-by", "open data commons", "opendatacommons")),
    ("pddl-1.0", r"pddl-1\.0", r"open data commons public domain dedication", r"opendatacommons\.org/licenses/pddl", ("pddl", "open data commons", "opendatacommons")),
    ("gfdl-1.3", r"gfdl-1\.3(?:-only|-or-later)?", r"gnu free documentation licen[sc]e(?:,? (?:version|v)?\.? ?1\.3)?", r"gnu\.org/licenses/fdl", ("gfdl", "free documentation", "/fdl")),
    ("openrail", r"(?:open|bigscience-)rail(?:-m)?", r"open ?rail(?:-m)? licen[sc]e|responsible ai licen[sc]e", r"licenses\.ai", ("rail", "responsible ai", "licenses.ai")),
)

#: Signatures that stand alone: label, keyword, regex, priority, weight.
SINGLE_RULES = (
    ("cc-by-sa", "by-sa", r"\bcc[- ]by-sa\b", 35, 0.6),
    ("cc-by-nc", "by-nc", r"\bcc[- ]by-nc\b", 35, 0.6),
    ("cc-by-nd", "by-nd", r"\bcc[- ]by-nd\b", 35, 0.6),
    ("cc-by", "cc by", r"\bcc by\b", 40, 0.6),
    ("cc-by", "cc-by", r"\bcc-by\b", 40, 0.6),
    ("cc", "creative commons", r"\bcreative commons\b", 60, 0.4),
    ("gpl", "general public license", r"\b(?:gnu )?general public license\b", 45, 0.6),
    ("gpl", "gpl", r"\b(?:gnu )?gpl(?:v[23])?\b", 50, 0.5),
    ("lgpl", "lgpl", r"\blgpl(?:v[23])?\b", 48, 0.5),
    ("agpl", "agpl", r"\bagpl(?:v3)?\b", 48, 0.5),
    ("bsd", "bsd", r"\bbsd licen[sc]e\b", 50, 0.5),
    ("apache", "apache", r"\bapache licen[sc]e\b", 50, 0.5),
    ("mpl", "mozilla public", r"\bmozilla public licen[sc]e\b", 50, 0.5),
    ("reserved", "all rights reserved", r"\ball rights reserved\b", 40, 0.7),
    ("reserved", "tous droits", r"\btous droits r[ée]serv[ée]s\b", 40, 0.7),
    ("reserved", "alle rechte", r"\balle rechte vorbehalten\b", 40, 0.7),
    ("reserved", "derechos reservados", r"\btodos los derechos reservados\b", 40, 0.7),
    ("copyright", "copyright", r"\bcopyright (?:\(c\) |© )?(?:19|20)[0-9]{2}\b", 70, 0.3),
    ("copyright", "©", r"© ?(?:19|20)[0-9]{2}\b", 70, 0.3),
    ("public-domain", "public domain", r"\b(?:in|into|to) the public domain\b", 55, 0.6),
    ("mit", "permission is hereby granted", r"\bpermission is hereby granted, free of charge, to any person obtaining a copy\b", 20, 0.9),
    ("isc", "permission to use, copy", r"\bpermission to use, copy, modify, and/or distribute this software\b", 20, 0.9),
    ("bsd", "redistribution and use", r"\bredistribution and use in source and binary forms\b", 25, 0.8),
    ("gpl", "free software", r"\bthis program is free software[:;] you can redistribute it\b", 25, 0.8),
    ("proprietary", "proprietary", r"\bproprietary and confidential\b", 40, 0.7),
    ("proprietary", "unauthori", r"\bunauthori[sz]ed (?:copying|reproduction|distribution)\b", 40, 0.6),
    ("no-ai-training", "train", r"\b(?:not|never) be used (?:to train|for training)\b", 30, 0.6),
)


def signature_rules() -> list[SignatureRule]:
    """All rules in order of priority: five per family, then those that stand alone."""
    rules = []
    for label, short, long_name, place, keywords in FAMILIES:
        rules += [
            SignatureRule(label, ("spdx-license-identifier",), rf"spdx-license-identifier: ?(?:{short})(?![\w.+-])", 5, 0.95),
            SignatureRule(label, keywords, rf"(?:{place})\b", 10, 0.85),
            SignatureRule(label, keywords, rf"\b(?:licen[sc]ed|released|distributed|available) under (?:the |a )?(?:terms of (?:the )?)?(?:{long_name}|{short})(?![\w-])", 15, 0.9),
            SignatureRule(label, keywords, rf"\b(?:{long_name})(?![\w-])", 30, 0.75),
            SignatureRule(label, keywords, rf"\blicen[sc]e ?[:=] ?[\"']?(?:{short})(?![\w.+-])", 12, 0.85),
        ]
    rules += [SignatureRule(label, (keyword,), pattern, priority, weight) for label, keyword, pattern, priority, weight in SINGLE_RULES]
    return sorted(rules, key=lambda r: (r.priority, r.label, r.pattern))


class Scanner:
    """Compiled rules with one automaton over all keywords."""

    def __init__(self, rules: list[SignatureRule]):
        self.rules = rules
        self.patterns = [re.compile(r.pattern) for r in rules]
        by_keyword: dict[str, list[int]] = {}
        for i, rule in enumerate(rules):
            for keyword in rule.keywords:
                by_keyword.setdefault(keyword, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for keyword, ids in by_keyword.items():
            self.automaton.add_word(keyword, ids)
        self.automaton.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) left after suppression, by start.

        ``text`` has A-Z lower-cased. In order of priority, then length, an interval is dropped if an earlier
        one contains it or if it overlaps an earlier one of stronger priority.
        """
        tried = {i for _, ids in self.automaton.iter(text) for i in ids}
        found = [
            (self.rules[i].priority, m.start() - m.end(), m.start(), m.end(), i)
            for i in tried
            for m in self.patterns[i].finditer(text)
        ]
        kept: list[tuple[int, int, int, int]] = []  # by start
        longest = 0
        for priority, _, start, end, i in sorted(found):
            low = bisect_left(kept, (start - longest,))
            near = kept[low : bisect_left(kept, (end,))]
            if not any((s <= start and end <= e) or (p < priority and start < e and s < end) for s, e, _, p in near):
                insort(kept, (start, end, i, priority))
                longest = max(longest, end - start)
        return [(s, e, i) for s, e, i, _ in kept]


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(word index, label) wherever a phrase's words stand one after the other."""
    places = []
    for phrase, label in phrases:
        at = -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if words[at : at + len(phrase)] == phrase:
                    places.append((at, label))
        except ValueError:
            pass
    return places


def scan_licenses(docs: DataFrame, rules: list[SignatureRule] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists the rules' detections as ``label:start:end`` in characters, by start. ``score`` is one
    minus the product of (1 - weight) over the strongest rule of each label; a base label counts 0.7.

    Null and empty texts have no words, null first and last word, empty labels, score 0; repeated rows are
    scanned each; an empty table gives no rows; other columns are ignored.
    """
    chosen = rules if rules is not None else signature_rules()
    phrases = [(phrase.encode().split(), label) for phrase, label in PHRASES]
    lowered = str.maketrans({c: chr(c + 32) for c in range(65, 91)})

    def factory():
        scanner = Scanner(chosen)

        def one(text):
            words = plain_words(text)
            places = phrase_places(words, phrases)
            low = text.lower() if text and text.isascii() else (text or "").translate(lowered)
            spans = [(chosen[i].label, s, e, chosen[i].weight) for s, e, i in scanner.detections(low)]
            base = sorted({label for _, label in places})
            weights = {label: 0.7 for label in base}
            for label, _, _, weight in spans:
                weights[label] = max(weight, weights.get(label, 0.0))
            missed = 1.0
            for label in sorted(weights):
                missed *= 1.0 - weights[label]
            at = [start for start, _ in places]
            return (
                len(words), len(places), min(at, default=None), max(at, default=None), ",".join(base),
                ",".join(sorted(weights)), round(1.0 - missed, 6), ",".join(f"{la}:{s}:{e}" for la, s, e, _ in spans),
            )

        def step(batch):
            rows = [one(t) for t in batch["text"].to_pylist()]
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
            return {"doc_id": batch["doc_id"], **{n: [r[i] for r in rows] for i, n in enumerate(names)}}

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind},n_words bigint,n_base bigint,first_word bigint,last_word bigint,base_labels string,labels string,"
        "score double,spans string"
    )
    return map_rows(docs, factory, schema, ["doc_id", "text"])
