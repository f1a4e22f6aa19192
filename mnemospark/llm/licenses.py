"""License scans with ordered signature rules.

A rule is a regular expression, the keywords that a text must hold before it is tried, a label, a priority
and a relevance. Keywords are found in one pass of an Aho-Corasick automaton. Rules come from the table of
licenses below and the forms in which a license is named: identifier tag and further operands of its expression,
notice, identifier alone, address, name. Detections
are resolved by priority, then length, then rule order: one that lies within a detection already kept is
dropped.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table, through_python

#: Label, identifiers, name, keywords, address. In names, ~ stands for white space. Every text
#: that a name matches holds one of its keywords; none spans a ~.
LICENSES = (
    ("mit", "mit", r"(?:the~)?(?:mit|expat)~licen[cs]e", "licen", "opensource.org/licenses/mit"),
    ("mit-0", "mit-0", r"mit~no~attribution", "attribution", "opensource.org/licenses/mit-0"),
    ("apache-2.0", "apache-2.0", r"apache~(?:software~)?licen[cs]e,?~(?:version~|v)?2(?:\.0)?", "apache", "apache.org/licenses/license-2.0"),
    ("apache-1.1", "apache-1.1", r"apache~(?:software~)?licen[cs]e,?~(?:version~|v)?1\.1", "apache", "apache.org/licenses/license-1.1"),
    ("apache-1.0", "apache-1.0", r"apache~(?:software~)?licen[cs]e,?~(?:version~|v)?1\.0", "apache", "apache.org/licenses/license-1.0"),
    ("gpl-2.0", "gpl-2.0(?:-only|-or-later|\\+)?", r"(?:gnu~)?(?:general~public~licen[cs]e|gpl),?~?(?:version~|v)?2(?:\.0)?", "general|gpl", "gnu.org/licenses/old-licenses/gpl-2.0"),
    ("gpl-3.0", "gpl-3.0(?:-only|-or-later|\\+)?", r"(?:gnu~)?(?:general~public~licen[cs]e|gpl),?~?(?:version~|v)?3(?:\.0)?", "general|gpl", "gnu.org/licenses/gpl-3.0"),
    ("gpl-1.0", "gpl-1.0(?:-only|-or-later|\\+)?", r"(?:gnu~)?(?:general~public~licen[cs]e|gpl),?~?(?:version~|v)?1(?:\.0)?", "general|gpl", "gnu.org/licenses/old-licenses/gpl-1.0"),
    ("lgpl-2.0", "lgpl-2.0(?:-only|-or-later|\\+)?", r"(?:gnu~)?(?:library~general~public~licen[cs]e|lgpl),?~?(?:version~|v)?2(?:\.0)?", "library|lgpl", "gnu.org/licenses/old-licenses/lgpl-2.0"),
    ("lgpl-2.1", "lgpl-2.1(?:-only|-or-later|\\+)?", r"(?:gnu~)?(?:lesser~general~public~licen[cs]e|lgpl),?~?(?:version~|v)?2\.1", "lesser|lgpl", "gnu.org/licenses/old-licenses/lgpl-2.1"),
    ("lgpl-3.0", "lgpl-3.0(?:-only|-or-later|\\+)?", r"(?:gnu~)?(?:lesser~general~public~licen[cs]e|lgpl),?~?(?:version~|v)?3(?:\.0)?", "lesser|lgpl", "gnu.org/licenses/lgpl-3.0"),
    ("agpl-3.0", "agpl-3.0(?:-only|-or-later|\\+)?", r"(?:gnu~)?(?:affero~general~public~licen[cs]e|agpl),?~?(?:version~|v)?3?(?:\.0)?", "affero|agpl", "gnu.org/licenses/agpl-3.0"),
    ("bsd-2-clause", "bsd-2-clause", r"(?:simplified~bsd|2-clause~bsd|bsd~2-clause|freebsd)~?(?:licen[cs]e)?", "bsd", "opensource.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd-3-clause", r"(?:new~bsd|modified~bsd|3-clause~bsd|bsd~3-clause)~?(?:licen[cs]e)?", "bsd", "opensource.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "bsd-4-clause", r"(?:original~bsd|4-clause~bsd|bsd~4-clause)~?(?:licen[cs]e)?", "bsd", "spdx.org/licenses/bsd-4-clause"),
    ("0bsd", "0bsd", r"(?:zero-clause~bsd|bsd~zero~clause|free~public~licen[cs]e)", "bsd|licen", "opensource.org/licenses/0bsd"),
    ("bsd", "bsd", r"bsd(?:-style|-like)?~licen[cs]e", "bsd", "opensource.org/licenses/bsd-license"),
    ("isc", "isc", r"isc~licen[cs]e", "isc", "opensource.org/licenses/isc"),
    ("mpl-1.0", "mpl-1.0", r"mozilla~public~licen[cs]e,?~(?:version~|v)?1\.0", "mozilla", "mozilla.org/mpl/1.0"),
    ("mpl-1.1", "mpl-1.1", r"mozilla~public~licen[cs]e,?~(?:version~|v)?1\.1", "mozilla", "mozilla.org/mpl/1.1"),
    ("mpl-2.0", "mpl-2.0", r"mozilla~public~licen[cs]e,?~(?:version~|v)?2(?:\.0)?", "mozilla", "mozilla.org/mpl/2.0"),
    ("epl-1.0", "epl-1.0", r"eclipse~public~licen[cs]e,?~(?:-~)?(?:version~|v)?1(?:\.0)?", "eclipse", "eclipse.org/legal/epl-v10"),
    ("epl-2.0", "epl-2.0", r"eclipse~public~licen[cs]e,?~(?:-~)?(?:version~|v)?2(?:\.0)?", "eclipse", "eclipse.org/legal/epl-2.0"),
    ("cddl-1.0", "cddl-1.0", r"common~development~and~distribution~licen[cs]e(?:,?~(?:version~|v)?1\.0)?", "distribution", "opensource.org/licenses/cddl-1.0"),
    ("cddl-1.1", "cddl-1.1", r"common~development~and~distribution~licen[cs]e,?~(?:version~|v)?1\.1", "distribution", "spdx.org/licenses/cddl-1.1"),
    ("cpl-1.0", "cpl-1.0", r"common~public~licen[cs]e(?:,?~(?:version~|v)?1\.0)?", "licen", "opensource.org/licenses/cpl1.0"),
    ("artistic-1.0", "artistic-1.0", r"artistic~licen[cs]e(?:,?~(?:version~|v)?1\.0)?", "artistic", "opensource.org/licenses/artistic-license-1.0"),
    ("artistic-2.0", "artistic-2.0", r"artistic~licen[cs]e,?~(?:version~|v)?2(?:\.0)?", "artistic", "opensource.org/licenses/artistic-license-2.0"),
    ("bsl-1.0", "bsl-1.0", r"boost~software~licen[cs]e(?:,?~(?:-~)?(?:version~|v)?1\.0)?", "boost", "boost.org/license_1_0"),
    ("zlib", "zlib", r"zlib(?:/libpng)?~licen[cs]e", "zlib", "opensource.org/licenses/zlib"),
    ("unlicense", "unlicense", r"the~unlicense", "unlicense", "unlicense.org"),
    ("wtfpl", "wtfpl", r"do~what~the~f\w+~you~want~to~public~licen[cs]e", "licen", "wtfpl.net"),
    ("cc0-1.0", "cc0-1.0", r"(?:creative~commons~)?(?:cc0|cc~zero)(?:~1\.0)?(?:~universal)?", "cc0|zero", "creativecommons.org/publicdomain/zero/1.0"),
    ("cc-by-1.0", "cc-by-1.0", r"creative~commons~attribution~1\.0", "creative", "creativecommons.org/licenses/by/1.0"),
    ("cc-by-2.0", "cc-by-2.0", r"creative~commons~attribution~2\.0", "creative", "creativecommons.org/licenses/by/2.0"),
    ("cc-by-3.0", "cc-by-3.0", r"(?:creative~commons~attribution|cc[ -]by)~3\.0", "attribution|cc by|cc-by", "creativecommons.org/licenses/by/3.0"),
    ("cc-by-4.0", "cc-by-4.0", r"(?:creative~commons~attribution|cc[ -]by)~4\.0", "attribution|cc by|cc-by", "creativecommons.org/licenses/by/4.0"),
    ("cc-by-sa-2.0", "cc-by-sa-2.0", r"(?:creative~commons~attribution-share~?-?alike|cc[ -]by-sa)~2\.0", "attribution|cc by|cc-by", "creativecommons.org/licenses/by-sa/2.0"),
    ("cc-by-sa-3.0", "cc-by-sa-3.0", r"(?:creative~commons~attribution-share~?-?alike|cc[ -]by-sa)~3\.0", "attribution|cc by|cc-by", "creativecommons.org/licenses/by-sa/3.0"),
    ("cc-by-sa-4.0", "cc-by-sa-4.0", r"(?:creative~commons~attribution-share~?-?alike|cc[ -]by-sa)~4\.0", "attribution|cc by|cc-by", "creativecommons.org/licenses/by-sa/4.0"),
    ("cc-by-nc-4.0", "cc-by-nc-4.0", r"(?:creative~commons~attribution-non~?-?commercial|cc[ -]by-nc)~4\.0", "attribution|cc by|cc-by", "creativecommons.org/licenses/by-nc/4.0"),
    ("cc-by-nc-sa-4.0", "cc-by-nc-sa-4.0", r"(?:creative~commons~attribution-non~?-?commercial-share~?-?alike|cc[ -]by-nc-sa)~4\.0", "attribution|cc by|cc-by", "creativecommons.org/licenses/by-nc-sa/4.0"),
    ("cc-by-nd-4.0", "cc-by-nd-4.0", r"(?:creative~commons~attribution-no~?-?deriv\w*|cc[ -]by-nd)~4\.0", "attribution|cc by|cc-by", "creativecommons.org/licenses/by-nd/4.0"),
    ("cc-by-nc-nd-4.0", "cc-by-nc-nd-4.0", r"(?:creative~commons~attribution-non~?-?commercial-no~?-?deriv\w*|cc[ -]by-nc-nd)~4\.0", "attribution|cc by|cc-by", "creativecommons.org/licenses/by-nc-nd/4.0"),
    ("gfdl-1.3", "gfdl-1.3(?:-only|-or-later)?", r"gnu~free~documentation~licen[cs]e(?:,?~(?:version~|v)?1\.\d)?", "documentation", "gnu.org/licenses/fdl-1.3"),
    ("python-2.0", "(?:python-2.0|psf-2.0)", r"(?:python~software~foundation|psf)~licen[cs]e(?:~(?:version~|v)?2)?", "python|psf", "docs.python.org/3/license"),
    ("openssl", "openssl", r"openssl~licen[cs]e", "openssl", "openssl.org/source/license"),
    ("php-3.01", "php-3.01", r"php~licen[cs]e(?:,?~(?:version~|v)?3\.01)?", "php", "php.net/license/3_01"),
    ("ruby", "ruby", r"ruby~licen[cs]e", "ruby", "ruby-lang.org/en/about/license"),
    ("postgresql", "postgresql", r"postgresql~licen[cs]e", "postgresql", "opensource.org/licenses/postgresql"),
    ("eupl-1.1", "eupl-1.1", r"european~union~public~licen[cs]e,?~(?:version~|v)?1\.1", "european", "joinup.ec.europa.eu/software/page/eupl"),
    ("eupl-1.2", "eupl-1.2", r"european~union~public~licen[cs]e(?:,?~(?:version~|v)?1\.2)?", "european", "eupl.eu/1.2"),
    ("ofl-1.1", "ofl-1.1", r"sil~open~font~licen[cs]e(?:,?~(?:version~|v)?1\.1)?", "font", "scripts.sil.org/ofl"),
    ("ms-pl", "ms-pl", r"microsoft~public~licen[cs]e", "microsoft", "opensource.org/licenses/ms-pl"),
    ("ms-rl", "ms-rl", r"microsoft~reciprocal~licen[cs]e", "microsoft", "opensource.org/licenses/ms-rl"),
    ("afl-3.0", "afl-3.0", r"academic~free~licen[cs]e(?:,?~(?:version~|v)?3(?:\.0)?)?", "academic", "opensource.org/licenses/afl-3.0"),
    ("osl-3.0", "osl-3.0", r"open~software~licen[cs]e(?:,?~(?:version~|v)?3(?:\.0)?)?", "licen", "opensource.org/licenses/osl-3.0"),
    ("ncsa", "ncsa", r"(?:university~of~illinois/)?ncsa~(?:open~source~)?licen[cs]e", "ncsa", "opensource.org/licenses/ncsa"),
    ("upl-1.0", "upl-1.0", r"universal~permissive~licen[cs]e(?:,?~(?:version~|v)?1\.0)?", "permissive", "opensource.org/licenses/upl"),
    ("ecl-2.0", "ecl-2.0", r"educational~community~licen[cs]e(?:,?~(?:version~|v)?2(?:\.0)?)?", "educational", "opensource.org/licenses/ecl-2.0"),
    ("busl-1.1", "busl-1.1", r"business~source~licen[cs]e(?:~1\.1)?", "business", "mariadb.com/bsl11"),
    ("sspl-1.0", "sspl-1.0", r"server~side~public~licen[cs]e(?:,?~(?:version~|v)?1)?", "server", "mongodb.com/licensing/server-side-public-license"),
    ("odbl-1.0", "odbl-1.0", r"open~(?:data~commons~open~)?database~licen[cs]e(?:~\(odbl\))?", "database", "opendatacommons.org/licenses/odbl"),
    ("public-domain", "public-domain", r"(?:in|to|into)~the~public~domain", "domain", "creativecommons.org/publicdomain/mark/1.0"),
)
#: Passages of license texts. Label, keyword, pattern, relevance.
PASSAGES = (
    ("mit", "permission", r"permission~is~hereby~granted,~free~of~charge,~to~any~person~obtaining~a~copy", 1.0),
    ("isc", "permission", r"permission~to~use,~copy,~modify,~and(?:/or)?~distribute~this~software~for~any~purpose", 0.9),
    ("bsd", "redistribution", r"redistribution~and~use~in~source~and~binary~forms,~with~or~without~modification", 0.9),
    ("bsd-3-clause", "neither", r"neither~the~name~of~.{1,80}?~nor~the~names~of~its~contributors", 0.9),
    ("bsd-4-clause", "advertising", r"all~advertising~materials~mentioning~features~or~use~of~this~software", 0.9),
    ("apache", "apache", r"licensed~under~the~apache~licen[cs]e", 0.8),
    ("gpl", "redistribute", r"you~can~redistribute~it~and/or~modify~it~under~the~terms~of~the~gnu~general~public~licen[cs]e", 0.9),
    ("lgpl", "redistribute", r"you~can~redistribute~it~and/or~modify~it~under~the~terms~of~the~gnu~(?:lesser|library)~general~public~licen[cs]e", 0.9),
    ("agpl", "redistribute", r"you~can~redistribute~it~and/or~modify~it~under~the~terms~of~the~gnu~affero~general~public~licen[cs]e", 0.9),
    ("zlib", "as-is", r"this~software~is~provided~'as-is',~without~any~express~or~implied~warranty", 0.9),
    ("unlicense", "unencumbered", r"this~is~free~and~unencumbered~software~released~into~the~public~domain", 1.0),
    ("bsl-1.0", "permission", r"permission~is~hereby~granted,~free~of~charge,~to~any~person~or~organization~obtaining", 1.0),
    ("gpl", "gpl", r"\bgpl(?:v?\d(?:\.\d)?)?\b", 0.5),
    ("lgpl", "lgpl", r"\blgpl(?:v?\d(?:\.\d)?)?\b", 0.5),
    ("gpl", "general", r"general~public~licen[cs]e", 0.6),
    ("mit", "mit", r"\bmit~licen[cs]e", 0.6),
    ("apache", "apache", r"apache~licen[cs]e", 0.6),
    ("proprietary", "reserved", r"all~rights~reserved", 0.3),
)
#: Forms of naming a license: name, priority, relevance. Higher priorities suppress what they contain.
FORMS = (("tag", 90, 1.0), ("operand", 90, 1.0), ("notice", 80, 0.95), ("short", 45, 0.8), ("address", 70, 0.8), ("name", 50, 0.6))
#: Base phrases and their labels.
PHRASES = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))

_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_TO_WORDS = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


class Rule:
    """A pattern with a group stands for the place of the group."""

    def __init__(self, label: str, keywords: tuple, pattern: str, priority: int, relevance: float):
        self.label, self.keywords, self.priority, self.relevance = label, keywords, priority, relevance
        self.pattern = re.compile(pattern.replace("~", r"[\s*#/]+"))

    def places(self, text: str):
        group = self.pattern.groups
        return [m.span(group) for m in self.pattern.finditer(text)]


def _stems(tag: str) -> tuple:
    """The plain texts of which an identifier holds one: up to its first optional part, or its alternatives."""
    if tag.startswith("(?:"):
        return tuple(tag[3:].split(")", 1)[0].split("|"))
    return (tag.split("(?:", 1)[0],)


def rules() -> list[Rule]:
    """All rules in order: the forms of every license, then passages."""
    out = []
    for label, tag, name, keyword, address in LICENSES:
        words, stems, tag = tuple(keyword.split("|")), _stems(tag), tag.replace(".", r"\.")
        forms = {"tag": (("spdx-license",), rf"spdx-license-identifier:\s*\(*{tag}\b"),
                 # further operands of an expression on the line of a tag
                 "operand": (("spdx-license",), rf"spdx-license-identifier:[\w.+() \t-]*?\b(?:and|or|with)[ \t(]+({tag})\b"),
                 # an identifier alone: "released under mit", "license: mit", "gpl-3.0 licence"
                 "short": (stems, rf"(?:\b(?:licensed|released|distributed|available)~under~(?:the~)?(?:terms~of~)?(?:the~)?{tag}\b|\blicen[cs]e[ \t]*[:=][ \t]*[\"'(]?{tag}\b|\b{tag}[ \t]+licen[cs]e\b)"),
                 "notice": (words, rf"(?:licensed|released|distributed|available)~under~(?:the~)?(?:terms~(?:of~)?)?(?:the~)?{name}"),
                 "address": ((address,), rf"(?:https?://)?(?:www\.)?{re.escape(address)}"),
                 "name": (words, rf"\b{name}\b")}
        out += [Rule(label, forms[f][0], forms[f][1], priority, relevance) for f, priority, relevance in FORMS]
    return out + [Rule(label, (keyword,), pattern, 60 if relevance > 0.6 else 40, relevance) for label, keyword, pattern, relevance in PASSAGES]


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = rules()
        by_word: dict[str, list[int]] = {}
        for k, rule in enumerate(self.rules):
            for w in rule.keywords:
                by_word.setdefault(w, []).append(k)
        self.finder = ahocorasick.Automaton()
        for w, ks in by_word.items():
            self.finder.add_word(w, ks)
        self.finder.make_automaton()
        self.priority = np.array([rule.priority for rule in self.rules])

    def detections(self, line: str, every: bool = False) -> list[tuple[int, int, int]]:
        """(start, end, rule) of a lower-cased text, after suppression, by place; every: without the gate."""
        gated = range(len(self.rules)) if every else sorted({k for _, ks in self.finder.iter(line) for k in ks})
        found = [(a, b, k) for k in gated for a, b in self.rules[k].places(line)]
        if not found:
            return []
        start, end, rule = np.array(found, np.int64).T
        rank = self.priority[rule]
        kept = np.zeros((0, 3), np.int64)  # by start
        for p in np.unique(rank)[::-1]:
            own = np.flatnonzero(rank == p)
            if len(kept):  # the furthest end of what starts no later tells whether one holds it
                reach = np.maximum.accumulate(kept[:, 1])
                at = np.searchsorted(kept[:, 0], start[own], "right") - 1
                own = own[(at < 0) | (reach[at] < end[own])]
            own = own[np.lexsort((rule[own], -end[own], start[own]))]  # what holds another comes before it
            before = np.r_[-1, np.maximum.accumulate(end[own])[:-1]] if len(own) else np.zeros(0, np.int64)
            own = own[end[own] > before]
            kept = np.concatenate([kept, np.stack([start[own], end[own], rule[own]], 1)])
            kept = kept[np.lexsort((kept[:, 2], kept[:, 1], kept[:, 0]))]
        return [tuple(d) for d in kept.tolist()]

    def scan(self, text: str | None) -> dict:
        """Everything op5 returns of one text but its id."""
        data = (text or "").encode().lower()
        words = data.translate(_TO_WORDS).split()
        starts, base = [], set()
        if b"license" in data:
            for at, w in enumerate(words):
                if w == b"license":
                    for phrase, label in PHRASES:
                        n = len(phrase)
                        if at >= n - 1 and [x.decode("latin-1") for x in words[at - n + 1:at + 1]] == list(phrase):
                            starts.append(at - n + 1)
                            base.add(label)
        own = self.detections(data.decode())
        spans = [{"start": a, "end": b, "label": self.rules[k].label, "rule": k} for a, b, k in own]
        score = max([self.rules[k].relevance for _, _, k in own] + [0.6] * bool(base), default=0.0)
        return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s["label"] for s in spans})), "score": score, "spans": spans}


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    spans (character offsets, label, number of the rule).

    A-Z is lower-cased, no other letter. The time grows with the length of a text times the rules whose keywords
    it holds, and suppression sorts its detections. Null and empty texts have no words, labels or spans and score 0. Repeated rows
    repeat; an empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
              "spans array<struct<start:int,end:int,label:string,rule:int>>")

    def work():
        scanner = Scanner()

        def each(part: pa.RecordBatch) -> dict:
            rows = [scanner.scan(t) for t in part.column(1).to_pylist()]
            return {"doc_id": part.column(0)} | {c: [r[c] for r in rows] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}

        return each

    return through_python(docs.select("doc_id", "text"), work, schema)


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
