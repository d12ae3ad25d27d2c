"""License scans: ordered signature rules behind a keyword prefilter; priority and containment decide between overlapping detections.

Signatures of license texts are in license_texts.py; the rules for names, identifiers and addresses of licenses come from the table here.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm.batches import parts
from verdigraph.llm.license_texts import SIGNATURES

#: Label, keywords of which a text must hold one, regex of the name, SPDX identifiers (regex), part of its address (regex or None).
LICENSES = [
    ("mit", "mit", r"(?:the )?mit", r"mit", r"opensource\.org/licenses/mit"),
    ("x11", "x11", r"x11", r"x11", None),
    ("isc", "isc", r"isc", r"isc", r"opensource\.org/licenses/isc"),
    ("apache", "apache", r"apache(?: software)?", r"apache-[12]\.[01]", r"apache\.org/licenses"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?,? (?:version |v)?2(?:\.0)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?,? (?:version |v)?1\.1", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    ("bsd-2-clause", "bsd", r"(?:bsd[ -]2[ -]clause|2[ -]clause bsd|simplified bsd)", r"bsd-2-clause", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:bsd[ -]3[ -]clause|3[ -]clause bsd|new bsd|modified bsd)", r"bsd-3-clause", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:bsd[ -]4[ -]clause|4[ -]clause bsd|original bsd)", r"bsd-4-clause", None),
    ("bsd", "bsd", r"bsd", r"bsd(?:-\d-clause)?", r"opensource\.org/licenses/bsd"),
    ("gpl", "gpl|general public|gnu.org", r"(?:gnu )?(?:gpl|general public)", r"gpl-[123]\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("gpl-2.0", "gpl|general public|gnu.org", r"(?:gnu )?(?:gpl|general public license),? ?(?:version |v)?2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2"),
    ("gpl-3.0", "gpl|general public|gnu.org", r"(?:gnu )?(?:gpl|general public license),? ?(?:version |v)?3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3"),
    ("lgpl", "lgpl|lesser general|library general", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public)", r"lgpl-[23]\.[01](?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("lgpl-2.1", "lgpl|lesser general", r"(?:gnu )?(?:lgpl|lesser general public license),? ?(?:version |v)?2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lgpl|lesser general", r"(?:gnu )?(?:lgpl|lesser general public license),? ?(?:version |v)?3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3"),
    ("agpl-3.0", "agpl|affero", r"(?:gnu )?(?:agpl|affero general public)(?: license)?(?:,? ?(?:version |v)?3(?:\.0)?)?", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl"),
    ("fdl", "fdl|free documentation", r"(?:gnu )?free documentation", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    ("mpl-1.1", "mpl|mozilla", r"(?:mpl|mozilla public(?: license)?),? ?(?:version |v)?1\.1", r"mpl-1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mpl|mozilla", r"(?:mpl|mozilla public(?: license)?),? ?(?:version |v)?2(?:\.0)?", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2"),
    ("mpl", "mpl|mozilla", r"(?:mpl|mozilla public)", r"mpl-[12]\.[01]", r"mozilla\.org/mpl"),
    ("epl-1.0", "epl|eclipse", r"(?:epl|eclipse public(?: license)?)(?: -)?,? ?(?:version |v)?1(?:\.0)?", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "epl|eclipse", r"(?:epl|eclipse public(?: license)?)(?: -)?,? ?(?:version |v)?2(?:\.0)?", r"epl-2\.0", r"eclipse\.org/legal/epl-2"),
    ("cddl-1.0", "cddl|common development", r"(?:cddl|common development and distribution)", r"cddl-1\.[01]", r"opensource\.org/licenses/cddl"),
    ("cpl-1.0", "cpl|common public", r"(?:cpl|common public)", r"cpl-1\.0", None),
    ("ipl-1.0", "ipl|ibm", r"ibm public", r"ipl-1\.0", None),
    ("artistic-1.0", "artistic", r"artistic(?: license)?,? ?(?:version )?1(?:\.0)?", r"artistic-1\.0", None),
    ("artistic-2.0", "artistic", r"artistic(?: license)?,? ?(?:version )?2(?:\.0)?", r"artistic-2\.0", r"opensource\.org/licenses/artistic-2"),
    ("artistic", "artistic", r"artistic", r"artistic-[12]\.0", None),
    ("zlib", "zlib", r"zlib(?:/libpng)?", r"zlib", r"zlib\.net/zlib_license"),
    ("libpng", "libpng", r"libpng", r"libpng(?:-2\.0)?", None),
    ("bsl-1.0", "boost|bsl", r"boost software", r"bsl-1\.0", r"boost\.org/license_1_0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl", r"wtfpl\.net"),
    ("cc0-1.0", "cc0|creative commons|creativecommons", r"(?:cc0|creative commons zero)(?:[ -]1\.0)?(?: universal)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", "cc-by|cc by|creative", r"(?:cc[ -]by|creative commons attribution)(?![ -](?:nc|nd|sa|non|no|share))(?:[ -][1-4]\.[05])?", r"cc-by-[1-4]\.[05]", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", "cc-by|cc by|creative", r"(?:cc[ -]by[ -]sa|creative commons attribution[ -]share ?alike)(?:[ -][1-4]\.[05])?", r"cc-by-sa-[1-4]\.[05]", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nc", "cc-by|cc by|creative", r"(?:cc[ -]by[ -]nc|creative commons attribution[ -]non-?commercial)(?![ -](?:sa|nd|share|no))(?:[ -][1-4]\.[05])?", r"cc-by-nc-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", "cc-by|cc by|creative", r"(?:cc[ -]by[ -]nd|creative commons attribution[ -]no ?deriv\w*)(?:[ -][1-4]\.[05])?", r"cc-by-nd-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-nc-sa", "cc-by|cc by|creative", r"(?:cc[ -]by[ -]nc[ -]sa|creative commons attribution[ -]non-?commercial[ -]share ?alike)(?:[ -][1-4]\.[05])?", r"cc-by-nc-sa-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", "cc-by|cc by|creative", r"(?:cc[ -]by[ -]nc[ -]nd|creative commons attribution[ -]non-?commercial[ -]no ?deriv\w*)(?:[ -][1-4]\.[05])?", r"cc-by-nc-nd-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc-nd"),
    ("odbl", "odbl|open database|opendatacommons", r"(?:odbl|open database)", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("ofl-1.1", "ofl|open font", r"(?:sil )?(?:open font|ofl)", r"ofl-1\.[01]", r"scripts\.sil\.org/ofl"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql", None),
    ("psf-2.0", "psf|python software", r"(?:psf|python software foundation)", r"psf-2\.0", None),
    ("ruby", "ruby", r"ruby", r"ruby", None),
    ("php-3.0", "php", r"php", r"php-3\.0[1]?", r"php\.net/license"),
    ("openssl", "openssl", r"openssl", r"openssl", None),
    ("eupl-1.2", "eupl|european union", r"(?:eupl|european union public)", r"eupl-1\.[012]", None),
    ("ms-pl", "ms-pl|microsoft", r"(?:ms-pl|microsoft public)", r"ms-pl", None),
    ("ms-rl", "ms-rl|microsoft", r"(?:ms-rl|microsoft reciprocal)", r"ms-rl", None),
    ("bsl-1.1", "business source|busl|mariadb", r"(?:business source)", r"busl-1\.1", r"mariadb\.com/bsl11"),
    ("sspl", "sspl|server side", r"(?:sspl|server side public)", r"sspl-1\.0", None),
    ("vim", "vim", r"vim", r"vim", None),
    ("proprietary", "proprietary", r"proprietary", r"licenseref-proprietary", None),
]
#: Kind, confidence and template; a smaller number of its place wins.
TEMPLATES = [
    ("tag", 1.0, r"spdx-license-identifier:\s*{spdx}(?![\w.+-])"),
    ("address", 0.95, r"https?://(?:www\.)?{address}"),
    ("text", 0.92, None),
    ("grant", 0.9, r"\b(?:licen[sc]ed|released|distributed|published|available|provided|redistributed) (?:\w+ ){{0,2}}under (?:the )?(?:terms of (?:the )?)?{name}\b{must}"),
    ("header", 0.8, r"\blicen[sc]e:\s*{name}\b"),
    ("version", 0.7, r"\b{name}(?![\w.])"),
    ("title", 0.6, r"\b{name} licen[sc]e\b"),
]
#: A statement of several licenses, with brackets and operators, and its licenses; the word before it tells the rule.
EXPRESSION = re.compile(r"(spdx-license-identifier|\blicen[sc]e):[(\s]*[\w.+-]+(?:[)\s]+(?:and|or|with)[(\s]+[\w.+-]+)+")
OPERAND = re.compile(r"(?::|\b(?:and|or|with))[(\s]*([\w.+-]+)")
#: Names that are ordinary words or products too. A grant under them must say license.
ORDINARY = {"x11", "isc", "zlib", "libpng", "unlicense", "postgresql", "ruby", "php-3.0", "openssl", "vim", "proprietary"}
#: What a space in a signature stands for, and one with a question mark.
GAP, ANY_GAP = r"[\s*#/]+", r"[\s*#/]*"
#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD_BYTES = np.array([chr(i).isdigit() or chr(i).islower() or i >= 0x80 for i in range(256)])


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keywords: str
    pattern: re.Pattern


class Detection(NamedTuple):
    label: str
    priority: int
    confidence: float
    start: int
    end: int


@cache
def rules() -> list[Rule]:
    """The rules in order of priority: by kind, and inside a kind versions before families, then as the licenses stand."""
    ordered = sorted(LICENSES, key=lambda row: not any(map(str.isdigit, row[0])))
    out = []
    for place, (kind, confidence, template) in enumerate(TEMPLATES):
        if kind == "text":
            out += [Rule(label, place, confidence, keyword, re.compile(pattern.replace(" ?", ANY_GAP).replace(" ", GAP))) for label, keyword, pattern in SIGNATURES]
            continue
        for label, keywords, name, spdx, address in ordered:
            if (kind != "address" or address) and (kind != "version" or "license" in name):
                out.append(Rule(label, place, confidence, keywords, re.compile(template.format(name=f"(?:{name})", spdx=f"(?:{spdx})", address=f"(?:{address})", must=" licen[sc]es?" if label in ORDINARY else "(?: licen[sc]es?)?"))))
    return [r._replace(priority=i) for i, r in enumerate(out)]


def lower(text: str) -> str:
    """A-Z lower-cased, nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def count_words(lowered: str) -> int:
    inside = _WORD_BYTES[np.frombuffer(lowered.encode("utf-8", "surrogatepass"), np.uint8)]
    return int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum())


def resolve(found: list[Detection]) -> list[Detection]:
    """Drops what lies inside another detection of an earlier rule, or of the same rule; of equal ranges the earlier rule stays."""
    starts = sorted({d.start for d in found})
    # A tree of the largest end among kept detections that start at or before a place.
    ends = [-1] * (len(starts) + 1)
    kept: list[Detection] = []
    for d in sorted(found, key=lambda d: (d.priority, d.start - d.end, d.start)):
        at = i = bisect_right(starts, d.start)
        furthest = -1
        while i:
            furthest = max(furthest, ends[i])
            i &= i - 1
        if furthest >= d.end:
            continue
        kept.append(d)
        while at < len(ends):
            ends[at] = max(ends[at], d.end)
            at += at & -at
    return kept


@cache
def _named() -> list[tuple[re.Pattern, dict[str, Rule]]]:
    """For each license what names it whole in an expression, and its rules by the word that begins a statement."""
    by = {(r.label, r.confidence): r for r in rules()}
    kinds = {"spdx-license-identifier": 1.0, "license": 0.8, "licence": 0.8}
    return [(re.compile(f"(?:{spdx})|(?:{name})"), {word: by[label, c] for word, c in kinds.items()}) for label, _, name, spdx, _ in LICENSES]


def expressions(lowered: str) -> list[Detection]:
    """Each license of every statement that names several."""
    found = []
    for m in EXPRESSION.finditer(lowered):
        for own in OPERAND.finditer(lowered, m.end(1), m.end()):
            found += [Detection(r.label, r.priority, r.confidence, *own.span(1)) for name, at in _named() if name.fullmatch(own[1]) for r in [at[m[1]]]]
    return found


def detections(lowered: str) -> list[Detection]:
    """What the rules find whose keywords the text has, resolved."""
    held: dict[str, bool] = {}
    found = []
    for r in rules():
        if (has := held.get(r.keywords)) is None:
            has = held[r.keywords] = any(k in lowered for k in r.keywords.split("|"))
        if has:
            found += [Detection(r.label, r.priority, r.confidence, *m.span()) for m in r.pattern.finditer(lowered)]
    return resolve(found + expressions(lowered) if ":" in lowered else found)


def phrase_places(lowered: str) -> list[tuple[int, str]]:
    """(word number, label) of each place where a base phrase stands."""
    if "license" not in lowered:
        return []
    line = " " + " ".join(WORDS.findall(lowered)) + " "
    places = []
    for phrase, label in PHRASES.items():
        at, word, counted = line.find(f" {phrase} "), 0, 0
        while at >= 0:
            word, counted = word + line.count(" ", counted, at), at
            places.append((word, label))
            at = line.find(f" {phrase} ", at + 1)
    return places


_RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int>>"


def _row(text: str | None) -> tuple:
    lowered = lower(text or "")
    places, found = phrase_places(lowered), detections(lowered)
    base, at = {label for _, label in places}, [p for p, _ in places]
    score = max([0.5 if at else 0.0, *(d.confidence for d in found)])
    spans = [{"label": d.label, "start": d.start, "end": d.end} for d in found]
    return count_words(lowered), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d.label for d in found})), score, spans


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts(batches):
        frame = pd.DataFrame([_row(t) for t in texts], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
        yield frame.astype({"first_word": "Int64", "last_word": "Int64"})


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each row of ``docs(doc_id, text)``.

    A null or empty text has no words and no labels; first_word and last_word are then null and the score 0. The score is the greatest confidence of a
    detection, 0.5 for a base phrase alone. Texts are read whole; time and memory grow with their length. Repeated rows are scanned each; an empty
    table gives an empty result; other columns are not read, whatever their names. Of detections at one place the earlier rule's stays. Spans are code
    points of the text.
    """
    return docs.select("doc_id", F.pandas_udf(_scan, _RESULT)("text").alias("found")).select("doc_id", "found.*")


def op8_licenses(spark, sf_dir):
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
