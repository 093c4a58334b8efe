"""License notices in text: ordered signature rules behind a keyword gate.

Text is lower-cased (A-Z only) and cut into words. A rule is a regular expression over the
words joined by single spaces, with a label, a priority (0 is the strongest) and one keyword.
A text is matched against a rule only if the rule's keyword is among its words, so that
texts without any keyword cost one pass for their words. Of overlapping detections, one
that lies inside another of at least its priority is suppressed. The rules of the base
phrases have priority 0 and are never suppressed.

A scan is a map over rows with no shuffle; a task holds one Arrow batch.

Defined cases: null text is empty (no words, score 0); empty table, empty result; repeated
rows and ids give repeated results; other columns are ignored; texts of any length are
scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
FOUND = (
    "doc_id long, n_words long, "
    "found array<struct<label:string,first:long,words:long,priority:int,kept:boolean>>"
)
FOUND_TYPE = pa.list_(
    pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64()),
               ("priority", pa.int32()), ("kept", pa.bool_())])
)

#: Base phrases, their labels and keywords.
BASE = (
    ("under the mit license", "mit", "mit"),
    ("apache license version 2", "apache-2", "apache"),
    ("cc by nc", "cc-by-nc", "cc"),
)

#: Label, keyword, and the names it goes by, as expressions over words.
NAMES = (
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("x11", "x11", "x11"),
    ("isc", "isc", "isc"),
    ("apache-1.1", "apache", "apache(?: software)? (?:v |version )?1 1"),
    ("apache-2", "apache", "apache(?: software)?(?: license)? ?(?:v|v |version )?2(?: 0)?"),
    ("apache-2", "apache2", "apache2(?: 0)?"),
    ("apache-2", "apachev2", "apachev2(?: 0)?"),
    ("apache", "apache", "apache(?: software)?"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd)"),
    ("bsd-2-clause", "freebsd", "freebsd"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", "bsd", "bsd(?: style)?"),
    ("0bsd", "0bsd", "0bsd"),
    ("gpl-1", "general", "gnu general public license(?: as published by the free software foundation)? (?:v|v |version )?1"),
    ("gpl-2", "general", "gnu general public license(?: as published by the free software foundation)? (?:v|v |version )?2"),
    ("gpl-3", "general", "gnu general public license(?: as published by the free software foundation)? (?:v|v |version )?3"),
    ("gpl", "general", "gnu general public"),
    ("gpl-2", "gpl", "(?:gnu )?gpl (?:v |version )?2(?: 0)?"),
    ("gpl-3", "gpl", "(?:gnu )?gpl (?:v |version )?3(?: 0)?"),
    ("gpl-2", "gplv2", "(?:gnu )?gplv2"),
    ("gpl-3", "gplv3", "(?:gnu )?gplv3"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("lgpl-2.1", "lesser", "gnu lesser general public license (?:v |version )?2 1"),
    ("lgpl-3", "lesser", "gnu lesser general public license (?:v |version )?3"),
    ("lgpl", "lesser", "gnu lesser general public"),
    ("lgpl-2", "library", "gnu library general public"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("agpl-3", "affero", "gnu affero general public license (?:v |version )?3"),
    ("agpl", "affero", "gnu affero general public"),
    ("agpl", "agpl", "(?:gnu )?agpl"),
    ("fdl", "documentation", "gnu free documentation"),
    ("mpl-1.1", "mozilla", "mozilla public license (?:v |version )?1 1"),
    ("mpl-2", "mozilla", "mozilla public license (?:v |version )?2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public"),
    ("mpl", "mpl", "mpl"),
    ("epl", "eclipse", "eclipse public"),
    ("edl", "eclipse", "eclipse distribution"),
    ("cddl", "cddl", "cddl"),
    ("cddl", "development", "common development and distribution"),
    ("cpl", "common", "common public"),
    ("eupl", "eupl", "eupl"),
    ("eupl", "european", "european union public"),
    ("artistic-2", "artistic", "artistic(?: license)? 2(?: 0)?"),
    ("artistic", "artistic", "(?:perl )?artistic"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("boost", "boost", "boost software"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("python", "python", "python(?: software foundation)?"),
    ("php", "php", "php"),
    ("ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl"),
    ("postgresql", "postgresql", "postgresql"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"),
    ("ofl", "font", "(?:sil )?open font"),
    ("odbl", "odbl", "odbl"),
    ("odbl", "database", "open database"),
    ("sspl", "sspl", "sspl"),
    ("sspl", "server", "server side public"),
    ("busl", "business", "business source"),
    ("elastic", "elastic", "elastic"),
    ("cc0", "cc0", "cc0(?: 1 0)?"),
    ("cc-by", "attribution", "creative commons attribution(?: \\d \\d)?"),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike(?: \\d \\d)?"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial(?: \\d \\d)?"),
    ("cc-by-nd", "noderivatives", "creative commons attribution noderivatives(?: \\d \\d)?"),
    ("cc-by-nc-sa", "noncommercial", "creative commons attribution noncommercial sharealike(?: \\d \\d)?"),
    ("cc-by-nc-nd", "noncommercial", "creative commons attribution noncommercial noderivatives(?: \\d \\d)?"),
    ("cc", "commons", "creative commons"),
)

#: How a name is used; priority and expression.
USES = (
    (1, "(?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?{name}(?: public)?(?: license| licence)?"),
    (1, "(?:under|subject to) the terms (?:and conditions )?of the {name}(?: public)?(?: license| licence)?"),
    (2, "spdx license identifier {name}"),
    (2, "license[ds]? {name}"),
    (3, "(?:the )?{name} licen[sc]e"),
)

#: Short creative commons tags; label and expression.
TAGS = (
    ("cc-by", "cc by(?: \\d \\d)?"),
    ("cc-by-sa", "cc by sa(?: \\d \\d)?"),
    ("cc-by-nc", "cc by nc(?: \\d \\d)?"),
    ("cc-by-nd", "cc by nd(?: \\d \\d)?"),
    ("cc-by-nc-sa", "cc by nc sa(?: \\d \\d)?"),
    ("cc-by-nc-nd", "cc by nc nd(?: \\d \\d)?"),
)

#: Notices without a license's name; label, keyword and expression.
NOTICES = (
    ("all-rights-reserved", "reserved", "all rights reserved"),
    ("public-domain", "domain", "(?:in|into|to) the public domain"),
    ("permissive", "hereby", "permission is hereby granted free of charge"),
    ("permissive", "redistribution", "redistribution and use in source and binary forms"),
    ("no-warranty", "warranty", "without (?:any )?warranty"),
    ("no-warranty", "warranties", "without warranties or conditions"),
    ("copyright", "copyright", "copyright(?: c)? \\d\\d\\d\\d"),
)
#: How sure a detection of each priority is.
CONFIDENCE = (0.95, 0.95, 0.8, 0.7, 0.3)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    pattern: str

    def compiled(self) -> re.Pattern:
        return re.compile(f"(?<![^ ]){self.pattern}(?![^ ])")


def standard_rules() -> tuple[Rule, ...]:
    """Base phrases first, then names by use, tags and bare notices."""
    rules = [Rule(label, keyword, 0, phrase) for phrase, label, keyword in BASE]
    rules += [
        Rule(label, keyword, priority, use.format(name=name))
        for priority, use in USES
        for label, keyword, name in NAMES
    ]
    titles = [(label, keyword, name) for label, keyword, name in NAMES if "license" in name]
    rules += [Rule(label, keyword, 2, name) for label, keyword, name in titles]
    rules += [Rule(label, "cc", 3, tag) for label, tag in TAGS]
    rules += [Rule(label, keyword, 4, notice) for label, keyword, notice in NOTICES]
    return tuple(rules)


def kept_of(found: list[tuple[int, int, int, int]]) -> list[bool]:
    """found: (first, end, priority, rule). False where another detection contains it.

    The container needs at least the same priority; of equal spans with the same priority
    the earlier rule stays. Priority 0 always stays. One sweep by start, widest first.
    """
    order = sorted(range(len(found)), key=lambda i: (found[i][0], -found[i][1], *found[i][2:]))
    reach = [-1] * len(CONFIDENCE)
    kept = [True] * len(found)
    for i in order:
        _, end, priority, _ = found[i]
        kept[i] = priority == 0 or max(reach[: priority + 1]) < end
        reach[priority] = max(reach[priority], end)
    return kept


def scan_licenses(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words and all detections in order of their place."""
    rules = standard_rules() if rules is None else rules

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gates: dict[str, list[tuple[int, Rule, re.Pattern]]] = {}
        for i, rule in enumerate(rules):
            gates.setdefault(rule.keyword, []).append((i, rule, rule.compiled()))
        for batch in batches:
            counts, lists = [], []
            for text in batch.column("text"):
                words = WORD.findall(text.as_py().translate(ASCII_LOWER))
                counts.append(len(words))
                lists.append(detections(words, gates))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(lists, FOUND_TYPE)],
                names=["doc_id", "n_words", "found"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.mapInArrow(scanned, FOUND)


def detections(words: list[str], gates: dict) -> list[dict]:
    keys = gates.keys() & set(words)
    if not keys:
        return []
    joined, found = " ".join(words), []
    for i, rule, pattern in sorted((g for k in keys for g in gates[k]), key=lambda g: g[0]):
        at, seen = 0, 0
        for m in pattern.finditer(joined):
            seen += joined.count(" ", at, m.start())
            at = m.start()
            found.append((seen, seen + m.group().count(" ") + 1, rule.priority, i, rule.label))
    kept = kept_of([f[:4] for f in found])
    rows = sorted(zip(found, kept), key=lambda r: r[0])
    return [
        {"label": label, "first": first, "words": end - first, "priority": priority, "kept": stays}
        for (first, end, priority, _, label), stays in rows
    ]


def labels_of(found: Column | str, base_only: bool = False) -> Column:
    """Distinct labels of what was kept, sorted, joined by commas."""
    found = F.col(found) if isinstance(found, str) else found
    stays = F.filter(found, lambda d: (d.priority == 0) if base_only else d.kept)
    return F.array_join(F.array_sort(F.array_distinct(F.transform(stays, lambda d: d.label))), ",")


def score_of(found: Column | str) -> Column:
    """1 - product over kept detections' best confidences by priority; 0 without any."""
    found = F.col(found) if isinstance(found, str) else found
    sure = F.create_map(*[F.lit(x) for pair in enumerate(CONFIDENCE) for x in pair])
    priorities = F.array_sort(
        F.array_distinct(F.transform(F.filter(found, lambda d: d.kept), lambda d: d.priority))
    )
    rest = F.aggregate(priorities, F.lit(1.0), lambda left, p: left * (F.lit(1.0) - sure[p]))
    return F.round(F.lit(1.0) - rest, 6)
