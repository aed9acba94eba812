"""License detection: ordered signature rules behind a keyword prefilter.

A signature is a regular expression over the words of a text (lower-cased, one
space between them), with a label, a priority (1 is strongest) and a confidence.
``signatures()`` builds the rules from the license table below: for every license an
identifier tag, its address, a grant ("licensed under ...") and its bare name,
and general notices after them. Only texts that hold a keyword are scanned, and
there only the rules of which a keyword occurs. Keywords are read off the parsed
pattern (``required``): every match of a rule holds one of its keywords.

Detections that lie inside another are suppressed by the stronger rule, and among
equals by the longer (then earlier rule) one. That is a running maximum over the
detections of one text, in one window per text; the texts themselves are not
shuffled.

Base phrases are exact word sequences, counted at every place; they are never
suppressed. Defined results: NULL and empty texts have no words, labels or
places and score 0; repeated documents give a row each.
"""

from __future__ import annotations

import itertools
import re._constants as op
import re._parser as parser
from functools import cache
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtrack.llm import common as C

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: (label, keyword, name pattern, identifier words, address words); words as they stand between single spaces
LICENSES = [
    ("mit", "mit", r"(?:mit|expat|x11)(?: style)?", "mit", "opensource org licenses mit"),
    ("apache-1", "apache", r"apache (?:software )?(?:licen[sc]e )?(?:version |v)?1(?: [01])?", "apache 1 [01]", "apache org licenses license 1 [01]"),
    ("apache-2", "apache", r"apache (?:software )?(?:licen[sc]e )?(?:version |v)?2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("gpl-2", "g", r"(?:gnu )?(?:general public licen[sc]e|gpl)(?: gpl)?(?: version| v)? ?2(?: 0)?", "gpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", "g", r"(?:gnu )?(?:general public licen[sc]e|gpl)(?: gpl)?(?: version| v)? ?3(?: 0)?", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl(?: 3 0)?"),
    ("lgpl-2", "l", r"(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)(?: version| v)? ?2(?: [01])?", "lgpl 2 [01](?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 [01]"),
    ("lgpl-3", "l", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version| v)? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl(?: 3 0)?"),
    ("agpl-3", "a", r"(?:gnu )?(?:affero general public licen[sc]e|agpl)(?: version| v)? ?3(?: 0)?", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl(?: 3 0)?"),
    ("gfdl", "documentation", r"(?:gnu )?(?:free documentation licen[sc]e|gfdl)", "gfdl 1 [123](?: only| or later)?", "gnu org licenses fdl(?: 1 [123])?"),
    ("bsd-2", "bsd", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("bsd-0", "bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)", "0bsd", "opensource org licenses 0bsd"),
    ("isc", "isc", r"isc(?: style)?", "isc", "opensource org licenses isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?", "zlib", "zlib net zlib license"),
    ("libpng", "libpng", r"libpng(?: version 2)?", "libpng(?: 2 0)?", "libpng org pub png src libpng license"),
    ("mpl-1", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?1(?: [01])?", "mpl 1 [01]", "mozilla org mpl mpl 1 [01]"),
    ("mpl-2", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?", "mpl 2 0", "mozilla org mpl 2 0"),
    ("epl-1", "eclipse", r"eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2", "eclipse", r"eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("cddl", "cddl", r"(?:common development and distribution licen[sc]e(?: cddl)?|cddl)", "cddl 1 [01]", "opensource org licenses cddl1"),
    ("cpl", "common public", r"common public licen[sc]e", "cpl 1 0", "opensource org licenses cpl1"),
    ("eupl", "european union", r"european union public licen[sc]e", "eupl 1 [012]", "joinup ec europa eu software page eupl"),
    ("artistic-1", "artistic", r"(?:perl )?artistic licen[sc]e(?: version)? 1(?: 0)?", "artistic 1 0(?: perl)?", "opensource org licenses artistic license 1"),
    ("artistic-2", "artistic", r"(?:perl )?artistic licen[sc]e(?: version)? 2(?: 0)?", "artistic 2 0", "opensource org licenses artistic license 2"),
    ("bsl-1", "boost", r"boost software licen[sc]e(?: version)?(?: 1(?: 0)?)?", "bsl 1 0", "boost org license 1 0"),
    ("busl", "business", r"business source licen[sc]e(?: version)?(?: 1(?: 1)?)?", "busl 1 1", "mariadb com bsl11"),
    ("elastic", "elastic", r"elastic licen[sc]e(?: version)?(?: 2(?: 0)?)?", "elastic 2 0", "elastic co licensing elastic license"),
    ("sspl", "server side", r"server side public licen[sc]e", "sspl 1 0", "mongodb com licensing server side public license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2)?", "wtfpl", "wtfpl net"),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e(?: version)?(?: 1(?: [01])?)?", "ofl 1 [01]", "scripts sil org ofl"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", "postgresql", "postgresql org about licence"),
    ("python", "python", r"(?:python software foundation|psf) licen[sc]e(?: version)?(?: 2)?", "(?:psf|python) 2 0", "docs python org license"),
    ("ruby", "ruby", r"ruby licen[sc]e", "ruby", "ruby lang org en about license"),
    ("php", "php", r"php licen[sc]e(?: version)?(?: 3(?: 01?)?)?", "php 3 0?1?", "php net license"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", "ncsa", "opensource org licenses ncsa"),
    ("upl", "universal permissive", r"universal permissive licen[sc]e", "upl 1 0", "opensource org licenses upl"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", "ms rl", "opensource org licenses ms rl"),
    ("osl-3", "open software", r"open software licen[sc]e(?: version)?(?: 3(?: 0)?)?", "osl 3 0", "opensource org licenses osl 3 0"),
    ("afl-3", "academic free", r"academic free licen[sc]e(?: version)?(?: 3(?: 0)?)?", "afl 3 0", "opensource org licenses afl 3 0"),
    ("ecl-2", "educational", r"educational community licen[sc]e(?: version)?(?: 2(?: 0)?)?", "ecl 2 0", "opensource org licenses ecl2"),
    ("w3c", "w3c", r"w3c software(?: and document)?(?: notice and)? licen[sc]e", "w3c", "w3 org consortium legal (?:2015 )?copyright software"),
    ("cecill", "cecill", r"cecill(?: [abc12])?", "cecill [abc12]", "cecill info licences"),
    ("mulan", "mulan", r"mulan (?:permissive software|psl)(?: licen[sc]e)?", "mulanpsl 2 0", "license coscl org cn mulanpsl2"),
    ("cc0", "cc0", r"(?:cc0(?: 1 0)?|creative commons zero)", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "c", r"(?:cc by|creative commons attribution)(?! (?:nc|sa|nd|noncommercial|sharealike|non|share|no))(?: [1234](?: [05])?)?", "cc by [1234] [05]", "creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", "c", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1234](?: [05])?)?", "cc by sa [1234] [05]", "creativecommons org licenses by sa"),
    ("cc-by-nd", "c", r"(?:cc by nd|creative commons attribution no ?deriv(?:s|atives))(?: [1234](?: [05])?)?", "cc by nd [1234] [05]", "creativecommons org licenses by nd"),
    ("cc-by-nc", "c", r"(?:cc by nc|creative commons attribution non ?commercial)(?! (?:sa|nd|share|no))(?: [1234](?: [05])?)?", "cc by nc [1234] [05]", "creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nc-sa", "c", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1234](?: [05])?)?", "cc by nc sa [1234] [05]", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "c", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives))(?: [1234](?: [05])?)?", "cc by nc nd [1234] [05]", "creativecommons org licenses by nc nd"),
    ("odbl", "open database", r"open (?:data commons open )?database licen[sc]e", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e", "odc by 1 0", "opendatacommons org licenses by"),
    ("pddl", "public domain dedication", r"public domain dedication and licen[sc]e", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("openrail", "rail", r"(?:open ?rail|responsible ai) (?:m )?licen[sc]e", "openrail", "huggingface co spaces bigscience license"),
]

#: (label, keyword, pattern, priority, confidence) of notices that name no license above
NOTICES = [
    ("gpl", "g", r"(?:gnu )?(?:general public licen[sc]e|gpl)", 4, 0.6),
    ("lgpl", "l", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl)", 4, 0.6),
    ("agpl", "a", r"(?:gnu )?(?:affero general public licen[sc]e|agpl)", 4, 0.6),
    ("bsd", "bsd", r"bsd (?:style )?licen[sc]e", 4, 0.6),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", 4, 0.6),
    ("epl", "eclipse", r"eclipse public licen[sc]e", 4, 0.6),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", 4, 0.6),
    ("artistic", "artistic", r"artistic licen[sc]e", 4, 0.6),
    ("creative-commons", "creative commons", r"creative commons(?: licen[sc]e)?", 5, 0.5),
    ("public-domain", "public domain", r"(?:in|into|dedicated to) the public domain", 4, 0.7),
    ("proprietary", "rights reserved", r"all rights reserved", 5, 0.4),
    ("proprietary", "licen", r"proprietary (?:and confidential )?licen[sc]e", 4, 0.6),
    ("mit", "permission is", r"permission is hereby granted free of charge to any person obtaining a copy", 1, 0.98),
    ("isc", "permission to", r"permission to use copy modify and or distribute this software for any purpose", 1, 0.95),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification", 1, 0.9),
    ("unknown-license", "licen", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:an? )?(?:\S+ ){1,4}?licen[sc]e", 6, 0.3),
]

#: words that the gate is made of where a rule allows it
COMMON = ("licen", "gpl", "gfdl", "cc0", "commons", "domain", "reserved", "permission", "redistribution", "wtfpl",
        "mozilla", "eclipse", "eupl", "ofl", "bsl11", "creative", "cddl", "mulan", "consortium")
GATE_CC = r"(?:^|[^a-z0-9])cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"


#: keywords that are part of this text tell no license from another
PLAIN = "licensed under the terms of the public license licence version licenses available released distributed published provided shared under"
MOST = 4  # spellings of one stretch of a pattern


def _spellings(node: tuple) -> list[str] | None:
    """All texts that a part of a pattern fits, if they are MOST at most."""
    kind, value = node
    if kind is op.LITERAL:
        return [chr(value)]
    if kind is op.IN and all(k is op.LITERAL for k, _ in value):
        out = [chr(v) for _, v in value]
    elif kind is op.SUBPATTERN:
        out = _spelled(value[3])
    elif kind is op.BRANCH:
        parts = [_spelled(p) for p in value[1]]
        out = None if None in parts else sum(parts, [])
    elif kind is op.MAX_REPEAT and tuple(value[:2]) == (0, 1):
        out = _spelled(value[2])
        out = None if out is None else ["", *out]
    else:
        out = [""] if kind in (op.ASSERT, op.ASSERT_NOT, op.AT) else None
    return out if out is not None and len(out) <= MOST else None


def _spelled(nodes) -> list[str] | None:
    out = [""]
    for node in nodes:
        one = _spellings(node)
        if one is None or len(out) * len(one) > MOST:
            return None
        out = [a + b for a, b in itertools.product(out, one)]
    return out


def _needs(nodes) -> list[tuple[str, ...]]:
    """Lists of texts; of each list, every match holds one text at least."""
    lists, run = [], [""]
    for node in nodes:
        kind, value = node
        if kind is op.ASSERT:
            lists += _needs(value[1])
            continue
        one = _spellings(node)
        if one is not None and len(run) * len(one) <= MOST:
            run = [a + b for a, b in itertools.product(run, one)]
            continue
        lists.append(run)
        # what all spellings so far end with; the parser takes a common first letter out of alternatives
        end = commonprefix([r[::-1] for r in run])[::-1]
        run = [end + x for x in one] if one else [""]
        if kind is op.SUBPATTERN:
            lists += _needs(value[3])
        elif kind is op.BRANCH:
            parts = [_needs([*((op.LITERAL, ord(x)) for x in end), *p]) for p in value[1]]
            if all(parts):
                lists.append([k for p in parts for k in max(p, key=_worth)])
        elif kind is op.MAX_REPEAT and value[0] > 0:
            lists += _needs(value[-1])
    lists.append(run)
    return [tuple(sorted(k for k in set(x) if not any(o != k and o in k for o in x))) for x in lists if all(k.strip() for k in x)]


def _worth(keys: tuple[str, ...]) -> tuple:
    return not any(k.strip() in PLAIN for k in keys), min(len(k.strip()) for k in keys), -len(keys)


@cache
def required(pattern: str) -> tuple[str, ...]:
    """Keywords of which every match of ``pattern`` holds one, as telling as can be."""
    return max(_needs(parser.parse(pattern)), key=_worth)


def _gate_word(key: str) -> str:
    """A part of ``key`` without spaces: one of COMMON if there is any, "" where GATE_CC does."""
    if key.startswith("cc by"):
        return ""
    return next((g for g in COMMON if g in key), max(key.split(" "), key=len))


def _gate_words() -> tuple[str, ...]:
    words = set()
    for _, _, pattern, _, _ in signatures():
        ways = [{_gate_word(k) for k in keys} for keys in _needs(parser.parse(pattern))]
        words |= max(ways, key=lambda w: (w <= {*COMMON, ""}, min(len(x) or 9 for x in w)))
    return tuple(sorted(words - {""}))


def signatures() -> list[tuple[str, tuple[str, ...], str, int, float]]:
    """(label, keywords, pattern, priority, confidence) of every rule, in order; patterns fit whole words."""
    rules = []
    terms = r"(?:the )?(?:terms of )?(?:the )?"
    tail = r"(?: (?:public )?licen[sc]e)?(?: (?:version |v)?\d(?: \d)?)?"
    given = r"(?:released|distributed|available|published|provided|shared) under"
    for label, key, name, tag, address in LICENSES:
        rules.append((label, rf"spdx licen[sc]e identifier {tag}", 1, 1.0))
        rules.append((label, rf"(?:https? )?(?:www )?{address}", 2, 0.95))
        rules.append((label, f"licen[sc]ed under {terms}{name}{tail}", 2, 0.95))
        rules.append((label, f"{given} {terms}{name}(?: public)? licen[sc]e{tail}", 2, 0.95))
        bare = name if "licen" in name else f"{name} licen[sc]e"
        if key == "apache":  # the word may stand inside the name or after it
            bare = rf"(?=(?:\S+ ){{1,4}}licen[sc]e){name}"
        rules.append((label, bare, 3, 0.8))
        if label.startswith("cc"):
            rules.append((label, name, 3, 0.8))
    rules += [(label, *rest) for label, _, *rest in NOTICES]
    return [(a, required(p), rf"(?<![^ ]){p}(?![^ ])", pr, c) for a, p, pr, c in rules]


#: every match of a rule holds one of these or GATE_CC, so a text without them (A-Z lower-cased) needs no scan
GATE = _gate_words()


def _gate(low: Column, base: tuple[str, ...] = ()) -> Column:
    """Texts that may hold a match of a rule or one of the phrases ``base``."""
    out = low.rlike(GATE_CC)
    more = {max(p.split(" "), key=len) for p in base if not (f" {p}".count(" cc by ") or any(g in p for g in GATE))}
    for k in (*GATE, *sorted(more)):
        out = out | F.contains(low, F.lit(k))
    return out


def _rules_column() -> Column:
    rows = [
        F.struct(
            F.lit(i).alias("rule"), F.lit(a).alias("label"),
            F.lit(p).alias("pattern"), F.lit(pr).alias("priority"), F.lit(c).alias("confidence"),
        )
        for i, (a, _, p, pr, c) in enumerate(signatures())
    ]
    return F.array(*rows)


def _rules_of(norm: Column) -> Column:
    """The rules of which a keyword occurs."""
    by_key: dict[str, list[int]] = {}
    for i, (_, keys, *_) in enumerate(signatures()):
        for k in keys:
            by_key.setdefault(k, []).append(i)
    keys = F.array(*[F.struct(F.lit(k).alias("key"), F.array(*map(F.lit, at)).alias("at")) for k, at in by_key.items()])
    found = F.transform(F.filter(keys, lambda x: F.contains(norm, x["key"])), lambda x: x["at"])
    return F.transform(F.array_distinct(F.flatten(found)), lambda i: F.get(_rules_column(), i))


def phrase_places(w: Column, phrase: str) -> Column:
    """Word positions (from 0) where the words of ``phrase`` stand consecutively."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        out = F.get(w, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            out = out & F.coalesce(F.get(w, i + k) == part, F.lit(False))
        return out

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), here)


def detections(documents: DataFrame) -> DataFrame:
    """doc_id, key, rule, label, priority, confidence, start, stop of every match left after suppression.

    ``start`` and ``stop`` are offsets in the text's words joined by single spaces.
    Repeated documents share their rows.
    """
    low = C.ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    gated = documents.select("doc_id", "text").where(C.let(low, lambda text: _gate(text)))
    norm = gated.select("doc_id", C.text_key(F.col("text")).alias("key"), F.array_join(C.words(F.col("text")), " ").alias("norm"))
    hit = norm.select(
        "doc_id", "key", "norm", F.explode(_rules_of(F.col("norm"))).alias("r")
    )
    hit = hit.where(F.expr("norm RLIKE r.pattern"))
    parts = hit.select(
        "doc_id", "key", "r",
        F.expr("transform(split(norm, r.pattern), x -> char_length(x))").alias("gaps"),
        F.expr("transform(regexp_extract_all(norm, r.pattern, 0), x -> char_length(x))").alias("lens"),
    )
    spans = parts.select("doc_id", "key", "r", F.posexplode("lens").alias("i", "len"), "gaps", "lens")
    per = Window.partitionBy("doc_id", "key", "r.rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.select("doc_id", "key", "r", "i", "len", F.get("gaps", F.col("i")).alias("gap"))
    spans = spans.distinct().withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(per))
    spans = spans.select(
        "doc_id", "key", "r.rule", "r.label", "r.priority", "r.confidence",
        (F.col("stop") - F.col("len")).alias("start"), "stop",
    )
    # inside an earlier or equal start that reaches as far: strongest rule first, then the longer span
    before = Window.partitionBy("doc_id", "key").orderBy("start", F.desc("stop"), "priority", "rule")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    out = spans
    for p in sorted({s[3] for s in signatures()}):
        # furthest stop of a span of priority p or stronger that starts no later
        reach = F.max(F.when(F.col("priority") <= p, F.col("stop"))).over(earlier)
        out = out.withColumn(f"_reach{p}", reach)
    inside = F.lit(False)
    for p in sorted({s[3] for s in signatures()}):
        inside = inside | ((F.col("priority") == p) & (F.coalesce(f"_reach{p}", F.lit(-1)) >= F.col("stop")))
    out = out.withColumn("_inside", inside).where(~F.col("_inside"))
    # the other way round: a weaker, longer span goes when a stronger one lies inside it
    after = Window.partitionBy("doc_id", "key").orderBy(F.desc("start"), "stop", "priority", "rule")
    sooner = after.rowsBetween(Window.unboundedPreceding, -1)
    outer = F.lit(False)
    for p in sorted({s[3] for s in signatures()})[1:]:
        least = F.min(F.when(F.col("priority") < p, F.col("stop"))).over(sooner)
        outer = outer | ((F.col("priority") == p) & (F.coalesce(least, F.lit(1 << 60)) <= F.col("stop")))
    out = out.withColumn("_outer", outer).where(~F.col("_outer"))
    return out.select("doc_id", "key", "rule", "label", "priority", "confidence", "start", "stop")


def scan(documents: DataFrame, base: dict[str, str] = BASE) -> DataFrame:
    """A row per document: doc_id, n_words, base places and labels, labels of both kinds, score and rules.

    ``score`` is the largest confidence among the detections left (1 for a base
    phrase), 0 without any. ``rules`` are the numbers of the rules left, sorted.
    """
    low = C.ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    read = C.let(low, lambda text: F.struct(C.words_of(text).alias("w"), _gate(text, tuple(base)).alias("gate")))
    rows = documents.select("doc_id", C.text_key(F.col("text")).alias("key"), read.alias("read"))
    rows = rows.select("doc_id", "key", F.col("read.w").alias("w"), F.col("read.gate").alias("gate"))
    none = F.array().cast("array<int>")
    rows = rows.select(
        "doc_id", "key", F.size("w").cast("long").alias("n_words"),
        *[
            F.when(F.col("gate"), phrase_places(F.col("w"), p)).otherwise(none).alias(f"p{i}")
            for i, p in enumerate(base)
        ],
    )
    labels = list(base.values())
    places = F.concat(*[F.col(f"p{i}") for i in range(len(base))])
    found = F.array_compact(
        F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(labels)])
    )
    rows = rows.select(
        "doc_id", "key", "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(found)).alias("_base"),
    )
    more = detections(documents).groupBy("doc_id", "key").agg(
        F.collect_set("label").alias("_more"), F.max("confidence").alias("_score"), F.sort_array(F.collect_set("rule")).alias("_rules")
    )
    more = more.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_more", "_score", "_rules")
    joined = rows.join(more, rows["doc_id"].eqNullSafe(more["_id"]) & (rows["key"] == more["_key"]), "left")
    no_text = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_more", no_text))), ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
        F.coalesce("_rules", none).alias("rules"),
    )
