"""License statements by ordered signature rules; DataFrame functions only.

A text becomes its lower-case words, each followed by one blank, and every rule is a regular
expression over that form. A name with alternatives gives a rule for each, so that every rule has a
keyword: the longest text that each of its matches holds. A rule runs only where its keyword occurs,
and no rule runs where none of the gate strings does, which spares nearly all documents; every match
of every rule holds its keyword and a gate string, so neither loses anything. Rules come in tiers: an
identifier tag, a grant, the name of a license, the base phrases. A detection inside a detection of
the same or a higher tier is suppressed; what is left gives the labels. Base labels always stay.

Nulls and edges: a null or empty text has no words, no labels and score 0; repeated rows give equal
results; an empty table gives an empty result; other columns are ignored. Everything of a document
is found in its own row, so there is no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

MARK = "\x01"
TAG, GRANT, NAME, BASE = 1, 2, 3, 4
SCORES = {TAG: 0.98, GRANT: 0.9, NAME: 0.6, BASE: 0.7}
# whatever a rule matches holds at least one of these, and the rule's own keyword
GATE = ["licen", "spdx", "copyright", "copyleft", "public domain", "rights reserved", "gpl", "bsd",
        "mpl 1", "mpl 2", "mpl v", "epl 1", "epl 2", "epl v", "eupl", "cddl", "cecill", "cc0",
        "creative commons", "apache", "mit no attribution", "under mit", "the mit", "of mit",
        "expat", "proprietary", "permission is hereby", "permission to use", "historical permission",
        "redistribution and use", "is free software", "terms as perl"]
GENERIC = {"license", "public license"}     # no keywords, since most gated texts hold them
BASE_RULES = [("mit", "mit license"), ("apache", "apache license"),
              ("gpl", "general public license")]

# label, identifier as words, name as words; "(v) " stands for an optional version word
LICENSES = [
    ("mit-0", "mit 0", "mit no attribution(?: license)?"),
    ("mit-modern", "mit modern variant", "mit license modern variant"),
    ("apache-1.0", "apache 1 0", "apache (?:software )?license (v) 1 0"),
    ("apache-1.1", "apache 1 1", "apache (?:software )?license (v) 1 1"),
    ("apache-2.0", "apache 2 0", "apache (?:software )?license (v) 2(?: 0)?"),
    ("gpl-1.0", "gpl 1 0(?: only| or later)?",
     "(?:gnu )?(?:general public license|gpl) (v) ?1(?: 0)?"),
    ("gpl-2.0", "gpl 2 0(?: only| or later)?",
     "(?:gnu )?(?:general public license|gpl) (v) ?2(?: 0)?"),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?",
     "(?:gnu )?(?:general public license|gpl) (v) ?3(?: 0)?"),
    ("lgpl-2.0", "lgpl 2 0(?: only| or later)?",
     "(?:gnu )?(?:library general public license|lgpl) (v) ?2(?: 0)?"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?",
     "(?:gnu )?(?:lesser general public license|lgpl) (v) ?2 1"),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?",
     "(?:gnu )?(?:lesser general public license|lgpl) (v) ?3(?: 0)?"),
    ("agpl-1.0", "agpl 1 0(?: only| or later)?", "affero general public license (v) 1"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?",
     "(?:gnu )?(?:affero general public license|agpl) (v) ?3(?: 0)?"),
    ("gfdl", "gfdl 1 [123](?: only| or later)?",
     "(?:gnu )?free documentation license"),
    ("bsd-0", "0bsd", "zero clause bsd(?: license)?"),
    ("bsd-1", "bsd 1 clause", "(?:bsd 1 clause|1 clause bsd)(?: license)?"),
    ("bsd-2", "bsd 2 clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?"),
    ("bsd-3", "bsd 3 clause",
     "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?"),
    ("bsd-4", "bsd 4 clause", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?"),
    ("bsd", "bsd", "bsd(?: style)? license"),
    ("isc", "isc", "isc license"),
    ("mpl-1.0", "mpl 1 0", "(?:mozilla public license|mpl) (v) ?1 0"),
    ("mpl-1.1", "mpl 1 1", "(?:mozilla public license|mpl) (v) ?1 1"),
    ("mpl-2.0", "mpl 2 0", "(?:mozilla public license|mpl) (v) ?2(?: 0)?"),
    ("epl-1.0", "epl 1 0", "(?:eclipse public license|epl) (v) ?1(?: 0)?"),
    ("epl-2.0", "epl 2 0", "(?:eclipse public license|epl) (v) ?2(?: 0)?"),
    ("eupl-1.1", "eupl 1 1", "(?:european union public licen[cs]e|eupl) (v) ?1 1"),
    ("eupl-1.2", "eupl 1 2", "(?:european union public licen[cs]e|eupl) (v) ?1 2"),
    ("cddl-1.0", "cddl 1 0",
     "(?:common development and distribution license|cddl)(?: (v) ?1 0)?"),
    ("cddl-1.1", "cddl 1 1",
     "(?:common development and distribution license|cddl) (v) ?1 1"),
    ("cpl-1.0", "cpl 1 0", "common public license(?: (v) ?1 0)?"),
    ("cpal-1.0", "cpal 1 0", "common public attribution license(?: (v) ?1 0)?"),
    ("ipl-1.0", "ipl 1 0", "ibm public license(?: (v) ?1 0)?"),
    ("bsl-1.0", "bsl 1 0", "boost software license(?: (v) ?1 0)?"),
    ("busl-1.1", "busl 1 1", "business source license(?: (v) ?1 1)?"),
    ("sspl-1.0", "sspl 1 0", "server side public license(?: (v) ?1)?"),
    ("elastic-2.0", "elastic 2 0", "elastic license(?: (v) ?2(?: 0)?)?"),
    ("artistic-1.0", "artistic 1 0(?: perl)?", "artistic license(?: (v) ?1 0)?"),
    ("artistic-2.0", "artistic 2 0", "artistic license (v) ?2(?: 0)?"),
    ("zlib", "zlib", "zlib(?: libpng)? license"),
    ("libpng", "libpng(?: 2 0)?", "png reference library license"),
    ("openssl", "openssl", "openssl license"),
    ("ssleay", "ssleay", "ssleay license"),
    ("python-2.0", "python 2 0", "python (?:software foundation )?license(?: (v) ?2)?"),
    ("php-3.0", "php 3 0", "php license (v) ?3 0"),
    ("php-3.01", "php 3 01", "php license(?: (v) ?3 01)?"),
    ("ruby", "ruby", "ruby license"),
    ("perl", "perl", "(?:same terms as perl|perl license)(?: itself)?"),
    ("postgresql", "postgresql", "postgresql license"),
    ("tcl", "tcl", "tcl(?: tk)? license"),
    ("unicode", "unicode dfs 201[56]", "unicode license(?: agreement)?"),
    ("vim", "vim", "vim license"),
    ("wtfpl", "wtfpl", "do what the (?:fuck|f) you want to public license"),
    ("unlicense", "unlicense", "unlicense"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? license"),
    ("ofl-1.0", "ofl 1 0", "(?:sil )?open font license (v) ?1 0"),
    ("ofl-1.1", "ofl 1 1", "(?:sil )?open font license(?: (v) ?1 1)?"),
    ("osl-3.0", "osl 3 0", "open software license(?: (v) ?3 0)?"),
    ("afl-3.0", "afl 3 0", "academic free license(?: (v) ?3 0)?"),
    ("ecl-2.0", "ecl 2 0", "educational community license(?: (v) ?2 0)?"),
    ("ms-pl", "ms pl", "microsoft public license"),
    ("ms-rl", "ms rl", "microsoft reciprocal license"),
    ("cecill-2.1", "cecill 2 1", "cecill (?:free software )?license(?: (v) ?2 1)?"),
    ("cecill-b", "cecill b", "cecill b(?: license)?"),
    ("cecill-c", "cecill c", "cecill c(?: license)?"),
    ("mulan-2.0", "mulanpsl 2 0", "mulan permissive software license(?: (v) ?2)?"),
    ("odbl-1.0", "odbl 1 0", "open database license(?: (v) ?1 0)?"),
    ("odc-by-1.0", "odc by 1 0", "open data commons attribution license(?: (v) ?1 0)?"),
    ("pddl-1.0", "pddl 1 0", "public domain dedication and license(?: (v) ?1 0)?"),
    ("cc0-1.0", "cc0 1 0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc by [1234] [05]",
     "creative commons attribution(?: [1234] [05])?(?: international| generic| unported)?"
     "(?: public)?(?: license)?"),
    ("cc-by-sa", "cc by sa [1234] [05]",
     "creative commons attribution share ?alike(?: [1234] [05])?"
     "(?: international| generic| unported)?(?: public)?(?: license)?"),
    ("cc-by-nc", "cc by nc [1234] [05]",
     "creative commons attribution non ?commercial(?: [1234] [05])?"
     "(?: international| generic| unported)?(?: public)?(?: license)?"),
    ("cc-by-nd", "cc by nd [1234] [05]",
     "creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa [1234] [05]",
     "creative commons attribution non ?commercial share ?alike(?: [1234] [05])?"),
    ("cc-by-nc-nd", "cc by nc nd [1234] [05]",
     "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1234] [05])?"),
    ("openrail", "(?:creativeml )?openrail(?: m)?", "open ?rail(?: m)? license"),
    ("polyform-nc-1.0", "polyform noncommercial 1 0 0",
     "polyform non ?commercial license(?: 1 0 0)?"),
    ("blueoak-1.0", "blueoak 1 0 0", "blue oak model license(?: 1 0 0)?"),
    ("upl-1.0", "upl 1 0", "universal permissive license(?: (v) ?1 0)?"),
    ("w3c", "w3c", "w3c (?:software )?(?:notice and )?license"),
    ("x11", "x11", "x11 license"),
    ("zpl-2.1", "zpl 2 1", "zope public license(?: (v) ?2 1)?"),
    ("ijg", "ijg", "independent jpeg group license"),
    ("curl", "curl", "curl license"),
    ("beerware", "beerware", "beer ?ware license"),
    ("json", "json", "json license"),
    ("hpnd", "hpnd", "historical permission notice and disclaimer"),
]

# Statements that name no license of the list: label, tier, expression.
STATEMENTS = [
    ("proprietary", GRANT, "all rights reserved"),
    ("proprietary", GRANT, "(?:proprietary and confidential|proprietary license)"),
    ("proprietary", GRANT, "unpublished proprietary(?: source code| work)?"),
    ("public-domain", GRANT,
     "(?:dedicated to|released to|released into|placed in|placed into) the public domain"),
    ("public-domain", NAME, "public domain"),
    ("copyleft", NAME, "copyleft"),
    ("copyright", NAME, "copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("copyright", NAME, "copyright (?:c )?by"),
    ("mit", GRANT, "permission is hereby granted free of charge to any person"),
    ("isc", GRANT, "permission to use copy modify and or distribute this software"),
    ("bsd", GRANT, "redistribution and use in source and binary forms"),
    ("gpl", GRANT, "this program is free software you can redistribute it"),
    ("lgpl", GRANT, "this library is free software you can redistribute it"),
    ("unlicense", GRANT, "free and unencumbered software released into the public domain"),
    ("mit", TAG, "spdx license identifier mit"),
    ("mit", GRANT, "(?:licensed|released|distributed|available|covered) under (?:the )?"
     "(?:terms of (?:the )?)?mit(?: license)?"),
    ("mit", GRANT, "(?:licensed|released|distributed|available|covered) under (?:the )?"
     "(?:terms of (?:the )?)?expat(?: license)?"),
    ("apache", GRANT, "(?:licensed|released|distributed|available|covered) under (?:the )?"
     "(?:terms of (?:the )?)?apache(?: license)?"),
    ("gpl", GRANT, "(?:licensed|released|distributed|available|covered) under (?:the )?"
     "(?:terms of (?:the )?)?(?:gnu )?gpl"),
]

VERBS = ("(?:licensed|released|distributed|available|covered|provided|published|made available)"
         " (?:under|by) (?:the )?(?:terms of (?:the )?)?")


def alternatives(text: str) -> list[str]:
    """An expression once for each choice of the groups that are not optional."""
    group = re.search(r"\(\?:([^()]*)\)(?!\?)", text)
    if not group:
        return [text]
    return [x for part in group[1].split("|")
            for x in alternatives(text[:group.start()] + part + text[group.end():])]


def keyword(text: str) -> str:
    """The longest text, but for ``GENERIC`` ones, that every match of an expression without
    alternatives holds."""
    gap, inner = "\0", None
    while inner != text:        # what is optional divides the rest, groups in groups too
        inner, text = text, re.sub(r"\(\?:[^()]*\)\?", gap, text)
    parts = re.split(r"\0|\[[^\]]*\](?:\{\d\})?|.\?", text)
    telling = [p for p in parts if len(p.strip()) > 2 and p.strip() not in GENERIC]
    return max(telling or parts, key=len)


def rules() -> list[tuple[str, int, str, str]]:
    """(label, tier, keyword, expression) of all rules, highest tier first."""
    out = [(label, tier, keyword(x), x) for label, tier, text in STATEMENTS
           for x in alternatives(text)]
    for label, tag, name in LICENSES:
        name = name.replace("(v) ?", "(?:version |v ?)?").replace("(v) ", "(?:version |v )?")
        out.append((label, TAG, "spdx", f"spdx license identifier {tag}"))
        for x in alternatives(name):
            # a blank follows a short name in any case
            word = keyword(x) if len(keyword(x)) > 3 else keyword(x) + " "
            out += [(label, GRANT, word, VERBS + x), (label, NAME, word, x)]
    out += [(label, BASE, phrase, phrase) for label, phrase in BASE_RULES]
    # whole words only: a rule starts after a blank and ends with one
    return [(label, tier, word, f"(?<![^ ]){text} ")
            for label, tier, word, text in sorted(set(out), key=lambda r: (r[1], r[0], r[3]))]


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _spans(words: Column, pattern: Column) -> Column:
    """(start, end) in words of every match, in linear time: matches are marked, then counted."""
    hits = F.regexp_extract_all(words, pattern, F.lit(0))
    marked = F.split(F.regexp_replace(words, pattern, F.lit(MARK + "$0")), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i)),
                      lambda i: i.isNotNull())
    return F.zip_with(starts, hits, lambda s, h: F.struct(s.alias("start"),
                                                          (s + _blanks(h)).alias("end")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, found (all detections), labels, score, and the base columns."""
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(tier).alias("tier"),
                               F.lit(word).alias("word"), F.lit(text).alias("text"))
                      for label, tier, word, text in rules()])
    form = F.concat(F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))),
                                     r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" "))
    # exactly one blank after each word, none in front
    words = docs.select("doc_id", F.regexp_replace(F.ltrim(form), " +$", " ").alias("words"))
    gate = F.contains("words", F.lit(GATE[0]))
    for text in GATE[1:]:
        gate = gate | F.contains("words", F.lit(text))
    gated = words.select("doc_id", _blanks(F.col("words")).cast("long").alias("n_words"),
                         F.when(gate, F.col("words")).alias("words"))
    fit = F.filter(table, lambda r: F.contains(F.col("words"), r["word"])
                   & F.regexp_like("words", r["text"]))
    ruled = gated.withColumn("fit", F.when(F.col("words").isNotNull(), fit))
    spans = F.flatten(F.transform("fit", lambda r: F.transform(
        _spans(F.col("words"), r["text"]),
        lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"),
                           r["tier"].alias("tier"), r["label"].alias("label")))))
    # by start, longest first, highest tier first: whatever contains a detection stands before it
    found = ruled.select("doc_id", "n_words", F.array_sort(spans).alias("found"))

    none = F.struct(*[F.lit(-1).alias(f"end{t}") for t in SCORES],
                    F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(seen: Column, d: Column) -> Column:
        end, tier = -d["back"], d["tier"]
        reach = F.greatest(*[F.when(tier >= t, seen[f"end{t}"]).otherwise(F.lit(-1))
                             for t in SCORES])
        stays = reach < end
        worth = F.element_at(F.array(*[F.lit(s) for s in SCORES.values()]), tier)
        return F.struct(
            *[F.when(tier == t, F.greatest(seen[f"end{t}"], end)).otherwise(seen[f"end{t}"])
              .alias(f"end{t}") for t in SCORES],
            F.when(stays, F.array_union(seen["labels"], F.array(d["label"])))
            .otherwise(seen["labels"]).alias("labels"),
            F.when(stays, F.greatest(seen["score"], worth)).otherwise(seen["score"])
            .alias("score"))

    base = F.filter("found", lambda d: d["tier"] == BASE)
    summed = found.select("doc_id", "n_words", "found", base.alias("base"),
                          F.aggregate("found", none, step).alias("kept"))
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    base_labels = F.coalesce(F.array_distinct(F.transform("base", lambda d: d["label"])),
                             F.array().cast("array<string>"))
    labels = F.array_union(base_labels, F.coalesce("kept.labels", F.array().cast("array<string>")))
    score = F.greatest(F.coalesce("kept.score", F.lit(0.0)),
                       F.when(F.size("base") > 0, F.lit(SCORES[BASE])).otherwise(F.lit(0.0)))
    return summed.select(
        "doc_id", "n_words", "found", labels.alias("labels"), score.alias("score"),
        F.greatest(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        base_labels.alias("base_labels"))


def scan_digest(docs: DataFrame) -> DataFrame:
    """``scan`` with labels as sorted, comma-joined text."""
    text = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word",
                             text("base_labels"), text("labels"), "score")
