"""Licence recognition by sentence rules: sentences -> known ids -> ordered rules over id sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "this software is released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "the software is provided as is without warranty of any kind": "as-is",
    "licensed under the apache license version 2 0": "apache-2-notice",
    "licensed under the apache license version 2 0 the license": "apache-2-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy-at",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "this work is licensed under the gnu general public license version 2": "gpl-2-notice",
    "this program is free software": "gnu-free-software",
    "licensed under cc by nc 4 0": "cc-by-nc-4-notice",
    "licensed under cc by 4 0": "cc-by-4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "neither the name of the copyright holder nor the names of its contributors may be used": "bsd-no-endorse",
    "all rights reserved": "all-rights-reserved",
}

#: Fixed values: (licence, identifiers that must occur in this order).  First fitting rule of a licence wins;
#: rules are in order of precedence, longer sequences before the shorter ones that they contain.
RULES = [
    ("MIT", ("mit-notice", "mit-grant", "as-is")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)),
    ("Apache-2.0", ("apache-2-notice", "apache-compliance", "apache-copy-at")),
    ("Apache-2.0", ("apache-2-notice",)),
    ("GPL-3.0", ("gpl-3-notice",)),
    ("GPL-2.0", ("gpl-2-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-no-endorse")),
    ("BSD-2-Clause", ("bsd-grant",)),
    ("Proprietary", ("all-rights-reserved",)),
    ("AGPL-3.0", ("agpl-3-notice",)),
    ("LGPL-3.0", ("lgpl-3-notice",)),
    ("LGPL-2.1", ("lgpl-2-1-notice",)),
    ("MPL-2.0", ("mpl-2-notice",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense-grant",)),
    ("BSD-3-Clause", ("bsd-3-tag",)),
    ("BSD-2-Clause", ("bsd-2-tag",)),
]

#: Licences that say nothing where another one is found.
RESERVED = ("Proprietary",)

#: Sentences in full as published, normalised; " | " stands between sentences that must follow each other,
#: {name} for 1 to 12 words.  Identifiers are those of SENTENCES, so RULES hold for both.
PUBLISHED = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
    " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
    " and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"
    " fitness for a particular purpose and noninfringement": "as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "neither the name of {name} nor the names of its contributors may be used to endorse or promote products derived from this software without specific"
    " prior written permission": "bsd-no-endorse",
    "neither the name of {name} nor the names of contributors may be used to endorse or promote products derived from this software without specific"
    " prior written permission": "bsd-no-endorse",
    "the asf licenses this file to you under the apache license version 2 0 the license": "apache-2-notice",
    "apache license version 2 0 january 2004": "apache-2-notice",
    "gnu general public license version 3 29 june 2007": "gpl-3-notice",
    "gnu general public license version 2 june 1991": "gpl-2-notice",
    "gnu affero general public license version 3 19 november 2007": "agpl-3-notice",
    "gnu lesser general public license version 3 29 june 2007": "lgpl-3-notice",
    "gnu lesser general public license version 2 1 february 1999": "lgpl-2-1-notice",
    "this source code form is subject to the terms of the mozilla public license v | 2 0": "mpl-2-notice",
    "mozilla public license version 2 0": "mpl-2-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above"
    " copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above"
    " copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
} | {
    f"{before}creative commons {kind} 4 0 international {after}": f"{short}-4-notice"
    for kind, short in (("attribution", "cc-by"), ("attribution sharealike", "cc-by-sa"), ("attribution noncommercial", "cc-by-nc"))
    for before in ("", "licensed under a ", "licensed under the ", "this work is licensed under a ", "this work is licensed under the ")
    for after in ("license", "public license")
} | {
    f"spdx license identifier | {tag}": found
    for tag, found in {
        "mit": "mit-notice", "apache 2 0": "apache-2-notice", "bsd 2 clause": "bsd-2-tag", "bsd 3 clause": "bsd-3-tag", "mpl 2 0": "mpl-2-notice", "isc": "isc-grant",
        "unlicense": "unlicense-grant", "cc by 4 0": "cc-by-4-notice", "cc by sa 4 0": "cc-by-sa-4-notice", "cc by nc 4 0": "cc-by-nc-4-notice",
    }.items() | {
        (f"{gnu} {version} {kind}".strip(), f"{notice}-notice")
        for gnu, version, notice in (("gpl", "2 0", "gpl-2"), ("gpl", "3 0", "gpl-3"), ("lgpl", "2 1", "lgpl-2-1"), ("lgpl", "3 0", "lgpl-3"), ("agpl", "3 0", "agpl-3"))
        for kind in ("", "only", "or later")
    }
} | {
    f"you can redistribute it and or modify it under the terms of the gnu {kind}general public license {rest}": f"{short}-{n.replace(' ', '-')}-notice"
    for kind, short, n in (("", "gpl", "2"), ("", "gpl", "3"), ("lesser ", "lgpl", "2 1"), ("lesser ", "lgpl", "3"), ("affero ", "agpl", "3"))
    for rest in (
        f"as published by the free software foundation either version {n} of the license or at your option any later version",
        f"as published by the free software foundation | either version {n} of the license or at your option any later version",
        f"as published by the free software foundation version {n} of the license",
        f"as published by the free software foundation | version {n} of the license",
        f"version {n} as published by the free software foundation",
    )
}

#: Ends of firms' names that hold a full stop, before a sentence that goes on.
FIRM = r"(?i:\b(Inc|Ltd|Corp|Co|LLC|L\.L\.C|S\.A|e\.V))\.(\s+[a-z])"
NAME = r"(?:[a-z0-9]+ (?:/ )?){1,12}"


def _pattern(sentence: str) -> str:
    """The sentence with a line end allowed at each space."""
    return "".join({"|": r"\| ", "{name}": NAME}.get(w, rf"{w} (?:/ )?") for w in sentence.split(" ")).removesuffix("(?:/ )?")


def sentence_ids(text: Column, sentences: Mapping[str, str] = SENTENCES | PUBLISHED) -> Column:
    """Identifiers of the known sentences of a text, in their order, repeats kept.

    A sentence ends after . ! ? ; : before white space, or at a blank line, one
    without letters and digits; it begins and may end at any line end, too, so
    that one wrapped over lines is found as well as one amid other lines.  "2.0"
    and "4.0" stay whole.  It is lower-cased (A-Z), runs of other characters than
    a-z and 0-9 become one space (comment signs before lines go with them), and
    the ends are trimmed; it must then equal a known one.  Of those that begin
    at one place the longest counts.
    """
    if not sentences:
        return F.array().cast("array<string>")
    named_firms = F.regexp_replace(text, FIRM, "$1$2")
    t = F.regexp_replace(F.regexp_replace(named_firms, r"\r\n?", "\n"), r"[.!?;:]+(?=\s|$)", "\n\n")
    # Lines are told apart by " / ", sentences by " | ".
    t = F.regexp_replace(F.regexp_replace(ascii_lower(t), r"[^a-z0-9\n]+", " "), r" ?\n ?", "\n")
    t = F.replace(F.regexp_replace(t, r"\n\n+", " | "), F.lit("\n"), F.lit(" / "))
    s = F.concat(F.lit("| "), F.trim(t), F.lit(" |"))
    longest_first = sorted(sentences, key=lambda k: (-len(k), k))
    found = F.regexp_extract_all(s, F.lit("[|/] ((?:" + "|".join(map(_pattern, longest_first)) + "))(?=[|/])"), F.lit(1))
    known = F.create_map(*[F.lit(x) for kv in sentences.items() for x in kv])
    named = [k for k in longest_first if "{name}" in k]

    def id_of(m: Column) -> Column:
        m = F.trim(F.replace(m, F.lit(" / "), F.lit(" ")))
        fits = [F.when(m.rlike("^" + _pattern(k).rstrip() + "$"), F.lit(sentences[k])) for k in named]
        return F.coalesce(F.try_element_at(known, m), *fits)

    return F.transform(found, id_of)


def longer_rules(name: str, need: Sequence[str], rules: Sequence[tuple[str, tuple[str, ...]]]) -> list[tuple[str, ...]]:
    """Rules of other licences that hold this one's identifiers in their order, and more."""

    def holds(longer: Sequence[str]) -> bool:
        rest = iter(longer)
        return len(longer) > len(need) and all(i in rest for i in need)

    return [longer for other, longer in rules if other != name and holds(longer)]


def marked(need: Sequence[str]) -> str:
    return "".join(f"<{i}>" for i in need)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: Mapping[str, str] = SENTENCES | PUBLISHED,
    rules: Sequence[tuple[str, tuple[str, ...]]] = RULES,
    reserved: Sequence[str] = RESERVED,
) -> DataFrame:
    """One row per input row: id, sentence_ids, licenses (sorted, distinct), rule_numbers, license (first rule's or null).

    A rule fits when its identifiers occur as a subsequence of the document's
    identifier sequence, in this order, others between them allowed.  What a
    longer rule of another licence takes is not there for a rule that is part of
    it: BSD-2-Clause needs a grant that no BSD-3-Clause has.  ``reserved``
    licences count only where no other is found.  Of one licence the first
    fitting rule is reported.  Null and empty texts have no
    sentences and no licence; the whole text of any length is scanned; repeated
    rows stay; other columns are ignored.  The rule tables are fixed and small,
    so the plan is one scan without a shuffle.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    ids = base.select("_id", sentence_ids(F.col("_text"), sentences).alias("_ids"))
    seq = ids.withColumn("_seq", F.concat(F.lit(" "), F.array_join("_ids", " "), F.lit(" ")))

    def fits(name: str, need: Sequence[str]) -> Column:
        here = F.col("_seq").rlike("".join(rf" {i} (?:.* )?" if n == 0 else rf"(?<= ){i} (?:.* )?" for n, i in enumerate(need)))
        for longer in longer_rules(name, need, rules):
            own = F.array_join(F.transform(F.filter("_ids", lambda i: i.isin(*longer)), lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")  # noqa: B023
            here &= F.replace(own, F.lit(marked(longer)), F.lit("")).rlike(".*".join(f"<{i}>" for i in need))
        return here

    every = [F.when(fits(name, need), F.struct(F.lit(n + 1).alias("n"), F.lit(name).alias("name"))) for n, (name, need) in enumerate(rules)]
    all_hits = F.filter(F.array(*every), lambda r: r.isNotNull())
    free = lambda r: ~r["name"].isin(*reserved)
    hits = F.when(F.exists(all_hits, free), F.filter(all_hits, free)).otherwise(all_hits) if reserved else all_hits
    first = F.filter(F.col("_hits"), lambda r, i: ~F.exists(F.slice(F.col("_hits"), F.lit(1), i), lambda q: q["name"] == r["name"]))
    return (
        seq.withColumn("_hits", hits)
        .withColumn("_first", first)
        .select(
            F.col("_id").alias(id_col),
            F.array_join("_ids", ",").alias("sentence_ids"),
            F.array_join(F.transform("_first", lambda r: r["name"]), ",").alias("licenses"),
            F.array_join(F.transform("_first", lambda r: r["n"].cast("string")), ",").alias("rule_numbers"),
            F.try_element_at("_first", F.lit(1))["name"].alias("license"),
        )
    )
