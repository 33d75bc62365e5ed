"""License scan: ordered signature rules over normalised words.

A text becomes its lower-cased words joined by single spaces.  Rules are regexes over
that form; each names the keyword without which it cannot match ('spdx' for the rules of
SPDX lines, whose ids hold no word of the names), and only rules whose keyword a text
holds are run.  Three tables give the rules: signatures are sentences of license bodies and
notices, SPDX ids stand for themselves in SPDX lines, and families give one rule for
each name and form.

Of equal places the first rule counts, so the specific stand before the general:
signatures, then SPDX ids, then families.

Detections are then resolved in one sweep by (start, longest, priority): one that lies
inside a kept detection is dropped, and of two that overlap partly the one with the
better (smaller) priority stays, the earlier one at a tie.

Everything is computed inside the row: no shuffle, no Python.

Defined cases: a null text has no words, no detection and score 0; rows that repeat an
id are scanned each by its own text; equal detections of one place are kept once, by
the first rule in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.llm.columns import let, picked, starts, whole

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that always count, with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


@dataclass(frozen=True)
class Family:
    """A license: its label, a word all its names hold, and names over words."""

    label: str
    keyword: str
    names: tuple[str, ...]
    versions: tuple[str, ...] = ()


FAMILIES = (
    Family("mit", "mit", ("mit", "expat mit")),
    Family("apache-2", "apache", ("apache", "apache software"), ("2", "2 0")),
    Family("gpl", "general", ("gnu general public", "general public"), ("1", "2", "2 0", "3", "3 0")),
    Family("gpl", "gpl", ("gnu gpl", "gpl"), ("1", "2", "2 0", "3", "3 0")),
    Family("lgpl", "lesser", ("gnu lesser general public", "lesser general public"), ("2 1", "3", "3 0")),
    Family("lgpl", "lgpl", ("gnu lgpl", "lgpl"), ("2 1", "3", "3 0")),
    Family("agpl", "affero", ("gnu affero general public", "affero general public"), ("3", "3 0")),
    Family("agpl", "agpl", ("gnu agpl", "agpl"), ("3", "3 0")),
    Family("mpl", "mozilla", ("mozilla public",), ("1 0", "1 1", "2 0")),
    Family("epl", "eclipse", ("eclipse public",), ("1 0", "2 0")),
    Family("cddl", "cddl", ("cddl",), ("1 0", "1 1")),
    Family("eupl", "eupl", ("eupl",), ("1 1", "1 2")),
    Family("bsd", "bsd", ("bsd", "new bsd", "simplified bsd", "modified bsd")),
    Family("bsd-2", "bsd", ("bsd 2 clause", "2 clause bsd")),
    Family("bsd-3", "bsd", ("bsd 3 clause", "3 clause bsd")),
    Family("isc", "isc", ("isc",)),
    Family("zlib", "zlib", ("zlib", "zlib libpng")),
    Family("artistic", "artistic", ("artistic", "perl artistic"), ("1 0", "2 0")),
    Family("boost", "boost", ("boost software",), ("1 0",)),
    Family("unlicense", "unlicense", ("unlicense",)),
    Family("wtfpl", "wtfpl", ("wtfpl",), ("2",)),
    Family("python", "python", ("python software foundation", "psf python"), ("2",)),
    Family("postgresql", "postgresql", ("postgresql",)),
    Family("ofl", "sil", ("sil open font",), ("1 0", "1 1")),
    Family("odbl", "database", ("open database",), ("1 0",)),
    Family("cc0", "cc0", ("cc0",), ("1 0",)),
    Family("cc-by", "cc", ("cc by",), ("2 0", "3 0", "4 0")),
    Family("cc-by-sa", "cc", ("cc by sa",), ("2 0", "3 0", "4 0")),
    Family("cc-by-nd", "cc", ("cc by nd",), ("2 0", "3 0", "4 0")),
    Family("cc-by-nc", "cc", ("cc by nc",), ("2 0", "3 0", "4 0")),
    Family("cc-by-nc-sa", "cc", ("cc by nc sa",), ("2 0", "3 0", "4 0")),
    Family("cc-by-nc-nd", "cc", ("cc by nc nd",), ("2 0", "3 0", "4 0")),
    Family("cc-by", "commons", ("creative commons attribution",), ("2 0", "3 0", "4 0")),
    Family("cc-by-sa", "commons", ("creative commons attribution share ?alike",), ("2 0", "3 0", "4 0")),
    Family("cc-by-nc", "commons", ("creative commons attribution non ?commercial",), ("2 0", "3 0", "4 0")),
)
#: Up to 20 words, as names of holders are.
SOME = "(?:[!-\U0010ffff]+ ){1,20}?"
#: Sentences of the public license texts as patterns over words, with the label
#: and a word that every match holds.
SIGNATURES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("boost", "hereby", "permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software"),
    ("ofl", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    (
        "isc", "hereby",
        "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided",
    ),
    (
        "0bsd", "hereby",
        "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software",
    ),
    (
        "postgresql", "hereby",
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",
    ),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    (
        "bsd-3", "endorse",
        rf"neither the names? of {SOME}contributors may be used to endorse or promote products derived from this software",
    ),
    ("bsd-4", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", "reproduction", "apache license version 2 0 january 2004 (?:http )?(?:https )?www apache org licenses terms and conditions for use reproduction and distribution"),
    (
        "apache-2", "applicable",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    ),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (
        "lgpl", "redistribute",
        "this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license",
    ),
    (
        "agpl", "redistribute",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license",
    ),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "mozilla", "the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("epl", "eclipse", "the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "contents", "the contents of this file are subject to the terms of the common development and distribution license"),
    (
        "zlib", "liable",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
    ),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0", "waived", rf"to the extent possible under law {SOME}waived all copyright and related or neighbou?ring rights"),
    ("artistic", "intent", "the intent of this document is to state the conditions under which a package may be copied"),
    ("python", "licensee", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
)
#: SPDX ids and their labels.
SPDX = {
    "0BSD": "0bsd", "Apache-1.1": "apache-1", "Apache-2.0": "apache-2", "Artistic-1.0": "artistic", "Artistic-2.0": "artistic",
    "BSD-2-Clause": "bsd-2", "BSD-3-Clause": "bsd-3", "BSD-4-Clause": "bsd-4", "BSL-1.0": "boost",
    "BUSL-1.1": "busl", "CC-PDDC": "public-domain", "EUPL-1.1": "eupl", "EUPL-1.2": "eupl", "ISC": "isc",
    "MIT-0": "mit-0", "MS-PL": "ms-pl", "MS-RL": "ms-rl", "NCSA": "ncsa", "OSL-3.0": "osl", "PSF-2.0": "python",
    "PostgreSQL": "postgresql", "Python-2.0": "python", "Unlicense": "unlicense", "Zlib": "zlib",
}
#: Verbs before a name, and what stands between.
GRANTS = ("licen[sc]ed", "released", "distributed", "available", "published")
PLAIN = (
    ("public-domain", "domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", 2, 0.8),
    ("all-rights-reserved", "reserved", "all rights reserved", 3, 0.5),
    ("proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)", 3, 0.6),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


def rules() -> list[Rule]:
    """All rules in order; patterns match whole words of the joined form."""
    found: list[Rule] = []

    def rule(label: str, keyword: str, body: str, priority: int, weight: float) -> None:
        found.append(Rule(label, keyword, rf"(?<![^ ]){body}(?![^ ])", priority, weight))

    for phrase, label in BASE.items():
        rule(label, phrase.split(" ")[0] if label == "cc-by-nc" else label.split("-")[0], phrase, 0, 1.0)
    for label, keyword, body in SIGNATURES:
        rule(label, keyword, body, 0, 1.0)
    for spdx_id, label in SPDX.items():
        words = " ".join(spdx_id.lower().replace(".", "-").split("-"))
        rule(label, "spdx", rf"spdx licen[sc]e identifier {words}(?: only| or later)?", 0, 1.0)
    for f in FAMILIES:
        spdx = f.label.replace("-", " ")
        rule(f.label, "spdx", rf"spdx licen[sc]e identifier {spdx}(?: [0-9]+)*(?: only| or later)?", 0, 1.0)
        for name in f.names:
            for grant in GRANTS:
                rule(
                    f.label, f.keyword,
                    rf"{grant} under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?(?: version)?(?: v?[0-9]+(?: [0-9]+)?)?",
                    1, 0.9,
                )
            for version in f.versions:
                rule(f.label, f.keyword, rf"{name} (?:public )?(?:licen[sc]e )?(?:version )?v?{version}", 1, 0.8)
            rule(f.label, f.keyword, rf"(?:the )?{name} licen[sc]e", 2, 0.6)
    for label, keyword, body, priority, weight in PLAIN:
        rule(label, keyword, body, priority, weight)
    return found


def joined_words(text: Column) -> Column:
    """Lower-cased (A-Z) words, joined by one space."""
    return F.trim(F.regexp_replace(F.translate(whole(text), UPPER, LOWER), NOT_WORD, " "))


def detections(joined: Column, table: list[Rule]) -> Column:
    """Array of (start, stop, priority, rank, label, weight) of all rules, in characters."""
    keywords = sorted({r.keyword for r in table})
    any_keyword = rf"(?<![^ ])(?:{'|'.join(keywords)})(?![^ ])"
    all_rules = F.array(
        *(
            F.struct(
                F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"),
                F.lit(r.priority).alias("priority"), F.lit(i).alias("rank"),
                F.lit(r.label).alias("label"), F.lit(r.weight).alias("weight"),
            )
            for i, r in enumerate(table)
        )
    )

    def places(r: Column) -> Column:
        def located(pair: Column) -> Column:
            lengths = F.zip_with(
                F.slice(pair["gaps"], 1, F.size(pair["hits"])), pair["hits"],
                lambda g, h: F.length(g) + F.length(h),
            )
            return let(
                starts(lengths),
                lambda at: F.transform(
                    pair["hits"],
                    lambda h, i: let(
                        at[i] + F.length(pair["gaps"][i]),
                        lambda s: F.struct(
                            s.alias("start"), (-s - F.length(h)).alias("back"),
                            r["priority"].alias("priority"), r["rank"].alias("rank"),
                            r["label"].alias("label"), r["weight"].alias("weight"),
                        ),
                    ),
                ),
            )

        both = F.struct(
            F.regexp_extract_all(joined, r["pattern"], F.lit(0)).alias("hits"),
            F.split(joined, r["pattern"], -1).alias("gaps"),
        )
        return let(both, located)

    held = F.array_distinct(F.regexp_extract_all(joined, F.lit(any_keyword), F.lit(0)))
    chosen = let(held, lambda k: F.filter(all_rules, lambda r: F.array_contains(k, r["keyword"])))
    found = F.flatten(F.transform(chosen, places))
    none = F.array().cast(
        "array<struct<start:bigint,back:bigint,priority:int,rank:int,label:string,weight:double>>"
    )
    # Arrays of structs sort field by field: start, longest first, priority, rank.
    return F.when(F.regexp_like(joined, F.lit(any_keyword)), F.sort_array(found)).otherwise(none)


def resolved(found: Column) -> Column:
    """Detections that stay: containment and priority, in one sweep over sorted ones."""
    empty = F.struct(
        F.array().cast(
            "array<struct<start:bigint,back:bigint,priority:int,rank:int,label:string,weight:double>>"
        ).alias("kept"),
        F.lit(-1).cast("long").alias("stop"),
    )

    def step(state: Column, x: Column) -> Column:
        stop = -x["back"]
        last = F.get(state["kept"], F.size(state["kept"]) - 1)
        more = F.struct(
            F.array_append(state["kept"], x).alias("kept"),
            F.greatest(state["stop"], stop).alias("stop"),
        )
        instead = F.struct(
            F.array_append(F.slice(state["kept"], 1, F.size(state["kept"]) - 1), x).alias("kept"),
            F.greatest(state["stop"], stop).alias("stop"),
        )
        return (
            F.when(stop <= state["stop"], state)
            .when((x["start"] < state["stop"]) & (x["priority"] >= last["priority"]), state)
            .when(x["start"] < state["stop"], instead)
            .otherwise(more)
        )

    return F.aggregate(found, empty, step, lambda s: s["kept"])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: word count, base places and labels, kept detections, labels, score.

    `detections` holds (label, first_word, stop_word, rule); stop is exclusive.
    """
    table = rules()

    def spaces(x: Column) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))

    base = picked(docs, doc_id=id_col, text=text_col).select(
        "doc_id", joined_words(F.col("text")).alias("joined")
    )
    n_words = F.when(F.length("joined") > 0, spaces(F.col("joined")) + 1).otherwise(0)
    base_pattern = "(?<![^ ])(?:" + "|".join(BASE) + ")(?![^ ])"
    places = F.when(
        F.regexp_like("joined", F.lit(base_pattern)),
        let(
            F.struct(
                F.split("joined", base_pattern, -1).alias("gaps"),
                F.regexp_extract_all("joined", F.lit(base_pattern), F.lit(0)).alias("hits"),
            ),
            lambda p: F.struct(
                F.size(p["hits"]).cast("long").alias("n"),
                spaces(p["gaps"][0]).cast("long").alias("first"),
                (
                    spaces(F.element_at(p["gaps"], -1))
                    + spaces(F.element_at(p["hits"], -1)) + 1
                ).cast("long").alias("behind"),
                F.array_sort(
                    F.array_distinct(
                        F.transform(
                            p["hits"],
                            lambda h: F.element_at(
                                F.create_map(*(F.lit(x) for kv in BASE.items() for x in kv)), h
                            ),
                        )
                    )
                ).alias("labels"),
            ),
        ),
    )
    kept = F.transform(
        resolved(detections(F.col("joined"), table)),
        lambda d: F.struct(
            d["label"].alias("label"),
            spaces(F.substring(F.col("joined"), F.lit(1), d["start"].cast("int"))).cast("long").alias("first_word"),
            (spaces(F.substring(F.col("joined"), F.lit(1), (-d["back"]).cast("int"))) + 1).cast("long").alias("stop_word"),
            d["rank"].alias("rule"), d["weight"].alias("weight"),
        ),
    )
    rows = base.select(
        "doc_id", n_words.cast("long").alias("n_words"), places.alias("p"), kept.alias("kept")
    )
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.col("p.labels"), none)
    labels = F.array_sort(F.array_union(base_labels, F.transform("kept", lambda d: d["label"])))
    score = F.greatest(
        F.when(F.col("p").isNotNull(), 1.0).otherwise(0.0),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["weight"])), F.lit(0.0)),
    )
    return rows.select(
        "doc_id", "n_words", F.coalesce("p.n", F.lit(0).cast("long")).alias("n_base"),
        F.col("p.first").alias("first_word"),
        (F.col("n_words") - F.col("p.behind")).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), score.alias("score"),
        F.transform("kept", lambda d: d.dropFields("weight")).alias("detections"),
    )
