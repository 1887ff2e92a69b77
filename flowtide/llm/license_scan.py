"""License scan by a positional index of rare tokens.

Templates are short licence notices. Their words and the places of these words
form an index. A scan first counts in how many documents each template word
stands; the words of highest inverse document frequency anchor a template. The
anchors that a file holds are looked up in the index, and each posting gives
the place where the template would start. Starts agree for words that keep
their relative places, so a start proposed by any anchor is one candidate. A
candidate counts when every word of the template's key phrases stands at its
relative place and enough of the other words do.

The index depends on the templates alone, so sending it to every task is
bounded by the caller's list; documents are never shuffled.

Defined results: null text counts as empty; words are case-blind for A-Z only;
repeated rows are scanned one by one; anchors with equal frequency are taken
in the order of the word; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCAN = "license_scan"
ANCHORS = 2
MIN_SHARE = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


@dataclass(frozen=True)
class Template:
    """``keys``: phrases of ``text`` that must stand at their place. ``phrase``: every word must, every place counts."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def needed(self) -> list[int]:
        if self.phrase:
            return list(range(len(self.words)))
        places: set[int] = set()
        for key in self.keys:
            part = key.split()
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(part)] == part)
            places |= set(range(at, at + len(part)))
        return sorted(places)


# Phrases and labels of the base scan, then public licence notices in lower-case words. Keys stand at fixed
# places, so a notice that is in use with and without some words (as a defined name in brackets) has a template for each form.
BASE = (
    Template("mit", "under the mit license", phrase=True),
    Template("apache-2", "apache license version 2", phrase=True),
    Template("cc-by-nc", "cc by nc", phrase=True),
)
NOTICES = (
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license version 3",)),
    Template("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", ("gnu lesser general public license version 2 1",)),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license version 3",)),
    Template("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license as published by", "either version 3 of the license")),
    Template("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license as published by", "either version 2 of the license")),
    Template("lgpl-3", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", ("gnu lesser general public license as published by", "either version 3 of the license")),
    Template("lgpl-2.1", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", ("gnu lesser general public license as published by", "either version 2 1 of the license")),
    Template("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license as published by", "either version 3 of the license")),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("redistribute it and or modify it", "gnu general public license")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0", "except in compliance with the license")),
    Template("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("apache license version 2 0", "except in compliance with the license")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("mpl-2", "licensed under the mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international license",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives",)),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0 universal",)),
    Template("cc0", "creative commons legal code cc0 1 0 universal", ("cc0 1 0 universal",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
TEMPLATES = BASE + NOTICES


def file_words(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case.

    lower() agrees with this on ASCII and is much faster; the Kelvin sign is
    the one other character that it turns into an ASCII word character.
    """
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.contains(text, F.lit("K")), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    trimmed = F.btrim(low, F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"))


def _texts(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def document_frequency(docs: DataFrame, text: str, templates: Sequence[Template]) -> dict[str, int]:
    """Documents that hold each template word: at most one number per distinct word of the templates."""
    known = sorted({w for t in templates for w in t.words})
    held = docs.select(F.explode(F.array_intersect(file_words(F.col(text)), _texts(known))).alias("w"))
    return dict.fromkeys(known, 0) | {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}


def anchors(templates: Sequence[Template], frequency: dict[str, int], most: int = ANCHORS) -> list[tuple[str, int, int]]:
    """Postings (word, template, place) of each template's rarest words.

    A phrase needs one: it cannot stand anywhere without its rarest word. A
    notice takes its rarest words among those its key phrases need, so that it
    cannot be missed either.
    """
    out = []
    for number, t in enumerate(templates):
        needed = t.needed
        rare = sorted({t.words[i] for i in needed}, key=lambda w: (frequency[w], w))[: 1 if t.phrase else most]
        for word in rare:
            # One place of the word is enough: the template's start is what a posting proposes.
            out.append((word, number, next(i for i in needed if t.words[i] == word)))
    return out


def scan(docs: DataFrame, text: str = "text", templates: Sequence[Template] = TEMPLATES, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` and a struct column ``license_scan``.

    n_words; matches: an array of (template, start, share) for every verified
    place, ``template`` being the place in ``templates``. An existing column of
    that name is replaced.
    """
    postings = anchors(templates, document_frequency(docs, text, templates))
    index = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(t).alias("tpl"), F.lit(q).alias("q")) for w, t, q in postings))
    rare = _texts(sorted({w for w, _, _ in postings}))
    table = F.array(
        *(F.struct(_texts(t.words).alias("words"), F.array(*(F.lit(i) for i in t.needed)).alias("needed")) for t in templates)
    )
    kept = [c for c in docs.columns if c != SCAN]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), file_words(F.col(text)).alias("_w"))
    # A candidate is one number: template, then start plus room for starts before the text.
    room = 1 << 12
    width = 1 << 40
    found = F.filter(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(rare, x["w"]))
    starts = F.array_distinct(
        F.flatten(
            F.transform(
                found,
                lambda x: F.transform(
                    F.filter(index, lambda p: p["word"] == x["w"]),
                    lambda p: p["tpl"].cast("bigint") * width + (x["i"] - p["q"] + room).cast("bigint"),
                ),
            )
        )
    )
    rows = rows.withColumn("_c", F.when(F.arrays_overlap("_w", rare), starts).otherwise(F.array().cast("array<bigint>")))

    def verified(c: Column) -> Column:
        tpl = F.floor(c / F.lit(width)).cast("int")
        start = (c.bitwiseAND(F.lit(width - 1)) - room).cast("int")
        words_of = F.get(table, tpl)["words"]
        stands = lambda j: F.coalesce(F.get("_w", start + j) == F.get(words_of, j), F.lit(False))
        needed = F.forall(F.get(table, tpl)["needed"], stands)
        share = F.when(needed, F.size(F.filter(F.sequence(F.lit(0), F.size(words_of) - 1), stands)) / F.size(words_of)).otherwise(F.lit(0.0))
        return F.struct(tpl.alias("template"), start.alias("start"), share.alias("share"))

    matches = F.filter(F.transform("_c", verified), lambda m: m["share"] >= min_share)
    out = F.struct(F.size("_w").cast("bigint").alias("n_words"), matches.alias("matches"))
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in kept), out.alias(SCAN))


def labels(matches: Column, templates: Sequence[Template] = TEMPLATES) -> Column:
    """Distinct labels of verified matches, sorted and comma-joined."""
    names = _texts([t.label for t in templates])
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: F.get(names, m["template"])))), ",")
