import re
from collections import Counter

from cases import documents, frame, lower, words
from pyspark.sql import functions as F

from flowtide.llm import license_scan, quality_rules


def plain_measures(text):
    w, t = words(text), text or ""
    grams = Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover), "n_upper": sum(c.isupper() for c in t),
    }


def test_ledger_equals_plain_rules(spark):
    rows = quality_rules.ledger(frame(spark, documents())).collect()
    assert len(rows) == len(documents()) and rows[0]["mix"] == "kept"
    for r in rows:
        m = plain_measures(r.text)
        got = r.ledger.asDict()
        bits = got.pop("fail_bits")
        assert got == m, r.text
        assert bool(bits & 1) == (m["n_words"] < 50) and bool(bits & 2) == (100 * m["n_repeat_words"] > 50 * m["n_words"])


def test_accept_keeps_columns_and_ablations_count(spark):
    docs = frame(spark, documents())
    kept = quality_rules.accept(docs)
    assert kept.columns == docs.columns and {r.ledger for r in kept.collect()} == {"kept"}
    led = quality_rules.ledger(docs)
    bits = [r.ledger.fail_bits for r in led.collect()]
    assert kept.count() == sum(b == 0 for b in bits)
    for r in quality_rules.ablations(led).collect():
        bit = quality_rules.BIT[r.rule]
        assert (r.n_failed, r.n_only_this) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits))
    assert quality_rules.accept(frame(spark, [])).count() == 0


def test_license_scan_equals_search(spark):
    rows = license_scan.scan(frame(spark, documents())).collect()
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
        expected = set()
        for n, t in enumerate(license_scan.TEMPLATES):
            for s in range(-len(t.words), len(w)):
                stands = [0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(t.words)]
                if all(stands[j] for j in t.needed) and sum(stands) / len(stands) >= license_scan.MIN_SHARE:
                    expected.add((n, s))
        assert {(m.template, m.start) for m in r.license_scan.matches} == expected and r.license_scan.n_words == len(w)
        assert r.mix == "kept"
    found = {label for r in rows for m in r.license_scan.matches for label in [license_scan.TEMPLATES[m.template].label]}
    assert {"mit", "cc-by-nc", "apache-2", "gpl-3"} <= found
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_every_key_phrase_anchors_its_template():
    frequency = Counter(w for t in license_scan.TEMPLATES for w in t.words)
    for word, number, place in license_scan.anchors(license_scan.TEMPLATES, frequency):
        t = license_scan.TEMPLATES[number]
        assert t.words[place] == word and place in t.needed


FSF = """This {0} is free software: you can redistribute it and/or modify
it under the terms of the GNU {1} Public License as published by
the Free Software Foundation, either version {2} of the License, or
(at your option) any later version."""
UNMODIFIED = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software"""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at"""),
    ("gpl-3", FSF.format("program", "General", "3")), ("gpl-2", FSF.format("program", "General", "2")), ("gpl", FSF.format("program", "General", "2")),
    ("lgpl-3", FSF.format("library", "Lesser General", "3")), ("lgpl-2.1", FSF.format("library", "Lesser General", "2.1")),
    ("agpl-3", FSF.format("program", "Affero General", "3")),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above"""),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this"""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc0", "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "Copyright (c) 2020 Someone. All rights reserved."),
]


def test_unmodified_notices_of_every_label(spark):
    assert {label for label, _ in UNMODIFIED} == {t.label for t in license_scan.TEMPLATES}
    docs = spark.createDataFrame([(n, f"/* {text}\n*/") for n, (_, text) in enumerate(UNMODIFIED)], "doc_id long, text string")
    notices = {n for n, t in enumerate(license_scan.TEMPLATES) if not t.phrase}
    for r in license_scan.scan(docs).collect():
        found = {license_scan.TEMPLATES[m.template].label for m in r.license_scan.matches if m.template in notices}
        label = UNMODIFIED[r.doc_id][0]
        assert label in found and found <= {label, "gpl", "gpl-2"} and ("gpl" not in found or label in ("gpl", "gpl-2", "gpl-3")), (label, found)
