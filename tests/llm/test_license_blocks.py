"""Licenses are found however their text is wrapped, and nothing is found that no block holds."""

from __future__ import annotations

import random
import textwrap

from fleetlens.llm import license_scan

from test_corpus_operators import FOLDED, low, make

NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
}


def test_wrapped_notices(spark):
    own = lambda k: " ".join(f"own{k}word{i}" for i in range(150))
    rows, want = [], {}
    for width in (12, 40, 76, 2000):
        for mark in ("", "# ", " * "):
            for label, notice in NOTICES.items():
                i = len(rows)
                body = "\n".join(mark + x for x in textwrap.wrap(notice, width))
                rows.append((i, f"{own(i)}\n{body}\n{own(i)}", "s"))
                want[i] = label
    rows.append((1000, own(1) + "\nGranted to any person.\n" + own(2) + "\nobtaining a copy of this software; documentation files", "s"))
    rows.append((1001, "Permission is hereby granted, free of Kharge, to any person obtaining a copy of this software and associated files", "s"))
    got = {r.id: r for r in license_scan.license_scan(make(spark, rows)).collect()}
    for i, label in want.items():
        assert label in got[i].labels and got[i].score >= 0.8, (i, rows[i][1])
    assert list(got[1000].labels) == [] and "mit" in got[1001].labels
    assert {i for i in want if "bsd" in got[i].labels} == {i for i, label in want.items() if label == "bsd"}


def test_blocks_equal_brute_force(spark):
    r = random.Random(3)
    templates = [(f"t{i}", " ".join(f"w{r.randrange(30)}" for _ in range(n))) for i, n in enumerate((3, 5, 7, 12, 20, 33))]
    rows = [(i, "".join(f"w{r.randrange(34)}{r.choice((' ', chr(10), ', '))}" for _ in range(r.choice((0, 4, 30, 90, 400)))), "s") for i in range(60)]
    want, best = set(), {}
    for i, text, _ in rows:
        words = FOLDED.findall(low(text))
        for label, t in templates:
            t = t.split()
            width = -(-2 * len(t) // 5) * 5
            for k in range(0, len(words), 5):
                share = len(set(t) & set(words[k : k + width])) / len(set(t))
                if share >= 0.8 - 1e-12:
                    want.add((i, label))
                    best[i] = max(best.get(i, 0), share)
    found = license_scan.license_scan(make(spark, rows), templates, {}).collect()
    assert want and {(x.id, label) for x in found for label in x.labels} == want
    assert all(abs(x.score - best.get(x.id, 0)) < 1e-9 for x in found)
