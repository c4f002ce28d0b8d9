from __future__ import annotations

import math
import re
from collections import Counter

from larkspan.llm import license

FILES = [
    (1, "h/a/", "Hello\nLicensed under the Apache License, Version 2.0.\nbye"),
    (2, "h/a/b/c.txt", "nothing"),
    (3, "h/a/b/license.txt", "Released under the MIT License."),
    (4, "h/a/b/d/e", "das ist mit Absicht kein Text"),
    (5, "h/a/x", None),
    (6, "h/z", "This work is licensed under the GNU General Public License, version 3."),
    (7, "g/q", ""),
    (8, None, "Licensed under CC BY-NC 4.0."),
    (9, None, "nothing"),
    (2, "h/a/b/c.txt", "nothing"),
]


VECTORS = license.Vectors()


def cosine(text, name):
    """The cosine to a licence's nearest notice; 0 if a deciding term speaks against it."""
    vectors = VECTORS
    terms = Counter(t for t in re.findall(license._TERM, text.lower()) if t not in license.FUNCTION_WORDS)
    if name in license.RULES and not license.RULES[name].fits(set(terms)):
        return 0
    weights = {t: n * vectors.idf.get(t, vectors.unseen) for t, n in terms.items()}
    length = math.sqrt(sum(w * w for w in weights.values()))
    return max((sum(w * v.get(t, 0) for t, w in weights.items()) / length for n, v in vectors.notices if n == name), default=0) if length else 0


def test_own_and_inherited(spark):
    files = spark.createDataFrame([(*f, "x") for f in FILES], "id long, path string, text string, license string")
    got = sorted(((r.id, r.license, r.known, r.directory) for r in license.scan(files).collect()), key=str)
    assert got == sorted(
        [
            (1, "Apache-2.0", "own", None),
            (2, "MIT", "inherited", "h/a/b"),
            (2, "MIT", "inherited", "h/a/b"),
            (3, "MIT", "own", None),
            (4, "MIT", "inherited", "h/a/b"),
            (5, "Apache-2.0", "inherited", "h/a"),
            (6, "GPL-3.0", "own", None),
            (7, None, "none", None),
            (8, "CC-BY-NC-4.0", "own", None),
            (9, None, "none", None),
        ],
        key=str,
    )
    assert license.scan(files.limit(0)).count() == 0


def test_filter_loses_nothing(spark):
    notices = [n.replace("\n", " ") for group in license.TEMPLATES.values() for n in group]
    texts = [f"{n[: len(n) * k // 4]} words of other kinds {'and more ' * j}" for n in notices for k in (2, 3, 4) for j in (0, 3)]
    files = spark.createDataFrame([(i, f"r{i}/f", t) for i, t in enumerate(texts)], "id long, path string, text string")
    got = {r.id: r for r in license.own(files).collect()}
    for i, t in enumerate(texts):
        best = max((cosine(t, n), n) for n in license.TEMPLATES)
        if best[0] >= license.COSINE + 1e-6:
            assert got[i].license is not None and abs(got[i].cosine - best[0]) < 1e-5
        elif best[0] < license.COSINE - 1e-6:
            assert got[i].license is None


RELATED = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit https://creativecommons.org/licenses/by-sa/4.0/.",
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy, visit https://creativecommons.org/licenses/by/4.0/.",
    "CC-BY-ND-4.0": "Licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}


def test_licences_that_differ_in_a_word(spark):
    texts = [*((name if name in license.TEMPLATES else None, x) for name, x in RELATED.items()), *((name, f"// SPDX-License-Identifier: {tag}") for name in license.TEMPLATES for tag in (n.partition(": ")[2] for n in license.TEMPLATES[name] if n.startswith("SPDX")))]
    # of licences that are not known none is named by a relative's name
    texts += [(None, "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License."), (None, "Licensed under CC BY-SA 2.0."), (None, "Licensed under the Apache License, Version 1.1.")]
    got = {r.id: r.license for r in license.own(spark.createDataFrame([(i, f"f/{i}", t) for i, (_, t) in enumerate(texts)], "id long, path string, text string")).collect()}
    assert [(got[i], t[:60]) for i, (_, t) in enumerate(texts)] == [(name, t[:60]) for name, t in texts]


def test_licence_files_of_any_length_and_wrapped_headers(spark):
    import textwrap

    mit = license.TEMPLATES["MIT"][2]
    apache = "\n".join("# " + x for x in textwrap.wrap(license.TEMPLATES["Apache-2.0"][2], 50))
    notice = "\n".join(textwrap.wrap(license.TEMPLATES["CC-BY-NC-4.0"][1], 40))
    code = "\n".join(f"value{i} = {i}" for i in range(900))
    files = {
        1: ("r/license", "Copyright 2020 Nobody\n\n" + "\n".join(textwrap.wrap(mit, 30))),
        2: ("r/copying", "\n".join([mit] * 40)),
        3: ("s/a.py", f"{apache}\n\n{code}"),
        4: ("s/b.html", f"{code}\n\n{notice}\n\n{code}"),
        5: ("s/c.py", code),
        6: ("t/license", "\n".join(license.TEMPLATES["BSD-3-Clause"][2].split(" "))),
    }
    got = {r.id: r.license for r in license.own(spark.createDataFrame([(i, *x) for i, x in files.items()], "id long, path string, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "CC-BY-NC-4.0", 5: None, 6: "BSD-3-Clause"}


def test_main_path_has_no_python(spark):
    files = spark.createDataFrame(FILES, "id long, path string, text string")
    plan = license.scan(files)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
