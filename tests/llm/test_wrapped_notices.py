"""Notices wrapped over lines are named, at several widths, as comments and between prose."""

import textwrap

from lectern.llm import licences

GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
NOTICES = {
    "gpl": GNU.format("program", "General Public License", "3"),
    "lgpl": GNU.format("library", "Lesser General Public License", "2.1"),
    "agpl": GNU.format("program", "Affero General Public License", "3"),
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def test_wrapped_notices(spark):
    prose = "Thond erat ing blestou.\nShan by st thha."
    rows = [(family, form(textwrap.wrap(notice, width))) for family, notice in NOTICES.items() for width in (40, 72, 1000) for form in (lambda ls: f"{prose}\n" + "\n".join(ls) + f"\n{prose}", lambda ls: "/*\n" + "\n".join(f" * {x}" for x in ls) + "\n */")]
    rows.append(("gpl,mit", "\n".join(textwrap.wrap(NOTICES["gpl"], 72)) + "\n\nReleased under the MIT License.\n\n" + "\n".join(textwrap.wrap(NOTICES["gpl"], 72))))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs, licences.train(prose.split("\n") * 20)).collect()}
    assert [got[i].families for i in range(len(rows))] == [f for f, _ in rows]
    assert [got[i].n_notices for i in range(len(rows))] == [1] * (len(rows) - 1) + [3]


def test_blocks_are_not_joined(spark):
    docs = spark.createDataFrame([(1, "Licensed under the Apache\n\nLicense version 2.0"), (2, "Licensed under the Apache\nLicense version 2.0")], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.scan(docs, licences.train(["Thond erat ing blestou."] * 20)).collect()}
    assert got == {1: "", 2: "apache"}


HARD = [
    "Licensed under the Apache License, Version 2.0", "x\nLicensed under the\nGNU General Public License\nversion 2\n\ny", "He lost his driving license.", "Released under the MIT License. " + "word " * 400,
    "Licensed under the Wobble Source License.", "the-license.of/things mit", "no notice at all", "", "ü licence ß\n\n\nMIT", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted.",
]


def test_lines_without_cues_change_nothing(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    model = licences.train(["Thond erat ing blestou."] * 20)
    some, all_ = ({r.doc_id: (r.families, r.n_notices, r.n_unknown, round(r.top_score, 9)) for r in licences.scan(docs, model, only_cued=flag).collect()} for flag in (True, False))
    assert some == all_ and some[0][0] == "apache" and some[1][0] == "gpl" and some[3][0] == "mit" and some[9][0] == "bsd"
    assert some[2][0] == some[6][0] == some[7][0] == ""


def test_probabilities_match_numpy(spark):
    import numpy as np

    model = licences.train(["Thond erat ing blestou."] * 20)
    lines = [t for t in HARD if "\n" not in t and t]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), model).collect()}
    for i, line in enumerate(lines):
        z = np.array(model.bias)
        for g in licences.grams_of(line):
            z = z + np.array(model.weights.get(g, [0.0] * len(licences.CLASSES)))
        p = np.exp(z / model.temperature - (z / model.temperature).max())
        p /= p.sum()
        best = int(p.argmax())
        assert abs(got[i].top_score - (p[best] if best else 0.0)) < 1e-9, line
    assert model.reliability < 0.25 and licences.calibration_error(np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([0, 0])) == (0.1 + 0.8) / 2


def test_very_long_texts(spark):
    line = "plain words of no notice " * 20_000
    texts = [line + " Released under the MIT License.", "\n".join(["a line of prose"] * 30_000 + ["Licensed under the Apache License, Version 2.0"] + ["another line"] * 9)]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licences.train(["a line of prose with plain words"] * 20)).orderBy("doc_id").collect()
    assert [r.families for r in got] == ["mit", "apache"]
