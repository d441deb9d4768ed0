from leafmill.llm import license_scan as lic

TEXTS = [
    None, "", "Some prose about a house.\nAnd its owner.", "Intro words here.\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "He lost his driving license on the way.", "free software", "MIT", "Released under the MIT License.\nx\nLicensed under the Apache License, Version 2.0.", "word " * 20_000 + "\nReleased under the MIT License.",
    "Use of this product requires the license number on the back of the box.", "Licensed under the EUPL, Version 1.2.", "intro of the file\n\nLicensed under the GNU Affero\nGeneral Public License, version 3.\n\nThe end",
    "MIT License\nApache License, Version 2.0", "Copyright (c) 2015 The Authors\n" + lic.NOTICES["mit"][0].replace(", ", ",\n"), "license " * 3000, "\n\n\n", "Licensed under the Foobar license",
]


def test_scan_against_definition(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, TEXTS[4], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = lic.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = lic.scan_text(TEXTS[4 if r.doc_id is None else r.doc_id])
        assert (r.license, r.n_notices) == want, r
        assert (r.license == "none") == (r.n_notices == 0) == (r.probability == 0.0)
    by = {r.doc_id: r.license for r in got}
    assert [by[i] for i in range(9)] == ["none", "none", "none", "mit", "apache", "gpl", "cc-by-nc", "cc-by", "none"]
    assert {r.licenses for r in got if r.doc_id == 11} == {"apache,mit"}
    assert [by[i] for i in (13, 14, 15, 17)] == ["none", "unknown", "agpl", "mit"]
    assert lic.scan(docs.limit(0)).count() == 0


def test_wordings():
    right = {
        "GNU General Public License v2": "gpl", "This program is licensed under the GNU General Public License.": "gpl", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl", "BSD-2-Clause": "bsd",
        "SPDX-License-Identifier: BSD-2-Clause": "bsd", "Apache-2.0": "apache", "SPDX-License-Identifier: Apache-2.0": "apache", "Released under the Unlicense.": "public-domain",
        "Published under the GNU Lesser General Public License v3.0": "lgpl", "You may copy this under the terms of the GNU Affero General Public License": "agpl", "Dual licensed: see the ISC License": "unknown",
        "The terms of the GNU treaty were made public in general.": "none", "A driving license is needed.": "none",
    }
    assert {x: lic.scan_text(x)[0] for x in right} == right
    assert lic.scan_text("The terms of the license agreement you signed with us.")[0] in ("unknown", "none")


def test_held_out_wordings():
    """Sentence frames, longer wordings and whole families that the first fit never saw."""
    report = lic.held_out_report()
    for c, (right, every, said) in report.items():
        assert right >= 0.8 * every and right >= 0.6 * said, (c, right, every, said)
    assert sum(r for r, _, _ in report.values()) >= 0.85 * sum(n for _, n, _ in report.values())
    # families that nothing was trained on are hardly ever taken for known ones
    m = lic.train()
    taken = [lic.scan_text(f.format(n), m)[0] for n in ("Fair Source License", "Sleepycat License", "QPL-1.0", "NASA Open Source Agreement") for f in lic.FRAMES[:5] + lic.HELD_FRAMES]
    assert sum(x in m.families for x in taken) <= 0.1 * len(taken)


def test_no_feature_is_no_license():
    model = lic.train()
    assert max(range(len(model.bias)), key=model.bias.__getitem__) == len(model.families) + 1
    for family, notices in lic.NOTICES.items():
        assert lic.scan_text(notices[0])[0] == family
    assert all(lic.scan_text(x)[0] == "none" for x in lic.OTHERS)


def test_lines_of_the_given_documents(spark):
    lines = {"This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "proprietary", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r.license for r in lic.scan(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        want = {lines[x] for x in (r.text or "").split("\n") if x in lines}
        assert found[r.doc_id] in want if want else found[r.doc_id] == "none", r


def test_every_line_is_scored(spark):
    """Lines without an anchor word: notices by themselves, and the middle, the beginning and the end of wrapped ones."""
    wrapped = "Redistribution and use in source and binary\nforms, with or without modification, are\npermitted provided that the following\nconditions are met:"
    texts = [
        "Some prose here.\nReleased under the EPL-2.0.", wrapped, "This program is free\nsoftware: you can redistribute it and/or\nmodify it under the terms of the\nGNU Affero General Public License\nas published by the Free Software Foundation",
        "Prose of a house.\nThis file has been placed in\nthe public domain by its author.\nMore prose.", "Released under the MIT License.\nx\nReleased under the MIT License.", "Released under the MIT License.\n \t\r\nLicensed under the Apache License, Version 2.0.",
        "Er kam mit dem Auto.\nEr ging mit dem Bus.", "\n" * 50_000 + "MIT License\nx\n" * 300, *("\n".join(n.split(", ")) for ns in lic.NOTICES.values() for n in ns), *("\n".join(n.split(" of ")) for ns in lic.NOTICES.values() for n in ns),
    ]
    got = {r.doc_id: r for r in lic.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, x in enumerate(texts):
        assert (got[i].license, got[i].n_notices) == lic.scan_text(x), x
    assert [got[i].license for i in range(7)] == ["unknown", "bsd", "agpl", "public-domain", "mit", "apache", "none"]
    assert got[1].n_notices == 1 and got[4].n_notices == 2 and got[5].licenses == "apache,mit"
