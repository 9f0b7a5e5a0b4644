import pytest

from tidewatt.llm import license_scan


@pytest.mark.parametrize("name", license_scan.TEMPLATES)
def test_every_template_confirms_itself(name):
    block = license_scan.TEMPLATES[name].replace("<>", "2020 Some Holder")
    found = license_scan.examine(block, 0.1)
    assert found[0] == name and found[4] and found[2] == 0


def test_versions_and_wording_must_agree():
    other = license_scan.examine("This work is licensed under the GNU General Public License, version 7.", 0.1)
    assert not other[4] and "7" in other[5]
    assert not license_scan.examine("No licence is granted for any use of these words at all.", 0.1)[4]
    changed = license_scan.examine(license_scan.TEMPLATES["MIT-text"].replace("Software", "Program"), 0.1)
    assert changed[0] == "MIT-text" and changed[4] and changed[2] == changed[3] > 0 and "software > program" in changed[5]


def test_ranking_is_by_reduction():
    ranked = license_scan.reductions(license_scan.TEMPLATES["GPL-3.0-header"])
    assert ranked[0][1] == "GPL-3.0-header" and ranked == sorted(ranked, key=lambda x: (-x[0], x[1]))


def test_blocks_in_texts(frame, odd, prose):
    notice = "Released under the MIT License."
    rows = [*odd, (50, f"{prose(1, 60)}\n{notice}\n{prose(2, 60)}"), (50, f"{prose(1, 60)}\n{notice}\n{prose(2, 60)}"), (51, notice), (52, f"{notice}\n\n{notice}")]
    found = [r for r in license_scan.scan(frame(rows)).collect()]
    texts = dict((d, t) for d, t in rows)
    assert sorted((r.doc_id, r.license) for r in found if r.confirmed) == [(50, "MIT"), (50, "MIT"), (51, "MIT"), (52, "MIT"), (52, "MIT")]
    assert all(texts[r.doc_id][r.start:r.end] == notice for r in found)
    assert license_scan.scan(frame([])).collect() == []


def test_long_blocks_are_looked_at_whole():
    text = "license terms " * 3000 + license_scan.TEMPLATES["MIT-text"]
    parts = license_scan.pieces(text, 0, len(text))
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(a[1] >= b[0] for a, b in zip(parts, parts[1:]))


@pytest.mark.parametrize("notice, name", [
    ("All rights reserved.", "LicenseRef-reserved"), ("Copyright (c) 2021 Some Holder. All rights reserved.", "LicenseRef-reserved"),
    ("Licensed under the MIT License", "MIT"), ("This file is distributed under the terms of the MIT license.", "MIT"),
    ("Our code is available under the GNU General Public License, version 3.", "GPL-3.0"), ("You may use it under the Apache License 2.0.", "Apache-2.0"),
    ("Distributed under the GNU GPL v3.", "GPL-3.0"), ("// SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause")])
def test_notices_as_they_stand_in_documents(frame, prose, notice, name):
    rows = license_scan.scan(frame([(1, f"{prose(1, 60)}\n{notice}\n{prose(2, 60)}")])).collect()
    assert [(r.license, r.confirmed) for r in rows] == [(name, True)]


@pytest.mark.parametrize("notice", ["Licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under CC BY 3.0.", "The MIT has a permission form."])
def test_other_notices_stay_unconfirmed(notice):
    assert not any(r[6] for r in license_scan.examine_all(notice, 0.1))


def test_every_licence_of_a_block():
    plain = {n: license_scan.TEMPLATES[n] for n in ("MIT", "Apache-2.0", "MIT-text", "Apache-2.0-header", "LGPL-3.0", "CC-BY-SA-4.0")}
    for glue in ("\n", " "):
        text = glue.join([*plain.values(), *plain.values()])
        found = license_scan.examine_all(text, 0.1)
        assert [r[2] for r in found if r[6]] == [*plain, *plain]
        assert [text[a:b] for a, b, *_ in found] == [*plain.values(), *plain.values()]
    text = "Copyright 2020 A Holder\nReleased under the MIT License.\nAll rights reserved."
    assert sorted(r[2] for r in license_scan.examine_all(text, 0.1)) == ["LicenseRef-reserved", "MIT"]
    text = "Released under the MIT License.\nLicensed under the Some Other License, version 8.\nReleased under the BSD 2-Clause License."
    assert [(r[2], r[6]) for r in sorted(license_scan.examine_all(text, 0.1)) if r[6]] == [("MIT", True), ("BSD-2-Clause", True)]
    assert [text[a:b] for a, b, *r in license_scan.examine_all(text, 0.1) if not r[4]] == ["Licensed under the Some Other License, version 8."]


def test_many_notices_in_a_block_are_quick():
    text = "Released under the MIT License. All rights reserved. " * 3000
    assert len(license_scan.examine_all(text, 0.1)) == 6000


@pytest.mark.parametrize("name", ["MIT", "CC-BY-NC-4.0", "GPL-3.0", "ISC", "MIT-text"])
def test_notices_within_long_lines(prose, name):
    notice = license_scan.TEMPLATES[name]
    for seed in range(12):
        for n in (400, 1000, 5000):
            text = f"{prose(seed, n // 2)} {notice} {prose(seed + 90, n // 2)}"
            found = [(r[2], text[r[0]:r[1]]) for r in license_scan.examine_all(text, 0.1) if r[6]]
            assert found == [(name, notice)]
