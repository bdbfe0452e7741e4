"""Every template is found, one by one, whole, altered, and in prose; and the nearest license wins."""

import random

import pytest

from lodestack.llm import licenses

TEXTS = [t for t in licenses.sheets() if t.kind == "text"]
PROSE = "the river ran on past old mills and quiet fields while people talked of weather trade music and long roads home again".split()


@pytest.mark.parametrize("template", TEXTS, ids=lambda t: t.license)
def test_whole_texts(template):
    rng = random.Random(template.license)
    words = list(template.wordings[0])
    lines = lambda w: "\n".join(" ".join(w[k : k + 11]) for k in range(0, len(w), 11))
    for share in (0.0, 0.05):
        altered = [x for w in words for x in ([] if rng.random() < share else [w, "extra"] if rng.random() < share else [w])]
        text = f"Copyright 2020 Somebody.\n\n{lines(altered)}\n\n" + "\n".join(" ".join(rng.choices(PROSE, k=12)) for _ in range(9)) + "\n" + lines(words)
        whole = [x for x in licenses.found_in(text) if x["kind"] == "text"]
        assert [x["license"] for x in whole] == [template.license] * 2
        assert len(whole[1]["missing"]) == len(whole[1]["between"]) == 0
        if not share:
            assert len(whole[0]["missing"]) == 0


def test_every_statement_and_notice_in_prose():
    """Brute force: each wording in a line of prose is found at its place."""
    rng, lost = random.Random(1), []
    for t in licenses.sheets():
        if t.kind == "text":
            continue
        for wording in t.wordings:
            before, said = " ".join(rng.choices(PROSE, k=15)), " ".join(wording)
            text = f"{before} {said} {' '.join(rng.choices(PROSE, k=15))}"
            found = [(x["license"], x["start"], x["end"]) for x in licenses.found_in(text)]
            if not any(a <= len(before) + 1 and b >= len(before) + 1 + len(said) for _, a, b in found):
                lost.append((t.license, said, found))
    assert lost == []


def test_short_notice_among_rare_words():
    """A notice of three words, in a block whose other words hardly compress, in many blocks."""
    rng = random.Random(2)
    for _ in range(200):
        other = lambda: " | ".join("".join(rng.choices("aehinorstuwy", k=rng.randrange(4, 14))) for _ in range(5))
        text = f"{other()} |\nAll rights reserved.\n{other()}"
        assert [x["license"] for x in licenses.found_in(text)] == ["Proprietary"]


def test_nearest_license_wins():
    bsd = {n: next(" ".join(t.wordings[0]) for t in TEXTS if t.license == n) for n in ("BSD-2-Clause", "BSD-3-Clause")}
    for name, text in bsd.items():
        assert [x["license"] for x in licenses.found_in(text)] == [name]
    assert [x["license"] for x in licenses.found_in("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007")] == ["GPL-3.0"]
    assert [x["license"] for x in licenses.found_in("This project is MIT licensed")] == ["MIT"]
    assert [x["license"] for x in licenses.found_in("SPDX-License-Identifier: Zlib")] == ["Zlib"]
    assert licenses.found_in("The license plate of my car, and her driving license. " * 20) == []
