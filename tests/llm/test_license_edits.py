"""The license scan against brute force: random edits within and beyond the limits, every statement of a table, few templates a block."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestack.llm import licenses

SF = "/root/testdata/sf0.01"
PROSE = "the river ran on past old mills and quiet fields while people talked of weather trade music and long roads home again".split()
LONG = [t for t in licenses.sheets() if t.kind != "statement"]


def edited(rng, wording, missing, between, keep=()):
    """So many words left out, and so many strange ones put between, at random places; those in keep stay, and so do both ends."""
    n = len(wording)
    inner = [k for k in range(1, n - 1) if k not in keep]
    out = set(rng.sample(inner, min(len(inner), missing)))
    after = [rng.randrange(1, n - 1) for _ in range(between)] if n > 2 else []
    made = []
    for k, w in enumerate(wording):
        made += [] if k in out else [w]
        if k + 1 not in keep or k not in keep:
            made += ["quux"] * after.count(k)
    return made


@pytest.mark.parametrize("template", LONG, ids=lambda t: f"{t.license}-{t.kind}")
def test_random_edits(template):
    """Within the limits a template is found, and its differences add up; with three times as many words missing it isn't."""
    rng, wording = random.Random(template.license), template.wordings[0]
    n = len(wording)
    keep = {k for a, b in licenses.identity(template.license, wording) for k in range(a, b)} if template.kind == "notice" else set()
    before, behind = (" ".join(rng.choices(PROSE, k=40)) for _ in range(2))
    for part in (1, 0.5, 0.2):
        missing, between = int(licenses.MISSING * n * part), int(licenses.BETWEEN * n * part * (1 if template.kind == "notice" else 0.3))
        text = f"{before}\n{' '.join(edited(rng, wording, missing, between, keep))}\n{behind}"
        assert licenses.KEYWORD.search(text) or len(re.findall(licenses.LEGAL, text.lower())) >= licenses.legal_left()[1]
        found = [x for x in licenses.found_in(text) if (x["license"], x["kind"]) == (template.license, template.kind)]
        assert len(found) == 1
        assert found[0]["start"] <= len(before) + 1 + len(wording[0])
        unlike = len(found[0]["missing"]) + len(found[0]["between"])
        assert len(licenses.worded(text[found[0]["start"] : found[0]["end"]])[0]) == n - len(found[0]["missing"]) + len(found[0]["between"])
        # A notice's differences are the fewest; a whole text's, aligned between anchors, a few more at most.
        assert unlike <= (missing + between if template.kind == "notice" else 1.1 * (missing + between) + 4)
    if n > 20:
        far = f"{before}\n{' '.join(edited(rng, wording, int(3 * licenses.MISSING * n), 0))}\n{behind}"
        assert [x for x in licenses.found_in(far) if (x["license"], x["kind"]) == (template.license, template.kind)] == []


def test_legal_words_are_left():
    """Of each notice and whole text some parts of LEGAL are left whatever is missing; notices that must be whole hold a keyword."""
    assert licenses.legal_left()[0] >= 1
    assert licenses.legal_left()[1] >= 4
    for t in LONG:
        if not int(licenses.MISSING * len(t.wordings[0])):
            assert licenses.KEYWORD.search(" ".join(t.wordings[0]))


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("This project is MIT-licensed.", "MIT"),
        ("License: MIT", "MIT"),
        ("MIT License\n\nCopyright (c) 2020 Some Body", "MIT"),
        ("GPL-3.0-or-later", "GPL-3.0"),
        ("Licensed under the GNU AGPL v3", "AGPL-3.0"),
        ("This software is licensed under Apache 2", "Apache-2.0"),
        ("licensed under CC BY-SA", "CC-BY-SA"),
        ("Released under the BSD license.", "BSD"),
    ],
)
def test_usual_sentences(text, name):
    assert [x["license"] for x in licenses.found_in(f"Read me first.\n{text}\nThanks to all.")] == [name]
    assert licenses.KEYWORD.search(text)


def test_unlicense_notice_without_any_one_word():
    words = licenses.NOTICES["Unlicense"][0].split()
    for k in range(len(words)):
        assert [x["license"] for x in licenses.found_in(" ".join(words[:k] + words[k + 1 :]))] == ["Unlicense"]


def naive(text):
    """Every statement word by word, the longest first, none twice in one place: no pairs, blocks or compressor."""
    words, _ = licenses.worded(text)
    every = {w: t.license for t in licenses.sheets() if t.kind == "statement" for w in t.wordings}
    most, made, taken = max(map(len, every)), [], set()
    for n in range(most, 0, -1):
        for a in range(len(words) - n + 1):
            w = tuple(words[a : a + n])
            if w in every and not taken & set(range(a, a + n)):
                taken |= set(range(a, a + n))
                made.append((a, every[w]))
    return [name for _, name in sorted(made)]


def test_statements_side_by_side():
    """Random statements with little or nothing between them, against the naive search."""
    rng = random.Random(3)
    every = [" ".join(w) for t in licenses.sheets() if t.kind == "statement" for w in t.wordings]
    for _ in range(150):
        text = " ".join(f"{rng.choice(every)} {' '.join(rng.choices(PROSE, k=rng.randrange(4)))}" for _ in range(rng.randrange(1, 12)))
        stated = sorted((place[0], licenses.sheets()[k].license) for k, place in licenses.confirmed(licenses.worded(text)[0]) if licenses.sheets()[k].kind == "statement")
        assert [name for _, name in stated] == naive(text), text


def test_prefilter(spark):
    """No statement, and no notice or text without its rarest legal words, is left out; prose is."""
    texts = [x.join(w).upper() for t in licenses.sheets() if t.kind == "statement" for w in t.wordings for x in (" ", "\n")]
    for t in LONG:
        words, allowed = list(t.wordings[0]), int(licenses.MISSING * len(t.wordings[0]))
        held = lambda w: next((x for x in licenses.PARTS if x in w), None)
        times = {x: sum(held(w) == x for w in words) for x in licenses.PARTS}
        for k in sorted((k for k, w in enumerate(words) if held(w)), key=lambda k: (times[held(words[k])], held(words[k])))[:allowed]:
            words[k] = None
        texts.append(" ".join(w for w in words if w))
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.text for r in docs.where(~licenses.likely(F.col("text"))).collect()] == []
    prose = spark.createDataFrame([(" ".join(PROSE),), ("",), (None,)], "text string")
    assert prose.where(licenses.likely(F.col("text"))).count() == 0


def test_whole_table(spark):
    """All documents: those that the keywords leave out hold nothing, and statements are those of the naive search."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.license, r.kind))
    for r in docs.select("doc_id", "text").collect():
        mine = sorted(got.get(r.doc_id, []))
        assert mine == [(x["start"], x["license"], x["kind"]) for x in licenses.found_in(r.text or "")]
        assert [name for _, name, kind in mine if kind == "statement"] == naive(r.text or "")


def test_few_templates_pass_a_block(monkeypatch):
    """Of 82 templates a handful is compared word by word."""
    passed, kept = [], licenses.ranked
    monkeypatch.setattr(licenses, "ranked", lambda block, of: passed.append(len(got := kept(block, of))) or got)
    for text in ("This module is released under the MIT license. See the readme for more.", "please ask for permission before entering the garden of roses", "SPDX-License-Identifier: Zlib"):
        licenses.found_in(text)
    assert max(passed) <= 2
    for t in LONG:
        licenses.found_in(" ".join(t.wordings[0]))
    assert sum(passed) / len(passed) < 6
