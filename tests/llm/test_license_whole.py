"""License scans find every wording of the templates, every place of it, and the license that it names."""

import pytest
from pyspark.sql import functions as F

from lodestack.llm import licenses


def test_keywords_lose_no_wording(spark):
    wordings = [w for made in licenses.templates().values() for _, w in made]
    texts = [x.join(w) for w in wordings for x in (" ", "\n", "; ")]
    assert [t for t in texts if not licenses.KEYWORD.search(t)] == []
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert docs.where(~F.col("text").rlike(f"(?i){licenses.KEYWORDS}")).count() == 0


@pytest.mark.parametrize(("text", "name"), [("Released under MIT", "MIT"), ("Distributed under MIT.", "MIT"), ("Released under the MPL 2.0", "MPL-2.0"), ("Published under\nthe MPL 2.0", "MPL-2.0")])
def test_short_statements(spark, text, name):
    whole = "Some words of prose that stand in front of it.\n" * 20 + text + "\nAnd more that come after it.\n" * 20
    docs = spark.createDataFrame([(1, whole)], "doc_id long, text string")
    assert [(r.license, whole[r.start : r.end]) for r in licenses.scan(docs).collect()] == [(name, text.rstrip("."))]


def test_every_place_of_a_statement_and_of_a_notice():
    line = "Figure. Licensed under CC BY 4.0\n"
    found = licenses.found_in(line * 300)
    assert [(x["license"], x["start"]) for x in found] == [("CC-BY-4.0", k * len(line) + 8) for k in range(300)]
    mit = licenses.NOTICES["MIT"][0]
    copies = [mit, mit.replace("furnished", "given"), mit.replace("hereby ", ""), mit.replace("charge", "any charge")]
    found = licenses.found_in("\n\nfile\n\n".join(copies * 20))
    assert [(x["license"], x["missing"], x["between"]) for x in found] == [("MIT", [], []), ("MIT", ["furnished"], ["given"]), ("MIT", ["hereby"], []), ("MIT", [], ["any"])] * 20


@pytest.mark.parametrize("name", sorted(licenses.IDENTITY))
def test_headers_name_their_license(name):
    (notice,) = licenses.NOTICES[name]
    other = notice.replace("published", "issued").replace("in compliance", "in full compliance").replace("distributed", "shipped")
    for text in (notice, other, f"{notice}\n\n{other}"):
        found = [x for x in licenses.found_in(text) if x["kind"] == "notice"]
        assert [x["license"] for x in found] == [name] * (1 + ("\n\n" in text))
    assert found[0]["missing"] == found[0]["between"] == []


def test_names_and_versions_must_be_there():
    gpl = licenses.NOTICES["GPL-3.0"][0]
    (spelt,) = licenses.found_in(gpl.replace("version 3", "version 3.0"))
    assert (spelt["license"], spelt["missing"], spelt["between"]) == ("GPL-3.0", ["3"], ["3.0"])
    assert licenses.found_in(gpl.replace("version 3", "version 7")) == []
    assert licenses.found_in(gpl.replace("GNU General", "GNU Other General")) == []
