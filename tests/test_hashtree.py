"""Hash trees of manifests: the root stands for the rows, differences are those of a full comparison, equal parts aren't read."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators.merge import manifest_changes
from lodestack.plans.hashtree import NOTHING, HashTree, changes, differing, frozen
from lodestack.schema import SCHEMAS


def tree(spark, at, rows, bits=16):
    return HashTree(spark, at.as_uri(), bits).write(spark.createDataFrame(rows, SCHEMAS["manifest"]))


ROWS = [(f"folder {k % 3}/é{k}.md", k, k % 50, f"sha{k % 7}") for k in range(1500)]


def test_root_stands_for_the_rows(spark, tmp_path):
    first = tree(spark, tmp_path / "a", ROWS)
    again = list(ROWS)
    random.Random(1).shuffle(again)
    assert first.root() == tree(spark, tmp_path / "b", again).root() != NOTHING
    assert first.nodes(0).first()["rows"] == 1500 and first.rows().count() == 1500
    for other in (ROWS[1:], [*ROWS, ROWS[0]], [(*ROWS[0][:3], None), *ROWS[1:]], [(ROWS[0][0], 1, *ROWS[0][2:]), *ROWS[1:]]):
        assert tree(spark, tmp_path / "c", other).root() != first.root()  # written anew in the same folder
    none = tree(spark, tmp_path / "d", [(None, 1, 1, "a")])
    assert none.root() == NOTHING and none.rows().count() == 0
    with pytest.raises(ValueError, match="bits"):
        changes(first, HashTree(spark, "x", 8))


@pytest.mark.parametrize("bits", [8, 24])
def test_changes_are_those_of_a_full_comparison(spark, tmp_path, bits):
    new = [r for k, r in enumerate(ROWS) if k % 400] + [("new.md", 1, 1, "n")]
    new[5], new[700] = (new[5][0], -1, *new[5][2:]), (*new[700][:3], "other")
    a, b = tree(spark, tmp_path / "a", ROWS, bits), tree(spark, tmp_path / "b", new, bits)
    old = a.rows().withColumnsRenamed({"rel_path": "path", "size": "size_bytes"})
    want = sorted(map(tuple, manifest_changes(old, b.rows()).where("change <> 'same'").collect()))
    assert sorted(map(tuple, changes(a, b).collect())) == want and len(want) == 7
    assert sorted(r.change for r in changes(b, a).collect()) == ["added"] * 4 + ["changed", "gone", "touched"]
    none = tree(spark, tmp_path / "n", [], bits)
    assert changes(none, a).where("change = 'added'").count() == 1500 and changes(a, none).where("change = 'gone'").count() == 1500
    assert changes(a, a).count() == 0 and changes(none, none).count() == 0


def test_equal_parts_are_not_read(spark, tmp_path):
    """One row differs: all but its part can be deleted, on each side, and one leaf is joined."""
    a = tree(spark, tmp_path / "a", ROWS)
    b = tree(spark, tmp_path / "b", [*ROWS[:-1], (*ROWS[-1][:3], "other")])
    part = a.rows().where(F.col("rel_path") == ROWS[-1][0]).first()["part"]
    assert differing(a, b, 16).count() == 1 and a.rows().select("part").distinct().count() > 200
    found = changes(a, b)
    for file in tmp_path.glob("*/rows/part=*/*.parquet"):
        if file.parent.name != f"part={part}":
            file.unlink()
    assert [tuple(r) for r in found.collect()] == [(ROWS[-1][0], "changed")]
    assert a.rows().count() < 100  # the rest is gone


def test_frozen_corpus(spark, tmp_path):
    root = tmp_path / "c"
    for k in range(30):
        (root / f"d{k % 4}").mkdir(parents=True, exist_ok=True)
        (root / f"d{k % 4}" / f"{k}.md").write_text(f"text {k}")
    old = frozen(spark, str(root), (tmp_path / "old").as_uri(), partitionbytes="500", openbytes="50")
    (root / "d1" / "1.md").write_text("another text")
    (root / "d2" / "2.md").unlink()
    (root / "d0" / "new.md").write_text("new")
    new = frozen(spark, str(root), (tmp_path / "new").as_uri())
    got = {r.path: r.change for r in changes(old, new).collect()}
    assert got == {"d1/1.md": "changed", "d2/2.md": "gone", "d0/new.md": "added"}
    assert new.rows().agg(F.count("*")).first()[0] == 30
