"""A feature table that follows its files: add, change, delete, rebuild, compact, and a killed refresh."""

import os
import tempfile

import pytest

from mailfeat.sources import raw as S
from mailfeat.sources.manifest import FeatureTable


def _put(root, name, subject, text="hello there", at=None):
    os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
    with open(f"{root}/{name}", "wb") as f:
        f.write(f"From: x@y.org\r\nTo: a@b.org\r\nSubject: {subject}\r\n\r\n{text}\r\n".encode())
    if at:
        os.utime(f"{root}/{name}", (at, at))


@pytest.fixture
def place(spark):
    root, path = tempfile.mkdtemp(prefix="mailfeat-raw-"), tempfile.mkdtemp(prefix="mailfeat-table-") + "/t"
    for i in range(3):
        _put(root, f"007/spam/s{i}.eml", "Win?", f"text {i}", 1_700_000_000 + i)
        _put(root, f"007/ham/h[{i}] {{x}}*.eml", "Plan", f"note {i}", 1_700_000_000 + i)
    _put(root, "B/spam/b.eml", "Other", at=1_700_000_000)
    os.makedirs(f"{root}/B/ham")
    return root, FeatureTable(spark, root, path)


def _bodies(table, datasets=None):
    return {os.path.basename(r.msg_id): r.body_text.strip() for r in table.rows(datasets).collect()}


def test_only_what_changed_is_parsed(spark, place, monkeypatch):
    root, table = place
    assert table.generation() == 0 and table.rows().count() == 0
    first = table.refresh(["007", "B"])
    assert (first.gen, first.parsed, first.removed, first.kept) == (1, 7, 0, 0)
    plain = S.build_feature_table(spark, root, ["007", "B"])
    assert table.rows().columns == plain.columns and sorted(map(tuple, table.rows().collect())) == sorted(map(tuple, plain.collect()))
    assert {r.dataset for r in table.rows().collect()} == {"007", "B"}  # a name of digits stays one
    assert table.refresh(["007", "B"]).gen == 1

    read = []
    real = S._binary_files
    monkeypatch.setattr(S, "_binary_files", lambda spark, paths: read.append(paths) or real(spark, paths))
    _put(root, "007/ham/h[3] {x}*.eml", "New", "note 3")
    _put(root, "007/spam/s0.eml", "Win?", "text zero")
    os.unlink(f"{root}/007/spam/s1.eml")
    done = table.refresh(["007"])
    assert (done.gen, done.parsed, done.removed, done.kept) == (2, 2, 2, 4)
    assert len(read[-1]) == 2  # no other file was opened
    got = _bodies(table)
    assert got["s0.eml"] == "text zero" and "s1.eml" not in got and got["h[3] {x}*.eml"] == "note 3" and len(got) == 7
    by_gen = sorted(r["count"] for r in table.manifest().groupBy("gen").count().collect())
    assert by_gen == [2, 5]
    assert set(_bodies(table, ["B"])) == {"b.eml"}

    assert table.refresh(["007"], rebuild=True).parsed == 6 and _bodies(table) == got
    table.compact()
    assert _bodies(table) == got and table._gone(table.generation()).count() == 0
    assert table.refresh(["007", "B"]).parsed == 0


def test_many_files_by_their_time(spark, place, monkeypatch):
    root, table = place
    monkeypatch.setattr(S, "NAMED_FILES", 1)
    assert table.refresh(["007", "B"]).parsed == 7 and len(_bodies(table)) == 7
    _put(root, "007/ham/new.eml", "a", "one", 1_700_000_001)
    _put(root, "007/ham/newer.eml", "a", "two", 1_700_000_009)
    assert table.refresh(["007"]).parsed == 2
    got = _bodies(table)
    assert len(got) == 9 and (got["new.eml"], got["newer.eml"]) == ("one", "two")


def test_a_killed_refresh_leaves_nothing(spark, place, monkeypatch):
    root, table = place
    table.refresh(["007"])
    want = _bodies(table)
    _put(root, "007/spam/late.eml", "a", "late")
    monkeypatch.setattr(FeatureTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        table.refresh(["007"])
    monkeypatch.undo()
    assert table.generation() == 1 and _bodies(table) == want
    os.unlink(f"{root}/007/spam/late.eml")
    os.unlink(f"{root}/007/spam/s2.eml")
    done = table.refresh(["007"])  # takes the number of the killed one, whose rows must not come back
    assert (done.gen, done.parsed, done.removed) == (2, 0, 1)
    assert set(_bodies(table)) == set(want) - {"s2.eml"}


def test_empty_and_missing_folders(spark):
    root = tempfile.mkdtemp(prefix="mailfeat-raw-")
    table = FeatureTable(spark, root, tempfile.mkdtemp(prefix="mailfeat-table-") + "/t")
    with pytest.warns(UserWarning, match="no such folder"):
        assert table.refresh(["X"]).parsed == 0
    _put(root, "X/spam/a.eml", "s")
    os.makedirs(f"{root}/X/ham")
    assert table.refresh(["X"]).parsed == 1
    os.unlink(f"{root}/X/spam/a.eml")
    assert table.refresh(["X"]).removed == 1 and table.rows().count() == 0
