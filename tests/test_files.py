"""Files of any filesystem, hidden ones too."""

import pytest

from quarry.errors import ScanError
from quarry.operators.scan import local_scan
from quarry.rules import PROSE_RULES
from quarry.sources.files import hidden_entries, read_bytes, read_files

NAMES = ["a.txt", "sub/b c%.txt", "sub/.env", ".git/config", ".git/objects/x", ".git/_more/y", ".git/_more/deep/z", "_dir/w", "_dir/.v/u", "_s=1/t", "sub/[1]*?.txt", "_metadata", "up._COPYING_"]


@pytest.fixture()
def tree(tmp_path):
    top = tmp_path / "t[o]p {x}"
    for i, name in enumerate(NAMES):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(b"\xff%d\r\nx\ry" % i)
    (top / "hollow").mkdir()
    (top / "hollow" / "nothing").write_bytes(b"")
    return top


def test_all_files_below_a_folder(spark, tree):
    got = {r["path"]: r["text"] for r in read_files(spark, str(tree)).collect()}
    assert got == {str(tree / n): f"{i}\nx\ny" for i, n in enumerate(NAMES)}
    assert read_files(spark, str(tree)).count() == len(NAMES)


def test_a_uri(spark, tree):
    got = {r["path"] for r in read_bytes(spark, f"file://{tree}").collect()}
    assert {p.removeprefix("file:").lstrip("/") for p in got} == {str(tree / n).lstrip("/") for n in NAMES} and all(p.startswith("file:/") for p in got)


@pytest.mark.parametrize("name", ["a.txt", "sub/.env", "sub/[1]*?.txt", ".git/_more/deep/z"])
def test_one_file(spark, tree, name):
    assert [tuple(r) for r in read_files(spark, str(tree / name)).collect()] == [(str(tree / name), f"{NAMES.index(name)}\nx\ny")]


def test_hidden_entries(spark, tree):
    folders, files = hidden_entries(spark, str(tree))
    short = lambda paths: sorted(p.split("{x}/")[1] for p in paths)
    assert short(folders) == [".git", ".git/_more", "_dir", "_dir/.v"] and short(files) == ["_metadata", "sub/.env", "up._COPYING_"]


def test_nothing_there(spark, tree):
    with pytest.raises(ScanError):
        read_files(spark, str(tree / "none"))
    assert read_files(spark, str(tree / "hollow")).collect() == []


def test_scan_by_uri(spark, tree):
    (tree / "sub" / ".env").write_text("write to a@b.net")
    assert [(r["type"], r["data"]) for r in local_scan(spark, f"file://{tree}", PROSE_RULES).collect()] == [("Bare Email", "a@b.net")]
