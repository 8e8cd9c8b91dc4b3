import fnmatch
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from threadloom.operators.lookup import callers
from threadloom.operators.index import current
from threadloom.sources.scan import indexed, list_tree, scan_signature, scan_tree
from threadloom.sources.tree import Store, TreeReader, rule
from threadloom.streaming.watch import Watcher


def grow(root, *paths, text="x = 1\n"):
    for p in paths:
        at = root / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


HIDDEN = ["pkg/__init__.py", "pkg/_private.py", "web/__tests__/x.test.js", "_internal/m.py", ".cfg/y.py", "plain.py", "Makefile"]


def test_hidden_names_are_listed_and_excluded_folders_are_not_opened(spark, tmp_path):
    root = tmp_path / "a tree (1)"
    grow(root, *HIDDEN, "node_modules/lib/index.js", ".git/hooks/pre.py", "deep/target/o.rs", "deep/.venv/z.py")
    (root / "link.py").symlink_to(root / "plain.py")
    (root / "loop").symlink_to(root)
    (root / "gone.py").symlink_to(root / "nowhere.py")
    opened = spark.sparkContext.accumulator(0)
    for at in (str(root), f"file://{root}/"):
        assert paths(list_tree(spark, at)) == sorted([*HIDDEN, "link.py"])
    got = scan_tree(spark, str(root), wanted=indexed(F.col("path")), opened=opened).collect()
    assert sorted(r.path for r in got) == sorted([*(p for p in HIDDEN if p != "Makefile"), "link.py"])
    assert {(r.content, r.size) for r in got} == {("x = 1\n", 6)}
    assert opened.value == len(got)
    assert list_tree(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 5, 64])
def test_however_the_tree_is_dealt_each_file_comes_once(spark, tmp_path, parts):
    made = [f"d{i % 7}/e{i % 3}/f{i}.py" for i in range(60)] + [f"wide/w{i}/x.py" for i in range(30)] + [f"top{i}.py" for i in range(9)]
    grow(tmp_path, *made)
    assert paths(list_tree(spark, str(tmp_path), parts=parts)) == sorted(made)
    planned = TreeReader({"path": str(tmp_path), "parts": str(parts)}).partitions()
    assert len(planned) <= 3 * parts + 8  # folders, never files


IGNORED = """# comment
*.log
!keep.log
/build.py
docs/*.txt
**/cache/
a/**/z.py
tmp?/
[xy]1.py
\\#odd
trailing\\ 
secret/
"""


def test_ignore_rules_agree_with_git(spark, tmp_path):
    names = ["x.log", "keep.log", "s/keep.log", "build.py", "s/build.py", "docs/a.txt", "docs/in/a.txt", "s/docs/a.txt", "cache", "s/cache/f.py", "a/z.py", "a/b/c/z.py", "tmp1/f.py", "tmp12/f.py", "x1.py", "z1.py", "#odd", "trailing ", "secret/f.py", "n/own.py", "n/m/own.py", "n/x.log", "keep/x.log", "n/free.log"]
    root = tmp_path / "repo"
    grow(root, *names)
    (root / ".gitignore").write_text(IGNORED)
    (root / "n" / ".gitignore").write_text("own.py\n!free.log\n!m/own.py\n")
    assert sorted(p for p in paths(list_tree(spark, str(root), excluded=(".git",))) if not p.endswith("ignore")) == sorted(names)  # no working tree
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    (root / ".git" / "info" / "exclude").write_text("z1.py\n")
    want = subprocess.run(["git", "-C", str(root), "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True, text=True, check=True).stdout.split("\0")
    assert paths(list_tree(spark, str(root))) == sorted(p for p in want if p)
    below = subprocess.run(["git", "-C", str(root / "docs"), "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True, text=True, check=True).stdout.split("\0")
    assert paths(list_tree(spark, str(root / "docs"))) == sorted(p for p in below if p)
    assert len(paths(list_tree(spark, str(root), git_ignore=False))) == len(names) + 2


def test_random_patterns_match_like_names():
    rng = random.Random(3)
    for _ in range(400):
        pattern = "".join(rng.choices(["a", "b", "*", "?", "[ab]", "[!a]", "."], k=rng.randint(1, 6)))
        name = "".join(rng.choices("abc.", k=rng.randint(1, 6)))
        found = rule(pattern)
        assert bool(found and found[0].fullmatch(name)) == fnmatch.fnmatchcase(name, pattern), (pattern, name)


def test_signature_and_watcher_see_hidden_files(spark, tmp_path):
    root = tmp_path / "tree"
    grow(root, "pkg/__init__.py", text="def first():\n    pass\n")
    grow(root, "pkg/use.py", text="def use():\n    first()\n    second()\n")
    before = scan_signature(spark, str(root))
    w = Watcher(spark, str(root), f"file://{tmp_path}/index")
    assert (w.refresh(), w.refresh()) == (True, False)
    assert [r["name"] for r in callers(current(spark, w.folder), "first").collect()] == ["use"]
    grow(root, "pkg/__init__.py", text="def second():\n    pass\n")
    assert scan_signature(spark, str(root)) != before
    assert w.refresh()
    g = current(spark, w.folder)
    assert [r["name"] for r in callers(g, "second").collect()] == ["use"]
    assert callers(g, "first").count() == 0


def test_names_that_are_no_text(spark, tmp_path):
    with open(os.path.join(os.fsencode(tmp_path), b"bad\xff.py"), "wb") as f:
        f.write(b"x")
    assert paths(list_tree(spark, str(tmp_path))) == ["bad�.py"]
    assert [r.content for r in scan_tree(spark, str(tmp_path)).collect()] == [None]  # told, but not found again by that name
    assert Store(str(tmp_path)).read("none") is None
