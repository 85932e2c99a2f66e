"""Source trees: every file is listed, and ignore files count as git counts them."""

import random
import re
import subprocess

from pyspark.sql import functions as F

from sparkgate.sources import files, tree

GLOBS = [
    "*.py", "a", "/a", "a/", "b/c", "b/*", "**/c", "a/**", "a/**/c", "!a", "!*.py", "!b/c", "x?", "[ab]", "[!ab]", "x[0-9].py", "\\!a", "\\#c", "# no rule", "", "c  ", "*/a/", "/b/**", "!/b/x1.py", "*.p[xy]", "c*", "!c/", "**", "!**/", "a.b", "x1.*", "/*", "!/c", "**/a/x1.py",
]


def drawn(root, seed: int) -> None:
    rng = random.Random(seed)
    names = ["a", "b", "c", "x1", "#c", "!a", "a.b"]
    for _ in range(60):
        path = root.joinpath(*rng.choices(names, k=rng.randrange(4)))
        try:
            path.mkdir(parents=True, exist_ok=True)
            (path / rng.choice(["x1.py", "a.py", "c.px", "c", "a", "x2", "é.py"])).write_text("" if rng.random() < 0.3 else "x = 1")
            if rng.random() < 0.3:
                (path / ".gitignore").write_text("".join(rng.choice(GLOBS) + "\n" for _ in range(rng.randrange(1, 5))))
        except (FileExistsError, NotADirectoryError, IsADirectoryError):
            continue


def test_ignore_files_like_git(spark, tmp_path):
    for seed in range(12):
        root = tmp_path / f"t{seed}"
        root.mkdir()
        drawn(root, seed)
        git = lambda *x: subprocess.run(["git", "-c", "core.excludesFile=/dev/null", "-c", "core.quotePath=false", *x], cwd=root, capture_output=True, text=True, check=True).stdout  # noqa: B023, E731
        git("init", "-q")
        want = {x for x in git("ls-files", "-z", "--others", "--exclude-standard").split("\0") if x and ".gitignore" not in x}
        found = tree.all_files(spark, str(root), parts=3).select("rel", "bytes", F.col("content").cast("string").alias("text"))
        kept = tree.not_ignored(found, tree.ignore_rules(found))
        got = [r.rel for r in kept.collect() if ".gitignore" not in r.rel]
        assert set(got) == want and len(got) == len(want), seed


def test_ignore_comes_before_gitignore(spark):
    rows = [(".gitignore", "*.py\n!b.py"), ("d/.ignore", "!a.py\nb.py"), ("d/.gitignore", "a.py"), ("a.py", ""), ("b.py", ""), ("d/a.py", ""), ("d/b.py", ""), ("d/c.py", None), ("d/e.ts", "")]
    found = spark.createDataFrame(rows, "rel string, text string").withColumn("path", F.lit("clash"))
    got = {r.rel for r in tree.not_ignored(found, tree.ignore_rules(found)).collect()}
    assert got >= {"b.py", "d/a.py", "d/e.ts"} and not got & {"a.py", "d/b.py", "d/c.py"}
    assert tree.not_ignored(found.where("false"), tree.ignore_rules(found)).count() == 0
    assert tree.not_ignored(found, tree.ignore_rules(found.where("false"))).count() == len(rows)


def test_patterns_are_whole_expressions():
    for glob in GLOBS:
        re.compile(tree.glob_pattern(glob or "a"))
    assert re.fullmatch(tree.glob_pattern("a.b"), "x/a.b") and not re.fullmatch(tree.glob_pattern("a.b"), "axb")


def test_the_tree_is_listed_in_parts(spark, tmp_path):
    for k in range(40):
        folder = tmp_path / f"d{k % 7}" / f"e{k % 3}" / "f"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"m{k}.py").write_bytes(b"" if k % 5 == 0 else b"x" * k)
    (tmp_path / "top.py").write_bytes(b"y" * (files.MAX_FILE_BYTES + 1))
    for parts in (1, 4, 15, 1000):
        rows = tree.all_files(spark, str(tmp_path), parts).collect()
        assert len(rows) == 41 and {r.rel: r.bytes for r in rows}["top.py"] == files.MAX_FILE_BYTES + 1
        assert [r.content for r in rows if r.rel == "top.py"] == [None] and sum(r.bytes == 0 for r in rows) == 8
    assert tree.all_files(spark, "file://" + str(tmp_path), 4).count() == 41
