"""Files, history and roots of a real temporary repository."""

import os
import subprocess

import pytest

from lodestone.operators import history
from lodestone.sources import files as sources
from lodestone.sources import repository


def _git(where, *args):
    env = os.environ | {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "a@example.com", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "a@example.com", "GIT_CONFIG_GLOBAL": "/dev/null"}
    return subprocess.run(["git", "-C", str(where), *args], check=True, capture_output=True, env=env).stdout.decode().strip()


def _put(root, **bodies):
    for path, body in bodies.items():
        where = root / path.replace("__", "/")
        where.parent.mkdir(parents=True, exist_ok=True)
        where.write_bytes(body if isinstance(body, bytes) else body.encode())


@pytest.fixture(scope="module")
def repo(tmp_path_factory, spark):
    repository.register(spark)
    root = tmp_path_factory.mktemp("repo")
    _git(root, "init", "-q", "-b", "main")
    for path, body in {"a.txt": "1", "src/lib.rs": "fn a() {}", "docs/é.md": "x"}.items():
        _put(root, **{path: body})
    _git(root, "add", "-A"), _git(root, "commit", "-qm", "first")
    for k in range(5):
        _put(root, **{"a.txt": f"v{k}", f"src/f{k}.rs": "x"})
        _git(root, "add", "-A"), _git(root, "commit", "-qm", f"step {k}")
    _git(root, "checkout", "-qb", "side", "HEAD~2")
    _put(root, **{"side.txt": "s"})
    _git(root, "add", "-A"), _git(root, "commit", "-qm", "on the side")
    _git(root, "checkout", "-q", "main"), _git(root, "merge", "-q", "--no-ff", "-m", "merge", "side")
    return root


def test_history_follows_first_parents_in_ranges(spark, repo):
    read = lambda **o: spark.read.format("repository_history").options(path=str(repo), **o).load()
    rows = sorted(read(range=3).collect(), key=lambda r: r.place)
    assert [r.summary for r in rows] == ["merge", "step 4", "step 3", "step 2", "step 1", "step 0", "first"] and [r.place for r in rows] == list(range(7))
    assert rows[0].parent_count == 2 and rows[0].changed_paths == ["side.txt"] and rows[-1].parent_count == 0 and set(rows[-1].changed_paths) == {"a.txt", "src/lib.rs", "docs/é.md"}
    assert set(rows[1].changed_paths) == {"a.txt", "src/f4.rs"} and {r.author_name for r in rows} == {"Ann"}
    assert [r.revision for r in rows] == _git(repo, "rev-list", "--first-parent", "HEAD").split()
    assert read(range=3).rdd.getNumPartitions() == 3
    assert sorted(r.summary for r in read(depth=2).collect()) == ["merge", "step 4"]
    commits = read().selectExpr("revision", "timestamp_seconds(committed_at_unix) AS ts")
    assert {r.path: r.touches for r in history.hotspots(commits, sources.exploded_changes(read())).collect()}["a.txt"] == 6


def test_history_of_no_commits_and_of_no_repository(spark, repo, tmp_path):
    _git(tmp_path, "init", "-q")
    assert spark.read.format("repository_history").option("path", str(tmp_path)).load().collect() == []
    with pytest.raises(Exception, match="git"):
        spark.read.format("repository_history").option("path", str(tmp_path / "none")).load().collect()


def test_nested_ignore_files_and_links(spark, repo, tmp_path):
    root = tmp_path / "tree"
    bodies = {
        ".gitignore": "*.log\n/build/\n!keep.log\ntmp\n# note\ndocs/*.draft\n", "a.log": "x", "keep.log": "x", "build/x.rs": "x", "src/build/y.rs": "x", "src/.gitignore": "!a.log\n*.gen\n/only_here\n", "src/a.log": "x", "src/b.log": "x",
        "src/deep/z.gen": "x", "src/deep/a.log": "x", "src/only_here": "x", "src/deep/only_here": "x", "tmp/.gitignore": "!*\n", "tmp/gone.rs": "x", "docs/n.draft": "x", "docs/m/n.draft": "x", "docs/secret.env": "s", "docs/big.txt": "y" * 2000, ".ignore": "private\n", "src/private/p.rs": "x",
    }
    _put(root, **bodies)
    _put(tmp_path, **{"outside/o.rs": "x"})
    os.symlink(tmp_path / "outside", root / "src" / "out"), os.symlink(root / "docs", root / "src" / "linked"), os.symlink(root / "src", root / "src" / "circle"), os.symlink(tmp_path / "nowhere", root / "broken")
    rows = spark.read.format("repository_files").options(path=str(root), redact="**/*.env", max_size=1000).load().collect()
    got = {r.path: r for r in rows}
    want = {".gitignore", "keep.log", "src/build/y.rs", "src/.gitignore", "src/a.log", "src/deep/a.log", "src/deep/only_here", "docs/m/n.draft", "docs/big.txt", ".ignore", "src/linked/big.txt", "src/linked/n.draft", "src/linked/m/n.draft"}
    assert set(got) == want and len(rows) == len(want)
    assert got["docs/big.txt"].content is None and got["docs/big.txt"].size_bytes == 2000 and bytes(got["keep.log"].content) == b"x"


def test_ignore_rules_agree_with_git(repo):
    lines = ["*.o", "!main.o", "/top", "a/b", "dir/", "**/deep", "x/**/y", "[ab].c", "sp?ce", "\\#hash", "trail  "]
    paths = ["k.o", "main.o", "top", "s/top", "a/b", "s/a/b", "dir/f", "s/dir/f", "q/deep", "deep", "x/y", "x/1/2/y", "a.c", "c.c", "space", "sp/ce", "#hash", "trail"]
    (repo / ".git" / "info" / "exclude").write_text("\n".join(lines) + "\n")
    rules = repository.ignore_rules(lines)
    for p in paths:
        parts = p.split("/")
        ours = any(repository.is_ignored("/".join(parts[: i + 1]), i + 1 < len(parts), rules) for i in range(len(parts)))
        told = subprocess.run(["git", "-C", str(repo), "check-ignore", "-q", "--no-index", p], check=False).returncode == 0
        assert ours == told, p
    (repo / ".git" / "info" / "exclude").write_text("")


def test_roots(spark, repo, tmp_path):
    _git(repo, "worktree", "add", "-q", str(tmp_path / "wt"), "side")
    got = {(r.root_id, r.kind) for r in spark.read.format("repository_roots").option("path", str(repo)).load().collect()}
    assert got == {("primary", "primary"), ("worktree:wt", "worktree"), ("branch:side", "branch")}
    _git(repo, "worktree", "remove", "--force", str(tmp_path / "wt"))
