"""Operations by name: checked arguments, error codes, jobs; and the smaller tools around the engine."""

import logging
import time

import pytest

from corvella import config
from corvella.functions import paths
from corvella.observe import redacted, timed
from corvella.operators import catalog
from corvella.plans.engine import Engine
from corvella.plans.service import OPERATIONS, Failure, Service, faults, tools
from corvella.sources.codetree import scan


def code_of(service, name, arguments):
    with pytest.raises(Failure) as e:
        service.call(name, arguments)
    return e.value.code


def finished(service, job):
    for _ in range(600):
        state = service.call("progress", {"jobId": job})
        if state["status"] != "running":
            return state
        time.sleep(0.1)
    raise TimeoutError


def test_a_codebase_by_its_operations(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("def one():\n    return 1\n")
    (tree / "b.js").write_text("function two() {\n  return 2;\n}\n")
    (tree / "skip.py").write_text("def three():\n    return 3\n")
    (tree / ".gitignore").write_text("skip.py\n")
    s = Service(Engine(spark, str(tmp_path / "store")))
    assert s.call("health") == {"status": "ok", "codebases": 0} and s.call("list_codebases") == {"codebases": []}
    state = finished(s, s.call("ingest", {"name": "My Code", "path": str(tree), "respectGitignore": True})["jobId"])
    assert (state["status"], state["phase"], state["current"], state["result"]["chunkCount"]) == ("completed", "Complete", 2, 2)
    assert s.call("list_codebases")["codebases"][0]["name"] == "my-code"
    assert s.call("get_codebase_stats", {"name": "my-code"})["languages"] == [{"language": "javascript", "fileCount": 1, "chunkCount": 1}, {"language": "python", "fileCount": 1, "chunkCount": 1}]
    found = s.call("search_codebases", {"query": "two", "language": "javascript", "maxResults": 5.0})
    assert [r["filePath"] for r in found["results"]] == ["b.js"]
    files = s.call("list_files", {"codebaseName": "my-code"})
    assert files["totalFiles"] == 2 and [f["filePath"] for f in files["files"]] == ["a.py", "b.js"]
    (tree / "c.py").write_text("def four():\n    return 4\n")
    assert finished(s, s.call("rescan", {"name": "my-code"})["jobId"])["result"]["filesAdded"] == 1
    assert s.call("delete_file", {"name": "my-code", "filePath": "c.py"})["chunksDeleted"] == 1
    assert s.call("delete_chunk_set", {"name": "my-code", "timestamp": "2000-01-01T00:00:00.000Z"})["chunksDeleted"] == 0
    assert s.call("rename_codebase", {"name": "my-code", "newName": "other"})["chunkCount"] == 2
    assert code_of(s, "get_codebase_stats", {"name": "my-code"}) == "NOT_FOUND"
    assert code_of(s, "delete_file", {"name": "other", "filePath": "../x"}) == "INVALID_PARAMETERS"
    assert code_of(s, "ingest", {"name": "x", "path": str(tree / "a.py")}) == "INVALID_PARAMETERS"
    assert code_of(s, "ingest", {"name": "!!", "path": str(tree)}) == "INVALID_PARAMETERS"
    assert code_of(s, "progress", {"jobId": "none"}) == "NOT_FOUND"
    assert s.call("delete_codebase", {"name": "other"})["deleted"] and code_of(s, "delete_codebase", {"name": "other"}) == "NOT_FOUND"
    s.engine.list_codebases = lambda: 1 / 0
    assert code_of(s, "list_codebases", {}) == "INTERNAL_ERROR" and code_of(s, "no_such", {}) == "TOOL_NOT_FOUND"
    assert s.call("open_codebase_manager")["url"] == "http://localhost:8008"


def test_arguments_are_checked():
    fields = OPERATIONS["search_codebases"][1]
    assert faults(fields, {"query": "x", "maxResults": 200}) == []
    for bad in ({}, {"query": ""}, {"query": 3}, {"query": "x", "maxResults": 0}, {"query": "x", "maxResults": 201}, {"query": "x", "maxResults": 1.5}, {"query": "x", "maxResults": True}, {"query": "x", "language": "cobol"}, {"query": "x", "more": 1}, {"query": None}):
        assert len(faults(fields, bad)) == 1, bad
    assert len(faults(fields, {"maxResults": 0, "more": 1})) == 3
    assert faults(OPERATIONS["search"][1], {"query": "x", "maxResults": 1000}) == []
    assert faults(OPERATIONS["rename_codebase"][1], {"name": "a", "newName": "b" * 256})
    listed = {t["name"]: t["inputSchema"] for t in tools()}
    assert set(listed) == set(OPERATIONS) and all(hasattr(Service, f"_{n}") for n in listed)
    assert listed["search_codebases"]["required"] == ["query"] and listed["search_codebases"]["properties"]["maxResults"]["maximum"] == 200


def test_folders_and_groups(spark, tmp_path):
    for n in ("beta", "Alpha", ".hidden", "gamma"):
        (tmp_path / n).mkdir()
    for n in ("x.py", "y.ts", "z.md", "Makefile", "beta/w.py"):
        (tmp_path / n).write_text("a\n")
    from corvella.sources.codetree import folders

    got = folders(str(tmp_path))
    assert [d["name"] for d in got["directories"]] == ["Alpha", "beta", "gamma"] and got["parentPath"] == str(tmp_path.parent)
    assert folders("/")["parentPath"] is None
    files = scan(spark, str(tmp_path))
    assert [tuple(r) for r in catalog.unsupported_files(files).collect()] == [("(no extension)", "Makefile"), (".md", "z.md")]
    assert [tuple(r) for r in catalog.files_by_language(files).collect()] == [("python", "beta/w.py"), ("python", "x.py"), ("typescript", "y.ts")]
    assert paths.languages() == ["csharp", "java", "javascript", "typescript", "python"] and len(paths.supported_extensions()) == 7
    assert paths.grammar("python") == "tree-sitter-python" and paths.grammar("cobol") is None


def test_default_file(tmp_path, monkeypatch):
    p = tmp_path / "config.json"
    monkeypatch.setattr(config, "DEFAULT_FILE", str(p))
    p.write_text('{"search": {"defaultMaxResults": 7}}')
    assert config.load(env={})["search"] == {"defaultMaxResults": 7, "cacheTimeoutSeconds": 60}
    for broken in ("{", "[]", '{"search": {"defaultMaxResults": -1}}', '{"x": 1}'):
        p.write_text(broken)
        assert config.load(env={})["search"]["defaultMaxResults"] == 50


def test_slow_operations_and_secrets(caplog):
    assert redacted({"a": 1, "token": "x", "b": {"password": "y", "c": 2}}) == {"a": 1, "token": "[Redacted]", "b": {"password": "[Redacted]", "c": 2}}
    with caplog.at_level(logging.DEBUG, "corvella"):
        with timed("quick") as t:
            pass
        assert t["durationMs"] < 500 and caplog.records[-1].levelno == logging.DEBUG
        with timed("long", token="abc"):
            time.sleep(0.55)
        assert caplog.records[-1].levelno == logging.WARNING and "abc" not in caplog.text
