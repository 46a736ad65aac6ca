"""The engine's operations by name, with checked arguments and plain results: what a tool server or web front end calls.

call(name, arguments) returns values that JSON can hold, or raises Failure with one
of the codes INVALID_PARAMETERS, TOOL_NOT_FOUND, NOT_FOUND and INTERNAL_ERROR. All
faults of the arguments are told at once.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from corvella.functions.names import normalise
from corvella.functions.paths import languages
from corvella.observe import timed
from corvella.plans.engine import Engine, NotFound
from corvella.sources.codetree import folders
from corvella.streaming.progress import Jobs


class Failure(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Field:
    """One argument: its type, whether it must be there, and its bounds (of a number, or of a text's length)."""

    kind: type
    required: bool = False
    least: int | None = None
    most: int | None = None
    among: tuple[str, ...] = ()
    help: str = ""

    def fault(self, value: Any) -> str | None:
        number = self.kind is int
        if number and isinstance(value, float) and value.is_integer():
            value = int(value)
        if not isinstance(value, self.kind) or (isinstance(value, bool) and self.kind is not bool):
            return f"must be {self.kind.__name__}"
        size = value if number else len(value) if self.kind is str else 0
        if self.least is not None and size < self.least:
            return f"must {'be' if number else 'have'} at least {self.least}"
        if self.most is not None and size > self.most:
            return f"must {'be' if number else 'have'} at most {self.most}"
        if self.among and value not in self.among:
            return f"must be one of {', '.join(self.among)}"
        return None

    def schema(self) -> dict:
        low, high = ("minimum", "maximum") if self.kind is int else ("minLength", "maxLength")
        limits = {low: self.least, high: self.most, "enum": list(self.among) or None, "description": self.help or None}
        return {"type": {str: "string", int: "integer", bool: "boolean"}[self.kind]} | {k: v for k, v in limits.items() if v is not None}


NAME = Field(str, True, 1, help="name of a codebase")
FILTERS = {
    "query": Field(str, True, 1, help="words that describe the code to find"),
    "codebaseName": Field(str, help="search this codebase only"),
    "language": Field(str, among=tuple(languages()), help="search this language only"),
    "excludeTests": Field(bool),
    "excludeLibraries": Field(bool),
}
OPERATIONS: dict[str, tuple[str, dict[str, Field]]] = {
    "list_codebases": ("All codebases with path, counts, last ingestion and languages", {}),
    "search_codebases": ("The chunks nearest to a query, best first", FILTERS | {"maxResults": Field(int, False, 1, 200, help="50 unless given")}),
    "search": ("As search_codebases, for up to 1000 results and any language", FILTERS | {"language": Field(str), "maxResults": Field(int, False, 1, 1000)}),
    "get_codebase_stats": ("Totals of a codebase, by language and by chunk type", {"name": NAME}),
    "list_files": ("Files of a codebase with chunks, sizes, flags and hashes", {"codebaseName": NAME}),
    "rename_codebase": ("Gives a codebase a new name", {"name": NAME, "newName": Field(str, True, 1, 255)}),
    "delete_codebase": ("Drops a codebase", {"name": NAME}),
    "delete_chunk_set": ("Deletes the chunks of one ingestion", {"name": NAME, "timestamp": Field(str, True, 1)}),
    "delete_file": ("Deletes the chunks of one file", {"name": NAME, "filePath": Field(str, True, 1)}),
    "ingest": ("Starts to read a directory tree into a codebase; the job's id", {"name": NAME, "path": Field(str, True, 1), "respectGitignore": Field(bool)}),
    "rescan": ("Starts to read again what changed; the job's id", {"name": NAME}),
    "progress": ("Where a job is", {"jobId": Field(str, True, 1)}),
    "browse_folders": ("Folders below a folder, the home folder unless given", {"path": Field(str)}),
    "open_codebase_manager": ("Address of the manager; nothing is opened here", {}),
    "health": ("Whether the engine answers", {}),
}


def tools() -> list[dict]:
    """Name, description and JSON schema of the arguments of each operation."""
    return [
        {"name": name, "description": about, "inputSchema": {"type": "object", "properties": {k: f.schema() for k, f in fields.items()}, "required": [k for k, f in fields.items() if f.required], "additionalProperties": False}}
        for name, (about, fields) in OPERATIONS.items()
    ]


def faults(fields: Mapping[str, Field], arguments: Mapping[str, Any]) -> list[str]:
    out = [f"{k} is unknown" for k in arguments if k not in fields]
    for k, f in fields.items():
        if k not in arguments:
            out += [f"{k} is missing"] * f.required
        elif why := f.fault(arguments[k]):
            out.append(f"{k} {why}")
    return out


class Service:
    def __init__(self, engine: Engine):
        self.engine, self.jobs = engine, Jobs()

    def call(self, name: str, arguments: Mapping[str, Any] | None = None) -> dict:
        arguments = arguments or {}
        if name not in OPERATIONS:
            raise Failure("TOOL_NOT_FOUND", f"there is no operation {name!r}")
        if wrong := faults(OPERATIONS[name][1], arguments):
            raise Failure("INVALID_PARAMETERS", "; ".join(wrong))
        run: Callable[..., dict] = getattr(self, f"_{name}")
        with timed(name, **arguments):
            try:
                return run(**arguments)
            except NotFound as e:
                raise Failure("NOT_FOUND", str(e)) from e
            except ValueError as e:
                raise Failure("INVALID_PARAMETERS", str(e)) from e
            except Exception as e:
                raise Failure("INTERNAL_ERROR", str(e)) from e

    @staticmethod
    def _rows(df) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def _list_codebases(self) -> dict:
        return {"codebases": self._rows(self.engine.list_codebases())}

    def _search(self, query: str, codebaseName=None, language=None, maxResults=0, excludeTests=False, excludeLibraries=False) -> dict:
        return self.engine.search(query, codebaseName, language, int(maxResults), excludeTests, excludeLibraries)

    _search_codebases = _search

    def _get_codebase_stats(self, name: str) -> dict:
        return self._rows(self.engine.stats(name))[0]

    def _list_files(self, codebaseName: str) -> dict:
        files = self._rows(self.engine.list_files(codebaseName).orderBy("filePath"))
        return {"files": files, "codebaseName": codebaseName, "totalFiles": len(files)}

    def _rename_codebase(self, name: str, newName: str) -> dict:
        return {"oldName": name, "newName": newName, "chunkCount": self.engine.rename(name, newName)}

    def _delete_codebase(self, name: str) -> dict:
        self.engine.drop(name)
        return {"name": name, "deleted": True}

    def _delete_chunk_set(self, name: str, timestamp: str) -> dict:
        return {"name": name, "timestamp": timestamp, "chunksDeleted": self.engine.delete_chunk_set(name, timestamp)}

    def _delete_file(self, name: str, filePath: str) -> dict:
        return {"name": name, "filePath": filePath, "chunksDeleted": self.engine.delete_file(name, filePath)}

    def _ingest(self, name: str, path: str, respectGitignore: bool = False) -> dict:
        """A form without the box ticked means that ignore rules don't hold; the library and the command line hold them."""
        name = normalise(name)
        if not os.path.isdir(path):
            raise ValueError(f"not a directory: {path}")
        return {"jobId": self.jobs.start(lambda tell: self.engine.ingest(path, name, respectGitignore, tell)), "codebaseName": name}

    def _rescan(self, name: str) -> dict:
        self.engine.store.info(name)
        return {"jobId": self.jobs.start(lambda tell: self.engine.rescan(name, tell=tell)), "codebaseName": name}

    def _progress(self, jobId: str) -> dict:
        try:
            return next(iter(self.jobs.events(jobId)))
        except KeyError:
            raise NotFound(f"job {jobId!r} not found") from None

    def _browse_folders(self, path: str = "") -> dict:
        return folders(path or os.path.expanduser("~"))

    def _open_codebase_manager(self) -> dict:
        server = self.engine.config["server"]
        url = f"http://{server['host']}:{server['port']}"
        return {"url": url, "message": f"The codebase manager is at {url}"}

    def _health(self) -> dict:
        return {"status": "ok", "codebases": len(self.engine.store.tables())}
