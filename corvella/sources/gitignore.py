"""Ignore rules of a root .gitignore: comments, negation, anchors, `dir/`, `*`, `?`, `[...]`, `**`."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pattern(rule: str) -> str:
    out, i = "", 0
    while i < len(rule):
        c = rule[i]
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            out, i = out + "/.*", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := rule.find("]", i + 2)) > 0:
            out, i = out + "[" + ("^" if rule[i + 1] == "!" else "") + rule[i + 1 + (rule[i + 1] == "!") : end].replace("\\", r"\\") + "]", end + 1
        else:
            c = rule[i + 1] if c == "\\" and i + 1 < len(rule) else c
            out, i = out + re.escape(c), i + 1 + (rule[i] == "\\")
    return out


class Ignore:
    """ignored(path, is_dir): the last rule that fits decides. A path below an ignored folder is ignored."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool]] = []
        for line in text.splitlines():
            line = line.rstrip() if not line.rstrip().endswith("\\") else line
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            rule = line[keep:].removeprefix("\\") if line[keep:].startswith(("\\#", "\\!")) else line[keep:]
            folder = rule.endswith("/")
            rule = rule.rstrip("/")
            anchored = "/" in rule
            head = "^" if anchored else "^(?:.*/)?"
            self.rules.append((re.compile(head + _pattern(rule.lstrip("/")) + ("/" if folder else "(?:/|$)")), keep))

    def ignored(self, path: str, is_dir: bool = False) -> bool:
        out = False
        for rule, keep in self.rules:
            if rule.search(path):
                out = not keep
        return out

    def matches(self, path: Column) -> Column:
        """Whether a walk leaves a file out: it, or a folder on its way, is ignored."""

        def one(p: Column) -> Column:
            out = F.lit(False)
            for rule, keep in self.rules:
                out = F.when(p.rlike(rule.pattern), not keep).otherwise(out)
            return out

        parts = F.split(path, "/")
        above = F.filter(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i), "/")), lambda p: p != "")
        return one(path) | F.exists(above, one)
