"""Path expressions: extension, language, test and library flags."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of the supported languages and the path patterns of test and library files.
LANGUAGES = {
    ".cs": "csharp",
    ".java": "java",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".py": "python",
}
GRAMMARS = {
    "csharp": "tree-sitter-c-sharp",
    "java": "tree-sitter-java",
    "javascript": "tree-sitter-javascript",
    "typescript": "tree-sitter-typescript",
    "python": "tree-sitter-python",
}
TEST_NAMES = (
    r"\.test\.(ts|js|tsx|jsx|py|java|cs)$",
    r"\.spec\.(ts|js|tsx|jsx|py|java|cs)$",
    r"_test\.(ts|js|tsx|jsx|py|java|cs)$",
    r"_spec\.(ts|js|tsx|jsx|py|java|cs)$",
    r"test_.*\.(py|java|cs)$",
)
TEST_DIRECTORIES = ("__tests__/", "/tests?/", "/spec/", "/test/")
LIBRARY_DIRECTORIES = (
    "/node_modules/",
    "/vendor/",
    "/packages/",
    "/dist/",
    "/build/",
    "/out/",
    "/target/",
    "/bin/",
    "/obj/",
    "/.venv/",
    "/venv/",
    "/site-packages/",
)


def supported_extensions() -> list[str]:
    return list(LANGUAGES)


def languages() -> list[str]:
    """Each once, in the order of the extensions."""
    return list(dict.fromkeys(LANGUAGES.values()))


def grammar(language: str) -> str | None:
    return GRAMMARS.get(language)


def extension(path: Column) -> Column:
    """Lower-case suffix of the last path part, '' where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]*)$", 1))


def language(path: Column) -> Column:
    """Language of a path, null where it is not supported."""
    return F.create_map(*map(F.lit, chain(*LANGUAGES.items())))[extension(path)]


def is_supported(path: Column) -> Column:
    return language(path).isNotNull()


def classify(path: Column) -> Column:
    """struct(supported, language, extension)."""
    return F.struct(is_supported(path).alias("supported"), language(path).alias("language"), extension(path).alias("extension"))


def is_test(path: Column) -> Column:
    return path.rlike("(?i)" + "|".join(TEST_NAMES)) | path.rlike("|".join(TEST_DIRECTORIES))


def is_library(path: Column) -> Column:
    return path.rlike("|".join(LIBRARY_DIRECTORIES))
