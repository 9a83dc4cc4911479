"""Column functions: identifiers, languages, globs, tokens, complexity, packages. All run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language by extension, branch words of the complexity count, generic folder names.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "c++": "cpp", "h++": "cpp", "hh": "cpp", "hxx": "cpp"}
BRANCH_WORDS = ["if", "elif", "elsif", "elseif", "for", "while", "loop", "match", "case", "switch", "catch", "except", "rescue", "finally", "&&", "||", "?"]
CALL_TAGS = {"Direct": "direct", "Virtual": "virtual", "Callback": "callback", "MacroExpansion": "macro", "Unknown": "unknown"}


def extension(path) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def language_of(path) -> Column:
    """Language by extension, else the extension itself."""
    ext = extension(path)
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(table, ext), ext)


def fingerprint(name, path, language, kind) -> Column:
    return F.left(F.sha2(F.concat_ws("::", name, path, language, kind), 256), F.lit(8))


def stable_id(language, path, kind, name) -> Column:
    """language::path::kind::name::fingerprint."""
    return F.concat_ws("::", language, path, kind, name, fingerprint(name, path, language, kind))


def parse_id(symbol_id) -> Column:
    """The five parts as a struct; null unless there are exactly five."""
    p = F.split(symbol_id, "::")
    return F.when(F.size(p) == 5, F.struct(*[p[i].alias(n) for i, n in enumerate(("language", "path", "kind", "name", "fingerprint"))]))


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob in which * stands for any characters, matched leftmost and without going back."""
    if "*" not in pattern:
        return f"^{re.escape(pattern)}$"
    head, *rest = re.split(r"\*+", pattern)
    body = "".join(f"(?>.*?{re.escape(x)})" if x else ".*" for x in rest)
    return f"(?s)^{re.escape(head)}{body}$"


def glob(column, pattern: str) -> Column:
    return F.col(column).rlike(glob_regex(pattern)) if isinstance(column, str) else column.rlike(glob_regex(pattern))


def tokens(text) -> Column:
    """Lower-case runs of letters and digits of at most 40 bytes."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: (F.octet_length(x) > 0) & (F.octet_length(x) <= 40))


def complexity(text) -> Column:
    """1 + branch words and operators, with ?? and ?. counted where they stand."""
    parts = F.split(text, r"[\s(){};,]")
    double = (F.length(text) - F.length(F.replace(text, F.lit("??"), F.lit("")))) / 2
    dotted = (F.length(text) - F.length(F.replace(text, F.lit("?."), F.lit("")))) / 2
    return (F.lit(1) + F.size(F.filter(parts, lambda x: x.isin(BRANCH_WORDS))) + double + dotted).cast("long")


def source_slice(text, line, end_line) -> Column:
    """The lines from line to end_line, or all of it when the range is no use or covers nearly everything."""
    lines = F.split(text, "\n")
    total = F.size(lines)
    span = end_line - line + 1
    whole = (line < 1) | (end_line < line) | (total <= end_line) | (total <= 20) | (span / total > 0.8)
    return F.when(whole, text).otherwise(F.array_join(F.slice(lines, F.greatest(line, F.lit(1)).cast("int"), F.greatest(span, F.lit(1)).cast("int")), "\n"))


def call_tag(call_type) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CALL_TAGS.items() for x in kv])
    return F.coalesce(F.element_at(table, call_type), F.lit("unknown"))


def package_of(path, skip: tuple[str, ...] = ("src",)) -> Column:
    """Nearest folder above the file that has not a generic name."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    kept = F.filter(folders, lambda x: (x != "") & ~x.isin(*skip) & ~x.startswith("."))
    return F.try_element_at(kept, F.lit(-1))


def java_package_of(path) -> Column:
    """Folders after the last of src, java, test, main and resources, joined by dots."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    last = F.aggregate(F.sequence(F.lit(0), F.size(folders)), F.lit(0), lambda acc, i: F.when((i > 0) & F.try_element_at(folders, F.greatest(i, F.lit(1))).isin("src", "java", "test", "main", "resources"), i).otherwise(acc))
    return F.array_join(F.slice(folders, last + 1, F.greatest(F.size(folders) - last, F.lit(0))), ".")


def confidence_label(value) -> Column:
    return F.when(value >= 0.8, "high").when(value >= 0.5, "medium").otherwise("low")
