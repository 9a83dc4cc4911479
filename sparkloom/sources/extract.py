"""Symbols, calls and imports from source text, eight languages, one pass of Arrow batches over files.

A scanner blanks comments and literals (keeping positions), then declaration, call and import patterns of the language run over
what is left; a declaration ends at the brace that closes it, and the comment right above it is its doc comment. Source is only read, never executed; a file that cannot be
handled gives one `failed` row. Output, one table tagged by `record`:
record, file_path, language, name, kind, line, col, end_line, signature, doc_comment, parent, is_exported, modifiers, complexity, ord
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.columns import BRANCH_WORDS, LANGUAGES
from sparkloom.scratch import workers_find_us

_WORDS = frozenset("if for while switch match return sizeof catch function fn new typeof await else do try loop in of using lock foreach when throw synchronized super this constructor defined alignof static_cast fun val var object".split())
_SKIP = {"rust": r"//[^\n]*|/\*.*?\*/|r#*\".*?\"#*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", "js": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", "c": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'"}
_RUST = [("Function", r"(?P<mod>pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+|extern\s+)*fn\s+(?P<name>\w+)"), ("Struct", r"(?P<mod>pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"), ("Trait", r"(?P<mod>pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)"), ("Enum", r"(?P<mod>pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"), ("TypeAlias", r"(?P<mod>pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)"), ("Module", r"(?P<mod>pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)"), ("Macro", r"macro_rules!\s*(?P<name>\w+)"), ("Variable", r"\blet\s+(?:mut\s+)?(?P<name>\w+)")]
_JS = [("Class", r"(?P<mod>export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)(?:<[^>{]*>)?(?:\s+extends\s+(?P<ext>[\w$.]+))?(?:\s+implements\s+(?P<impl>[\w$.,\s]+))?"), ("Interface", r"(?P<mod>export\s+)?interface\s+(?P<name>[\w$]+)(?:\s+extends\s+(?P<ext>[\w$.,\s]+))?"), ("Enum", r"(?P<mod>export\s+)?(?:const\s+)?enum\s+(?P<name>[\w$]+)"), ("TypeAlias", r"(?P<mod>export\s+)?type\s+(?P<name>[\w$]+)\s*(?:<[^>]*>)?\s*="), ("Function", r"(?P<mod>export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)"), ("Function", r"(?P<mod>export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=\n]+)?=>"), ("Function", r"(?:const|let|var)\s+(?P<name>[\w$]+)\s*=\s*(?:async\s+)?function"), ("Method", r"(?m)^[ \t]+(?P<mod>(?:public\s+|private\s+|protected\s+|static\s+|async\s+|readonly\s+|get\s+|set\s+)*)(?P<name>[\w$]+)\s*(?:<[^>\n]*>)?\([^()\n]*\)\s*(?::\s*[^{;\n]+)?\{"), ("Variable", r"(?P<mod>export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)")]
_MODS = r"(?P<mod>(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|virtual|override|async|synchronized|readonly|default|native|extern)\s+)*)"
_JAVA = [("Class", _MODS + r"(?:class|record)\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<ext>[\w.]+)(?:<[^{]*?>)?)?(?:\s+implements\s+(?P<impl>[\w.,\s<>]+))?"), ("Interface", _MODS + r"@?interface\s+(?P<name>\w+)(?:\s+extends\s+(?P<ext>[\w.,\s]+))?"), ("Enum", _MODS + r"enum\s+(?P<name>\w+)"), ("Method", r"(?m)^[ \t]*" + _MODS + r"(?:<[^>]+>\s+)?(?:[\w.\[\]<>,?]+\s+)?(?P<name>\w+)\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?\{"), ("Field", r"(?m)^[ \t]+" + _MODS + r"[\w.<>\[\],]+\s+(?P<name>\w+)\s*(?:=[^;]*)?;")]
_CS = [("Class", _MODS + r"(?:class|record)\s+(?P<name>\w+)(?:<[^{]*?>)?(?:\s*:\s*(?P<ext>[\w.,\s<>]+))?"), ("Interface", _MODS + r"interface\s+(?P<name>\w+)"), ("Struct", _MODS + r"struct\s+(?P<name>\w+)"), ("Enum", _MODS + r"enum\s+(?P<name>\w+)"), ("Module", r"namespace\s+(?P<name>[\w.]+)"), ("Method", _JAVA[3][1]), ("property", r"(?m)^[ \t]+" + _MODS + r"[\w.<>\[\],?]+\s+(?P<name>\w+)\s*\{\s*(?:get|set|init)"), ("Field", _JAVA[4][1])]
_C = [("Class", r"\bclass\s+(?P<name>\w+)(?:\s*:\s*(?:public|private|protected)?\s*(?P<ext>\w+))?\s*(?=[{:])"), ("Struct", r"\b(?:struct|union)\s+(?P<name>\w+)\s*(?=\{)"), ("Enum", r"\benum\s+(?:class\s+)?(?P<name>\w+)\s*(?=[{:])"), ("Macro", r"(?m)^[ \t]*#[ \t]*define[ \t]+(?P<name>\w+)"), ("TypeAlias", r"\btypedef\b[^;{}]*?(?P<name>\w+)\s*;"), ("Function", r"(?m)^(?P<mod>(?:static|extern|inline|virtual|constexpr)\s+)*[\w:*&<>\s]+?[\s*&](?P<name>[\w:~]+)\s*\([^(){};]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?=\{)")]
_KT = [("Enum", r"(?P<mod>(?:(?:public|private|internal)\s+)*)enum\s+class\s+(?P<name>\w+)"), ("Class", r"(?P<mod>(?:(?:public|private|protected|internal|abstract|open|sealed|data|inner|inline|value|annotation)\s+)*)(?:class|object)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<ext>[\w.,\s<>()]+?))?(?=\s*(?:[{\n;]|$))"), ("Interface", r"(?P<mod>(?:(?:public|private|internal|sealed|fun)\s+)*)interface\s+(?P<name>\w+)"), ("TypeAlias", r"\btypealias\s+(?P<name>\w+)"), ("Function", r"(?P<mod>(?:(?:public|private|protected|internal|override|suspend|inline|open|abstract|operator|infix|tailrec)\s+)*)fun\s+(?:<[^>]*>\s*)?(?:[\w.<>]+\.)?(?P<name>\w+)\s*\("), ("Field", r"(?P<mod>(?:(?:public|private|protected|internal|override|const|lateinit)\s+)*)\b(?:val|var)\s+(?P<name>\w+)")]
_IMPORTS = {"kotlin": r"(?m)^[ \t]*import\s+([\w.*]+)","rust": r"\buse\s+([^;]+);|extern\s+crate\s+(\w+)", "js": r"\bimport\b[^'\"\n;]*?['\"]([^'\"\n]+)['\"]|\brequire\(\s*['\"]([^'\"\n]+)['\"]", "java": r"\bimport\s+(?:static\s+)?([\w.*]+)\s*;|\bpackage\s+([\w.]+)\s*;", "csharp": r"\busing\s+(?:static\s+)?([\w.]+)\s*;", "c": r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]"}
_CALL = re.compile(r"(?P<new>\bnew\s+)?(?P<dot>(?:\.|->|::)\s*)?\b(?P<name>[A-Za-z_$][\w$]*)(?P<bang>!)?\s*(?:<[\w\s,.]*>)?\(")
FAMILY = {"rust": ("rust", _RUST, "rust"), "typescript": ("js", _JS, "js"), "javascript": ("js", _JS, "js"), "java": ("c", _JAVA, "java"), "csharp": ("c", _CS, "csharp"), "c": ("c", _C, "c"), "cpp": ("c", _C, "c"), "kotlin": ("c", _KT, "kotlin")}

SCHEMA = pa.schema([("record", pa.string()), ("file_path", pa.string()), ("language", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("line", pa.int64()), ("col", pa.int64()), ("end_line", pa.int64()), ("signature", pa.string()), ("doc_comment", pa.string()), ("parent", pa.string()), ("is_exported", pa.bool_()), ("modifiers", pa.list_(pa.string())), ("complexity", pa.int64()), ("ord", pa.int64())])
DDL = "record string, file_path string, language string, name string, kind string, line long, col long, end_line long, signature string, doc_comment string, parent string, is_exported boolean, modifiers array<string>, complexity long, ord long"


def language_of(path: str) -> str:
    ext = path.rpartition("/")[2].rpartition(".")[2].lower()
    return LANGUAGES.get(ext, ext)


def blanked(text: str, family: str) -> str:
    """Comments and literals as spaces, line ends kept."""
    return re.sub(_SKIP[family], lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _closing(code: str, at: int) -> int:
    """Place after the brace that closes the first one from `at`, or the end of the statement."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(code, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif depth == 0:
            return m.end()
    return len(code)


def _line_closing(code: str, at: int) -> int:
    """The same where line ends end statements: a body has to open on the declaration's own line."""
    stop = code.find("\n", at)
    stop = len(code) if stop < 0 else stop
    return _closing(code, at) if "{" in code[at:stop] else stop


def branches(code: str) -> int:
    parts = re.split(r"[\s(){};,]", code)
    return 1 + sum(p in BRANCH_WORDS for p in parts) + code.count("??") + code.count("?.")


def _exported(language: str, kind: str, mods: list[str]) -> bool:
    """What other files can use: pub, export or public; Kotlin and C show what they do not hide."""
    if language == "rust":
        return any(m.startswith("pub") for m in mods) or kind == "Macro"
    if language in ("typescript", "javascript"):
        return "export" in mods
    if language in ("java", "csharp"):
        return "public" in mods
    return not {"private", "protected", "internal", "static"} & set(mods) and kind not in ("Field", "Variable")


def _comment_above(text: str, code: str, starts: list[int], line: int) -> str | None:
    """Text of the comment lines right above a line, without their marks; attributes and annotations may stand between."""
    kept: list[str] = []
    for at in range(line - 2, -1, -1):
        end = starts[at + 1] - 1 if at + 1 < len(starts) else len(text)
        raw, left = text[starts[at] : end].strip(), code[starts[at] : end].strip()
        if raw and not left:
            kept.append(re.sub(r"^(?:/\*+|\*+/|///?!?|\*)\s?|\s*\*+/$", "", raw))
        elif kept or not left.startswith(("#[", "@")):
            break
    return "\n".join(reversed(kept)).strip() or None


def _set_parents(found: list[dict], language: str) -> None:
    """Members get the innermost type around them, by one scan in order of place; functions in a Kotlin type are methods."""
    stack: list[dict] = []
    for s in sorted((s for s in found if s["record"] == "symbol"), key=lambda s: s["_at"]):
        while stack and stack[-1]["_end"] <= s["_at"]:
            stack.pop()
        if s["parent"] is None and stack and (s["kind"] in ("Method", "Field", "property") or language == "kotlin" and s["kind"] == "Function"):
            s["parent"] = stack[-1]["name"]
            s["kind"] = "Method" if s["kind"] == "Function" else s["kind"]
        if s["kind"] in ("Class", "Interface", "Struct", "Enum", "Trait"):
            stack.append(s)


def registered() -> dict[str, list[str]]:
    """Languages with an extractor, and what their files end in."""
    return {k: sorted(e for e, v in LANGUAGES.items() if v == k) for k in sorted(FAMILY)}


def register(language: str, family: str, patterns: list[tuple[str, str]], imports: str, endings: list[str]) -> None:
    """A further language: declaration patterns with groups name (and mod, ext, impl), and an import pattern."""
    re.compile(imports)
    for _, p in patterns:
        if "name" not in re.compile(p).groupindex:
            raise ValueError("a declaration pattern has a group `name`")
    _IMPORTS[language] = imports
    FAMILY[language] = (family, patterns, language)
    LANGUAGES.update(dict.fromkeys(endings, language))


def records(path: str, text: str) -> Iterator[dict]:
    """Rows of one file."""
    language = language_of(path)
    if language not in FAMILY:
        return
    family, patterns, imports = FAMILY[language]
    code = blanked(text, family)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def place(at: int) -> tuple[int, int]:
        line = bisect_right(starts, at)
        return line, len(text[starts[line - 1] : at].encode()) + 1

    base = {"file_path": path, "language": language, "signature": None, "doc_comment": None, "parent": None, "is_exported": None, "modifiers": None, "complexity": None}
    taken: dict[tuple[int, str], int] = {}
    found: list[dict] = []
    for kind, pattern in patterns:
        for m in re.finditer(pattern, code):
            name, at = m["name"], m.start("name")
            if (at, name) in taken or name in _WORDS:
                continue
            taken[at, name] = 1
            end = at if kind == "Macro" and family == "c" else (_line_closing if language == "kotlin" else _closing)(code, m.start("name"))
            groups = m.groupdict()
            mods = (groups.get("mod") or "").split()
            line, col = place(m.start() + len(m[0]) - len(m[0].lstrip()))
            last, _ = place(max(at, end - 1))
            exported = _exported(language, kind, mods)
            head = code[m.start() : code.find("{", at) if "{" in code[at:end] else end]
            found.append(base | {"record": "symbol", "name": name, "kind": kind, "line": line, "col": col, "end_line": last, "signature": " ".join(text[m.start() : m.start() + len(head)].split())[:500], "doc_comment": _comment_above(text, code, starts, line), "is_exported": exported, "modifiers": mods, "complexity": branches(code[at:end]) if kind in ("Function", "Method") else None, "_at": m.start(), "_end": end})
            for relation, group in (("extends", "ext"), ("implements", "impl")):
                for parent in re.split(r"\s*,\s*", groups.get(group) or ""):
                    if parent.strip():
                        found.append(base | {"record": "heritage", "name": name, "kind": relation, "line": line, "col": col, "end_line": line, "parent": re.sub(r"[<(].*", "", parent.strip()), "_at": m.start(), "_end": m.start()})
    if language == "rust":
        for m in re.finditer(r"\bimpl\b(?:\s*<[^>]*>)?\s+(?:(?P<trait>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<type>\w+)", code):
            end = _closing(code, m.end())
            for s in found:
                if s["record"] == "symbol" and s["kind"] == "Function" and m.start() < s["_at"] < end:
                    s["kind"], s["parent"] = "Method", m["type"]
            if m["trait"]:
                line, col = place(m.start())
                found.append(base | {"record": "heritage", "name": m["type"], "kind": "implements", "line": line, "col": col, "end_line": line, "parent": m["trait"], "_at": m.start(), "_end": m.start()})
    _set_parents(found, language)
    heads = {(a, n) for a, n in taken}
    for m in _CALL.finditer(code):
        if m["name"] in _WORDS or (m.start("name"), m["name"]) in heads:
            continue
        kind = "MacroExpansion" if m["bang"] else "Direct" if m["new"] or not m["dot"] or m["dot"].startswith("::") else "Virtual"
        line, col = place(m.start("name"))
        found.append(base | {"record": "call", "name": m["name"], "kind": kind, "line": line, "col": col, "end_line": line, "_at": m.start()})
    for m in re.finditer(_IMPORTS[imports], text):
        path_of = next(g for g in m.groups() if g)
        line, col = place(m.start())
        found.append(base | {"record": "import", "name": " ".join(path_of.split()), "kind": "Unresolved", "line": line, "col": col, "end_line": line, "_at": m.start()})
    for i, s in enumerate(sorted(found, key=lambda s: (s["_at"], s["record"] != "symbol"))):
        yield {k: v for k, v in s.items() if k[0] != "_"} | {"ord": i}


def extract(files: DataFrame, max_chars: int = 4_000_000) -> DataFrame:
    """files (file_path, content) to records. Files of more than max_chars give a `failed` row, as do unreadable ones."""
    workers_find_us(files.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    if text is None or len(text) > max_chars:
                        raise ValueError("no text, or too long")
                    rows += records(path, text)
                except (ValueError, RecursionError) as e:
                    rows.append(dict.fromkeys(SCHEMA.names) | {"record": "failed", "file_path": path, "signature": str(e)[:200]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    return files.select(F.col("file_path").cast("string"), F.col("content").cast("string")).mapInArrow(run, DDL)
