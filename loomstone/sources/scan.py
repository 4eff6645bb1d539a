"""Lines of code and functions of a source file, by small scanners for each family of languages.

No grammar is at hand, so comments and strings are recognised by their delimiters, and functions by
the words and braces (or indentation) that define them. Line classes follow one rule: a line is blank
if it holds white space alone, a comment if all else on it lies in comments, and code otherwise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.lines import LANGUAGES

#: Line-comment markers and block-comment pairs by language.
COMMENTS: dict[str, tuple[tuple[str, ...], tuple[tuple[str, str], ...]]] = {
    **{name: (("//",), (("/*", "*/"),)) for name in ("Rust", "JavaScript", "TypeScript", "TSX", "Go", "C", "C++", "Java", "Scala")},
    "PHP": (("//", "#"), (("/*", "*/"),)),
    "CSS": ((), (("/*", "*/"),)),
    "Python": (("#",), ()),
    "Ruby": (("#",), (("=begin", "=end"),)),
    "Bash": (("#",), ()),
    "Lua": (("--",), (("--[[", "]]"),)),
    "Vim Script": (('"',), ()),
    "Haskell": (("--",), (("{-", "-}"),)),
    "OCaml": ((), (("(*", "*)"),)),
    "HTML": ((), (("<!--", "-->"),)),
    "Markdown": ((), (("<!--", "-->"),)),
    "JSON": ((), ()),
}
STRINGS = {"Python": ('"""', "'''", '"', "'"), "Go": ("`", '"', "'"), "JavaScript": ("`", '"', "'"), "TypeScript": ("`", '"', "'"), "TSX": ("`", '"', "'")}
_NO_STRINGS = frozenset(["HTML", "Markdown", "Vim Script"])
#: In these a quote mark alone is no string (lifetimes, type variables, chars).
_DOUBLE_ONLY = frozenset(["Rust", "Haskell", "OCaml", "C", "C++", "Java", "Scala"])
_NESTS = frozenset(["Rust", "Scala", "Haskell", "OCaml"])


@dataclass
class Function:
    name: str
    kind: str
    start: int
    end: int


@dataclass
class Scan:
    language: str
    code: int = 0
    comments: int = 0
    blanks: int = 0
    functions: list[Function] = field(default_factory=list)


def language_by_path(path: str) -> str | None:
    return LANGUAGES.get(path.rpartition("/")[2].rpartition(".")[2].lower()) if "." in path.rpartition("/")[2] else None


def masked(text: str, language: str) -> tuple[str, str]:
    """The text with comments blanked, and with strings blanked as well; line breaks stay."""
    lines, blocks = COMMENTS.get(language, ((), ()))
    quotes = () if language in _NO_STRINGS else ('"',) if language in _DOUBLE_ONLY else STRINGS.get(language, ('"', "'"))
    marks = sorted([*lines, *(a for a, _ in blocks), *quotes], key=len, reverse=True)
    if not marks:
        return text, text
    finder = re.compile("|".join(map(re.escape, marks)))
    closing = dict(blocks)
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    code, bare, at = [], [], 0
    while found := finder.search(text, at):
        start, mark = found.start(), found.group()
        code.append(text[at:start])
        bare.append(text[at:start])
        if mark in closing:
            end, depth = found.end(), 1
            pair = re.compile(f"{re.escape(mark)}|{re.escape(closing[mark])}" if language in _NESTS else re.escape(closing[mark]))
            while depth and (step := pair.search(text, end)):
                end, depth = step.end(), depth + (1 if step.group() == mark else -1)
            end = len(text) if depth else end
            code.append(blank(text[start:end]))
            bare.append(blank(text[start:end]))
        elif mark in lines:
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
            code.append(" " * (end - start))
            bare.append(" " * (end - start))
        else:
            many = len(mark) == 3 or mark == "`"
            close = re.compile(rf"(?:\\.|(?!{re.escape(mark)}).)*?{re.escape(mark)}", re.DOTALL) if many else re.compile(rf"(?:\\.|[^\\\n])*?{re.escape(mark)}", re.DOTALL)
            step = close.match(text, found.end())
            end = step.end() if step else found.end()
            code.append(text[start:end])
            bare.append(blank(text[start:end]))
        at = end
    code.append(text[at:])
    bare.append(text[at:])
    return "".join(code), "".join(bare)


_BRACES = {
    "Rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\S*\s*)?fn\s+(\w+)",
    "Go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]",
    "JavaScript": r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)\s*\(",
    "PHP": r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(\w+)",
    "Scala": r"^[ \t]*(?:(?:private|protected|override|final|implicit|inline)\s+)*def\s+(\w+)",
    "Bash": r"^[ \t]*(?:function\s+)?([\w-]+)\s*\(\s*\)",
    "C": r"^[A-Za-z_][\w\s*&:<>,~]*?[\s*&]([A-Za-z_~][\w:~]*)\s*\([^;{}]*\)[^;{}()]*(?=\{)",
}
_BRACES |= {"TypeScript": _BRACES["JavaScript"], "TSX": _BRACES["JavaScript"], "C++": _BRACES["C"]}
_METHODS = {
    "JavaScript": r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?([\w$#]+)\s*(?:<[^>]*>)?\([^;{}]*\)[^;{}()]*(?=\{)",
    "Java": r"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*(?:<[^>]*>\s*)?[\w<>\[\],.? ]*?\b(\w+)\s*\([^;{}]*\)[^;{}()]*(?=\{)",
    "C++": r"^[ \t]+(?:(?:virtual|static|inline|constexpr|explicit)\s+)*(?:[\w:<>*& ]+?[ *&])?(~?\w+)\s*\([^;{}]*\)[^;{}()]*(?=\{)",
}
_METHODS |= {"TypeScript": _METHODS["JavaScript"], "TSX": _METHODS["JavaScript"]}
_TYPES = {
    "Rust": r"\b(?:impl|trait)\b[^;{}]*(?=\{)",
    **{k: r"\b(?:class|struct|interface|trait|object)\b[^;{}()]*(?=\{)" for k in ("JavaScript", "TypeScript", "TSX", "Java", "C++", "PHP", "Scala")},
}
_KEYWORDS = frozenset("if for while switch catch return else do function new sizeof throw await typeof with try match".split())


def _closing(bare: str, at: int) -> int:
    """The place of the brace that closes the first one from `at` on; a body that never opens ends its line."""
    depth = 0
    for found in re.compile(r"[{};]").finditer(bare, at):
        mark = found.group()
        if mark == "{":
            depth += 1
        elif mark == "}":
            depth -= 1
            if depth <= 0:
                return found.start()
        elif not depth:
            return -1
    return len(bare) - 1 if depth else -1


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _braced(text: str, bare: str, language: str) -> list[Function]:
    spans = [(m.start(), _closing(bare, m.start())) for m in re.finditer(_TYPES[language], bare)] if language in _TYPES else []
    hits = [(m, "fn") for m in re.finditer(_BRACES[language], bare, re.MULTILINE)] if language in _BRACES else []
    hits += [(m, "method") for m in re.finditer(_METHODS[language], bare, re.MULTILINE)] if language in _METHODS else []
    found, ends = [], []
    for m, kind in sorted(hits, key=lambda h: (h[0].start(1), h[1])):
        name, start = m.group(1), m.start() + len(m.group()) - len(m.group().lstrip())
        inside = any(a < start < b for a, b in spans)
        if name in _KEYWORDS or kind == "method" and not inside or any(a < start < b for a, b in ends):
            continue  # nothing within a body is searched
        end = _closing(bare, m.end(1))
        if end < 0:
            continue
        ends.append((start, end))
        method = inside or language == "Go" and re.match(r"func\s+\(", m.group()) or language == "C++" and "::" in name
        found.append(Function(name.rpartition("::")[2], "method" if method else "fn", _line(bare, start), _line(bare, end)))
        if language == "Rust" and _rust_test(text, bare, start):
            found[-1].kind = "test"
    return found


def _rust_test(text: str, bare: str, start: int) -> bool:
    above = text[:start].rstrip()
    while above.endswith("]") and (at := above.rfind("#[")) >= 0:
        if "test" in above[at:]:
            return True
        above = above[:at].rstrip()
    for m in re.finditer(r"#\[cfg\(test\)\]\s*(?:pub\s+)?mod\s+\w+\s*(?=\{)", text):
        if m.start() < start < _closing(bare, m.end()):
            return True
    return False


def _indented(bare: str, language: str) -> list[Function]:
    pattern = r"^([ \t]*)(?:async[ \t]+)?def[ \t]+(?:self\.)?([\w?!=]+)"
    lines, found, skip = bare.split("\n"), [], 0
    classes: list[int] = []
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        classes = [c for c in classes if c < indent]
        if re.match(r"\s*(?:class|module)\b", line):
            classes.append(indent)
        m = re.match(pattern, line)
        if not m or i < skip:
            continue
        end = i
        for j in range(i + 1, len(lines)):
            if lines[j].strip():
                depth = len(lines[j]) - len(lines[j].lstrip())
                if language == "Ruby" and depth == indent and lines[j].strip().startswith("end"):
                    end = j
                    break
                if depth <= indent and not (end == i and lines[j].lstrip()[:1] in ")]}"):
                    break
                end = j
        skip = end + 1
        name = m.group(2)
        kind = "test" if name.startswith("test_") else "method" if classes else "fn"
        found.append(Function(name, kind, i + 1, end + 1))
    return found


def _lua(bare: str) -> list[Function]:
    found, skip = [], -1
    opens = re.compile(r"\b(function|do|then|repeat|end|until|elseif)\b")
    for m in re.finditer(r"^[ \t]*(?:local\s+)?function\s+([\w.:]+)", bare, re.MULTILINE):
        if m.start() < skip:
            continue
        depth, end = 0, len(bare)
        for step in opens.finditer(bare, m.start()):
            depth += {"function": 1, "do": 1, "then": 1, "repeat": 1, "elseif": -1}.get(step.group(), -1)
            if depth == 0:
                end = step.end()
                break
        skip = end
        found.append(Function(re.split(r"[.:]", m.group(1))[-1], "method" if ":" in m.group(1) else "fn", _line(bare, m.start(1)), _line(bare, end)))
    return found


#: First words of a line that begin no equation of a function (fixed values).
_HASKELL = frozenset("module import data type newtype class instance infix infixl infixr deriving where foreign default pattern let in if then else case of do".split())


def _end_of_body(lines: list[str], i: int) -> int:
    """The last line further in than line i before one that is not."""
    indent, end = len(lines[i]) - len(lines[i].lstrip()), i
    for j in range(i + 1, len(lines)):
        if lines[j].strip():
            if len(lines[j]) - len(lines[j].lstrip()) <= indent:
                break
            end = j
    return end


def _by_line(bare: str, language: str) -> list[Function]:
    """Functions that a line begins: let bindings outside of others, equations with arguments, and functions up to their end word."""
    lines, found, skip = bare.split("\n"), [], 0
    for i, line in enumerate(lines):
        if i < skip:
            continue
        if language == "Vim Script":
            m = re.match(r"\s*:?\s*fu(?:n|nc|nct|ncti|nctio|nction)?!?\s+([\w:#.<>]+)\s*\(", line)
            end = next((j for j in range(i, len(lines)) if re.match(r"\s*:?\s*endf(?:u|un|unc|unct|uncti|unctio|unction)?\b", lines[j])), -1) if m else -1
        elif language == "OCaml":
            m = re.match(r"\s*(?:let(?:\s+rec)?|and)\s+([a-z_][\w']*)", line)
            end = _end_of_body(lines, i) if m else -1
        else:
            m = re.match(r"([a-z_][\w']*)\s+(?!::)[^=|\s].*?(?:=|\||$)", line)
            end = _end_of_body(lines, i) if m else -1
            body = " ".join(lines[i : end + 1])
            if not m or m.group(1) in _HASKELL or re.match(r"[\w', ]+::", line) or not re.search(r"(?<![=<>/!|])=(?![=>])", body):
                continue
        if end >= 0:
            found.append(Function(m.group(1), "fn", i + 1, end + 1))
            skip = end + 1
    return found


def scan(text: str, path: str, test_path: bool = False) -> Scan | None:
    """Line classes and functions of a file; None for an unknown extension."""
    language = language_by_path(path)
    if language is None:
        return None
    code, bare = masked(text, language)
    out = Scan(language)
    if text:
        originals = text.split("\n")
        for before, after in zip(originals[:-1] if text.endswith("\n") else originals, code.split("\n")):
            if not before.strip(" \t\r\x0b\x0c"):
                out.blanks += 1
            elif not after.strip():
                out.comments += 1
            else:
                out.code += 1
    if language in ("Python", "Ruby"):
        out.functions = _indented(bare, language)
    elif language == "Lua":
        out.functions = _lua(bare)
    elif language in ("Vim Script", "OCaml", "Haskell"):
        out.functions = _by_line(bare, language)
    elif language in _BRACES or language in _METHODS:
        out.functions = _braced(text, bare, language)
    for f in out.functions:
        if test_path or language == "Go" and f.name.startswith("Test"):
            f.kind = "test"
    return out
