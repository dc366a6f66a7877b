"""Patterns of declarations, imports and routes, composed from what a language's grammar allows.

A declaration is a line that begins with any modifiers in any order, then the word that begins it, then a name. Where no
word begins a function (Java, C#), a result type stands before the name instead. Comments are masked first, so nothing in
them is found; a mark inside a string does not begin a comment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

#: Stands for each character of a comment: no pattern takes it.
MASK = "\x1a"
PATH = "(?P<path>/[^{0}]*)"


def any_of(words) -> str:
    """One of these words, the longest first."""
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


@dataclass(frozen=True)
class Grammar:
    """What a language's declarations are made of."""

    #: words before a type or function
    modifiers: tuple[str, ...]
    #: words that begin a type
    types: tuple[str, ...]
    #: word that begins a function; None: a result type stands there
    function: str | None
    #: between that word and the name: receivers, type parameters
    between: str = ""
    #: word that begins an import, and what it names up to its end
    imported: tuple[str, str] = ("import", r"[\w.*]+")
    import_end: str = ""
    name: str = r"[^\W\d]\w*"
    line_comment: tuple[str, ...] = ("//",)
    quotes: str = "\"'"
    annotation: str = ""

    def lead(self) -> str:
        """The begin of a line, annotations on it, and modifiers; those with an argument too, as in pub(crate)."""
        return rf"(?m)^\s*{self.annotation}(?:(?:{any_of(self.modifiers)})(?:\([^)]*\))?\s+)*"

    @cache
    def type_pattern(self) -> re.Pattern:
        words = "|".join(r"\s+".join(map(re.escape, t.split())) for t in self.types)
        return re.compile(rf"{self.lead()}(?:{words})\s+(?P<name>{self.name})")

    @cache
    def function_pattern(self) -> re.Pattern:
        if self.function:
            return re.compile(rf"{self.lead()}{self.function}\s+{self.between}(?P<name>{self.name})\s*(?:[<\[][^(]*[>\]]\s*)?\(")
        part = rf"{self.name}(?:\.{self.name})*"
        result = rf"(?!(?:{any_of(NOT_TYPES)})\b){part}(?:<[^(){{}};=]*>)?(?:\[[\], ]*\])*\??"
        return re.compile(rf"{self.lead()}(?:<[^>]*>\s*)?{result}\s+(?P<name>{self.name})\s*\(")

    @cache
    def import_pattern(self) -> re.Pattern:
        word, what = self.imported
        return re.compile(rf"(?m)^\s*{word}\s+(?P<name>{what}){self.import_end}")

    @cache
    def _tokens(self) -> re.Pattern:
        strings = "|".join(rf"{q}(?:\\.|[^{q}\\\n])*{q}" for q in self.quotes if q != "`") + ("|`[^`]*`" if "`" in self.quotes else "")
        lines = "|".join(rf"{re.escape(c)}[^\n]*" for c in self.line_comment)
        return re.compile(rf"(?P<text>{strings})|(?P<comment>(?s:/\*.*?(?:\*/|$))|{lines})")

    def masked(self, text: str) -> str:
        """The text with its comments masked; lines stay."""
        mask = lambda m: m[0] if m["text"] is not None else re.sub(r"[^\n]", MASK, m[0])
        return self._tokens().sub(mask, text)


#: What may stand where a result type would, but begins a statement.
NOT_TYPES = ("return", "new", "else", "throw", "await", "yield", "case", "import", "using", "package", "namespace", "goto", "do", "in", "is", "as", "when", "where")
_ACCESS = ("public", "protected", "private")
_ANNOTATED = r"(?:@[\w.]+(?:\([^\n]*?\))?[ \t]+)*"
_RECEIVER = r"(?:\((?P<receiver>[^)]*)\)\s*)?"
GRAMMARS = {
    "Java": Grammar((*_ACCESS, "static", "final", "abstract", "default", "synchronized", "native"), ("class", "interface", "enum"), None, imported=(r"import(?:\s+static)?", r"[\w.*]+"), import_end=r"\s*;", annotation=_ANNOTATED),
    "C#": Grammar((*_ACCESS, "internal", "static", "async", "abstract", "sealed", "partial", "virtual", "override", "readonly", "unsafe", "new"), ("class", "interface", "record", "struct", "enum"), None, imported=(r"(?:global\s+)?using(?:\s+static)?", r"[\w.]+"), import_end=r"\s*;"),
    "Go": Grammar((), (), "func", between=_RECEIVER, quotes="\"'`"),
    "Rust": Grammar(("pub", "async", "const", "unsafe", "default", "extern"), ("struct", "enum", "trait", "mod"), "fn", imported=(r"(?:pub\s+)?use", "[^;]+"), import_end=";", quotes='"'),
    "Kotlin": Grammar((*_ACCESS, "internal", "data", "sealed", "open", "abstract", "inner", "annotation", "value", "suspend", "inline", "override", "operator", "infix", "tailrec"), ("class", "interface", "object", "enum class"), "fun", between=r"(?:<[^>]*>\s*)?(?:[^\W\d][\w.<>?]*\.)?", annotation=_ANNOTATED),
    "PHP": Grammar((*_ACCESS, "static", "abstract", "final", "readonly"), ("class", "interface", "trait", "enum"), "function", between="&?", imported=("use", "[^;]+"), import_end=";", line_comment=("//",)),
    "JavaScript": Grammar(("export", "default", "async", "abstract", "declare"), ("class",), r"function\s*\*?", name=r"(?!\d)[\w$]+", quotes="\"'`"),
}
#: Go has its types' names before the word.
GO_TYPE = re.compile(r"(?m)^type\s+(?P<name>[^\W\d]\w*)\s*(?:\[[^\]]*\]\s*)?(?:struct|interface)\b")
_JS = GRAMMARS["JavaScript"]
#: Functions that are values of names, and what a module hands out.
JS_VALUE = re.compile(rf"{_JS.lead()}(?:const|let|var)\s+(?P<name>{_JS.name})\s*(?::[^=]+)?=\s*(?P<wait>async\s+)?(?:function\b|(?:\([^()]*\)|{_JS.name})\s*(?::[^=]+)?=>)")
JS_EXPORT = re.compile(rf"(?m)^\s*export\s+(?:(?:{any_of(('default', 'abstract', 'async', 'declare'))})\s+)*(?:class|function\s*\*?|const|let|var|interface|type|enum)\s+(?P<name>{_JS.name})")
JS_IMPORT = re.compile(r"(?m)^\s*import\s+(?:[^'\";]*?\bfrom\s+)?(?P<quote>['\"])(?P<name>[^'\"]+)(?P=quote)")


def go_imports(text: str) -> set[str]:
    """Quoted names after the word import, alone or in a block."""
    out = set()
    for m in re.finditer(r"(?m)^\s*import\b\s*(?:\((?P<block>[^)]*)\)|(?P<one>[^\n]*))", text):
        out.update(x[1] for x in re.finditer("[\"`]([^\"`]+)[\"`]", m["block"] or m["one"] or ""))
    return out


def argument_text(text: str, at: int) -> str:
    """What stands in the parentheses that open at this place, inner ones and strings counted in; nothing if none open."""
    if text[at : at + 1] != "(":
        return ""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return text[at + 1 : i]
    return text[at + 1 :]


def annotated_routes(text: str, opened: str, names: dict[str, str]):
    """(start, end, verb, path) of annotations: the first quoted path among their arguments, or /."""
    for m in re.finditer(rf"{re.escape(opened)}(?P<name>{any_of(names)})\b", text):
        inner = argument_text(text, m.end())
        quoted = re.search("[\"'](/[^\"']*)[\"']", inner)
        yield m.start(), m.end() + len(inner), names[m["name"]], quoted[1] if quoted else "/"


def called_routes(text: str, before: str, names: dict[str, str], quotes: str):
    """(start, end, verb, path) of calls whose first argument is a quoted path."""
    for m in re.finditer(rf"{before}(?P<name>{any_of(names)})\s*\(\s*[{quotes}]{PATH.format(quotes)}[{quotes}]", text):
        yield m.start(), m.end(), names[m["name"]], m["path"]
