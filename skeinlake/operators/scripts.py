"""Declarations of JavaScript and TypeScript, JSX included, by a scanner with a stack of bracket kinds.

The text becomes tokens and matched groups: round, square and curly brackets, templates and their
code, elements, their tags, children and code. Whether a slash opens a regular expression and a `<`
an element follows from whether a value may start there. Statements are then told apart by `;`, closed
blocks and line ends after which none can go on; heads of classes and functions step over type
arguments, object types and decorators as groups.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple


class Piece(NamedTuple):
    kind: str
    name: str  # what follows the path in the id, kind included for methods
    start: int
    end: int


class Lines:
    """Line numbers, from 0, of places in a text."""

    def __init__(self, text: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, place: int) -> int:
        return bisect_right(self.starts, place) - 1


_CODE = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<word>\#?[\w$]+)"
    r"|=>|\+\+|--|\?\.(?!\d)|\.\.\.|[=!]==?|<=|&&|\|\||\?\?|.",
    re.S,
)
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_TAG = re.compile(r"<(?:(?P<name>[A-Za-z_$][\w$.:-]*)|(?=\s*>))")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|=|extends\b)")
_IN_TAG = re.compile(r"\s+|/\*.*?\*/|//[^\n]*|[\w$.:-]+|=|\"[^\"]*\"|'[^']*'", re.S)
_KIDS = re.compile(r"[^<{]*")
_CLOSE = re.compile(r"</[^>]*>?")
#: Words after which an expression starts, so that a slash opens a regular expression.
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new instanceof do else yield await default extends".split())
_OPEN, _SHUT = {"(": ")", "[": "]", "{": "}", "`": "`", "<>": "</>"}, frozenset([")", "]", "}"])
#: Words that go on with an expression, so that no statement ends before them at a line end.
_GOES_ON = frozenset("in of instanceof as satisfies extends implements is".split())
#: Words after which a statement cannot end.
_UNFINISHED = _BEFORE_VALUE - {"default"} | frozenset("export default declare abstract async const let var class function import from implements keyof readonly".split())
_MODIFIERS = frozenset("public private protected static override readonly async get set accessor declare abstract".split())
_CONTROL = frozenset("if while for switch catch with function return".split())
_TYPE_PREFIX = frozenset("keyof typeof readonly infer unique asserts new abstract".split())
_DECLARED = frozenset("function class interface enum namespace module type const let var abstract async".split())


class Tokens:
    """kind (a word's text, an operator, an opening or closing bracket, `s` a string, `r` a regular
    expression), start, end, whether a line end comes before, and the partner of each bracket."""

    def __init__(self, text: str, jsx: bool = True) -> None:
        self.text, self.jsx = text, jsx
        self.kind: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.word: list[bool] = []
        self.fresh: list[bool] = []
        self.match: dict[int, int] = {}
        self._stack: list[list] = []  # [kind, token, whether a statement follows]
        self._line = True
        self._read()
        for _, opened, _ in self._stack:
            self.match[opened] = len(self.kind)

    def _put(self, kind: str, start: int, end: int, word: bool = False) -> int:
        for held, x in ((self.kind, kind), (self.start, start), (self.end, end), (self.word, word), (self.fresh, self._line)):
            held.append(x)
        self._line = False
        return len(self.kind) - 1

    def _push(self, kind: str, shown: str, start: int, end: int, flag: bool = False) -> None:
        self._stack.append([kind, self._put(shown, start, end), flag])

    def _pop(self, shown: str, start: int, end: int) -> list:
        top = self._stack.pop()
        self.match[top[1]] = self._put(shown, start, end)
        return top

    def _element(self, at: int) -> re.Match | None:
        """The head of an element that starts here, if one does and it is closed somewhere."""
        m = _TAG.match(self.text, at)
        if m is None or _GENERIC.match(self.text, at):
            return None
        name, after = m["name"] or "", self.text[m.end() : m.end() + 1]
        if after == ">" or not name:
            return m if re.compile(rf"</\s*{re.escape(name)}\s*>").search(self.text, m.end()) else None
        ends = self.text.find("/>", m.end()) >= 0 or self.text.find(f"</{name}", m.end()) >= 0
        return m if ends and (after.isspace() or after in "/<") else None

    def _read(self) -> None:
        text, at, value, word = self.text, 0, True, ""
        while at < len(text):
            top = self._stack[-1][0] if self._stack else ""
            if top == "`":
                at = _TEMPLATE.match(text, at).end()
                if text.startswith("${", at):
                    self._push("${", "{", at, at + 2)
                    at, value, word = at + 2, True, ""
                elif at < len(text):
                    self._pop("``", at, at + 1)
                    at, value, word = at + 1, False, ""
            elif top == "kids":
                at = _KIDS.match(text, at).end()
                if text.startswith("</", at):
                    end = _CLOSE.match(text, at).end()
                    self._pop("</>", at, end)
                    at, value, word = end, False, ""
                elif text.startswith("{", at):
                    self._push("{}", "{", at, at + 1)
                    at, value, word = at + 1, True, ""
                elif at < len(text):
                    m = _TAG.match(text, at)
                    if m:
                        self._push("tag", "<>", at, m.end())
                    at = m.end() if m else at + 1
            elif top == "tag":
                m = _IN_TAG.match(text, at)
                if m:
                    at = m.end()
                elif text[at] == "{":
                    self._push("{}", "{", at, at + 1)
                    at, value, word = at + 1, True, ""
                elif text.startswith("/>", at):
                    self._pop("</>", at, at + 2)
                    at, value, word = at + 2, False, ""
                elif text[at] == ">":
                    self._stack[-1][0] = "kids"
                    at += 1
                elif text[at] == "<" and text[:at].rstrip().endswith("=") and _TAG.match(text, at):
                    m = _TAG.match(text, at)
                    self._push("tag", "<>", at, m.end())
                    at = m.end()
                elif text[at] == "<":  # type arguments
                    shut = re.compile(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>").match(text, at)
                    at = shut.end() if shut else at + 1
                else:
                    at += 1
            else:
                at, value, word = self._code(at, value, word)

    def _code(self, at: int, value: bool, word: str) -> tuple[int, bool, str]:
        text = self.text
        if value and text[at] == "/" and (m := _REGEX.match(text, at)):
            self._put("r", at, m.end())
            return m.end(), False, ""
        if value and self.jsx and text[at] == "<" and (m := self._element(at)):
            self._push("tag", "<>", at, m.end())
            return m.end(), False, ""
        m = _CODE.match(text, at)
        end, c = m.end(), m[0]
        if m["space"] or m["comment"]:
            self._line |= "\n" in c
            return end, value, word
        if m["string"]:
            self._put("s", at, end)
            return end, False, ""
        if m["word"]:
            self._put(c, at, end, True)
            named = word == "."
            return end, c in _BEFORE_VALUE and not named, "" if named else c
        if c in ("++", "--"):
            self._put(c, at, end)
            return end, value, word
        if c == "`":
            self._push("`", "`", at, end)
            return end, False, ""
        if c in "([{":
            self._push(c, c, at, end, c == "(" and word in ("if", "while", "for", "with"))
            return end, True, ""
        if c in _SHUT:
            return end, self._shut(c, at, end), ""
        self._put(c, at, end)
        return end, True, "." if c in (".", "?.") else ""

    def _shut(self, c: str, start: int, end: int) -> bool:
        """Close a group; one that is open within it stays without a partner. Whether a value follows."""
        fits = ("{", "${", "{}") if c == "}" else ("(",) if c == ")" else ("[",)
        kinds = [k for k, _, _ in self._stack]
        for i in range(len(kinds) - 1, -1, -1):
            if kinds[i] in fits:
                for _, opened, _ in self._stack[i + 1 :]:
                    self.match[opened] = len(self.kind)
                del self._stack[i + 1 :]
                top = self._pop(c, start, end)
                return top[2] if c == ")" else c == "}"
            if c != "}" and kinds[i] in ("{", "${", "{}", "`", "kids", "tag"):
                break
        self._put("?" + c, start, end)
        return False


def silent_script(text: str, strings: bool = False) -> str:
    """A script with comments, regular expressions and the text of templates and elements blanked out,
    and strings too unless `strings`; places and lines stay. The code in a template's ${} stays, in
    round brackets."""
    out, at, t = [], 0, Tokens(text)
    blank = lambda part: re.sub(r"[^\n]", " ", part)
    codes = {i: "(" for i in t.match if t.kind[i] == "{" and t.end[i] - t.start[i] == 2}
    codes |= {t.match[i]: ")" for i in codes}
    for i, kind in enumerate(t.kind):
        out.append(blank(text[at : t.start[i]]))
        here, at = text[t.start[i] : t.end[i]], t.end[i]
        if i in codes:
            out.append(codes[i].rjust(len(here)))
        elif kind in ("r", "`", "``", "<>", "</>") or kind == "s" and not strings:
            out.append(blank(here))
        else:
            out.append(here)
    return "".join([*out, blank(text[at:])])


class _Reader:
    """Declarations over the tokens of one text."""

    def __init__(self, text: str, jsx: bool) -> None:
        self.t = t = Tokens(text, jsx)
        self.text, self.lines = text, Lines(text)
        self.kind = [*t.kind, ""]  # an end that fits nothing
        self.n, self.out, self.named = len(t.kind), [], {}

    def after(self, i: int) -> int:
        """The token behind this one, or behind the group that it opens."""
        return min(self.n, self.t.match[i] + 1) if i in self.t.match else i + 1

    def is_word(self, i: int) -> bool:
        return i < self.n and self.t.word[i]

    def fresh(self, i: int) -> bool:
        return i >= self.n or self.t.fresh[i]

    def place(self, i: int) -> int:
        """Where the token before i ends."""
        return self.t.end[min(i, self.n) - 1]

    def angle(self, i: int, hi: int) -> int:
        """Behind the type arguments that open at i; i + 1 if they do not close."""
        depth, k = 0, i
        while k < hi:
            c = self.kind[k]
            depth += (c == "<") - (c == ">")
            if depth == 0:
                return k + 1
            if c == ";" or c in ("?)", "?}", "?]"):
                break
            k = self.after(k)
        return i + 1

    def type_end(self, k: int, hi: int) -> int:
        """Behind the type that starts at k."""
        pending, group, tests = True, False, 0
        while k < hi:
            c = self.kind[k]
            if pending:
                if c in ("{", "[", "(", "`", "s"):
                    group, pending, k = c == "(", False, self.after(k)
                elif c == "<":
                    k = self.angle(k, hi)
                elif self.is_word(k):
                    pending, group = c in _TYPE_PREFIX and (self.is_word(k + 1) or self.kind[k + 1] in ("{", "(", "[", "<")), False
                    k += 1
                    if c == "import" and self.kind[k] == "(":
                        k = self.after(k)
                elif c in ("|", "&", "-", "...", "&&", "||"):
                    k += 1
                else:
                    return k
                continue
            if c in ("|", "&", "."):
                pending = True
            elif c == "[" and not self.fresh(k):
                k = self.after(k)
                continue
            elif c == "<" and not self.fresh(k):
                k = self.angle(k, hi)
                continue
            elif c == "=>" and group:
                pending, group = True, False
            elif c == "is" and not self.fresh(k):
                pending = True
            elif c == "extends":
                pending, tests = True, tests + 1
            elif c == "?" and tests:
                pending = True
            elif c == ":" and tests:
                pending, tests = True, tests - 1
            else:
                return k
            k += 1
        return k

    def ends_before(self, k: int) -> bool:
        """Whether the line end before k ends a statement."""
        p = self.kind[k - 1]
        if not (self.is_word(k - 1) and p not in _UNFINISHED or p in ("s", "r", ")", "]", "}", "``", "</>", "++", "--", ">")):
            return False
        c = self.kind[k]
        return self.is_word(k) and c not in _GOES_ON or c in ("s", "@", "{", "++", "--", "")

    def value_end(self, k: int, hi: int) -> int:
        """Behind the expression that starts at k, at the comma, semicolon or line end that closes it."""
        first = k
        while k < hi and self.kind[k] not in (",", ";"):
            if k > first and self.fresh(k) and self.ends_before(k):
                break
            shut = self.angle(k, hi) if self.kind[k] == "<" and (k == first or self.is_word(k - 1)) else 0
            # type arguments of a call hold commas
            k = shut if shut > k + 1 and self.kind[shut] == "(" else self.after(k)
        return min(k, hi)

    def function(self, k: int, hi: int) -> tuple[str | None, int, bool]:
        """Name, end and whether there is a body of the function whose keyword stands at k."""
        k += 1 + (self.kind[k + 1] == "*")
        name = self.kind[k] if self.is_word(k) else None
        k += name is not None
        if self.kind[k] == "<":
            k = self.angle(k, hi)
        if self.kind[k] != "(":
            return name, k, False
        k = self.after(k)
        if self.kind[k] == ":":
            k = self.type_end(k + 1, hi)
        return (name, self.after(k), True) if self.kind[k] == "{" else (name, k, False)

    def head(self, k: int, hi: int) -> tuple[str | None, int]:
        """Name and the opening brace of the class or interface whose keyword stands at k; -1 without."""
        k += 1
        name = self.kind[k] if self.is_word(k) and self.kind[k] not in ("extends", "implements") else None
        k += name is not None
        open_ended = False
        while k < hi:
            c = self.kind[k]
            if c == "{":
                if not open_ended:
                    return name, k
                open_ended, k = False, self.after(k)
            elif c == "<":
                open_ended, k = False, self.angle(k, hi)
            elif self.is_word(k) or c in (",", ".", "?."):
                open_ended = c in ("extends", "implements", ",")
                k += 1
            elif c in ("(", "["):
                open_ended, k = False, self.after(k)
            else:
                break
        return name, -1

    def decorators(self, k: int) -> int:
        while self.kind[k] == "@":
            k += 1
            if self.kind[k] == "(":
                k = self.after(k)
                continue
            while self.is_word(k):
                k += 1
                if self.kind[k] == "." and not self.fresh(k):
                    k += 1
                else:
                    break
            if self.kind[k] == "(" and not self.fresh(k):
                k = self.after(k)
        return k

    def value(self, v: int, hi: int) -> tuple[str, int, int] | None:
        """Kind, end and class token of the function or class that starts at v and is the whole value."""
        k = v
        if self.kind[k] == "async" and not self.fresh(k + 1) and (self.is_word(k + 1) or self.kind[k + 1] in ("(", "<")):
            k += 1
        if self.kind[k] == "function":
            _, end, body = self.function(k, hi)
            return ("function", end, -1) if body else None
        if self.kind[k] == "class":
            _, opened = self.head(k, hi)
            return ("class", self.after(opened), k) if opened >= 0 else None
        if self.kind[k] == "<":
            k = self.angle(k, hi)
        if self.kind[k] == "(":
            k = self.after(k)
            if self.kind[k] == ":":
                k = self.type_end(k + 1, hi)
        elif self.is_word(k):
            k += 1
        else:
            return None
        if self.kind[k] != "=>":
            return None
        return "function", self.after(k + 1) if self.kind[k + 1] == "{" else self.value_end(k + 1, hi), -1

    def variables(self, s: int, k: int, hi: int, exported: bool) -> int:
        """The first function or class among the declarators behind k; returns where they end."""
        found = None
        while True:
            k += 1
            name = self.text[self.t.start[k] : self.place(self.after(k))] if k < hi else ""
            k = self.after(k)
            k += self.kind[k] == "!"
            if self.kind[k] == ":":
                k = self.type_end(k + 1, hi)
            if self.kind[k] == "=":
                value, end = self.value(k + 1, hi), self.value_end(k + 1, hi)
                if found is None and value and value[1] == end:
                    found = (name, k + 1, *value)
                k = end
            if self.kind[k] != "," or k >= hi:
                break
        end = k + (self.kind[k] == ";")
        if found:
            name, v, kind, stop, cls = found
            if cls >= 0:
                self.named[cls] = name
            self.add(kind, name, s if exported else v, end if exported else stop)
        return end

    def add(self, kind: str, name: str, first: int, behind: int) -> None:
        self.out.append(Piece(kind, f"{kind}::{name}", self.t.start[first], self.place(behind)))

    def declaration(self, s: int, hi: int) -> int | None:
        """Where the declaration that starts at s ends, None if there is none."""
        k = self.decorators(s)
        exported = default = False
        if self.kind[k] == "export":
            exported, k = True, k + 1
            if self.kind[k] == "default":
                default, k = True, k + 1
            k = self.decorators(k)
        if self.kind[k] == "declare" and self.kind[k + 1] in _DECLARED and not self.fresh(k + 1):
            k += 1
        if self.kind[k] == "abstract" and self.kind[k + 1] == "class":
            k += 1
        if self.kind[k] == "async" and self.kind[k + 1] == "function":
            k += 1
        c = self.kind[k]
        follows = self.is_word(k + 1) and not self.fresh(k + 1)
        if c == "function":
            name, end, body = self.function(k, hi)
            if body and (name or default):
                self.add("function", name or "default", s, end)
            return end
        if c == "class":
            name, opened = self.head(k, hi)
            if opened < 0:
                return None
            self.named[k] = name = name or ("default" if default else f"anonymous_L{self.lines.of(self.t.start[s])}")
            self.add("class", name, s, self.after(opened))
            return self.after(opened)
        if c == "interface" and follows:
            name, opened = self.head(k, hi)
            if opened < 0:
                return None
            self.add("interface", name, s, self.after(opened))
            return self.after(opened)
        if c == "const" and self.kind[k + 1] == "enum":
            k, c, follows = k + 1, "enum", self.is_word(k + 2)
        if c == "enum" and follows and self.kind[k + 2] == "{":
            self.add("enum", self.kind[k + 1], s, self.after(k + 2))
            return self.after(k + 2)
        if c in ("namespace", "module") and (follows or self.kind[k + 1] == "s"):
            end = k + 2
            while self.kind[end] == "." and self.is_word(end + 1):
                end += 2
            if self.kind[end] != "{":
                return None
            self.add("namespace", self.text[self.t.start[k + 1] : self.place(end)], s, self.after(end))
            return self.after(end)
        if c == "type" and follows:
            end = self.angle(k + 2, hi) if self.kind[k + 2] == "<" else k + 2
            if self.kind[end] != "=":
                return None
            end = self.type_end(end + 1, hi)
            end += self.kind[end] == ";"
            self.add("type", self.kind[k + 1], s, end)
            return end
        if c in ("const", "let", "var") and not default:
            return self.variables(s, k, hi, exported)
        return None

    def starts(self, k: int) -> bool:
        return k == 0 or self.kind[k - 1] in (";", "}") or self.fresh(k) and self.ends_before(k)

    def top(self) -> None:
        k = 0
        while k < self.n:
            end = self.declaration(k, self.n) if self.starts(k) else None
            k = max(end, k + 1) if end is not None else self.after(k)

    def decorated(self, p: int) -> bool:
        """Whether the token p ends a decorator."""
        if self.kind[p] == ")":
            p = self.back.get(p, 0) - 1
        while p > 0 and (self.is_word(p) or self.kind[p] == "."):
            p -= 1
        return self.kind[p] == "@"

    def methods(self) -> None:
        """Functions with a body that are members of a class, or of an object within one."""
        self.back = {b: a for a, b in self.t.match.items()}
        classes: dict[int, str] = {}  # opening brace -> name
        around: list[int] = []
        for i in range(self.n):
            c = self.kind[i]
            if c == "class" and self.kind[i - 1] not in (".", "?.") and (self.is_word(i + 1) or self.kind[i + 1] in ("{", "<")):
                name, opened = self.head(i, self.n)
                if opened >= 0:
                    classes[opened] = self.named.get(i) or name or f"anonymous_L{self.lines.of(self.t.start[i])}"
            if i in self.back and around and around[-1] == self.back[i]:
                around.pop()
            if c == "(" and around and (held := [x for x in around if x in classes]):
                self.method(i, around[-1], classes[held[-1]], around[-1] in classes)
            if i in self.t.match:
                around.append(i)

    def method(self, i: int, inside: int, container: str, member: bool) -> None:
        j = i - 1
        if self.kind[j] == ">":
            depth = 0
            while j > inside:
                depth += (self.kind[j] == ">") - (self.kind[j] == "<")
                if depth == 0:
                    break
                j = self.back.get(j, j) - 1
            j -= 1
        j -= self.kind[j] == "?"
        first = self.back.get(j, j) if self.kind[j] == "]" else j
        if first <= inside or not (self.is_word(j) or self.kind[j] in ("]", "s")) or not member and self.kind[j] in _CONTROL:
            return
        name = self.text[self.t.start[first] : self.t.end[j]]
        while first - 1 > inside and (self.kind[first - 1] in _MODIFIERS or self.kind[first - 1] == "*"):
            if self.kind[first - 1] != "*" and self.decorated(first - 1):
                break
            first -= 1
        before = first - 1
        if member:
            fits = before == inside or self.kind[before] in (";", "}") or self.fresh(first) and self.kind[before] not in ("=", ",") or self.decorated(before)
        else:
            fits = self.kind[inside] == "{" and (before == inside or self.kind[before] == ",")
        k = self.after(i)
        if fits and self.kind[k] == ":":
            k = self.type_end(k + 1, self.n)
        if fits and self.kind[k] == "{":
            self.out.append(Piece("method", f"class::{container}::method::{name}", self.t.start[first], self.place(self.after(k))))


def script(text: str, jsx: bool = True) -> list[Piece]:
    """Top-level declarations of a script, and the methods of its classes at any depth.

    A function or class that is the whole value of a variable is its value alone, or with `export` the
    statement. Signatures without a body are none. jsx: whether `<` may open an element."""
    reader = _Reader(text, jsx)
    reader.top()
    reader.methods()
    return reader.out
