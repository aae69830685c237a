"""Source scanners: one file's text in, its declarations out. They read comments, strings and
brackets, not grammars: a declaration is where a keyword stands at the start of a statement."""

from __future__ import annotations

import re

from .scripts import Lines, Piece, script, silent_script

MIN_RULE_CHARS = 80


_QUIET = {
    "go": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'|`[^`]*`?",
    "rust": r"//[^\n]*|/\*.*?(?:\*/|\Z)|r(?P<h>\#*)\".*?\"(?P=h)|\"(?:\\.|[^\"\\])*\"?|'(?:\\[^'\n]*|[^'\\\n])'",
    "sharp": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\$?@\$?\"(?:\"\"|[^\"])*\"?|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'",
    "c": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?",
    "java": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?",
    "php": r"//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?",
    "css": r"/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?",
    "scss": r"(?<!:)//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?",
    "hash": r"\#[^\n]*|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?",
    "sql": r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:''|[^'])*'?",
}
_QUIET = {k: re.compile(v, re.S) for k, v in _QUIET.items()}


def _blank(part: str) -> str:
    return re.sub(r"[^\n]", " ", part)


def silent(text: str, style: str) -> str:
    """The text with comments and strings blanked out; places and lines stay."""
    return silent_script(text) if style == "script" else _QUIET[style].sub(lambda m: _blank(m[0]), text)


def closing(text: str, place: int, pair: str = "{}") -> int:
    """Place of the bracket that closes the one at `place`, or -1."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(text, place):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.start()
    return -1


#: Words before a bracket that name no method.
_WORDS = frozenset("if for while switch catch return function new typeof await super else do try with throw delete".split())


_PHP = re.compile(r"(?:^|(?<=[;{}\s]))(?:(?:abstract|final|readonly)\s+)*(?P<kind>class|trait|interface|enum|function|namespace)\s+&?\s*(?P<name>[A-Za-z_\\][\w\\]*)", re.M)
_PHP_METHOD = re.compile(r"(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?\s*(?P<name>\w+)\s*\(")


def php(text: str) -> list[Piece]:
    """PHP: declarations at the top or in a braced namespace, and methods of classes, traits, enums."""
    first = re.search(r"<\?(?:php|=)?", text)
    if first is None:
        return []
    quiet = silent(text, "php")
    quiet = re.sub(r"\A.*?<\?(?:php|=)?|\?>.*?(?:<\?(?:php|=)?|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), quiet, flags=re.S)
    out: list[Piece] = []

    def walk(lo: int, hi: int) -> None:
        at = lo
        while m := _PHP.search(quiet, at, hi):
            start = m.start()
            opened = re.compile(r"[{;]").search(quiet, m.end(), hi)
            if opened is None:
                return
            if opened[0] == ";":
                at = opened.end()
                continue
            end = closing(quiet, opened.start())
            if end < 0 or end >= hi:
                return
            if m["kind"] == "namespace":
                walk(opened.end(), end)
            else:
                out.append(Piece(m["kind"], f"{m['kind']}::{m['name']}", start, end + 1))
                if m["kind"] in ("class", "trait", "enum"):
                    inner = opened.end()
                    while f := _PHP_METHOD.search(quiet, inner, end):
                        paren = closing(quiet, f.end() - 1, "()")
                        body = re.compile(r"[{;]").search(quiet, paren + 1, end) if paren >= 0 else None
                        if body is None:
                            break
                        stop = closing(quiet, body.start()) if body[0] == "{" else body.start()
                        out.append(Piece("method", f"{m['kind']}::{m['name']}::method::{f['name']}", f.start(), stop + 1))
                        inner = stop + 1
            at = end + 1

    walk(0, len(quiet))
    return out


_JAVA_BODY = re.compile(r"(?P<at>@\s*)?\b(?P<kind>class|interface|enum|record)\s+(?P<name>[A-Za-z_$][\w$]*)|\bnew\s+[A-Za-z_$][\w$.]*\s*(?:<[^;(){}]*>)?\s*(?=\()")
_JAVA_METHOD = re.compile(r"(?:^|[\s>\]])(?P<name>[A-Za-z_$][\w$]*)\s*\Z")
_ANNOTATION = re.compile(r"@\s*(?!interface\b)[A-Za-z_$][\w$.]*\s*")


def _members(quiet: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(start, end of the head, end) of what stands between two places of Java, up to its semicolon or
    its own braces; a head ends before either."""
    out, at, begin = [], lo, None
    while at < hi:
        c = quiet[at]
        if begin is None and not c.isspace() and c not in ";}":
            begin = at
        if c == "(":
            shut = closing(quiet, at, "()")
            at = hi if shut < 0 else shut + 1
            continue
        if c in "{;":
            shut = closing(quiet, at) if c == "{" else at
            shut = hi - 1 if shut < 0 else shut
            # an array or a lambda goes on to its semicolon
            if c == "{" and begin is not None and "=" in re.sub(r"\([^()]*\)", "", quiet[begin:at]):
                at = shut + 1
                continue
            if begin is not None:
                out.append((begin, at, shut + 1))
            begin, at = None, shut
        at += 1
    return out


def _plain_head(head: str) -> str:
    """A head without its annotations and their arguments; places do not matter any more."""
    while m := _ANNOTATION.search(head):
        end = m.end()
        if head.startswith("(", end):
            shut = closing(head, end, "()")
            end = len(head) if shut < 0 else shut + 1
        head = head[: m.start()] + " " + head[end:]
    return head


def java(text: str) -> list[Piece]:
    """Java: top-level classes, interfaces and enums with their annotations, and methods whose nearest
    class is the container, those of its interfaces, enums and nameless classes included. Constructors,
    records and annotation types are none."""
    quiet, out = silent(text, "java"), []
    for start, head, end in _members(quiet, 0, len(quiet)):
        m = re.search(r"(?<![\w$@.])(class|interface|enum)\s+([A-Za-z_$][\w$]*)", _plain_head(quiet[start:head]))
        if m and quiet[head : head + 1] == "{" and not re.search(r"@\s*interface\b|\brecord\s+\w+\s*[(<]", quiet[start:head]):
            out.append(Piece(m[1], f"{m[1]}::{m[2]}", start, end))
    bodies = []
    for m in _JAVA_BODY.finditer(quiet):
        at = m.end()
        if m["kind"] is None:
            shut = closing(quiet, at, "()")
            found = re.compile(r"\s*\{").match(quiet, shut + 1) if shut >= 0 else None
            opened = found.end() - 1 if found else -1
        else:
            found = re.compile(r"[{;=]").search(quiet, at)
            opened = found.start() if found and found[0] == "{" and not m["at"] else -1
        if opened >= 0:
            shut = closing(quiet, opened)
            bodies.append((opened, len(quiet) if shut < 0 else shut, m["kind"], m["name"]))
    classes = [b for b in bodies if b[2] == "class"]
    for opened, shut, kind, _ in bodies:
        held = [c for c in classes if c[0] <= opened and shut <= c[1]]
        if not held:
            continue
        container = max(held)[3]
        first = opened + 1
        if kind == "enum":  # its constants come first; bodies of theirs are not looked into
            at = next((h for s, h, e in _members(quiet, first, shut) if quiet[h] == ";"), shut)
            first = at + 1
        for start, head, end in _members(quiet, first, shut):
            plain = _plain_head(quiet[start:head])
            paren = plain.find("(")
            m = _JAVA_METHOD.search(plain[: max(paren, 0)])
            if m is None or "=" in plain[:paren] or not re.search(r"[\w>\]]\s+\Z", plain[: m.start("name")]) or plain[: m.start("name")].split()[-1] in ("public", "private", "protected", "new", "return", "throw", "else"):
                continue
            out.append(Piece("method", f"class::{container}::method::{m['name']}", start, end))
    return out


_SQL = re.compile(r"\bcreate\s+(?:or\s+replace\s+)?(?:definer\s*=\s*\S+\s+)?(?P<kind>function|procedure|trigger)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w\"`\[\]]+(?:\s*\.\s*[\w\"`\[\]]+)*)", re.I)


def sql(text: str) -> list[Piece]:
    """SQL: functions, procedures and triggers, named with their schema. A body between dollar
    quotes or BEGIN and END is part of it; one that does not close is left out."""
    dollars = [(m.start(), m.end()) for m in re.finditer(r"\$(\w*)\$.*?\$\1\$", text, re.S)]
    quiet = list(silent(text, "sql"))
    for a, b in dollars:
        quiet[a:b] = re.sub(r"[^\n]", " ", "".join(quiet[a:b]))
    quiet = "".join(quiet)
    out = []
    for m in _SQL.finditer(quiet):
        inside = next((b for a, b in dollars if a > m.start() and ";" not in quiet[m.end() : a]), None)
        if inside is None:
            depth, end = 0, None
            for w in re.compile(r"\b(?:begin|case|end(?:\s+(?:if|loop|case|while|repeat))?)\b|;", re.I).finditer(quiet, m.end()):
                x = w[0].lower()
                if x == ";":
                    if depth == 0:
                        end = w.start()
                        break
                elif x in ("begin", "case"):
                    depth += 1
                elif x == "end" or x.endswith("case"):
                    depth -= 1
                    if depth < 0:
                        break
            if end is None and (depth != 0 or not quiet[m.end() :].strip()):
                continue
            end = len(quiet.rstrip()) if end is None else end
        else:
            stop = quiet.find(";", inside)
            end = len(quiet.rstrip()) if stop < 0 else stop
        name = re.sub(r"\s*\.\s*", ".", re.sub(r"[\"`\[\]]", "", m["name"]))
        out.append(Piece("function", f"function::{name}", m.start(), end))
    return out


def _selectors(parent: str | None, child: str) -> str:
    """The selector of a rule inside another: & stands for the parent, else the parent goes before."""
    one = lambda s: re.sub(r"\s+", " ", s).strip()
    child = re.sub(r"&\s+([_-])", r"&\1", one(child))
    if not parent:
        return child
    parents, out = [one(p) for p in parent.split(",") if one(p)], []
    for c in [one(c) for c in child.split(",") if one(c)]:
        for p in parents:
            out.append(one(c.replace("&", p) if "&" in c else p + c if c[0] in "-_" else f"{p} {c}"))
    return ", ".join(out)


def styles(text: str, scss: bool, least: int = MIN_RULE_CHARS) -> list[Piece]:
    """CSS and SCSS: rules of at least `least` characters with nested selectors joined, at-rules, and
    SCSS mixins and functions."""
    quiet = silent(text, "scss" if scss else "css")
    out: list[Piece] = []

    def walk(lo: int, hi: int, parent: str | None) -> None:
        at = lo
        while at < hi:
            m = re.compile(r"[{};]").search(quiet, at, hi)
            if m is None:
                return
            head = quiet[at : m.start()]
            start = at + len(head) - len(head.lstrip())
            head = head.strip()
            if m[0] == "}":
                at = m.end()
                continue
            if m[0] == ";":
                end = m.end()
                if head.startswith("@") and not head.startswith(("@function", "@mixin", "@return")):
                    out.append(Piece("at_rule", f"at_rule::{re.sub(r'\s+', ' ', text[start : m.start()]).strip()}", start, end))
                at = end
                continue
            if quiet[m.start() - 1 : m.start()] == "#":  # interpolation
                stop = closing(quiet, m.start())
                nxt = re.compile(r"[{;}]").search(quiet, stop + 1, hi) if stop >= 0 else None
                while nxt is not None and quiet[nxt.start() - 1] == "#":
                    stop = closing(quiet, nxt.start())
                    nxt = re.compile(r"[{;}]").search(quiet, stop + 1, hi) if stop >= 0 else None
                if nxt is None or nxt[0] != "{":
                    at = hi if nxt is None else nxt.end()
                    continue
                m = nxt
                head = quiet[start : m.start()].strip()
            end = closing(quiet, m.start())
            if end < 0 or end > hi:
                return
            name = text[start : m.start()].strip()
            if head.startswith("@"):
                if not head.startswith(("@function", "@mixin", "@return")):
                    out.append(Piece("at_rule", f"at_rule::{re.sub(r'\s+', ' ', name)}", start, end + 1))
                walk(m.end(), end, parent)
            else:
                full = _selectors(parent, name)
                if end + 1 - start >= least:
                    out.append(Piece("rule", f"rule::{full}", start, end + 1))
                walk(m.end(), end, full)
            at = end + 1

    walk(0, len(quiet), None)
    if scss:
        for kind in ("mixin", "function"):
            for m in re.finditer(rf"@{kind}\s+([\w-]+)\s*\(", quiet):
                opened = quiet.find("{", m.start())
                end = closing(quiet, opened) if opened >= 0 else -1
                if end >= 0:
                    out.append(Piece(kind, f"{kind}::{m[1]}", m.start(), end + 1))
    return out


# Elements that are chunks, and the attribute that names each.
XML_INJECTION = {"plugin": "name", "preference": "for", "type": "name", "virtualType": "name"}
XML_LAYOUT = {"block": "name", "referenceBlock": "name", "referenceContainer": "name"}
_LAYOUT = re.compile(r"(?:^|/)view/(?:frontend|adminhtml|base)/layout/[^/]+\.xml$")


def xml(text: str, path: str) -> list[Piece]:
    """XML: named elements of injection and layout files; tags that do not match give none."""
    named = XML_INJECTION if path.rsplit("/", 1)[-1] == "di.xml" else XML_LAYOUT if _LAYOUT.search(path) else None
    if named is None:
        return []
    quiet = re.sub(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    out, stack = [], []
    for m in re.finditer(r"<(?P<end>/?)(?P<tag>[^\s/>?!]+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<self>/?)>", quiet):
        tag = m["tag"]
        if not m["end"]:
            values = {a[0]: a[1][1:-1] for a in re.findall(r"([^\s=/>]+)\s*=\s*(\"[^\"]*\"|'[^']*')", m["attrs"])}
            if not m["self"]:
                stack.append((tag, values, m.start()))
                continue
            opened = (tag, values, m.start())
        else:
            if not stack or stack[-1][0] != tag:
                return []
            opened = stack.pop()
        value = opened[1].get(named.get(tag, ""))
        if value:
            out.append(Piece("element", f"element::{tag}[{value}]", opened[2], m.end()))
    return [] if stack else out


def yaml(text: str) -> list[Piece]:
    """YAML: a block for each top-level key, up to the next."""
    keys = list(re.finditer(r"^([A-Za-z_][A-Za-z0-9_-]*):", text, re.M))
    return [Piece("block", f"block::{m[1]}", m.start(), n.start() - 1 if n else len(text)) for m, n in zip(keys, [*keys[1:], None])]


_RUBY = re.compile(r"^(?P<pad>[ \t]*)(?P<kind>class|module|def)\s+(?P<name>(?:self\.)?[\w:]+[?!=]?)", re.M)


def ruby(text: str) -> list[Piece]:
    """Ruby: classes, modules and methods, to the `end` at the same indentation."""
    quiet, out = silent(text, "hash"), []
    for m in _RUBY.finditer(quiet):
        end = re.compile(rf"^{m['pad']}end\b", re.M).search(quiet, m.end())
        one_line = re.compile(r"[^\n]*;\s*end\b").match(quiet, m.end())
        stop = one_line.end() if one_line else end.end() if end else len(quiet.rstrip())
        kind = {"def": "method"}.get(m["kind"], m["kind"])
        out.append(Piece(kind, f"{kind}::{m['name'].removeprefix('self.')}", m.start("kind"), stop))
    return out


_SHARP = re.compile(r"^[ \t]*(?:\[[^\]\n]*\]\s*)*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|virtual|override|async|extern|unsafe|new|readonly)\s+)*(?:(?P<kind>class|interface|enum)\s+(?P<name>\w+)|[\w<>\[\],.?]+\s+(?P<method>\w+)\s*(?:<[^>]*>)?\()", re.M)


def c_sharp(text: str) -> list[Piece]:
    """C#: classes, interfaces, enums and methods at any depth."""
    quiet, out = silent(text, "sharp"), []
    for m in _SHARP.finditer(quiet):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        if m["method"]:
            if m["method"] in _WORDS or re.match(r"\s*(?:return|new|else|await|throw|using|if|while|for)\b", m[0]):
                continue
            paren = closing(quiet, m.end() - 1, "()")
            body = re.compile(r"\s*(?:where[^{;]+)?(\{|=>|;)").match(quiet, paren + 1) if paren >= 0 else None
            if body is None:
                continue
            end = closing(quiet, body.end() - 1) + 1 if body[1] == "{" else quiet.find(";", paren) + 1
            if body[1] == ";" and not re.match(r"\s*(?:public|private|protected|internal|abstract|static|extern|partial)\b", m[0]):
                continue
            kind, name = "method", m["method"]
        else:
            opened = quiet.find("{", m.end())
            end = closing(quiet, opened) + 1 if opened >= 0 else 0
            kind, name = m["kind"], m["name"]
        if end > start:
            out.append(Piece(kind, f"{kind}::{name}", start, end))
    return out


_GO = re.compile(r"^func\s+(?P<name>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\(", re.M)


def go(text: str) -> list[Piece]:
    """Go: functions without a receiver."""
    quiet, out = silent(text, "go"), []
    for m in _GO.finditer(quiet):
        paren = closing(quiet, m.end() - 1, "()")
        opened = quiet.find("{", paren)
        end = closing(quiet, opened) if paren >= 0 and opened >= 0 else -1
        if end >= 0:
            out.append(Piece("function", f"function::{m['name']}", m.start(), end + 1))
    return out
