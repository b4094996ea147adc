"""Reading source text inside a task: imports, tags with their attributes, and putting edited tags back.

One pass over the characters with a stack of contexts (code, a tag being read,
children of an element, a template literal), so braces and elements nest to any
depth without recursion, and strings, comments, template literals, regular
expressions and type arguments are told apart from markup.  Time is linear in the
length of the text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from functools import lru_cache
from math import isinf

from tagloom.functions.patterns import EMPTY_EXPRESSION, EXPRESSION_KINDS, NAMED_EXPRESSION_KINDS, OTHER_EXPRESSION

_NAME = r"[A-Za-z_$][\w$-]*(?:[.:][A-Za-z_$][\w$-]*)*"
_CODE = re.compile(r"""[{}"'`/<]|\bimport\b""", re.A)
_STRING = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\[\s\S])*{q}") for q in "\"'"}
_REGEX = re.compile(r"/(?:[^/\\\n\[*]|\\.|\[(?:[^\]\\\n]|\\.)*\])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])*/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?:[(,=:\[!&|?{};+\-*%~^<>]|\b(?:return|typeof|case|in|of|delete|void))\s*$")
_OPENS = re.compile(f"<({_NAME})", re.A)
_CLOSES = re.compile(rf"</({_NAME})?\s*>", re.A)
_BEFORE_TAG = re.compile(r"[\w$)\]]$", re.A)
_WORD_BEFORE_TAG = re.compile(r"\b(?:return|case|default|yield|await|else|do)$")
_CHILDREN = re.compile(r"[<{]")
_TEMPLATE = re.compile(r"\\[\s\S]|`|\$\{")
_BLANK = re.compile(r"(?:\s|/\*[\s\S]*?\*/|//[^\n]*)*")
_ATTRIBUTE = re.compile(r"([A-Za-z_$@:][\w$@:.-]*)", re.A)
_EQUALS = re.compile(r"\s*=\s*")
#: An attribute that needs no context: a bare name, a quoted value, or braces without anything that could open another one.
_PLAIN = re.compile(r"""\s*([A-Za-z_$@:][\w$@:.-]*+)(?:\s*=\s*("[^"]*"|'[^']*'|\{[^{}"'`/<]*\})|(?!\s*=))""", re.A)
_SIMPLE = re.compile(r"[A-Za-z_$][\w$-]*", re.A)
_QUOTED = {'"': re.compile('"[^"]*"'), "'": re.compile("'[^']*'")}
_BARE = re.compile(r"""[^\s"'{}<>=`]+?(?=\s|/?>|$)""")
_TYPES = re.compile(r"<[^<>(){}]*(?:<[^<>(){}]*>[^<>(){}]*)*>")
_COMMENT = r"/\*[\s\S]*?\*/|//[^\n]*\n"
_CLAUSE = re.compile(rf"\s+|{_COMMENT}|[\w$]+|[*{{}},]", re.A)
_SOURCE = re.compile(r"\s*(?:\"([^\"\n]+)\"|'([^'\n]+)')[ \t]*;?")
_STATEMENT_START = re.compile(r"(?:^|[;\n}]|\*/)[ \t]*$")
_ANY = r"[A-Za-z0-9_$]+"


class Scan:
    """What one text holds.

    ``imports``: (start, stop, package, default, namespace, named parts).
    ``tags``: [name, pos, kind, start, stop, close_start, close_stop, attrs],
    attrs being (name, source, start, stop); a spread has no name, an attribute
    without a value no source.  ``unread``: names of tags whose attributes could
    not be read.
    """

    def __init__(self, code: str):
        self.code = code
        self.imports: list[tuple] = []
        self.tags: list[list] = []
        self.unread: list[str] = []
        self.tokens = 0
        self._run()

    def _comment(self, start: int) -> int | None:
        """The end of a comment that starts here."""
        if self.code.startswith("/*", start):
            stop = self.code.find("*/", start + 2)
        elif self.code.startswith("<!--", start):
            stop = self.code.find("-->", start + 4)
            stop = stop + 1 if stop >= 0 else stop
        elif self.code.startswith("//", start):
            stop = self.code.find("\n", start)
            self.tokens += 1
            return len(self.code) if stop < 0 else stop
        else:
            return None
        self.tokens += 1
        return len(self.code) if stop < 0 else stop + 2

    def _open(self, stack: list[list], name: str, tag: list | None) -> None:
        """Begin the children of an element; the elements open in one stretch of markup share a count of their names."""
        names = stack[-1][3] if stack[-1][0] == "children" else {}
        names[name] = names.get(name, 0) + 1
        stack.append(["children", name, tag, names])

    def _close(self, stack: list[list], name: str, start: int, stop: int) -> None:
        """Pop to the element that this tag closes, if one is open in this stretch of markup."""
        top = stack[-1]
        if top[0] == "children" and top[3].get(name):
            while True:
                _, opened, tag, names = stack.pop()
                names[opened] -= 1
                if opened == name:
                    if tag is not None:
                        tag[5], tag[6] = start, stop
                    break
        if _SIMPLE.fullmatch(name):
            self.tokens += 1

    def _run(self) -> None:
        code, size, i = self.code, len(self.code), 0
        # frames: [code, open braces] | [children, name, tag, names open in this stretch] | [template] | [tag, name, tag, simple, attribute start, attribute name]
        stack: list[list] = [["code", 0]]
        while i < size:
            frame = stack[-1]
            mode = frame[0]
            if mode == "tag":
                i = self._in_tag(stack, frame, i)
                continue
            if mode == "template":
                found = _TEMPLATE.search(code, i)
                if not found:
                    return self._end(stack)
                i = found.end()
                if found[0] == "`":
                    stack.pop()
                elif found[0] == "${":
                    stack.append(["code", 0])
                continue
            found = (_CODE if mode == "code" else _CHILDREN).search(code, i)
            if not found:
                return self._end(stack)
            at, char = found.start(), found[0][0]
            if char == "<":
                i = self._at_angle(stack, mode, at)
            elif mode == "children":  # a brace in the text of an element
                stack.append(["code", 0])
                i = at + 1
            elif char == "{":
                frame[1] += 1
                i = at + 1
            elif char == "}":
                i = at + 1
                if frame[1]:
                    frame[1] -= 1
                elif len(stack) > 1:
                    stack.pop()
                    if stack[-1][0] == "tag":
                        self._attribute(stack[-1], i)
            elif char in "\"'":
                string = _STRING[char].match(code, at)
                i = string.end() if string else at + 1
            elif char == "`":
                stack.append(["template"])
                i = at + 1
            elif char == "/":
                end = self._comment(at)
                if end is None:
                    regex = _REGEX.match(code, at) if _BEFORE_REGEX.search(code, max(0, at - 12), at) or (at < 12 and not code[:at].strip()) else None
                    end = regex.end() if regex else at + 1
                i = end
            else:
                i = self._import(at, frame, len(stack)) or found.end()
        self._end(stack)

    def _end(self, stack: list[list]) -> None:
        self.unread.extend(frame[1] for frame in stack if frame[0] == "tag")
        self.tags = [t for t in self.tags if t[2]]

    def _at_angle(self, stack: list[list], mode: str, at: int) -> int:
        code = self.code
        if code.startswith("</", at):
            found = _CLOSES.match(code, at)
            if not found:
                return at + 2
            self._close(stack, found[1] or "", at, found.end())
            return found.end()
        if code.startswith("<!--", at):
            return self._comment(at)
        if mode == "code" and _BEFORE_TAG.search(code, max(0, at - 1), at) and not _WORD_BEFORE_TAG.search(code, max(0, at - 10), at):
            return at + 1  # a comparison or type arguments
        if code.startswith("<>", at):
            self._open(stack, "", None)
            return at + 2
        found = _OPENS.match(code, at)
        if not found:
            return at + 1
        end = found.end()
        types = _TYPES.match(code, end) if code.startswith("<", end) else None
        end = types.end() if types else end
        if not (code[end : end + 1].isspace() or code.startswith((">", "/>"), end)):
            return end
        simple = bool(_SIMPLE.fullmatch(found[1]))
        tag = [found[1], self.tokens, "", at, 0, None, None, []]
        if simple:
            self.tags.append(tag)
            self.tokens += 1
        stack.append(["tag", found[1], tag, simple, None, None])
        return end

    def _attribute(self, frame: list, stop: int) -> None:
        """The attribute whose value or spread in braces ends here."""
        start, name = frame[4], frame[5]
        source = self.code[frame[6] : stop] if name else None
        frame[2][7].append((name or "", source, start, stop))
        del frame[6:]
        frame[4] = frame[5] = None

    def _in_tag(self, stack: list[list], frame: list, i: int) -> int:
        code, attrs = self.code, frame[2][7]
        while plain := _PLAIN.match(code, i):
            attrs.append((plain[1], plain[2], plain.start(1), plain.end()))
            i = plain.end()
        i = _BLANK.match(code, i).end()
        if code.startswith("/>", i) or code.startswith(">", i):
            closed = code[i] == "/"
            stop, tag = i + (2 if closed else 1), frame[2]
            if tag[7] and tag[7][0][:2] == ("extends", None):  # type parameters of an arrow function
                self._drop(frame)
                stack.pop()
                return stop
            tag[2], tag[4] = "self" if closed else "open", stop
            stack.pop()
            if not closed:
                self._open(stack, frame[1], tag if frame[3] else None)
            return stop
        if code.startswith("{", i):
            frame[4:] = [i, None, i]
            stack.append(["code", 0])
            return i + 1
        name = _ATTRIBUTE.match(code, i)
        if name:
            equals = _EQUALS.match(code, name.end())
            if not equals:
                frame[2][7].append((name[1], None, i, name.end()))
                return name.end()
            at = equals.end()
            if code.startswith("{", at):
                frame[4:] = [i, name[1], at]
                stack.append(["code", 0])
                return at + 1
            value = _QUOTED[code[at]].match(code, at) if code[at : at + 1] in ('"', "'") and at < len(code) else _BARE.match(code, at)
            if value:
                frame[2][7].append((name[1], value[0], i, value.end()))
                return value.end()
        # not a tag after all, or one that cannot be read
        if any(a[1] is not None or not a[0] for a in frame[2][7]):
            self.unread.append(frame[1])
        self._drop(frame)
        stack.pop()
        return max(i, frame[2][3] + 1)

    def _drop(self, frame: list) -> None:
        frame[2][2] = ""  # no kind: left out at the end

    def _import(self, at: int, frame: list, depth: int) -> int | None:
        if depth > 1 or frame[1] or not _STATEMENT_START.search(self.code, max(0, at - 80), at):
            return None
        read = self._clause(at + len("import"))
        if read is None:
            return None
        clause, source = read
        words = clause.split(None, 1)
        is_type = len(words) == 2 and words[0] == "type"
        body = words[1] if is_type else clause
        default = re.match(rf"\s*({_ANY})", body)
        space = re.search(rf"\*\s*as\s+({_ANY})", body)
        braces = re.search(r"\{([^}]*)\}", body)
        named = [re.sub(r"^\s*type\s+", "", part).strip() for part in braces[1].split(",")] if braces else []
        self.imports.append((at, source.end(), source[1] or source[2], default[1] if default else "", space[1] if space else "", [p for p in named if p], is_type))
        return source.end()

    def _clause(self, at: int) -> tuple[str, re.Match] | None:
        """What stands between ``import`` and ``from``, without comments, and the package; token by token, so no blank is read twice."""
        parts: list[str] = []
        if not self.code[at : at + 1].isspace():
            return None
        while token := _CLAUSE.match(self.code, at):
            word, at = token[0], token.end()
            if word == "import":  # a reserved word: an earlier statement broke off
                return None
            if word == "from" and any(not p.isspace() for p in parts):
                source = _SOURCE.match(self.code, at)
                if source:
                    return "".join(parts).strip(), source
            parts.append(" " if word.startswith("/") else word)
        return None


_KINDS = [(starts, [(re.compile(p, re.A), result) for p, result in kinds]) for starts, kinds in EXPRESSION_KINDS]
_NAMED_KINDS = [(re.compile(p, re.A), result) for p, result in NAMED_EXPRESSION_KINDS]
_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*)?\.?[0-9][0-9_]*(?:[eE][+-]?[0-9]+)?)$")
_ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _number(text: str) -> str | None:
    """A numeric literal as its value is printed; None if it is none after all."""
    text = text.replace("_", "")
    try:
        value = float(int(text, 0) if text[:2].lower() in ("0x", "0b", "0o") else text)
        if isinf(value):
            return "Infinity"
        if value < 1e21 and value == int(value):
            return str(int(value))
        return repr(value)
    except OverflowError:  # above the largest number
        return "Infinity"
    except ValueError:
        return None


def expression_text(expression: str) -> str:
    """Literals, names and members as text, any other expression as its kind."""
    if not expression:
        return EMPTY_EXPRESSION
    if _NUMBER.match(expression):
        return _number(expression) or OTHER_EXPRESSION
    kinds = next((kinds for starts, kinds in _KINDS if expression[0] in starts), _NAMED_KINDS)
    for pattern, result in kinds:
        found = pattern.search(expression)
        if found:
            return result.replace("\\1", found[1]) if "\\1" in result else result
    return OTHER_EXPRESSION


def value_text(source: str | None) -> str:
    """An attribute's value as it is recorded; short ones are remembered."""
    return _value_text(source) if source is None or len(source) > 100 else _short_value(source)


def _value_text(source: str | None) -> str:
    if source is None:
        return "true"
    if source[0] == "{":
        return expression_text(source[1:-1].strip(" \t\r\n"))
    if source[0] in "\"'":
        return _ENTITY.sub(lambda m: html.unescape(m[0]), source[1:-1])
    return source


_short_value = lru_cache(4096)(_value_text)


def attributes(code: str, attrs: list[tuple]) -> list[tuple]:
    """Attributes as rows: name, value, kind, raw, start, stop."""
    rows = []
    for name, source, start, stop in attrs:
        kind = "spread" if not name else "shorthand" if source is None else "expr" if source[0] == "{" else "text"
        rows.append((name, value_text(source), kind, code[start:stop], start, stop))
    return rows


def specifiers(scan: Scan) -> list[tuple]:
    """Import specifiers in text order: package, pos, specifier_type, import_type, import_stm, local_name, imported_name."""
    rows: list[tuple] = []

    def add(package: str, statement: str, kind: str, import_type: str | None, local: str, imported: str | None) -> None:
        rows.append((package, len(rows), kind, import_type, statement, local, imported))

    for start, stop, package, default, space, named, _ in scan.imports:
        statement = scan.code[start:stop].strip(" \t\r\n").replace(",\n}", " }").replace("\n  ", " ")
        if default:
            add(package, statement, "ImportDefaultSpecifier", "default", default, "default")
        if space:
            add(package, statement, "ImportNamespaceSpecifier", None, space, None)
        for part in named:
            add(package, statement, "ImportSpecifier", "named", re.search(rf"({_ANY})$", part)[1], re.match(_ANY, part)[0])
    return rows


def line_starts(code: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", code))]


def place(starts: list[int], at: int) -> tuple[int, int]:
    """Line from 1, column from 0."""
    line = bisect_right(starts, at)
    return line, at - starts[line - 1]


# ---- putting edits back ----

MARK = "\0"
_MARKED = re.compile(f"{MARK}(\\d+):(\\d+){MARK}")


def without_statement(code: str, start: int, stop: int) -> tuple[int, int, str]:
    """The edit that takes a statement out together with its line, if it has the line to itself."""
    begin = start
    while begin and code[begin - 1] in " \t":
        begin -= 1
    end = stop
    while end < len(code) and code[end] in " \t":
        end += 1
    alone = (begin == 0 or code[begin - 1] == "\n") and (end == len(code) or code[end] == "\n")
    if not alone:
        return start, stop, ""
    if begin:
        return begin - 1, end, ""
    return begin, min(end + 1, len(code)), ""


def pruned_statement(code: str, entry: tuple, spec: dict) -> tuple[int, int, str] | None:
    """The edit that takes the specifier out of an import statement; None if it is not in there."""
    start, stop, package, default, space, named, is_type = entry
    if package != spec["package"]:
        return None
    kept, left = named, default
    if spec["import_type"] == "default" and default == spec["local_name"]:
        left = ""
    elif spec["import_type"] == "named":
        kept = [p for p in named if re.match(_ANY, p)[0] != spec["local_name"]]
    if left == default and len(kept) == len(named):
        return None
    parts = [left] * bool(left) + ([f"* as {space}"] if space else []) + (["{ " + ", ".join(kept) + " }"] if kept else [])
    if not parts:
        return without_statement(code, start, stop)
    tail = re.search(r"from\s*[\"'][^\"']+[\"'][ \t]*;?$", code[start:stop])[0]
    return start, stop, f"import {'type ' if is_type else ''}{', '.join(parts)} {tail}"


def import_edits(code: str, imports: list[tuple], spec: dict, component: str, targets: list[str]) -> tuple[list[tuple[int, int, str]], str]:
    """Edits that move a specifier, and the lines to put at the top; ``imports`` are those of the text's :class:`Scan`."""
    if not targets:
        return [], ""
    edits = [e for e in (pruned_statement(code, entry, spec) for entry in imports) if e]
    missing = [to for to in targets if not any(entry[2] == to and entry[5] for entry in imports)]
    return edits, "".join(f'import {{ {component} }} from "{to}";\n' for to in reversed(missing))


def spliced(code: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with ranges replaced.

    A replacement may name ranges of the text between marks; these show the
    text as edited there.  Ranges nest or are apart.
    """
    done: list[tuple[int, int, str]] = []  # the last has the smallest start

    def show(start: int, stop: int, inside: list[tuple[int, int, str]]) -> str:
        parts, at = [], start
        for begin, end, text in inside:
            if begin >= at and end <= stop:
                parts += [code[at:begin], text]
                at = end
        parts.append(code[at:stop])
        return "".join(parts)

    for start, stop, text in sorted(edits, key=lambda e: (e[0], -e[1]), reverse=True):
        inside = []
        while done and done[-1][0] < stop:
            inside.append(done.pop())
        if inside:
            text = _MARKED.sub(lambda m, held=inside: show(int(m[1]), int(m[2]), held), text)
        elif MARK in text:
            text = _MARKED.sub(lambda m: code[int(m[1]) : int(m[2])], text)
        done.append((start, stop, text))
    return show(0, len(code), done[::-1])
