"""Regular expressions for the markup subset the library reads.

Every pattern is built by one function for both dialects in use.  Spark runs on
``java.util.regex``: there the outer loops are possessive, so they run without
recursion or backtracking however long the text is.  The SQL twins run on RE2,
which has no possessive loops and needs none.

The subset: attribute values are quoted strings, bare words, or braces nested
up to six levels; block comments, HTML comments and whole-line ``//`` comments
are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

NAME = r"[A-Za-z_$][\w$-]*"
IDENT = r"[A-Za-z_$][\w$]*"


@dataclass(frozen=True)
class Patterns:
    """The patterns of one regex dialect."""

    attribute: str
    attribute_parts: str  # the same with groups: 1 name, 2 value source; a spread has neither
    opening_tag: str
    token: str
    import_statement: str


def build_patterns(possessive: bool) -> Patterns:
    """Patterns for Java (``possessive=True``) or RE2 (``False``)."""
    many = "*+" if possessive else "*"
    inner = r"[^{}]" + many
    for _ in range(5):
        inner = r"[^{}]" + many + r"(?:\{" + inner + r"\}[^{}]" + many + ")" + many
    braces = r"\{" + inner + r"\}"
    value = r'"[^"]*"|\'[^\']*\'|' + braces + r"|[^\s\"'{}<>=`]+"
    name = r"[A-Za-z_$@:][\w$@:.-]*"
    attribute = name + r"(?:\s*=\s*(?:" + value + "))?|" + braces
    parts = "(" + name + r")(?:\s*=\s*(" + value + "))?|" + braces
    opening = "<" + NAME + r"(?:\s+(?:" + attribute + "))" + many + r"\s*/?>"
    closing = "</" + NAME + r"\s*>"
    comment = r"/\*[\s\S]*?\*/|<!--[\s\S]*?-->|(?:^|\n)[ \t]*//[^\n]*"
    clause = r"(?:type\s+)?[\w$*{},\s]+?"
    statement = (
        r"(?:^|\n)[ \t]*import\s+" + clause + r"\s*from\s*(?:\"[^\"\n]+\"|'[^'\n]+')[ \t]*;?"
    )
    return Patterns(attribute, parts, opening, "|".join([opening, closing, comment]), statement)


JAVA = build_patterns(possessive=True)
RE2 = build_patterns(possessive=False)

# How a braced attribute value is classified.  Entries are grouped by the
# characters the trimmed expression can start with, and tried from top to
# bottom inside a group: (pattern, result).  ``\\1`` in a result stands for the
# capture group.  All patterns are valid in both dialects.
_CHAIN = IDENT + r"(?:\." + IDENT + ")*"
_ARROW = (r"^(?:async\s+)?(?:\([^()]*\)|" + IDENT + r")\s*=>", "ArrowFunctionExpression")
EXPRESSION_KINDS: list[tuple[str, list[tuple[str, str]]]] = [
    ('"', [(r'^"([^"\\]*)"$', r"\1")]),
    ("'", [(r"^'([^'\\]*)'$", r"\1")]),
    (
        "0123456789",
        [(r"^0*([0-9]+)(?:\.0*)?$", r"\1"), (r"^0*([0-9]+\.[0-9]*[1-9])0*$", r"\1")],
    ),
    ("(", [_ARROW]),
    ("`", [(r"^`[^`]*`$", "TemplateLiteral")]),
    ("{", [(r"^\{[\s\S]*\}$", "ObjectExpression")]),
    ("[", [(r"^\[[^\[\]]*\]$", "ArrayExpression")]),
    ("!~+-", [(r"^[!~+-]\s*(?:" + _CHAIN + r"|[0-9.]+)$", "UnaryExpression")]),
    ("/", [(r"^/\*[\s\S]*\*/$", "JSXEmptyExpression")]),
    ("<", [(r"^<", "JSXElement")]),
]
NAMED_EXPRESSION_KINDS: list[tuple[str, str]] = [
    (r"^this$", "ThisExpression"),
    (r"^(" + IDENT + r")$", r"\1"),
    (r"^this\.(" + IDENT + r")$", r"undefined.\1"),
    (r"^(" + IDENT + r"\." + IDENT + r")$", r"\1"),
    (r"^" + _CHAIN + r"\.(" + IDENT + r")$", r"undefined.\1"),
    (r"^(" + IDENT + r"\[" + IDENT + r"\])$", r"\1"),
    (r"^(" + IDENT + r"\[)(?:\"[^\"]*\"|'[^']*'|[0-9]+)\]$", r"\1undefined]"),
    _ARROW,
    (r"^" + _CHAIN + r"\([^()]*\)$", "CallExpression"),
    (r"^" + _CHAIN + r"\?\." + IDENT + r"$", "OptionalMemberExpression"),
    (r"^(?:async\s+)?function\b", "FunctionExpression"),
]
# The most frequent braced values, recognised with their braces in one step.
SIMPLE_BRACED = r"^\{\s*(" + IDENT + r"(?:\." + IDENT + r")?|0|[1-9][0-9]*)\s*\}$"
ARROW_BRACED = r"^\{\s*(?:async\s+)?(?:\([^()]*\)|" + IDENT + r")\s*=>"
EMPTY_EXPRESSION = "JSXEmptyExpression"
OTHER_EXPRESSION = "Expression"

# Entities decoded in quoted attribute values; ``&amp;`` comes last.
ENTITIES: list[tuple[str, str]] = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
]
