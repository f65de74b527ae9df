"""JavaScript and TypeScript units: lexer, functions, bindings, fingerprints, regions.

A light front end of its own: it lexes, matches brackets and finds functions, bindings and
statements by local token patterns.  Input that doesn't lex or whose brackets don't match is
reported as invalid, never guessed at.  Offsets are in UTF-8 bytes, lines are 0-based.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from .text import KEYWORDS, MIN_FINGERPRINT_CHARS, TOKEN

_RESERVED = frozenset(KEYWORDS)
_LEX = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<name>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*|\#[A-Za-z_$][\w$]*)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<sign>=>|\?\.(?!\d)|\.\.\.|\*\*=|<<=|>>>=|>>=|&&=|\|\|=|\?\?=|===|!==|\*\*|\+\+|--|<<|>>>|>>|<=|>=|==|!=|&&|\|\||\?\?|[-+*/%&|^]=|[{}()\[\];,<>=!?:+\-*/%&|^~.@])",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_ENDS_VALUE = frozenset(")]}")
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class Invalid(ValueError):
    """Text that is no script."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def lex(source: str) -> list[Token]:
    """All tokens, white space and comments too; offsets in characters."""
    out: list[Token] = []
    at, before = 0, None
    while at < len(source):
        if source[at] == "`":
            token = Token("template", *_template(source, at))
        else:
            m = None
            value = before is not None and (before.kind in ("number", "string", "template", "regex") or (before.kind == "name" and before.text not in _RESERVED) or before.text in _ENDS_VALUE or before.text in ("this", "super"))
            if source[at] == "/" and not value and not source.startswith(("//", "/*"), at):
                m = _REGEX.match(source, at)
                if m:
                    token = Token("regex", m[0], at, m.end())
            if not m:
                m = _LEX.match(source, at)
                if not m:
                    raise Invalid(f"no token at {at}")
                token = Token(m.lastgroup, m[0], at, m.end())
        out.append(token)
        if token.kind not in ("space", "comment"):
            before = token
        at = token.end
    return out


def _template(source: str, start: int) -> tuple[str, int, int]:
    at, depth = start + 1, 0
    while at < len(source):
        c = source[at]
        if c == "\\":
            at += 1
        elif depth == 0 and c == "`":
            return source[start : at + 1], start, at + 1
        elif source.startswith("${", at):
            depth += 1
            at += 1
        elif depth and c == "{":
            depth += 1
        elif depth and c == "}":
            depth -= 1
        elif depth and c == "`":
            at = _template(source, at)[2] - 1
        at += 1
    raise Invalid("a template doesn't end")


@dataclass
class Script:
    """Significant tokens of a text, and the partner of each bracket."""

    source: str
    tokens: list[Token] = field(default_factory=list)
    partner: dict[int, int] = field(default_factory=dict)
    inside: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.tokens = [t for t in lex(self.source) if t.kind not in ("space", "comment")]
        open_: list[int] = []
        for i, t in enumerate(self.tokens):
            self.inside.append(open_[-1] if open_ else -1)
            if t.kind != "sign":
                continue
            if t.text in _CLOSE:
                open_.append(i)
            elif t.text in _ENDS_VALUE:
                if not open_ or _CLOSE[self.tokens[open_[-1]].text] != t.text:
                    raise Invalid(f"bracket at {t.start}")
                self.inside[-1] = self.inside[open_[-1]]
                self.partner[i] = open_[-1]
                self.partner[open_.pop()] = i
        if open_:
            raise Invalid("a bracket stays open")
        self.lines = [0]
        for m in re.finditer("\n", self.source):
            self.lines.append(m.end())

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def line(self, offset: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.lines, offset) - 1


def valid(source: str) -> bool:
    try:
        Script(source)
        return True
    except Invalid:
        return False


_TYPE = r"(?:string|number|boolean|any|unknown|void|never|object|bigint|symbol|[A-Z]\w*)(?:<[^<>()]*>)?(?:\[\])*"
_TYPES = rf"{_TYPE}(?:\s*\|\s*(?:{_TYPE}|null|undefined))*"


def strip_types(source: str) -> str:
    """Blank out TypeScript-only parts, keeping every offset: interfaces, aliases, annotations, casts, modifiers.

    Annotations are seen after parameters, declared names and parameter lists, where the type is
    a built-in or capitalised one.
    """

    def blank(m: re.Match) -> str:
        kept = m["keep"] if "keep" in m.re.groupindex else ""
        return kept + re.sub(r"[^\n]", " ", m[0][len(kept) :])

    for pattern in (
        r"\b(?:export\s+)?(?:declare\s+)?interface\s+\w+[^{]*\{[^{}]*\}",
        r"\b(?:export\s+)?type\s+\w+(?:<[^>]*>)?\s*=[^;\n]*;?",
        r"\b(?:public|private|protected|readonly|abstract|declare)\s+(?=[\w*\[])",
        rf"\s+as\s+(?:const|{_TYPES})",
        rf"(?P<keep>\))\s*:\s*(?:Promise<[^<>]*>|{_TYPES})(?=\s*(?:\{{|=>))",
        rf"(?P<keep>\b(?:const|let|var)\s+\w+)\s*:\s*{_TYPES}(?=\s*[=;])",
        rf"(?P<keep>[(,]\s*(?:\.\.\.)?\w+)\??\s*:\s*{_TYPES}(?=\s*[,)=])",
    ):
        source = re.sub(pattern, blank, source)
    return source


def without_comments(source: str) -> str:
    """Comments become the line feeds in them, so lines keep their numbers."""
    return "".join(re.sub(r"[^\n]", "", t.text) if t.kind == "comment" else t.text for t in lex(source))


def normal_lines(source: str) -> list[str]:
    """Comment-free lines with white space collapsed, blank ones dropped."""
    return [x for x in (re.sub(r"\s+", " ", line).strip() for line in without_comments(source).splitlines()) if x]


@dataclass(frozen=True)
class Unit:
    """A function: its node type, name, tokens ``first`` to ``last`` and the tokens of its parameters."""

    node_type: str
    name: str | None
    first: int
    last: int
    params: tuple[int, int]


def _named_before(s: Script, i: int) -> str | None:
    """Name that a function expression starting at token ``i`` is bound to."""
    if s.text(i - 1) == "=" and s.kind(i - 2) in ("name", "string"):
        return s.text(i - 2).strip("\"'")
    if s.text(i - 1) == ":" and s.kind(i - 2) in ("name", "string"):
        return s.text(i - 2).strip("\"'")
    return None


def _expression_end(s: Script, i: int) -> int:
    """Last token of an expression that begins at token ``i``."""
    at = i
    while at < len(s.tokens):
        t = s.text(at)
        if s.kind(at) == "sign" and t in _CLOSE:
            at = s.partner[at]
        elif s.kind(at) == "sign" and t in (",", ";", ")", "]", "}"):
            return at - 1
        at += 1
    return len(s.tokens) - 1


def functions(s: Script) -> list[Unit]:
    """All functions in order of their beginnings; nested ones are units of their own."""
    found: list[Unit] = []
    for i, t in enumerate(s.tokens):
        if t.kind == "name" and t.text == "function":
            star = s.text(i + 1) == "*"
            j = i + 1 + star
            name = s.text(j) if s.kind(j) == "name" else None
            j += name is not None
            if s.text(j) != "(" or s.text(s.partner[j] + 1) != "{":
                continue
            first = i - 1 if s.text(i - 1) == "async" else i
            statement = s.text(first - 1) in ("", ";", "{", "}", "export", "default") and name is not None
            kind = ("generator_function" if star else "function") + ("_declaration" if statement else "" if star else "_expression")
            found.append(Unit(kind, name or _named_before(s, first), first, s.partner[s.partner[j] + 1], (j + 1, s.partner[j])))
        elif t.text == "=>":
            if s.text(i - 1) == ")":
                first = s.partner[i - 1]
                params = (first + 1, i - 1)
            elif s.kind(i - 1) == "name":
                first = i - 1
                params = (first, i)
            else:
                continue
            first -= s.text(first - 1) == "async"
            last = s.partner[i + 1] if s.text(i + 1) == "{" else _expression_end(s, i + 1)
            found.append(Unit("arrow_function", _named_before(s, first), first, last, params))
        elif t.text == "(" and i and s.text(s.partner[i] + 1) == "{" and s.kind(i - 1) in ("name", "string") and s.inside[i] >= 0 and s.text(s.inside[i]) == "{":
            name = s.text(i - 1)
            before = i - 2
            while s.text(before) in ("async", "get", "set", "static", "*"):
                before -= 1
            if name in _RESERVED or s.text(before) not in ("{", ",", ";", "}") or s.text(i - 2) == "function":
                continue
            found.append(Unit("method_definition", name.strip("\"'"), before + 1, s.partner[s.partner[i] + 1], (i + 1, s.partner[i])))
    return sorted((u for u in found if u.name not in _RESERVED), key=lambda u: (u.first, -u.last))


def outer_name(s: Script) -> str | None:
    """The name of the only outermost function, if there is just one."""
    units, outer = functions(s), []
    for u in units:
        if not any(o.first <= u.first and u.last <= o.last for o in outer):
            outer.append(u)
    return outer[0].name if len(outer) == 1 else None


def _pattern_names(s: Script, a: int, b: int) -> list[str]:
    """Names bound by parameters or a destructuring pattern in tokens a to b."""
    out, at = [], a
    while at < b:
        t = s.text(at)
        if s.kind(at) == "name" and t not in _RESERVED:
            if s.text(at + 1) == ":" and s.inside[at] >= a - 1 and s.text(s.inside[at]) == "{":
                at += 2
                continue
            out.append(t)
            if s.text(at + 1) == "=":  # a default binds nothing
                at = _expression_end(s, at + 2)
        at += 1
    return out


def bindings(s: Script) -> tuple[list[str], list[str]]:
    """Parameters and locals by first declaration; a parameter's name is no local."""
    params: list[str] = []
    local: list[str] = []
    for u in functions(s):
        params += [n for n in _pattern_names(s, *u.params) if n not in params]
    for i, t in enumerate(s.tokens):
        if t.kind != "name":
            continue
        names: list[str] = []
        if t.text in ("let", "const", "var"):
            at = i + 1
            while at < len(s.tokens):
                end = s.partner[at] + 1 if s.text(at) in ("{", "[") else at + 1
                names += _pattern_names(s, at, end)
                if s.text(end) == "=":
                    end = _expression_end(s, end + 1) + 1
                if s.text(end) != ",":
                    break
                at = end + 1
        elif t.text == "catch" and s.text(i + 1) == "(":
            names = _pattern_names(s, i + 2, s.partner[i + 1])
        local += [n for n in names if n not in params and n not in local]
    return params, local


def abstract(source: str) -> str:
    """Bound names become FPARAMn and LVARn; comments go; all else stays."""
    s = Script(source)
    params, local = bindings(s)
    names = {n: f"LVAR{i}" for i, n in enumerate(local)} | {n: f"FPARAM{i}" for i, n in enumerate(params)}
    swap = {}
    for i, t in enumerate(s.tokens):
        if t.kind != "name" or t.text not in names or s.text(i - 1) in (".", "?."):
            continue
        key = s.text(i + 1) == ":" and s.inside[i] >= 0 and s.text(s.inside[i]) == "{" and s.text(i - 1) in ("{", ",")
        if not key:
            shorthand = s.inside[i] >= 0 and s.text(s.inside[i]) == "{" and s.text(i - 1) in ("{", ",") and s.text(i + 1) in (",", "}")
            swap[t.start] = f"{t.text}: {names[t.text]}" if shorthand else names[t.text]
    return "".join(swap.get(t.start, t.text) if t.kind != "comment" else re.sub(r"[^\n]", "", t.text) for t in lex(source))


def fingerprint(source: str) -> dict:
    """Native digest always; exact and abstracted ones where the abstracted form is long enough and the text is valid."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = {"native": sha(source), "exact": None, "abstracted": None, "abstracted_length": None}
    try:
        exact, loose = " ".join(normal_lines(source)), " ".join(normal_lines(abstract(source)))
    except Invalid:
        return out
    if len(loose) >= MIN_FINGERPRINT_CHARS:
        out |= {"exact": sha(exact), "abstracted": sha(loose), "abstracted_length": len(loose)}
    return out


def role_tokens(source: str) -> list[str]:
    """Roles for edit comparison: literals as they are, names after a dot ``API:x``, before a bracket ``CALL:x``, else ``ID``.

    Parts of a text will do: brackets need not match, and what doesn't lex is cut into words and signs.
    """
    try:
        tokens = [(t.kind == "name" and t.text not in _RESERVED, t.text) for t in lex(source) if t.kind not in ("space", "comment")]
    except Invalid:
        tokens = [(re.match(r"[A-Za-z_$]", x) is not None and x not in _RESERVED, x) for x in re.findall(TOKEN, source)]
    texts = ["", *(x for _, x in tokens), ""]
    out = []
    for i, (name, text) in enumerate(tokens):
        out.append(text if not name else f"API:{text}" if texts[i] in (".", "?.") else f"CALL:{text}" if texts[i + 2] == "(" else "ID")
    return out


def has_identity(tokens: list[str]) -> bool:
    """Whether tokens name something: an API, a call, a quoted text, a pattern or a number."""
    return any(t.startswith(("API:", "CALL:", '"', "'", "`", "/")) or t[:1].isdigit() for t in tokens)


#: Words that keep their own role when regions are compared.
REGION_KEYWORDS = frozenset("if else for while do switch case return throw try catch finally const let var new function class await async true false null undefined this typeof instanceof".split())


def region_roles(tokens: list[str], literals: list[str]) -> list[str]:
    """Roles for region comparison: literals ``LIT``, names ``ID``, keywords and signs themselves; patterns once more at the end, as they are."""
    known = set(literals)
    roles = ["LIT" if t in known else "ID" if re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", t) and t not in REGION_KEYWORDS else t for t in tokens]
    return roles + [f"REGEX:{x}" for x in literals if x.startswith("/")]


def api_anchor(name: str) -> str:
    """A dotted path without white space; its receiver is ``ID``, but for ``this`` and ``super``."""
    text = re.sub(r"\s+", "", name)
    parts = re.split(r"\?\.|\.", text)
    if len(parts) < 2 or not all(re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", x) for x in parts):
        return text
    return ".".join([parts[0] if parts[0] in ("this", "super") else "ID", *parts[1:]])


#: Node types by the word that opens a statement.
STATEMENTS = {
    "if": "if_statement", "for": "for_statement", "while": "while_statement", "do": "do_statement", "switch": "switch_statement", "return": "return_statement", "throw": "throw_statement",
    "try": "try_statement", "const": "lexical_declaration", "let": "lexical_declaration", "var": "variable_declaration", "break": "break_statement", "continue": "continue_statement", "class": "class_declaration",
}


def node_type(s: Script, a: int) -> str:
    """Type of the statement that begins at token ``a``."""
    return "statement_block" if s.text(a) == "{" else STATEMENTS.get(s.text(a), "expression_statement")


def node_path(s: Script, a: int) -> list[str]:
    """Types of what encloses token ``a``, the outermost first."""
    out, o = [], s.inside[a]
    while o >= 0:
        before = s.text(o - 1)
        if s.text(o) == "(":
            out.append("parenthesized_expression" if before in STATEMENTS else "arguments" if s.kind(o - 1) == "name" or before in (")", "]") else "parenthesized_expression")
        elif s.text(o) == "[":
            out.append("subscript_expression" if s.kind(o - 1) == "name" or before in (")", "]") else "array")
        elif before in ("=", "(", ",", ":", "return", "[", "?"):
            out.append("object")
        else:
            out.append("statement_block")
            head = s.text(s.partner[o - 1] - 1) if before == ")" else before
            if head in STATEMENTS:
                out.append(STATEMENTS[head])
            elif head in ("else", "finally"):
                out.append(f"{head}_clause")
            elif before in (")", "=>"):
                out.append("function")
        o = s.inside[o]
    return out[::-1]


def region_text(r: dict) -> str:
    """What an encoder reads of a region."""
    return " ".join(f"{k}={v}" for k, v in (("node", r["node_type"]), ("path", "/".join(r["ast_path"])), ("tokens", " ".join(r["tokens"])), ("calls", " ".join(r["calls"])), ("members", " ".join(r["member_accesses"]))))


def region_record(s: Script, a: int, b: int, granularity: str) -> dict:
    """A region of tokens a to b: its place, kind and features."""
    f, start, end = features(s, a, b), s.tokens[a].start, s.tokens[b].end
    kind = {"context": "context_slice", "function": "function"}.get(granularity) or node_type(s, a)
    begin = len(s.source[:start].encode())
    out = {
        "granularity": granularity, "node_type": kind, "ast_path": node_path(s, a), "start_line": s.line(start), "end_line": s.line(end - 1), "start_byte": begin, "end_byte": begin + len(s.source[start:end].encode()),
        "roles": region_roles(f["tokens"], f["literals"]), **f,
    }
    return out | {"text": region_text(out)}


def near_lines(s: Script, a: int, b: int, more: int = 2) -> tuple[int, int]:
    """Tokens on the lines of a to b and ``more`` lines around them."""
    low, high = s.line(s.tokens[a].start) - more, s.line(s.tokens[b].end - 1) + more
    near = [i for i, t in enumerate(s.tokens) if low <= s.line(t.start) <= high]
    return near[0], near[-1]


def anchored_regions(source: str, lines: list[int]) -> dict[str, dict]:
    """The four regions of one side of a fix, around its first changed line, or the middle one if none has changed.

    The smallest statement with that line, else the whole function; its block; the lines around it; the function.
    """
    s = Script(source)
    if not s.tokens:
        return {}
    last, count = len(s.tokens) - 1, len(source.splitlines())
    line = max(0, min(min(lines), count - 1)) if lines else count // 2
    around = [(a, b) for a, b in statements(s, 0, last) if s.line(s.tokens[a].start) <= line <= s.line(s.tokens[b].end - 1)]
    a, b = min(around, key=lambda r: (s.tokens[r[1]].end - s.tokens[r[0]].start, r), default=(0, last))
    o = s.inside[a]
    while o >= 0 and s.text(o) != "{":
        o = s.inside[o]
    spans = {"changed": (a, b), "block": (o, s.partner[o]) if o >= 0 else (0, last), "context": near_lines(s, a, b), "function": (0, last)}
    return {g: region_record(s, *span, g) for g, span in spans.items()}


def features(s: Script, a: int, b: int) -> dict:
    """Shape (node types in order), calls, members, names and literals of tokens a to b."""
    shape, calls, members, names, literals = [], set(), set(), set(), set()
    for i in range(a, b + 1):
        t, before, after = s.tokens[i], s.text(i - 1), s.text(i + 1)
        if t.kind == "name" and t.text in STATEMENTS:
            shape.append(STATEMENTS[t.text])
        elif t.kind == "name" and t.text not in _RESERVED:
            if after == "(":
                shape.append("call_expression")
                calls.add(t.text)
            if before in (".", "?."):
                shape.append("member_expression")
                members.add(t.text)
            else:
                names.add(t.text)
            shape.append("identifier")
        elif t.kind in ("string", "number", "regex", "template"):
            shape.append(t.kind)
            literals.add(t.text)
        elif t.text in ("=", "+=", "-=", "*=", "/="):
            shape.append("assignment_expression")
        elif t.text == "{":
            shape.append("statement_block")
        elif t.kind == "sign" and t.text not in "(){}[];,.:" and t.text not in ("?.", "=>"):
            shape.append("binary_expression")
    return {"ast_shape": shape, "tokens": [s.text(i) for i in range(a, b + 1)], "calls": sorted(calls), "member_accesses": sorted(members), "identifiers": sorted(names), "literals": sorted(literals)}


def statements(s: Script, a: int, b: int) -> list[tuple[int, int]]:
    """Token ranges of statements in a to b, by beginning and length; blocks' inner ones too."""
    out, first, i = [], None, a
    while i <= b:
        t = s.text(i)
        if t == "{" and (s.text(i - 1) in (")", "else", "try", "finally", "do", "=>", ";", "{", "}", "") or first is None):
            out += statements(s, i + 1, s.partner[i] - 1)
            if first is not None:
                end = s.partner[i]
                out.append((first, end))
                first = None
            i = s.partner[i] + 1
            continue
        first = i if first is None else first
        if t in _CLOSE:
            i = s.partner[i]
        elif t == ";":
            out.append((first, i))
            first = None
        i += 1
    if first is not None and first <= b:
        out.append((first, b))
    return sorted(set(out), key=lambda r: (r[0], r[1] - r[0]))


def informative(f: dict, granularity: str) -> bool:
    if f["calls"] or f["member_accesses"] or any(x.strip("\"'`") not in ("", "0", "1", "true", "false") for x in f["literals"]):
        return True
    return len(f["tokens"]) >= 12 if granularity in ("context", "function") else len(f["tokens"]) >= 6 and len(f["ast_shape"]) >= 4


def regions(source: str, unit_id: str, cap: int = 96) -> list[dict]:
    """Candidate regions of one function's text: each statement, its block, two lines around it, then the function.

    Targets stop once ``cap`` - 1 regions are in, and the list is cut to ``cap``; repeats of a
    span and granularity count once, before the test for being informative.
    """
    s = Script(source)
    if not s.tokens:
        return []
    out: list[dict] = []
    seen = set()

    def add(a: int, b: int, granularity: str) -> None:
        if (a, b, granularity) in seen:
            return
        seen.add((a, b, granularity))
        r = region_record(s, a, b, granularity)
        if informative(r, granularity):
            out.append({"region_id": f"candidate:{unit_id}:{len(out):04d}", **r})

    for a, b in statements(s, 0, len(s.tokens) - 1):
        if len(out) >= cap - 1:
            break
        add(a, b, "changed")
        if (o := s.inside[a]) >= 0 and s.text(o) == "{":
            add(o, s.partner[o], "block")
        add(*near_lines(s, a, b), "context")
    add(0, len(s.tokens) - 1, "function")
    return out[:cap]


def unit_rows(path: str, source: str) -> list[dict]:
    """Function units of a file as records; none if it is invalid."""
    text = strip_types(source) if re.search(r"\.[mc]?tsx?$", path or "") else source
    try:
        s = Script(text)
    except Invalid:
        return []
    out = []
    for u in functions(s):
        start, end = s.tokens[u.first].start, s.tokens[u.last].end
        body = source[start:end]
        a, b = len(source[:start].encode()), len(source[:end].encode())
        out.append({"unit_id": f"{path}::{a}:{b}", "name": u.name, "node_type": u.node_type, "start_line": s.line(start), "end_line": s.line(end - 1), "start_byte": a, "end_byte": b, "source": body, "function_hash": hashlib.sha256(body.encode()).hexdigest()})
    return out


# --- fallbacks: forms in which equivalent code is equal ---


def guard_form(source: str) -> str | None:
    """A function's guards in one form: ``if (c) return x;`` and ``c ? x : y`` read alike; None if there is nothing to compare."""
    try:
        text = " ".join(normal_lines(abstract(source)))
    except Invalid:
        return None
    text = re.sub(r"if \((.+?)\) \{ return (.+?); \}( else)?", r"if (\1) return \2;", text)
    text = re.sub(r"return (.+?) \? (.+?) : (.+?);", r"if (\1) return \2; return \3;", text)
    text = re.sub(r"else \{ return (.+?); \}", r"return \1;", text)
    return text if "return" in text else None


def regex_only_change(before: str, after: str) -> bool:
    """Whether two texts differ in regular expressions alone."""
    try:
        a, b = Script(before).tokens, Script(after).tokens
    except Invalid:
        return False
    if len(a) != len(b):
        return False
    other = [(x, y) for x, y in zip(a, b) if x.text != y.text]
    return bool(other) and all(x.kind == y.kind == "regex" for x, y in other)


def ast_form(source: str, max_chars: int = 40_000, max_tokens: int = 6_000) -> str | None:
    """Digest of the renamed token form with one kind of quotes; None for large texts and those that look at their own names."""
    if len(source) > max_chars or re.search(r"\b(eval|with|Function|arguments)\b", source):
        return None
    try:
        tokens = Script(abstract(source)).tokens
    except Invalid:
        return None
    if len(tokens) > max_tokens:
        return None
    form = ['"' + t.text[1:-1].replace('"', '\\"') + '"' if t.kind == "string" else "let" if t.text in ("const", "let") else t.text for t in tokens]
    return hashlib.sha256("\x00".join(form).encode()).hexdigest()


def compare_forms(candidate: str | None, vulnerable: str | None, patched: str | None) -> str | None:
    """The side whose form the candidate has, where the sides differ."""
    if None in (candidate, vulnerable, patched) or vulnerable == patched:
        return None
    return "vulnerable" if candidate == vulnerable else "patched" if candidate == patched else None


def local_vote(candidate: str, vulnerable: str, patched: str) -> str | None:
    """The side that all decisive local forms agree on; ``conflict`` if they don't, None if none decides.

    The forms are guards, and the patterns of a fix that changes patterns alone.
    """
    votes = {compare_forms(*(guard_form(x) for x in (candidate, vulnerable, patched)))}
    if regex_only_change(vulnerable, patched) and valid(candidate):
        patterns = [{t.text for t in Script(x).tokens if t.kind == "regex"} for x in (candidate, vulnerable, patched)]
        old, new = patterns[1] - patterns[2], patterns[2] - patterns[1]
        if old and new:
            has = (old <= patterns[0], new <= patterns[0])
            votes.add({(True, False): "vulnerable", (False, True): "patched"}.get(has))
    votes.discard(None)
    return None if not votes else votes.pop() if len(votes) == 1 else "conflict"


WRAPPERS = (("", ""), ("class W {\n", "\n}"), ("function w() {\n", "\n}"), ("(", ")"))


def expand(source: str) -> str:
    """One-line code broken after braces and semicolons outside of brackets, so that lines tell statements apart."""
    s = Script(source)
    out, at = [], 0
    for i, t in enumerate(s.tokens):
        out.append(source[at : t.end])
        at = t.end
        round_ = s.inside[i] >= 0 and s.text(s.inside[i]) in ("(", "[")
        if t.text in ("{", "}", ";") and t.kind == "sign" and not round_ and not source[at:].lstrip(" \t").startswith("\n"):
            out.append("\n")
    return "".join(out) + source[at:]


def wrapped(source: str) -> tuple[str, int, int] | None:
    """The text in the first wrapper that makes it valid, with the wrapper's lines and bytes to subtract."""
    for head, tail in WRAPPERS:
        if valid(head + source + tail) and (head or functions(Script(source)) or not re.match(r"\s*(async\s+)?[\w$]+\s*\([^)]*\)\s*\{", source)):
            return head + source + tail, head.count("\n"), len(head.encode())
    return None
