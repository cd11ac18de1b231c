"""Classes, methods, imports and calls of one source text. Python goes through its own grammar, others through patterns
over text without comments and strings, with bodies found by matching braces (or a closing line of equal indentation)."""

from __future__ import annotations

import ast
import bisect
import functools
import re

from weft.parse.languages import CALL, RULES, WORDS

#: Lines of a Python text that are given up for the rest of it.
REPAIRS = 20
INTERFACE = re.compile(r"\b(?:interface|trait|protocol)\b")
#: The first word of a shell command, after what may stand before it.
COMMAND = re.compile(r"(?:^|[;&|({`]|\b(?:then|do|else|if|elif|while|until)\b)[ \t]*(?:(?:then|do|else|if|elif|while|until|!|\w+=\S*)[ \t]+)*(?!(?:then|do|done|else|if|elif|fi|for|while|until|case|esac|in|function|select)\b|\w+=)([\w./-]+)(?![\w./-]*[ \t]*\()", re.M)
RUBY_WORDS = frozenset("if unless while until case when then else elsif end def class module return yield begin rescue ensure do in and or not nil true false self super require require_relative include extend".split())
MESSAGE = re.compile(r"(?<![\w.@:])(?:[a-z_]\w*(?:\.[a-z_]\w*[?!]?)+|(?<=[\n; \t])[a-z_]\w*[?!]?(?=[ \t]+[\w\"':@]))", re.M)
TABLE = re.compile(r"\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)", re.I)
ROUTINE = re.compile(r"\bcreate\s+(?:or\s+replace\s+)?(?:function|procedure)\s+[\"`]?([\w.]+)", re.I)
STATEMENT = re.compile(r"(?:(?<=;)|\A)\s*((?:select|insert|update|delete)\b[^;]*)", re.I)
TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.I | re.S)
SCRIPT = re.compile(r"<script\b([^>]*)>.*?</script\s*>", re.I | re.S)
LINK = re.compile(r"<link\b([^>]*)>", re.I)
ATTRIBUTE = re.compile(r"""([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


@functools.cache
def _pattern(p: str) -> re.Pattern:
    return re.compile(p, re.M | re.S)


def joined(*parts: str | None) -> str:
    return ".".join(p for p in parts if p)


def module_of(path: str) -> str:
    """The path without its suffix, dots for slashes."""
    dot = path.rfind(".")
    return (path[:dot] if dot > path.rfind("/") else path).replace("/", ".")


def masked(text: str, pattern: str) -> str:
    """text with blanks for what matches; line ends stay, so places do too."""
    return _pattern(pattern).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


class Lines:
    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)


def braces(bare: str) -> dict[int, int]:
    """Where each opening brace closes; an open one closes with the text."""
    out, stack = {}, []
    for m in re.finditer(r"[{}]", bare):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out | dict.fromkeys(stack, len(bare))


def _end(bare: str, at: int, closes: dict[int, int], ends: str, start: int) -> int:
    if ends == "end":
        line = bare.rfind("\n", 0, start) + 1
        indent = re.match(r"[ \t]*", bare[line:])[0]
        m = re.compile(rf"^{indent}end\b", re.M).search(bare, at)
        return m.end() if m else len(bare)
    depth = 0
    for m in re.compile(r"[{};()\n]").finditer(bare, at):
        c = m[0]
        depth += (c == "(") - (c == ")")
        if c == "{" and depth <= 0:
            return closes[m.start()]
        if c in ";}" and depth <= 0 or depth < 0:
            return m.start()
        if c == "\n" and depth == 0 and bare[at : m.start()].strip() and "=>" in bare[at : m.start()] and not bare[at : m.start()].rstrip().endswith("=>"):
            return m.start()
    return len(bare)


def _calls(bare: str, a: int, b: int, lines: Lines, language: str) -> list[dict]:
    """Last call first; of a nested pair the outer one counts as earlier."""
    if language == "shell":
        found = [(m.start(1), m[1]) for m in COMMAND.finditer(bare, a, b)]
    else:
        found = [(m.start(), m[0]) for m in CALL.finditer(bare, a, b) if re.split(r"\W+", m[0])[0] not in WORDS and not bare[: m.start()].endswith("new ")]
        if language == "php":  # a member's call goes by the member's name
            found = [(at, re.split(r"->|::", name)[-1]) for at, name in found]
        if language == "ruby":  # calls without brackets: a receiver's message, or a word before its first argument
            known = {at for at, _ in found}
            found += [(m.start(), m[0]) for m in MESSAGE.finditer(bare, a, b) if m.start() not in known and re.split(r"\W+", m[0])[0] not in RUBY_WORDS]
            found.sort()
    return [{"callee_name": name, "line": lines.at(at)} for at, name in reversed(found)]


def _annotated(bare: str, start: int) -> int:
    """Where a declaration's annotations start: the first one after the end of what stands before it."""
    depth, i = 0, start - 1
    while i >= 0 and (depth or bare[i] not in ";{}"):
        depth += (bare[i] == ")") - (bare[i] == "(")
        i -= 1
    first = re.compile(r"@(?!interface\b)\w").search(bare, i + 1, start)
    return first.start() if first else start


def _closing(bare: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[()]").finditer(bare, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.end()
    return len(bare)


def _signature(language: str, name: str, text: str, bare: str, first: int, start: int, after: int, end: int) -> str:
    """A method as its language's users write it down. first: its annotations; start: its declaration; after: the end of its name."""
    if language not in ("typescript", "javascript", "java", "go", "rust", "c", "cpp"):
        return name if language == "css" else text[start:end].split("\n")[0]
    tidy = lambda s: " ".join(s.split())
    stop = bare.find("{", after, end)
    head = text[start : stop if stop >= 0 else end]
    if language in ("go", "c", "cpp"):
        return tidy(re.sub(r"\b(?:static|inline|extern|virtual|explicit|constexpr|friend|const|volatile)\b(?=[^(]*\()", "", head) if language != "go" else head)
    if language in ("typescript", "javascript") and "=>" in bare[after:end]:
        arrow = bare.index("=>", after, end)
        at = bare.find("(", after, arrow)
        if at < 0:
            return f"{name}()"
        close = _closing(bare, at)
        return name + tidy(text[at:close]) + tidy(text[close:arrow])
    at = bare.find("(", after, end)
    close = _closing(bare, at) if at >= 0 else after
    params = tidy(text[at:close]) if at >= 0 else "()"
    rest = tidy(text[close : stop if stop >= 0 else end])
    if language in ("typescript", "javascript"):
        return f"{name}{params}{rest.rstrip(';')}"
    if language == "rust":
        returns = re.match(r"->\s*(.*?)(?:\s+where\b.*)?;?$", rest)
        return f"fn {name}{params}" + (f" {returns[1]}" if returns else "")
    notes, i = [], first
    while m := re.compile(r"\s*(@\w[\w.]*)\s*").match(bare, i, after):
        i = _closing(bare, m.end()) if bare[m.end() : m.end() + 1] == "(" else m.end(1)
        notes.append(text[m.start(1) : i])
        while w := re.compile(r"\s*(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\b").match(bare, i, after):
            i = w.end()
    before = re.sub(r"\b(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\b", " ", text[max(i, start) : after])
    kind = tidy(before.rstrip()[: -len(name)])
    kind = re.sub(r"^<[^<>]*(?:<[^<>]*>[^<>]*)*>\s*", "", kind)
    return " ".join([*notes, f"{name}{params}" + (f": {kind}" if kind else "")])


def _python(text: str) -> tuple[list, list, list]:
    tree, types, methods, imports = ast.parse(text), [], [], []
    rows = text.splitlines(keepends=True)

    def segment(n: ast.AST) -> str:
        return ast.get_source_segment(text, n) or ""

    def walk(node: ast.AST, owner: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.ClassDef):
                bases = {b.attr if isinstance(b, ast.Attribute) else b.id for b in n.bases if isinstance(b, ast.Attribute | ast.Name)}
                types.append({"name": n.name, "line": n.lineno, "is_interface": "Protocol" in bases, "is_abstract": "ABC" in bases})
                walk(n, n.name)
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                returns = f" -> {segment(n.returns)}" if n.returns else ""
                head = segment(n)
                at, depth = head.index("("), 0
                for i in range(at, len(head)):
                    depth += (head[i] == "(") - (head[i] == ")")
                    if not depth:
                        break
                calls = [c for part in (n.args, n.returns, *n.body) if part for c in ast.walk(part) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)]
                calls.sort(key=lambda c: (c.lineno, c.col_offset), reverse=True)
                methods.append({
                    "name": n.name, "line": n.lineno, "class_name": owner, "signature": f"def {n.name}{head[at : i + 1]}{returns}:",
                    "source_code": head, "calls": [{"callee_name": segment(c.func), "line": c.lineno} for c in calls],
                })
                walk(n, None)
            else:
                if isinstance(n, ast.Import | ast.ImportFrom):
                    imports.append(segment(n))
                walk(n, None)

    if rows:
        walk(tree, None)
    return types, methods, imports


def _repaired(text: str) -> str:
    """The text with ``pass`` for the lines its grammar refuses, so that the rest of the file still counts; raises where that won't do."""
    rows, tried = text.split("\n"), set()
    while True:
        try:
            ast.parse("\n".join(rows))
            return "\n".join(rows)
        except SyntaxError as e:
            at = (e.lineno or 0) - 1
            if not 0 <= at < len(rows) or at in tried or len(tried) >= REPAIRS:
                raise
            tried.add(at)
            rows[at] = rows[at][: len(rows[at]) - len(rows[at].lstrip())] + "pass"


def _sql(text: str) -> tuple[list, list, list]:
    bare = masked(text, r"--[^\n]*|/\*.*?\*/")
    lines = Lines(text)
    types = [{"name": m[1], "line": lines.at(m.start())} for m in TABLE.finditer(bare)]
    row = lambda name, m, owner, sig: {"name": name, "line": lines.at(m.start()), "class_name": owner, "signature": sig, "source_code": text[m.start() : (text.find(";", m.end()) + 1) or len(text)], "calls": []}
    methods = [row("__table__", m, m[1], f"table {m[1]}") for m in TABLE.finditer(bare)] + [row(m[1], m, None, m[0]) for m in ROUTINE.finditer(bare)]
    return types, methods, [m[1].strip() for m in STATEMENT.finditer(bare)]


def _html(text: str) -> tuple[list, list, list]:
    bare, lines = masked(text, r"<!--.*?-->"), Lines(text)
    attrs = lambda s: {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(s)}
    types = [{"name": m[1].strip(), "line": lines.at(m.start())} for m in TITLE.finditer(bare) if m[1].strip()]
    methods = [{"name": "inline_script", "line": lines.at(m.start()), "class_name": None, "signature": m[0].split("\n")[0], "source_code": m[0], "calls": []} for m in SCRIPT.finditer(bare)]
    links = [(m.start(), a["src"]) for m in SCRIPT.finditer(bare) if (a := attrs(m[1])).get("src")]
    links += [(m.start(), a["href"]) for m in LINK.finditer(bare) if (a := attrs(m[1])).get("href") and a.get("rel", "").lower() == "stylesheet"]
    return types, methods, [x for _, x in sorted(links)]


def _braced(text: str, language: str) -> tuple[list, list, list, str]:
    rules = RULES[language]
    bare, lines = masked(text, rules.mask), Lines(text)
    closes = braces(bare)
    name = lambda m: next(g for g in reversed(m.groups()) if g)
    types, owners = [], []
    for p, counts in ((rules.types, True), (rules.scopes, False)):
        for m in _pattern(p).finditer(bare) if p else ():
            if counts:
                at = m.start() + len(m[0]) - len(m[0].lstrip())
                first = _annotated(bare, at) if language == "java" else at
                before = re.search(r"(?:[\w@()]+[ \t]+)*$", bare[max(0, at - 200) : at])[0] + m[0]
                types.append({"name": name(m), "line": lines.at(first), "head": text[first:at], "is_interface": bool(INTERFACE.search(m[0])) or language == "go" and m[0].endswith("interface"), "is_abstract": "abstract" in before.split()})
            owners.append((m.start(), _end(bare, m.end(), closes, rules.ends, m.start()), name(m)))
    methods = []
    for m in _pattern(rules.methods).finditer(bare) if rules.methods else ():
        called = name(m)
        first = m[0].split()[0] if m[0].split() else ""
        if called in WORDS or first in ("return", "new", "throw", "else"):
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        if language == "cpp" and (labels := re.compile(r"(?:(?:public|private|protected)\s*:\s*)+").match(bare, start)):
            start = labels.end()
        end = _end(bare, m.end(), closes, rules.ends, start)
        inside = [o for o in owners if o[0] < start < o[1]]
        owner = max(inside)[2] if inside else None
        if language == "go":
            r = re.match(r"func\s+\(\s*(?:\w+\s+)?\*?\s*(\w+)", m[0])
            owner = r[1] if r else None
        if language == "kotlin" and m.re.groups >= 2 and m[2]:
            owner = called
        if "::" in called:
            owner, called = called.rsplit("::", 1)[0].rsplit("::", 1)[-1], called.rsplit("::", 1)[1]
        if language in ("typescript", "javascript") and m[3] and owner is None:
            continue  # an object's method shorthand or a plain call before a block
        first = _annotated(bare, start) if language == "java" else start
        signature = _signature(language, called, text, bare, first, start, m.end(), end)
        methods.append({"name": called[:50], "line": lines.at(first), "class_name": owner, "signature": signature, "source_code": text[first:end], "calls": [] if language == "css" else _calls(bare, m.end(), end, lines, language)})
    imports = []
    for m in _pattern(rules.imports).finditer(text) if rules.imports else ():
        word = m.start() + len(m[0]) - len(m[0].lstrip())
        if bare[word] == " ":
            continue
        imports.append(m[0].strip())
        if language == "go":
            imports += [x.strip() for x in re.findall(r'(?:[\w.]+[ \t]+)?"[^"]+"', m[0].strip().removeprefix("import"))]
    package = _pattern(rules.package).search(bare) if rules.package else None
    return types, methods, imports, package[1].replace("::", ".") if package else ""


def parse(path: str, text: str, language: str) -> dict:
    """The parts of one file. A text that its grammar refuses says so in ``error``; lines it refuses have no parts."""
    package, error, parts = "", None, ([], [], [])
    if language == "python":
        try:
            parts = _python(text)
        except (SyntaxError, ValueError, RecursionError) as e:
            error = str(e)
            try:
                parts = _python(_repaired(text))
            except (SyntaxError, ValueError, RecursionError):
                pass
    elif language in ("sql", "html"):
        parts = _sql(text) if language == "sql" else _html(text)
    elif language in RULES:
        *parts, package = _braced(text, language)
    else:
        raise ValueError(f"no such language: {language}")
    types, methods, imports = parts
    module = module_of(path)
    base = joined(module, package) if language == "cpp" else package or module
    for t in types:
        t["is_interface"], t["is_abstract"] = t.get("is_interface", False), t.get("is_abstract", False)
        t["fqn"], t["methods"] = joined(base, t["name"]), [m["name"] for m in methods if m["class_name"] == t["name"]]
    for m in methods:
        m["fqn"] = joined(base, m["class_name"], m["name"])
    return {"module_name": base, "classes": types, "methods": methods, "imports": imports, "error": error}


def problems(text: str, language: str | None) -> list[str]:
    """What a syntax check has against a text, with 1-based lines and columns; unknown languages pass."""
    if language == "python":
        try:
            ast.parse(text)
        except SyntaxError as e:
            return [f"line {e.lineno}, column {e.offset}: {e.msg}"]
        except ValueError as e:
            return [f"line 1, column 1: {e}"]
        return []
    if language not in RULES or language in ("shell", "ruby"):
        return []
    bare, lines, stack, out = masked(text, RULES[language].mask), Lines(text), [], []
    place = lambda at: f"line {lines.at(at)}, column {at - lines.starts[lines.at(at) - 1] + 1}"
    pairs = {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", bare):
        if m[0] in "([{":
            stack.append((m[0], m.start()))
        elif stack and stack[-1][0] == pairs[m[0]]:
            stack.pop()
        else:
            out.append(f"{place(m.start())}: unexpected {m[0]}")
    return out + [f"{place(at)}: {c} is never closed" for c, at in stack]
