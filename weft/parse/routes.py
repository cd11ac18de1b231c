"""HTTP endpoints and HTTP client calls in source texts: a reader of calls and their arguments, and tables of who is called."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from weft.parse.scan import Lines, joined

# Verbs, receivers of routes, receivers of client calls.
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH")
SERVERS = ("app", "router")
CLIENTS = ("api", "http", "apiclient", "client", "request", "httpclient")

_NAMED = re.compile(r"(@?)([A-Za-z_]\w*(?:\.\w+)*)\s*\(")
_OPEN, _CLOSE, _QUOTES = "([{", ")]}", "\"'`"


@dataclass(frozen=True)
class Call:
    """A call as it is written: its place, whether it is an annotation, its dotted name, and where its arguments start."""

    text: str
    at: int
    annotation: bool
    receiver: str
    name: str
    start: int

    def arguments(self) -> list[str]:
        """The texts of the arguments; brackets and strings are kept whole. A call that is never closed ends with the text."""
        out, depth, first, i = [], 0, self.start, self.start
        while i < len(self.text):
            c = self.text[i]
            if c in _QUOTES:
                i = _string_end(self.text, i)
            elif c in _OPEN:
                depth += 1
            elif c in _CLOSE and depth == 0:
                break
            elif c in _CLOSE:
                depth -= 1
            elif c == "," and depth == 0:
                out.append(self.text[first:i].strip())
                first = i + 1
            i += 1
        last = self.text[first:i].strip()
        return [*out, last] if last else out


def _string_end(text: str, at: int) -> int:
    """Where the string that starts at a quote ends: its closing quote, or the last character of the text."""
    i = at + 1
    while i < len(text) and text[i] != text[at]:
        i += 2 if text[i] == "\\" else 1
    return min(i, len(text) - 1)


def calls(text: str, wanted: Callable[[str, str], bool]) -> Iterator[Call]:
    """Calls in text order whose receiver's last part and name, in lower case, are wanted."""
    for m in _NAMED.finditer(text):
        *before, name = m[2].lower().split(".")
        receiver = before[-1] if before else ""
        if wanted(receiver, name):
            yield Call(text, m.start(), m[1] == "@", receiver, name, m.end())


def literal(argument: str) -> tuple[str, str] | None:
    """(quote, value) of the string that an argument starts with."""
    if argument[:1] not in _QUOTES or not argument:
        return None
    end = _string_end(argument, 0)
    return (argument[0], argument[1:end]) if end and argument[end] == argument[0] else None


def plain(arguments: list[str], nth: int = 0) -> str | None:
    """The value of an argument that starts with an ordinary string."""
    s = literal(arguments[nth]) if len(arguments) > nth else None
    return s[1] if s and s[0] != "`" else None


def named(text: str, key: str) -> tuple[int, str] | None:
    """(place, what follows) of ``key =`` or ``key:`` in an argument or in an object's text."""
    m = re.search(rf"\b{key}\s*[:=]\s*", text)
    return (m.end(), text[m.end() :]) if m else None


def slashed(path: str) -> str:
    path = path.strip()
    return path if path.startswith("/") else f"/{path}"


def under(prefix: str, path: str) -> str:
    a, b = slashed(prefix).rstrip("/"), slashed(path).lstrip("/")
    return slashed(f"{a}/{b}" if b else a)


def _is_verb(name: str) -> bool:
    return name.upper() in VERBS


def _python(text: str, parsed: dict) -> Iterator[tuple[str, str, dict]]:
    """Decorators with a receiver in the five lines above a function: verbs, and route() with its list of methods."""
    rows = text.split("\n")
    for m in parsed["methods"]:
        above = "\n".join(r.strip() for r in rows[max(0, m["line"] - 6) : m["line"] - 1] if r.strip().startswith("@"))
        for c in calls(above, lambda receiver, name: bool(receiver) and (_is_verb(name) or name == "route")):
            given = c.arguments()
            path = plain(given)
            if not c.annotation or not path:
                continue
            if c.name != "route":
                yield path, c.name, m
                continue
            listed = next((v[1] for a in given[1:] if (v := named(a, "methods")) and a.startswith("methods")), "")
            for verb in Call(listed, 0, False, "", "", 1).arguments() if listed[:1] in ("[", "(", "{") else ():
                if (value := literal(verb)) is not None:
                    yield path, value[1], m


def _mapping(c: Call) -> tuple[str, str] | None:
    """(path, verb) of a Spring annotation: GetMapping("p") and its like, or RequestMapping(value = "p", method = RequestMethod.V)."""
    given = c.arguments()
    if c.name != "requestmapping":
        path = plain(given)
        return (path, c.name.removesuffix("mapping")) if path else None
    value, method = (next((v[1] for a in given if (v := named(a, k)) and a.startswith(k)), "") for k in ("value", "method"))
    path = plain([value])
    return (path, method.removeprefix("RequestMethod.").strip()) if path and method.startswith("RequestMethod.") else None


def _java(parsed: dict) -> Iterator[tuple[str, str, dict]]:
    """Annotations of methods, under the mapping of their class. Each declaration's own annotations alone count."""
    prefixes = {}
    for t in parsed["classes"]:
        for c in calls(t.get("head", ""), lambda _, name: name == "requestmapping"):
            first = c.arguments()[:1]
            value = named(first[0], "value") if first and first[0].startswith("value") else None
            prefixes.setdefault(t["name"], (plain([value[1]]) if value else plain(first)) or "")
    for m in parsed["methods"]:
        for c in calls(m["signature"], lambda _, name: name == "requestmapping" or name.endswith("mapping") and _is_verb(name.removesuffix("mapping"))):
            if c.annotation and (found := _mapping(c)):
                yield under(prefixes.get(m["class_name"], ""), found[0]), found[1], m


def _web(text: str, parsed: dict) -> Iterator[tuple[str, str, dict]]:
    """Decorators of methods named by a verb, then routes of an application or router, each with the nearest method."""
    rows, lines, methods = text.split("\n"), Lines(text), parsed["methods"]
    for m in methods:
        above = rows[max(0, m["line"] - 6) : m["line"] - 1]
        start = next((i + 1 for i in range(len(above) - 1, -1, -1) if not above[i].strip().startswith("@")), 0)
        for c in calls("\n".join([*above[start:], m["source_code"] or ""]), lambda receiver, name: not receiver and _is_verb(name)):
            if c.annotation and (path := plain(c.arguments())) is not None:
                yield path, c.name, m
    for c in calls(text, lambda receiver, name: receiver in SERVERS and _is_verb(name)):
        given = c.arguments()
        path, line = literal(given[0]) if given else None, lines.at(c.at)
        if path and path[1]:
            near = min(methods, key=lambda m: abs(m["line"] - line), default=None)
            yield path[1], c.name, near or {"fqn": joined(parsed["module_name"], f"handler_line_{line}"), "line": line}


def endpoints(text: str, language: str, parsed: dict) -> list[dict]:
    """path, http_method, handler_fqn, line of the endpoints a file declares; once a (path, verb, handler)."""
    found: dict = {}
    rows = _python(text, parsed) if language == "python" else _java(parsed) if language == "java" else _web(text, parsed) if language in ("typescript", "javascript") else ()
    for path, verb, m in rows:
        if _is_verb(verb):
            key = (slashed(path), verb.upper(), m["fqn"])
            found.setdefault(key, dict(zip(("path", "http_method", "handler_fqn"), key, strict=True)) | {"line": m["line"]})
    return list(found.values())


def _client_call(c: Call) -> tuple[int, str, str, float] | None:
    """(rank, path, verb, confidence) of a client call; of calls to one path the lowest rank wins. Templates are half sure."""
    given = c.arguments()
    target = literal(given[0]) if given else None
    rooted = target is not None and len(target[1]) > 1 and target[1][0] == "/"
    template = target is not None and target[0] == "`"
    if c.name == "fetch":
        option = named(given[1], "method") if len(given) > 1 and given[1].startswith("{") else None
        verb = literal(option[1]) if option else None
        return (int(template), target[1], verb[1] if verb else "GET", 0.5 if template else 1.0) if rooted else None
    if c.name == "axios":
        method, url = (named(given[0], k) if given and given[0].startswith("{") else None for k in ("method", "url"))
        verb, path = (literal(x[1]) if x else None for x in (method, url))
        return (3, path[1], verb[1], 1.0) if verb and path and path[1] and method[0] < url[0] else None
    if target is None or not target[1] or template and not (c.receiver == "axios" and rooted):
        return None
    return (4 if template else 2 if c.receiver == "axios" else 5, target[1], c.name, 0.5 if template else 1.0)


def route_calls(text: str, language: str, parsed: dict) -> list[dict]:
    """source_method_fqn, path, http_method, confidence, line: client calls of each method, then of the whole file."""
    if language not in ("typescript", "javascript"):
        return []
    wanted = lambda receiver, name: name in ("fetch", "axios") or _is_verb(name) and (receiver == "axios" or receiver in CLIENTS)
    found: dict = {}
    scopes = [(m["fqn"], m["source_code"], m["line"]) for m in parsed["methods"]]
    for fqn, source, first in [*scopes, (joined(parsed["module_name"], "module_level"), text, 1)]:
        lines = Lines(source)
        hits = [(got[0], c.at, *got[1:]) for c in calls(source, wanted) if (got := _client_call(c))]
        for _, at, path, verb, confidence in sorted(hits):
            if _is_verb(verb):
                key = (fqn, slashed(path), verb.upper())
                found.setdefault(key, dict(zip(("source_method_fqn", "path", "http_method"), key, strict=True)) | {"confidence": confidence, "line": first + lines.at(at) - 1})
    return list(found.values())
