"""Symbols and edges of JavaScript, TypeScript, Go, Rust and Java by patterns and brace matching.

No grammar of these languages is at hand, so this is an approximation: declarations are
found by pattern, bodies by matching braces outside strings and comments.  Node and edge
kinds, confidences and test rules are those of the grammar-based form; hashes of bodies are
of the text.
"""

from __future__ import annotations

import hashlib
import json
import re

from weftline.functions.vocabulary import ASSERT_CALLS, EFFECTS_OF, TEST_NAMES

_NAME = r"[A-Za-z_$][\w$]*"
_SCRIPT = {
    "function": rf"(?:^|[^\w$.])(?:async\s+)?function\s*\*?\s*(?P<name>{_NAME})\s*(?:<[^>(]*>)?\(|(?:const|let|var)\s+(?P<arrow>{_NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|{_NAME})\s*(?::[^=\n]+)?=>",
    "method": rf"(?m)^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*(?P<name>(?!(?:if|for|while|switch|catch|return|function|new|await|else|do)\b){_NAME})\s*(?:<[^>(]*>)?\([^;{{}}]*\)\s*(?::[^{{;]+)?\{{",
    "class": rf"(?:^|[^\w$.])(?:class|interface)\s+(?P<name>{_NAME})",
    "import": r"""(?m)^\s*import\s[^;'"]*?from\s*['"](?P<path>[^'"]+)['"]|require\(\s*['"`](?P<req>[^'"`]+)['"`]\s*\)""",
    "inherits": rf"(?:extends|implements)\s+(?P<names>[\w$.]+(?:\s*,\s*[\w$.]+)*)",
}
_DECLARED = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "go": {
        "function": rf"(?m)^func\s+(?:\([^)]*\)\s*)?(?P<name>{_NAME})\s*(?:\[[^\]]*\])?\(",
        "class": rf"(?m)^type\s+(?P<name>{_NAME})\s+(?:struct|interface)",
        "import": r'(?m)^import\s+(?:\w+\s+)?"(?P<path>[^"]+)"|^import\s*\((?P<block>[^)]*)\)',
    },
    "rust": {
        "function": rf"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(?P<name>{_NAME})",
        "class": rf"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|impl(?:<[^>]*>)?(?:\s+[\w:<>]+\s+for)?)\s+(?P<name>{_NAME})",
        "import": r"(?m)^\s*(?:pub\s+)?use\s+(?P<path>[^;]+);",
    },
    "java": {
        "method": rf"(?m)^[ \t]+(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*(?:<[^>]+>\s*)?(?:[\w$.<>\[\],?]+\s+)?(?P<name>(?!(?:if|for|while|switch|catch|return|new|else|do|try)\b){_NAME})\s*\([^;{{}}]*\)\s*(?:throws\s+[\w.,\s]+)?\{{",
        "class": rf"(?:^|[^\w$.])(?:class|interface|enum)\s+(?P<name>{_NAME})",
        "import": r"(?m)^\s*import\s+(?:static\s+)?(?P<path>[\w.*]+)\s*;",
        "inherits": rf"(?:extends|implements)\s+(?P<names>[\w$.]+(?:\s*,\s*[\w$.]+)*)",
    },
}
_CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*)(?:(?:\.|::)[A-Za-z_$][\w$]*)*)!?\s*\(")
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "match", "super", "new", "sizeof", "typeof", "import", "await"}
_ASSIGN = {"javascript": r"\bthis\.([\w$]+)\s*(?:[-+*/%]|\|\||&&|\?\?)?=(?![=>])", "java": r"\bthis\.([\w$]+)\s*[-+*/%]?=(?!=)", "rust": r"\bself\.(\w+)\s*[-+*/%]?=(?![=>])"}
_ASSIGN["typescript"] = _ASSIGN["javascript"]


_TOKEN = re.compile(r"""//[^\n]*|/\*[\s\S]*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""")


def masked(text: str) -> str:
    """text with the insides of strings and comments blanked, of the same length."""
    return _TOKEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def block_comments(text: str) -> dict[int, int]:
    """Where each block comment begins, by its end."""
    return {m.end(): m.start() for m in _TOKEN.finditer(text) if m[0].startswith("/*")}


def block_end(text: str, at: int) -> int:
    """The end of the brace block that opens at or after ``at``; of the line where there is none before the statement ends."""
    open_ = re.compile(r"[{;]").search(text, at)
    if open_ is None or open_[0] == ";":
        end = text.find("\n", at)
        return len(text) if end < 0 else end
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, open_.start()):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def call_end(text: str, at: int) -> int:
    """The end of the call whose bracket opens at ``at``; of the text where it stays open."""
    depth = 0
    for m in re.compile(r"[()]").finditer(text, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.end()
    return len(text)


_CHAIN = re.compile(r"\)\s*(?:\??\.\s*[A-Za-z_$][\w$]*)+\s*\(")
_CALLEE = re.compile(r"(?P<dot>\??\.\s*)?[A-Za-z_$][\w$.]*\s*$")


def chained_calls(plain: str) -> list[tuple[int, int, int]]:
    """Calls whose receiver is a call, f(x).g(y): where the whole begins, where its name ends, and where its bracket opens."""
    opens: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[()]", plain):
        if m[0] == "(":
            stack.append(m.start())
        elif stack:
            opens[m.start()] = stack.pop()
    out = []
    for m in _CHAIN.finditer(plain):
        close = m.start()
        while close in opens:
            begin = opens[close]
            callee = _CALLEE.search(plain, max(0, begin - 200), begin)
            if callee is None:
                break
            begin = callee.start()
            close = begin - 1 if callee["dot"] else -1
            while close >= 0 and plain[close].isspace():
                close -= 1
            if close < 0 or plain[close] != ")":
                break
        else:
            continue
        out.append((begin, m.start() + len(m[0][:-1].rstrip()), m.end() - 1))
    return out


def comment_before(text: str, at: int, blocks: dict[int, int]) -> str | None:
    """The whole comment that ends on the line before ``at``: a block comment, or all lines of comments."""
    head = text[: text.rfind("\n", 0, at) + 1].rstrip()
    begin = end = len(head)
    if end in blocks:
        return head[blocks[end] :].strip("/* \n")
    while begin > 0 and head[(line := head.rfind("\n", 0, begin) + 1) : begin].lstrip(" \t").startswith("//"):
        begin = max(line - 1, 0)
    return head[begin:].strip("/* \n") if begin < end else None


def effect_of(call: str, language: str) -> str | None:
    for name, effect in EFFECTS_OF[language].items():
        stem = name.rstrip(".:")
        if call == name or call == stem or (call.startswith(name) if name[-1] in ".:" else call.startswith((f"{name}.", f"{name}::"))):
            return effect
    return None


def parse(content: bytes, module: str, file: str, language: str) -> tuple[list[dict], list[dict]]:
    """(nodes, edges) of a file."""
    text = content.decode("utf-8", errors="replace")
    plain, blocks = masked(text), block_comments(text)
    declared = _DECLARED[language]
    base = file.rpartition("/")[2]
    is_test = int(any(p in base for p in TEST_NAMES[language]))
    line = lambda at: text.count("\n", 0, at) + 1
    nodes: list[dict] = []
    edges: list[dict] = []
    spans: list[tuple[int, int, str]] = []

    def edge(src: str, dst: str, kind: str, confidence: float, detail: str | None = None) -> None:
        edges.append({"src": src, "dst": dst, "kind": kind, "confidence": confidence, "detail": detail})

    classes = []
    for m in re.finditer(declared["class"], plain):
        name, at = m["name"], m.start("name")
        begin = plain.rfind("\n", 0, at) + 1
        classes.append((begin, block_end(plain, at), name))

    def node(id_: str, kind: str, name: str, begin: int, end: int, shown: str) -> None:
        body = text[begin:end].strip()
        nodes.append(
            {
                "id": id_, "kind": kind, "module": module, "file": file, "line_start": line(begin), "line_end": line(end - 1), "signature": shown,
                "docstring": comment_before(text, begin + 1, blocks), "is_public": int(not name.startswith("_")), "is_test": is_test, "body_hash": hashlib.sha256(body.encode()).hexdigest(),
            }
        )

    seen = set()
    for what in ("function", "method"):
        for m in re.finditer(declared[what], plain) if what in declared else ():
            group = "arrow" if what == "function" and m.groupdict().get("arrow") else "name"
            name, at = m[group], m.start(group)
            if at in seen:
                continue
            seen.add(at)
            begin, end = plain.rfind("\n", 0, at) + 1, block_end(plain, at)
            owner = next((c for a, b, c in reversed(classes) if a < begin < b), None)
            if what == "method" and owner is None:
                continue
            id_ = ".".join(filter(None, (module, owner, name)))
            spans.append((begin, end, id_))
            node(id_, "method" if owner else "function", name, begin, end, text[begin:end].split("{")[0].strip()[:200])
    for begin, end, name in classes:
        node(f"{module}.{name}", "class", name, begin, end, f"class {name}")
        if "inherits" in declared:
            for m in re.finditer(declared["inherits"], plain[begin : plain.find("{", begin) if "{" in plain[begin:end] else end]):
                for b in re.split(r"\s*,\s*", m["names"]):
                    edge(f"{module}.{name}", b, "inherits", 0.8)
    chains = chained_calls(plain) if language != "java" else []
    # Short names of all that the file declares; of equal ones the last in the text counts.
    short = {n["id"].rpartition(".")[2]: n["id"] for n in sorted(nodes, key=lambda n: n["line_start"])}
    for begin, end, id_ in spans:
        first = plain.find("{", begin, end)
        body_at = begin if first < 0 else first
        found = [(m.start(), m[1], m.end() - 1) for m in _CALL.finditer(plain, body_at, end)]
        found += [(a, text[a:b], c) for a, b, c in chains if body_at <= a < end]
        for at, name, bracket in sorted(found, key=lambda x: (x[0], -x[2])):
            call = name.replace("::", ".")
            if call in _NOT_CALLS:
                continue
            own = short.get(call.rpartition(".")[2])
            edge(id_, own or call, "calls", 1.0 if own else 0.3)
            if effect := effect_of(name, language):
                edge(id_, f"side_effect:{effect}:{name}", "side_effect", 1.0, json.dumps({"kind": effect, "call": name}))
            if is_test and call.rpartition(".")[2] in ASSERT_CALLS.get(language, ()):
                shown = text[at : call_end(plain, bracket)]
                for name, target in short.items():
                    if name in shown:
                        edge(id_, target, "asserts_on", 0.8)
        if language in _ASSIGN and id_.count("."):
            for m in re.finditer(_ASSIGN[language], plain[body_at:end]):
                edge(id_, f"{id_.rpartition('.')[0]}.{m[1]}", "mutates", 1.0)
    for m in re.finditer(declared["import"], text):
        found = m.groupdict()
        if found.get("block"):
            names = re.findall(r'"([^"]+)"', found["block"])
        else:
            names = [next(v for v in found.values() if v)]
        for name in names:
            edge(module, name.strip(), "imports", 1.0)
    return nodes, edges
