"""Symbols and edges of Python source, with the standard library's syntax tree."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from weftline.functions.vocabulary import PYTHON_ASSERTS, PYTHON_EFFECTS

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def dotted(expr: ast.expr) -> str:
    """a.b.c of names and attributes; what is neither is left out in front, so f(x).g is g."""
    names: list[str] = []
    while isinstance(expr, ast.Attribute):
        names.append(expr.attr)
        expr = expr.value
    if isinstance(expr, ast.Name):
        names.append(expr.id)
    return ".".join(reversed(names))


def signature(f: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """The def line of ordinary, starred and double-starred arguments, with annotations and defaults."""
    noted = lambda a: a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "")
    defaults = [None] * (len(f.args.args) - len(f.args.defaults)) + list(f.args.defaults)[-len(f.args.args) :] if f.args.args else []
    shown = [noted(a) + (f" = {ast.unparse(d)}" if d is not None else "") for a, d in zip(f.args.args, defaults)]
    shown += [f"{stars}{noted(a)}" for stars, a in (("*", f.args.vararg), ("**", f.args.kwarg)) if a]
    head = "async def" if isinstance(f, ast.AsyncFunctionDef) else "def"
    return f"{head} {f.name}({', '.join(shown)})" + (f" -> {ast.unparse(f.returns)}" if f.returns else "")


def asserted(expr: ast.expr) -> Iterator[str]:
    """Names that an asserted expression is about."""
    match expr:
        case ast.Call():
            name = dotted(expr.func)
        case ast.Name() | ast.Attribute():
            name = dotted(expr)
        case ast.Compare():
            for part in (expr.left, *expr.comparators):
                yield from asserted(part)
            return
        case ast.BoolOp():
            for part in expr.values:
                yield from asserted(part)
            return
        case ast.UnaryOp():
            yield from asserted(expr.operand)
            return
        case _:
            return
    if name:
        yield name


def effect_of(call: str) -> str | None:
    """The side effect of a call: by its whole name, else by the first listed prefix."""
    return PYTHON_EFFECTS.get(call) or next((v for k, v in PYTHON_EFFECTS.items() if k.endswith(".") and call.startswith(k)), None)


@dataclass
class Facts:
    """What one file says: nodes and edges as dicts, in source order."""

    module: str
    file: str
    is_test: bool = False
    scope: dict[str, str] = field(default_factory=dict)
    imports: dict[str, str] = field(default_factory=dict)
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)

    def resolve(self, call: str) -> tuple[str, float]:
        """A name of this file, or one that an import brings in, or the text itself."""
        if call in self.scope:
            return self.scope[call], 1.0
        root, _, rest = call.partition(".")
        if root in self.imports:
            return self.imports[root] + (f".{rest}" if rest else ""), 0.8
        return call, 0.3

    def edge(self, src: str, dst: str, kind: str, confidence: float, detail: str | None = None) -> None:
        self.edges.append({"src": src, "dst": dst, "kind": kind, "confidence": confidence, "detail": detail})

    def node(self, id_: str, kind: str, name: str, tree: ast.AST, shown: str | None, doc: str | None, is_test: bool) -> None:
        self.nodes.append(
            {
                "id": id_, "kind": kind, "module": self.module, "file": self.file, "line_start": tree.lineno, "line_end": tree.end_lineno or tree.lineno,
                "signature": shown, "docstring": doc, "is_public": int(not name.startswith("_")), "is_test": int(is_test),
                "body_hash": hashlib.sha256(ast.dump(tree).encode()).hexdigest(),
            }
        )

    def learn_names(self, tree: ast.Module) -> None:
        """Names at module level: definitions, methods as Class.method, imports by the name they bind."""
        for item in tree.body:
            if isinstance(item, (*_FUNCTIONS, ast.ClassDef)):
                self.scope[item.name] = f"{self.module}.{item.name}"
            if isinstance(item, ast.ClassDef):
                for m in item.body:
                    if isinstance(m, _FUNCTIONS):
                        self.scope[f"{item.name}.{m.name}"] = f"{self.module}.{item.name}.{m.name}"
            if isinstance(item, ast.Import):
                self.imports |= {a.asname or a.name: a.name for a in item.names}
            if isinstance(item, ast.ImportFrom):
                self.imports |= {a.asname or a.name: ".".join(filter(None, (item.module, a.name))) for a in item.names}

    def function(self, f, owner: str | None) -> None:
        id_ = f"{self.module}.{owner}.{f.name}" if owner else f"{self.module}.{f.name}"
        self.node(id_, "method" if owner else "function", f.name, f, signature(f), ast.get_docstring(f), self.is_test)
        inside = list(ast.walk(f))
        calls = [(c, name) for c in inside if isinstance(c, ast.Call) and (name := dotted(c.func))]
        for _, name in calls:
            dst, confidence = self.resolve(name)
            self.edge(id_, dst, "calls", confidence)
        for item in inside:
            targets = item.targets if isinstance(item, ast.Assign) else [item.target] if isinstance(item, (ast.AugAssign, ast.AnnAssign)) else []
            for t in targets:
                if isinstance(t, ast.Attribute) and owner and isinstance(t.value, ast.Name) and t.value.id == "self":
                    self.edge(id_, f"{self.module}.{owner}.{t.attr}", "mutates", 1.0)
                elif isinstance(t, ast.Name) and not isinstance(item, ast.AnnAssign):
                    self.edge(id_, f"{self.module}.{t.id}", "mutates", 0.8)
        if self.is_test:
            for item in inside:
                about = None
                if isinstance(item, ast.Assert):
                    about = item.test
                elif isinstance(item, ast.Call) and item.args:
                    last = dotted(item.func).rpartition(".")[2]
                    about = item.args[0] if last in PYTHON_ASSERTS or last.startswith("assert_") else None
                for name in asserted(about) if about is not None else ():
                    self.edge(id_, self.resolve(name)[0], "asserts_on", 1.0)
        for _, name in calls:
            if effect := effect_of(name):
                self.edge(id_, f"side_effect:{effect}:{name}", "side_effect", 1.0, f'{{"kind": "{effect}", "call": "{name}"}}')

    def klass(self, c: ast.ClassDef) -> None:
        id_ = f"{self.module}.{c.name}"
        self.node(id_, "class", c.name, c, f"class {c.name}", ast.get_docstring(c), self.is_test)
        bases = [b for b in map(dotted, c.bases) if b]
        for b in bases:
            self.edge(id_, self.scope.get(b) or self.imports.get(b, b), "inherits", 1.0 if b in self.scope else 0.8)
        for m in c.body:
            if isinstance(m, _FUNCTIONS):
                self.function(m, c.name)
                for b in bases:
                    if b in self.scope and f"{b}.{m.name}" in self.scope:
                        self.edge(f"{id_}.{m.name}", f"{self.module}.{b}.{m.name}", "overrides", 1.0)

    def module_level(self, tree: ast.Module) -> None:
        for item in tree.body:
            match item:
                case ast.FunctionDef() | ast.AsyncFunctionDef():
                    self.function(item, None)
                case ast.ClassDef():
                    self.klass(item)
                case ast.Assign() | ast.AnnAssign():
                    for t in item.targets if isinstance(item, ast.Assign) else [item.target]:
                        if isinstance(t, ast.Name):
                            self.node(f"{self.module}.{t.id}", "variable", t.id, item, None, None, False)
        for item in tree.body:
            if isinstance(item, ast.Import):
                for a in item.names:
                    self.edge(self.module, a.name, "imports", 1.0)
            elif isinstance(item, ast.ImportFrom):
                for a in item.names:
                    self.edge(self.module, ".".join(filter(None, (item.module, a.name))), "imports", 1.0)


def parse(content: bytes, module: str, file: str) -> Facts:
    """Facts of a file; a syntax error gives none, text that is not UTF-8 raises."""
    stem = file.rpartition("/")[2].rpartition(".")[0]
    facts = Facts(module, file, stem.startswith("test_") or stem.endswith("_test"))
    text = content.decode("utf-8")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return facts
    facts.learn_names(tree)
    facts.module_level(tree)
    return facts
