"""Targets of unsure Python calls, by what is known of the receiver's type in the same file.

A type is the dotted id of a class.  It is known of parameters and variables with an
annotation, of names bound to a call of a class or of a function with a return annotation,
of ``self`` and its attributes, of ``super()``, and of ``with ... as``.  A class is one of the
file, or an imported name with a capital letter.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping

from weftline.sources.pythoncode import Facts, dotted

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
UNSURE, RESOLVED = 1.0, 0.5


class Module:
    """What one file tells about types."""

    def __init__(self, content: bytes | str, module: str):
        text = content if isinstance(content, str) else content.decode("utf-8")
        self.tree = ast.parse(text)
        self.facts = Facts(module, "")
        self.facts.learn_names(self.tree)
        self.classes = {c.name: c for c in self.tree.body if isinstance(c, ast.ClassDef)}
        self.returns = {f.name: self.annotated(f.returns) for f in self.tree.body if isinstance(f, _FUNCTIONS)}
        self.globals: dict[str, str] = {}
        self.bind(self.tree.body, self.globals, None)
        self.attributes = {name: self._attributes(c) for name, c in self.classes.items()}
        self.targets: dict[tuple[str, str], str] = {}
        for item in self.tree.body:
            if isinstance(item, _FUNCTIONS):
                self._calls(item, None)
            elif isinstance(item, ast.ClassDef):
                for m in item.body:
                    if isinstance(m, _FUNCTIONS):
                        self._calls(m, item)

    def named(self, name: str) -> str | None:
        """The class that a dotted name stands for."""
        if name in self.classes:
            return f"{self.facts.module}.{name}"
        root, _, rest = name.partition(".")
        known = self.facts.imports.get(root)
        whole = f"{known}.{rest}" if known and rest else known
        return whole if whole and whole.rpartition(".")[2][:1].isupper() else None

    def annotated(self, note: ast.expr | None) -> str | None:
        """The class of an annotation; of ``X | None`` and ``Optional[X]`` that of X."""
        match note:
            case ast.Constant(value=str(text)):
                try:
                    return self.annotated(ast.parse(text, mode="eval").body)
                except SyntaxError:
                    return None
            case ast.Name() | ast.Attribute():
                return self.named(dotted(note))
            case ast.BinOp(op=ast.BitOr()):
                return self.annotated(note.left) or self.annotated(note.right)
            case ast.Subscript() if dotted(note.value).rpartition(".")[2] == "Optional":
                return self.annotated(note.slice)
        return None

    def type_of(self, expr: ast.expr, names: dict[str, str], owner: ast.ClassDef | None) -> str | None:
        match expr:
            case ast.Name():
                return names.get(expr.id) or self.globals.get(expr.id)
            case ast.Await() | ast.NamedExpr():
                return self.type_of(expr.value, names, owner)
            case ast.Attribute():
                inner = self.type_of(expr.value, names, owner)
                own = (inner or "").removeprefix(f"{self.facts.module}.")
                return self.attributes.get(own, {}).get(expr.attr) if inner and hasattr(self, "attributes") else None
            case ast.Call(func=ast.Name(id="super")) if owner is not None and owner.bases:
                return self.named(dotted(owner.bases[0]))
            case ast.Call():
                name = dotted(expr.func) if not isinstance(expr.func, ast.Call) else ""
                return self.named(name) or self.returns.get(name)
        return None

    def bind(self, body: list[ast.stmt], names: dict[str, str], owner: ast.ClassDef | None) -> None:
        """Types of names that statements (and blocks within them) bind, in source order."""
        for item in body:
            pairs: list[tuple[ast.expr, ast.expr | None, str | None]] = []
            match item:
                case ast.Assign():
                    pairs = [(t, item.value, None) for t in item.targets]
                case ast.AnnAssign():
                    pairs = [(item.target, item.value, self.annotated(item.annotation))]
                case ast.With() | ast.AsyncWith():
                    pairs = [(w.optional_vars, w.context_expr, None) for w in item.items if w.optional_vars is not None]
            for target, value, known in pairs:
                if isinstance(target, ast.Name):
                    found = known or (self.type_of(value, names, owner) if value is not None else None)
                    if found:
                        names[target.id] = found
                    else:
                        names.pop(target.id, None)
            if not isinstance(item, (*_FUNCTIONS, ast.ClassDef)):
                for block in ("body", "orelse", "finalbody"):
                    self.bind(getattr(item, block, []) or [], names, owner)
                for h in getattr(item, "handlers", []):
                    self.bind(h.body, names, owner)

    def _names(self, f, owner: ast.ClassDef | None) -> dict[str, str]:
        names = {}
        arguments = [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs]
        for i, a in enumerate(arguments):
            if owner is not None and i == 0 and a.arg == "self":
                names["self"] = f"{self.facts.module}.{owner.name}"
            elif found := self.annotated(a.annotation):
                names[a.arg] = found
        self.bind(f.body, names, owner)
        return names

    def _attributes(self, c: ast.ClassDef) -> dict[str, str]:
        found = {item.target.id: t for item in c.body if isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name) and (t := self.annotated(item.annotation))}
        for m in (m for m in c.body if isinstance(m, _FUNCTIONS)):
            names = self._names(m, c)
            for item in ast.walk(m):
                if isinstance(item, (ast.Assign, ast.AnnAssign)) and item.value is not None:
                    for t in item.targets if isinstance(item, ast.Assign) else [item.target]:
                        if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                            known = self.annotated(item.annotation) if isinstance(item, ast.AnnAssign) else None
                            if kind := known or self.type_of(item.value, names, c):
                                found.setdefault(t.attr, kind)
        return found

    def method(self, kind: str, name: str) -> str | None:
        """The id of a class's method; of a class of this file only if it or a base of this file has it."""
        own = kind.removeprefix(f"{self.facts.module}.")
        if own not in self.classes:
            return f"{kind}.{name}"
        seen = set()
        todo = [own]
        while todo:
            c = todo.pop(0)
            if c in seen:
                continue
            seen.add(c)
            if f"{c}.{name}" in self.facts.scope:
                return f"{self.facts.module}.{c}.{name}"
            bases = [dotted(b) for b in self.classes[c].bases]
            todo += [b for b in bases if b in self.classes]
            outside = [k for b in bases if b not in self.classes and (k := self.named(b))]
            if outside and not todo:
                return f"{outside[0]}.{name}"
        return None

    def _calls(self, f, owner: ast.ClassDef | None) -> None:
        src = ".".join(filter(None, (self.facts.module, owner.name if owner else None, f.name)))
        names = self._names(f, owner)
        for c in (c for c in ast.walk(f) if isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute)):
            kind = self.type_of(c.func.value, names, owner)
            target = self.method(kind, c.func.attr) if kind else None
            if target:
                stated = self.facts.resolve(dotted(c.func))[0]
                self.targets.setdefault((src, stated), target)
                self.targets.setdefault((src, c.func.attr), target)


def source_of(symbol: str, modules: Mapping | set) -> str | None:
    """The module whose file holds a symbol: its longest prefix that is one."""
    parts = symbol.split(".")
    return next((m for i in range(len(parts), 0, -1) if (m := ".".join(parts[:i])) in modules), None)


def resolve_calls(edges: list[dict], sources: Mapping[str, bytes | str]) -> list[dict]:
    """edges, of which unsure calls whose receiver's type is known point to its method with confidence 0.5.

    Other kinds, sure calls, symbols of no given source (module: text) and sources that do
    not parse stay as they are.
    """
    read: dict[str, Module | None] = {}
    out = []
    for edge in edges:
        module = source_of(edge["src"], sources) if edge.get("kind") == "calls" and (edge.get("confidence") or 1.0) < UNSURE else None
        if module is not None and module not in read:
            try:
                read[module] = Module(sources[module], module)
            except (SyntaxError, ValueError, RecursionError):
                read[module] = None
        known = read.get(module) if module is not None else None
        target = known.targets.get((edge["src"], edge["dst"])) if known else None
        out.append({**edge, "dst": target, "confidence": RESOLVED} if target and target != edge["dst"] else edge)
    return out
