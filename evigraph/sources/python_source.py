"""Facts of Python sources, by the standard parser: symbols, imports, calls with effects. Files that don't parse become rows of errors."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, fact string, name string, owner string, target string, line int, end_line int, public boolean, detail string"

# Modules and their actions that have an effect.
EFFECTS = {
    "filesystem": {"os": ("remove", "rename", "mkdir", "makedirs", "unlink"), "shutil": ("rmtree", "copy", "move"), "pathlib": ("Path",)},
    "network": {"requests": ("get", "post", "put", "delete", "request"), "urllib.request": ("urlopen",), "socket": ("socket",)},
    "process": {"subprocess": ("run", "Popen", "call", "check_output"), "os": ("system", "fork")},
    "clock": {"time": ("time", "sleep"), "datetime": ("now",)},
    "random": {"random": ("random", "randint", "choice"), "uuid": ("uuid4",)},
}
_ACTIONS = {(module, action): kind for kind, modules in EFFECTS.items() for module, actions in modules.items() for action in actions}


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def facts(path: str, text: str) -> list[tuple]:
    """Rows of SCHEMA for one file."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, "skipped", None, None, None, getattr(e, "lineno", None), None, None, type(e).__name__)]
    out: list[tuple] = []
    names: dict[str, str] = {}
    exported = next((v for v in (_all_of(n) for n in tree.body) if v is not None), None)

    def visit(body: list[ast.stmt], owner: str) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{owner}.{node.name}" if owner else node.name
                public = node.name in exported if exported is not None and not owner else not node.name.startswith("_")
                kind = "class" if isinstance(node, ast.ClassDef) else "function"
                doc = (ast.get_docstring(node) or "").split("\n")[0]
                out.append((path, kind, node.name, owner or None, None, node.lineno, node.end_lineno, public, doc))
                if not isinstance(node, ast.ClassDef):
                    calls(node, name)
                visit(node.body, name)
            elif isinstance(node, ast.Import):
                for a in node.names:
                    names[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                    out.append((path, "import", a.name, owner or None, a.asname, node.lineno, node.end_lineno, None, None))
            elif isinstance(node, ast.ImportFrom):
                module = "." * node.level + (node.module or "")
                for a in node.names:
                    names[a.asname or a.name] = f"{module}.{a.name}"
                    out.append((path, "import", module, owner or None, a.name, node.lineno, node.end_lineno, None, "star" if a.name == "*" else None))
            elif isinstance(node, (ast.If, ast.Try, ast.With)):
                for part in ("body", "orelse", "finalbody"):
                    visit(getattr(node, part, []), owner)
                for handler in getattr(node, "handlers", []):
                    visit(handler.body, owner)

    def calls(function: ast.AST, owner: str) -> None:
        todo = list(ast.iter_child_nodes(function))
        while todo:
            node = todo.pop()
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                continue  # what they do is theirs
            if isinstance(node, ast.Call) and (name := _dotted(node.func)):
                first, _, rest = name.partition(".")
                full = f"{names.get(first, first)}{'.' if rest else ''}{rest}"
                module, _, action = full.rpartition(".")
                kind = _ACTIONS.get((module, action))
                if not kind:  # a name below an imported module
                    kind = next((k for (m, a), k in _ACTIONS.items() if a == action and module.startswith(m + ".")), None)
                out.append((path, "call", full, owner, kind, node.lineno, node.end_lineno, None, "effect" if kind else None))
            todo.extend(ast.iter_child_nodes(node))

    visit(tree.body, "")
    return out


def _all_of(node: ast.stmt) -> set[str] | None:
    if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
        return {e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
    return None


def scan(files: DataFrame) -> DataFrame:
    """Facts of every Python file of (path, language, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in frames:
            rows = [r for p, t in zip(frame["path"], frame["text"], strict=True) for r in facts(p, t or "")]
            out = pd.DataFrame(rows, columns=columns)
            for c in ("line", "end_line"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.filter("language = 'python'").select("path", "text").mapInPandas(run, SCHEMA)
