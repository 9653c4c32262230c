"""Module resolution on a small workspace, case by case."""

import pytest
from pyspark.sql import functions as F

from evigraph.operators import resolution

MODULES = {
    "app": ["src/a.ts", "src/b.tsx", "src/c/index.ts", "src/c/d.svelte", "src/lib/util.js", "src/two.ts", "src/two.js", "src/two/index.ts", "src/types.d.ts", "src/.hidden.ts", "src/e.test.ts", "inner/src/lib/own.ts", "inner/src/page.ts", "src/x.y.ts"],
    "core": ["src/index.ts", "src/public.ts", "src/private.ts", "deep.ts"],
    "tool": ["main.js"],
}
PROJECTS = [("app", "apps/app", True, ""), ("core", "packages/core", True, "src"), ("tool", "packages/tool", False, ""), ("top", ".", False, "")]
EXPORTS = [("@x/core", "core", ".", "./src/index.ts"), ("@x/core", "core", "./public", "src/public.ts"), ("@x/core", "core", "./built", "./dist/built.js"), ("@x/core", "core", "./gone", "./src/gone.ts"), ("@x/core", "core", "./lying", "./src/lying.ts"), ("tool", "tool", None, None)]
ALIASES = [("app", "@core/*", ["../../packages/core/src/*"]), ("app", "@main", ["../../packages/tool/main"]), ("app", "~/*", ["missing/*", "src/*"]), ("app", "a*z", ["src/*.ts"])]
IMPORTS = [("app", "", "#util", "./src/lib/util.js"), ("app", "", "#dep", "lodash"), ("app", "", "#all/*", "./src/*"), ("app", "inner", None, None)]
PRESENT = [("app", "inner/svelte.config.js"), ("app", "src/skipped.ts"), ("core", "src/lying.ts")]

CASES = {
    ("src/a.ts", "./b"): ("node", "app:src/b.tsx"), ("src/a.ts", "./b.js"): ("node", "app:src/b.tsx"), ("src/a.ts", "./c"): ("node", "app:src/c/index.ts"), ("src/a.ts", "./c/"): ("node", "app:src/c/index.ts"), ("src/c/d.svelte", "."): ("node", "app:src/c/index.ts"),
    ("src/c/d.svelte", "../a"): ("node", "app:src/a.ts"), ("src/a.ts", "./two"): ("node", "app:src/two.ts"), ("src/a.ts", "./two.js"): ("node", "app:src/two.js"), ("src/a.ts", "./two.mjs"): ("node", "app:src/two.ts"), ("src/a.ts", "./two/index"): ("node", "app:src/two/index.ts"),
    ("src/a.ts", "./types"): ("node", "app:src/types.d.ts"), ("src/a.ts", "./types.d.ts"): ("node", "app:src/types.d.ts"), ("src/a.ts", "./.hidden"): ("node", "app:src/.hidden.ts"), ("src/a.ts", "./e.test"): ("node", "app:src/e.test.ts"), ("src/a.ts", "./e.test.js"): ("node", "app:src/e.test.ts"),
    ("src/a.ts", "./x.z"): ("unsupported", "./x.z"), ("src/a.ts", "./x.y"): ("node", "app:src/x.y.ts"), ("src/a.ts", "./nothing"): ("unresolved_internal", "./nothing"), ("src/a.ts", "./script.py"): ("unsupported", "./script.py"), ("src/a.ts", "./skipped.ts"): ("unsupported", "./skipped.ts"),
    ("src/a.ts", "../../outside"): ("unsupported", "../../outside"), ("src/a.ts", "./generated/x"): ("unsupported", "./generated/x"), ("src/a.ts", "./b.tsx?x=1#top"): ("node", "app:src/b.tsx"), ("src/a.ts", "./b?raw"): ("node", "app:src/b.tsx"), ("src/a.ts", "./zz?a=1&url=2"): ("external", "./zz?a=1&url=2"),
    ("src/a.ts", "../../../packages/core/src/private"): ("node", "core:src/private.ts", True), ("src/a.ts", "../../../packages/tool/main"): ("node", "tool:main.js"), ("src/a.ts", "../../../packages/core/src/private?raw"): ("node", "core:src/private.ts"),
    ("src/a.ts", "/packages/core/deep"): ("node", "core:deep.ts", True), ("src/a.ts", "/src/b"): ("node", "app:src/b.tsx"), ("src/a.ts", "/nowhere"): ("unresolved_internal", "/nowhere"),
    ("src/a.ts", "./style.css"): ("external", "./style.css"), ("src/a.ts", "$app/stores"): ("external", "$app/stores"), ("src/a.ts", "./$types"): ("external", "./$types"), ("src/a.ts", "node:fs"): ("external", "node:fs"), ("src/a.ts", "react"): ("external", "react"),
    ("src/a.ts", "$lib/util"): ("node", "app:src/lib/util.js"), ("inner/src/page.ts", "$lib/own"): ("node", "app:inner/src/lib/own.ts"), ("src/a.ts", "$lib/own"): ("external", "$lib/own"),
    ("src/a.ts", "#util"): ("node", "app:src/lib/util.js"), ("src/a.ts", "#all/a"): ("node", "app:src/a.ts"), ("src/a.ts", "#all/none"): ("unresolved_internal", "#all/none"), ("src/a.ts", "#dep"): ("external", "lodash"), ("src/a.ts", "#what"): ("unsupported", "#what"), ("inner/src/page.ts", "#util"): ("unsupported", "#util"),
    ("src/a.ts", "@x/core"): ("node", "core:src/index.ts"), ("src/a.ts", "@x/core/public"): ("node", "core:src/public.ts"), ("src/a.ts", "@x/core/private"): ("unexported_workspace", "@x/core/private"), ("src/a.ts", "@x/core/dist/a"): ("unsupported", "@x/core/dist/a"),
    ("src/a.ts", "@x/core/built"): ("unsupported", "@x/core/built"), ("src/a.ts", "@x/core/gone"): ("unresolved_internal", "@x/core/gone"), ("src/a.ts", "@x/core/lying"): ("unsupported", "@x/core/lying"), ("src/a.ts", "tool"): ("unexported_workspace", "tool"), ("src/a.ts", "@x"): ("external", "@x"),
    ("src/a.ts", "@core/private"): ("node", "core:src/private.ts", True), ("src/a.ts", "@main"): ("node", "tool:main.js"), ("src/a.ts", "~/a"): ("node", "app:src/a.ts"), ("src/a.ts", "abz"): ("node", "app:src/b.tsx"), ("src/a.ts", "aaz"): ("node", "app:src/a.ts"), ("src/a.ts", "az"): ("external", "az"),
}
OF_CORE = {("src/index.ts", "@x/core/src/private"): ("node", "core:src/private.ts"), ("src/index.ts", "@x/core/nope"): ("unresolved_internal", "@x/core/nope"), ("src/index.ts", "private"): ("node", "core:src/private.ts"), ("src/index.ts", "nope"): ("external", "nope")}


@pytest.fixture(scope="module")
def workspace(spark):
    make = spark.createDataFrame
    return {
        "modules": make([(f"{p}:{x}", p, x) for p, xs in MODULES.items() for x in xs], "node string, project string, path string"),
        "projects": make(PROJECTS, "project string, root string, member boolean, base_url string"), "exports": make(EXPORTS, "package string, project string, public_path string, source string"),
        "aliases": make(ALIASES, "project string, pattern string, targets array<string>"), "package_imports": make(IMPORTS, "project string, directory string, pattern string, target string"), "present": make(PRESENT, "project string, path string"),
    }


def test_every_kind_of_target(spark, workspace):
    want = {("app", *k): (*v, False)[:3] for k, v in CASES.items()} | {("core", *k): (*v, False)[:3] for k, v in OF_CORE.items()}
    imports = spark.createDataFrame(list(want) * 2, "project string, path string, specifier string")
    got = {(r.project, r.path, r.specifier): (r.target_kind, r.target, r.bypass) for r in resolution.resolve_modules(imports, **workspace).collect()}
    assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {} and len(got) == len(want)


def test_edges_and_boundaries(spark, workspace):
    imports = spark.createDataFrame([("app:src/a.ts", "app", "src/a.ts", s, "import") for s in ("./b", "@core/private", "./nothing", "./script.py", "react")], "src string, project string, path string, specifier string, kind string")
    resolved = resolution.resolve_modules(imports, **workspace)
    assert {(r.dst, r.kind, r.target_kind) for r in resolution.connections(resolved, imports).collect()} == {
        ("app:src/b.tsx", "import", "node"), ("core:src/private.ts", "workspace_source_bypass", "node"), ("./nothing", "import", "unresolved_internal"), ("./script.py", "import", "unsupported"), ("react", "import", "external"),
    }
    assert {(r.node, r.kind) for r in resolution.import_boundaries(resolved, imports).collect()} == {("app:src/a.ts", "unresolved_internal"), ("app:src/a.ts", "unsupported_dependency")}


def test_paths(spark):
    for path, plain in {"a/./b//c": "a/b/c", "a/../b": "b", "../a/../..": "../..", "": "", "./x/..": ""}.items():
        assert spark.range(1).select(resolution.normal_path(F.lit(path))).first()[0] == plain
    assert spark.range(1).select(resolution.above(F.lit("a/b/c.ts"))).first()[0] == ["a/b", "a", ""] and spark.range(1).select(resolution.above(F.lit("c.ts"))).first()[0] == [""]
