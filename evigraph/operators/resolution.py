"""Module resolution: which file an import means, or what kind of boundary it ends at, by joins on equality.

A specifier leads to attempts, paths inside a project in an order. A path may mean a file in about forty ways: as written, with an
extension put behind or in place of its own, as a folder with an index, or as declarations. Instead of forty probes an
attempt makes four (as written, to be lengthened, without its extension, as a folder), and each file is entered under
the few keys by which it can be meant, with the rank of that way. The least (attempt, rank) wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import cut, union_all

# Extensions in the order they are tried, and names that tell generated sources from others.
EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "svelte")
DECLARATIONS = ("d.ts", "d.mts", "d.cts")
SOURCE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "svelte")
NO_SOURCES = (
    "css", "scss", "sass", "less", "styl", "json", "json5", "yaml", "yml", "toml", "svg", "png", "jpg", "jpeg", "gif", "webp", "avif",
    "woff", "woff2", "ttf", "glsl", "vert", "frag", "md", "mdx", "svx",
)
GENERATED_SOURCES = (".svelte-kit", "__generated__", "generated", "paraglide")
GENERATED_EXPORTS = (*GENERATED_SOURCES, "build", "dist", "pkg", "target")
RESOURCE_QUERIES = ("compose", "raw", "url")
VIRTUAL = ("$app", "$env", "$types")
KEY = ["project", "path", "specifier"]


def normal_path(path: Column) -> Column:
    """Without empty and ``.`` segments; ``..`` takes the segment before it, and stays where there is none."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(parts, empty, lambda done, x: F.when((x == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("..")) != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    return F.array_join(folded, "/")


def joined_path(*parts: Column) -> Column:
    return normal_path(F.concat_ws("/", *parts))


def folder(path: Column) -> Column:
    """What stands before the last segment."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """The last extension of a name that doesn't begin with it, or an empty text."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def plain_specifier(specifier: Column) -> Column:
    """Without query and fragment; a leading number sign is no fragment."""
    return F.regexp_replace(specifier, r"\?.*$|(?<!^)#.*$", "")


def _segments(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def above(path: Column) -> Column:
    """The folders that hold a path, from its own up to the empty one."""
    parts = F.split(folder(path), "/")
    longer = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(folder(path) == "", F.array(F.lit(""))).otherwise(F.concat(longer, F.array(F.lit(""))))


def package_and_path(specifier: Column) -> Column:
    """(package, public_path) of a bare specifier, null for others: two segments name a scoped package."""
    parts = F.split(specifier, "/")
    n = F.when(specifier.startswith("@"), 2).otherwise(1)
    named = F.slice(parts, F.lit(1), n)
    bare = ~specifier.rlike("^[.#/]|:") & (F.size(parts) >= n) & ~F.array_contains(named, "")
    public = F.when(F.size(parts) == n, ".").otherwise(F.concat(F.lit("./"), F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))), "/")))
    return F.when(bare, F.struct(F.array_join(named, "/").alias("package"), public.alias("public_path")))


def captured(pattern: Column, value: Column) -> Column:
    """What a pattern's first asterisk stands for in a value; an empty text where a pattern without one is the value; null if it doesn't fit."""
    prefix, suffix = F.substring_index(pattern, "*", 1), F.regexp_replace(pattern, r"^[^*]*\*", "")
    inner = F.substring(value, F.length(prefix) + 1, F.greatest(F.length(value) - F.length(prefix) - F.length(suffix), F.lit(0)))
    fits = value.startswith(prefix) & value.endswith(suffix) & (F.length(value) >= F.length(prefix) + F.length(suffix))
    return F.when(~pattern.contains("*"), F.when(pattern == value, "")).when(fits, inner)


def with_capture(target: Column, pattern: Column, value: Column) -> Column:
    """The target with its first asterisk replaced by what the pattern's stands for."""
    got = captured(pattern, value)
    filled = F.concat(F.substring_index(target, "*", 1), got, F.regexp_replace(target, r"^[^*]*\*", ""))
    return F.when(pattern.contains("*") & target.contains("*"), filled).otherwise(target)


def file_keys(modules: DataFrame) -> DataFrame:
    """(project, way, key, rank, node): the keys under which each file (node, project, path) can be meant."""
    path, name = F.col("path"), F.element_at(F.split("path", "/"), -1)

    def entry(way: str, key: Column, rank: int, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(way).alias("way"), key.alias("key"), F.lit(rank).alias("rank")))

    keys = [entry("raw", path, 0, F.lit(True))]
    ways = [(e, 1 + 2 * k, 2 + 2 * k, 1 + 2 * len(EXTENSIONS) + k) for k, e in enumerate(EXTENSIONS)]
    after = 1 + 3 * len(EXTENSIONS)
    ways += [(e, after + 1 + 2 * k, after + 2 * k, after + 2 * len(DECLARATIONS) + k) for k, e in enumerate(DECLARATIONS)]
    for e, behind, instead, index in ways:
        stem = F.substring(path, F.lit(1), F.length(path) - len(e) - 1)
        keys += [entry("behind", stem, behind, path.endswith(f".{e}")), entry("instead", stem, instead, path.endswith(f".{e}")), entry("index", folder(path), index, name == f"index.{e}")]
    return modules.select("project", "node", F.explode(F.array_compact(F.array(*keys))).alias("k")).select("project", "k.*", "node")


def found_files(attempts: DataFrame, modules: DataFrame) -> DataFrame:
    """(project, path, specifier, route, node, in_project): the file of the first attempt (project, path, specifier, route, order, in_project, raw) of a route that means one."""
    raw = F.col("raw")
    stem = F.when(extension(raw) != "", F.regexp_replace(raw, r"\.[^./]*$", "")).otherwise(raw)
    probes = F.array(*[F.struct(F.lit(way).alias("way"), key.alias("key")) for way, key in (("raw", raw), ("behind", raw), ("instead", stem), ("index", raw))])
    asked = attempts.select(*KEY, "route", "order", "in_project", F.explode(probes).alias("p")).select(*KEY, "route", "order", "in_project", "p.*")
    files = file_keys(modules).withColumnRenamed("project", "in_project")
    best = asked.join(files, ["in_project", "way", "key"]).groupBy(*KEY, "route").agg(F.min(F.struct("order", "rank", "node", "in_project")).alias("best"))
    return best.select(*KEY, "route", "best.node", "best.in_project")


def resolve_modules(imports: DataFrame, modules: DataFrame, projects: DataFrame, exports: DataFrame, aliases: DataFrame, package_imports: DataFrame, present: DataFrame) -> DataFrame:
    """(project, path, specifier, target_kind, target, bypass) of each distinct import.

    ``imports``: (project, path, specifier), the path being the importing module's; ``modules``: (node, project, path), scanned files;
    ``projects``: (project, root, member, base_url); ``exports``: (package, project, public_path, source), a row without public path
    for a package that exports nothing; ``aliases``: (project, pattern, targets array) tried by pattern; ``package_imports``:
    (project, directory, pattern, target), a row without pattern for a folder whose manifest maps nothing; ``present``: (project,
    path) of all files, scanned or not.

    Relative paths mean files of the project, or of the one with the deepest root that holds them. ``#`` names are mapped by the
    nearest manifest, ``$lib`` by the nearest source folder beside a Svelte configuration. Packages of the workspace
    answer for their names with what they export. Aliases come last, then the base folder; all else is external.
    """
    asked = cut(imports.select(*KEY).distinct())
    s = F.col("specifier")
    query = F.split(F.regexp_replace(F.regexp_extract(s, r"\?(.*)$", 1), "#.*$", ""), "&")
    resource = s.contains("?") & F.arrays_overlap(F.transform(query, lambda x: F.substring_index(x, "=", 1)), F.array(*[F.lit(q) for q in RESOURCE_QUERIES]))
    plain = plain_specifier(s)
    name = F.element_at(F.split(s, "/"), -1)
    virtual = s.isin(*VIRTUAL) | s.rlike(r"^\$(app|env)/") | (name == "$types") | name.startswith("$types.")
    sort = F.when(virtual | extension(plain).isin(*NO_SOURCES), "external").when(plain.isin(".", "..") | plain.rlike(r"^\.{0,2}/"), "relative").when(plain.startswith("#"), "mapped").when(plain.contains(":"), "external").otherwise("bare")
    rows = cut(asked.select(*KEY, resource.alias("resource"), plain.alias("plain"), sort.alias("sort")))  # many joins read these few columns
    attempt = [*KEY, "route", "order", "in_project", "raw"]
    roots = projects.select("project", F.when(F.btrim("root", F.lit("/")) == ".", "").otherwise(F.btrim("root", F.lit("/"))).alias("root"), "member", "base_url")

    # relative: in the project itself; a leading slash stands for the workspace, then for the nearest manifest's folder
    relative = rows.filter("sort = 'relative'")
    manifests = package_imports.select("project", "directory").distinct()
    slash = relative.filter("plain LIKE '/%'")
    nearest = slash.select(*KEY, "plain", F.posexplode(above(F.col("path"))).alias("near", "directory")).join(manifests, ["project", "directory"]).groupBy(*KEY, "plain").agg(F.min_by("directory", "near").alias("directory"))
    within = relative.filter("plain NOT LIKE '/%'").select(*KEY, joined_path(folder(F.col("path")), F.col("plain")).alias("raw")).unionByName(nearest.select(*KEY, joined_path(F.col("directory"), F.col("plain")).alias("raw")))
    own = within.select(*KEY, F.lit("file").alias("route"), F.array(F.lit(1), F.lit(0)).alias("order"), F.col("project").alias("in_project"), "raw")
    whole = slash.select(*KEY, normal_path(F.col("plain")).alias("whole"))
    from_root = _inside(whole, roots.filter("root <> ''")).groupBy(*KEY).agg(F.max_by(F.struct("in_project", "raw"), F.length("root")).alias("b")).select(*KEY, F.lit("file").alias("route"), F.array(F.lit(0), F.lit(0)).alias("order"), "b.*")
    across = _across(within, roots).select(*KEY, F.lit("file").alias("route"), F.array(F.lit(2), -F.length("root")).alias("order"), "in_project", "raw")

    # mapped: the nearest manifest decides, by its first pattern that fits
    mapped = rows.filter("sort = 'mapped'")
    held = mapped.select(*KEY, "plain", F.posexplode(above(F.col("path"))).alias("near", "directory")).join(manifests, ["project", "directory"]).groupBy(*KEY, "plain").agg(F.min_by("directory", "near").alias("directory"))
    fits = held.join(package_imports.filter("pattern IS NOT NULL"), ["project", "directory"]).filter(captured(F.col("pattern"), F.col("plain")).isNotNull())
    chosen = fits.groupBy(*KEY, "plain", "directory").agg(F.min(F.struct("pattern", "target")).alias("m")).select(*KEY, "directory", with_capture(F.col("m.target"), F.col("m.pattern"), F.col("plain")).alias("mapped_to"))
    inside = chosen.filter("mapped_to RLIKE '^[.]{1,2}/'").select(*KEY, F.lit("mapped").alias("route"), F.array(F.lit(0)).alias("order"), F.col("project").alias("in_project"), joined_path(F.col("directory"), F.col("mapped_to")).alias("raw"))

    # bare: $lib, packages of the workspace, aliases, the base folder
    bare = rows.filter("sort = 'bare'")
    lib = bare.filter("plain = '$lib' OR plain LIKE '$lib/%'").select(*KEY, F.regexp_replace("plain", r"^\$lib/?", "").alias("rest"))
    configured = present.filter(F.element_at(F.split("path", "/"), -1).isin("svelte.config.js", "svelte.config.ts", "svelte.config.mjs")).select("project", folder(F.col("path")).alias("app")).distinct()
    sources = lib.select(*KEY, "rest", F.posexplode(F.filter(above(F.col("path")), lambda x: x.rlike("(^|/)src$"))).alias("near", "source")).withColumn("app", folder(F.col("source")))
    at = sources.join(configured, ["project", "app"]).groupBy(*KEY).agg(F.min_by("source", "near").alias("source"))
    of_lib = lib.join(at, KEY, "left").select(*KEY, F.lit("lib").alias("route"), F.array(F.lit(0)).alias("order"), F.col("project").alias("in_project"), joined_path(F.coalesce("source", F.lit("src")), F.lit("lib"), F.col("rest")).alias("raw"))
    split = bare.select(*KEY, package_and_path(F.col("plain")).alias("n")).select(*KEY, "n.*")
    packages = exports.groupBy("package").agg(F.min("project").alias("owner"))
    named = split.join(packages, "package").join(exports.filter("public_path IS NOT NULL").groupBy("package", "public_path").agg(F.min("source").alias("source")), ["package", "public_path"], "left")
    public = F.regexp_replace("public_path", r"^\./", "")
    of_package = named.filter((F.col("source").isNotNull()) | (F.col("owner") == F.col("project"))).select(*KEY, F.lit("package").alias("route"), F.array(F.lit(0)).alias("order"), F.col("owner").alias("in_project"), normal_path(F.coalesce("source", public)).alias("raw"))
    exported = named.select(*KEY, "owner", "public_path", "source", normal_path(F.coalesce("source", public)).alias("source_path"))
    lying = present.select(F.col("project").alias("owner"), F.col("path").alias("source_path")).distinct().withColumn("lies", F.lit(True))
    exported = exported.join(lying, ["owner", "source_path"], "left")
    ranked = aliases.select("project", "pattern", F.posexplode("targets").alias("k", "target"))
    aliased = bare.join(ranked, "project").filter(captured(F.col("pattern"), F.col("plain")).isNotNull()).select(*KEY, "pattern", "k", normal_path(with_capture(F.col("target"), F.col("pattern"), F.col("plain"))).alias("raw"))
    order = lambda far: F.concat(F.lit("0"), F.col("pattern"), F.lit("\x00"), F.lpad(F.col("k").cast("string"), 6, "0"), far)
    by_alias = aliased.select(*KEY, order(F.lit("0")).alias("text_order"), F.col("project").alias("in_project"), "raw")
    far_alias = _across(aliased, roots).select(*KEY, F.concat(order(F.lit("1")), F.lpad((9999 - F.length("root")).cast("string"), 4, "0")).alias("text_order"), "in_project", "raw")
    by_base = bare.join(roots.filter("base_url <> ''").select("project", "base_url"), "project").select(*KEY, F.lit("1").alias("text_order"), F.col("project").alias("in_project"), joined_path(F.col("base_url"), F.col("plain")).alias("raw"))
    of_alias = cut(union_all([by_alias, far_alias, by_base]))
    alias_files = found_files(of_alias.select(*KEY, F.lit("alias").alias("route"), F.col("text_order").alias("order"), "in_project", "raw"), modules)

    attempts = cut(union_all([x.select(*attempt) for x in (own, from_root, across, inside, of_lib, of_package)]))
    files = found_files(attempts, modules).unionByName(alias_files).groupBy(*KEY).agg(F.max_by(F.struct("route", "node", "in_project"), F.element_at(F.create_map(*[F.lit(x) for kv in {"file": 9, "mapped": 9, "lib": 3, "package": 2, "alias": 1}.items() for x in kv]), F.col("route"))).alias("f"))
    unscanned = within.select(*KEY, "raw").join(present.select("project", F.col("path").alias("raw")).distinct().withColumn("there", F.lit(True)), ["project", "raw"], "left")
    beyond = unscanned.groupBy(*KEY).agg(F.max(F.col("raw").rlike(r"^\.\.(/|$)") | _segments(F.col("raw"), GENERATED_SOURCES) | F.coalesce("there", F.lit(False))).alias("beyond"))
    met = rows.join(files, KEY, "left").join(beyond, KEY, "left").join(chosen.select(*KEY, "mapped_to"), KEY, "left").join(exported.select(*KEY, "owner", "public_path", "source", "lies"), KEY, "left")
    met = met.join(roots.select(F.col("project").alias("at_project"), "member"), F.col("f.in_project") == F.col("at_project"), "left")

    file, route, sort_ = F.col("f.node"), F.col("f.route"), F.col("sort")
    odd = (extension(F.col("plain")) != "") & ~extension(F.col("plain")).isin(*SOURCE_EXTENSIONS)
    generated = _segments(F.coalesce("source", "public_path"), GENERATED_EXPORTS)
    by_package = F.when(F.col("source").isNull() & (F.col("owner") != F.col("project")), F.when(generated, "unsupported").otherwise("unexported_workspace")).when(file.isNotNull() & (route == "package"), "node")
    by_package = by_package.when(F.col("source").isNotNull() & (F.coalesce("lies", F.lit(False)) | generated), "unsupported").otherwise("unresolved_internal")
    kind = (
        F.when(sort_ == "external", "external")
        .when(sort_ == "relative", F.when(file.isNotNull(), "node").when(odd | F.coalesce("beyond", F.lit(False)), "unsupported").otherwise("unresolved_internal"))
        .when(sort_ == "mapped", F.when(F.col("mapped_to").isNull(), "unsupported").when(~F.col("mapped_to").rlike(r"^\.{1,2}/"), "external").when(file.isNotNull(), "node").otherwise("unresolved_internal"))
        .when(route == "lib", "node")
        .when(F.col("owner").isNotNull(), by_package)
        .when(route == "alias", "node")
        .otherwise("external")
    )
    settled = F.when(F.col("resource") & (kind != "node"), "external").otherwise(kind)
    outside = F.when(F.col("sort") == "mapped", F.coalesce("mapped_to", "specifier")).otherwise(F.col("specifier"))
    target = F.when(settled == "node", file).when((settled == "external") & ~F.col("resource"), outside).otherwise(F.col("specifier"))
    bypass = (settled == "node") & ~F.col("resource") & route.isin("file", "alias") & (F.col("f.in_project") != F.col("project")) & F.coalesce("member", F.lit(False))
    return met.select(*KEY, settled.alias("target_kind"), target.alias("target"), F.coalesce(bypass, F.lit(False)).alias("bypass"))


def _inside(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (..., whole), a path of the workspace, with each project (in_project, root) whose root holds it and the path in there (raw)."""
    met = rows.withColumn("root", F.explode(above(F.concat(F.col("whole"), F.lit("/x"))))).join(roots.select(F.col("project").alias("in_project"), "root"), "root")
    return met.withColumn("raw", F.when(F.col("root") == "", F.col("whole")).otherwise(F.substring("whole", F.length("root") + 2, F.length("whole"))))


def _across(within: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (project, ..., raw) whose path leads into other projects, with those and the path in there in place of ``raw``."""
    whole = within.join(roots.select("project", F.col("root").alias("own_root")), "project").withColumn("whole", joined_path(F.col("own_root"), F.col("raw"))).drop("raw", "own_root")
    return _inside(whole, roots.filter("root <> ''")).filter(F.col("in_project") != F.col("project"))


def connections(resolved: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst, kind, target_kind): an edge for each import (src, project, path, specifier, kind); a bypass has a kind of its own."""
    kind = F.when(F.col("bypass"), "workspace_source_bypass").otherwise(F.col("kind"))
    return imports.join(resolved, KEY).select("src", F.col("target").alias("dst"), kind.alias("kind"), "target_kind").distinct()


def import_boundaries(resolved: DataFrame, imports: DataFrame) -> DataFrame:
    """(project, node, kind, effect) where an import leaves the graph."""
    kind = F.when(F.col("target_kind") == "unresolved_internal", "unresolved_internal").when(F.col("target_kind") == "unsupported", "unsupported_dependency")
    return imports.join(resolved, KEY).select("project", F.col("src").alias("node"), kind.alias("kind"), F.lit("partial").alias("effect")).filter("kind IS NOT NULL").distinct()
