"""Evidence of projects: manifests, imports and lock files, and whether an advisory's package applies to a file.

Files are rows ``project, path, content`` (text); any number of projects is looked at in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How sources name packages, and the sections of a manifest that declare them.
IMPORT = r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)['"]([^'"]+)['"]"""
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
INTERNAL = r"^(\.|/|node:|#)"
TOOL_FOLDERS = r"(^|/)(\.git|\.pairlens)/"


def _head(path: Column) -> Column:
    """The package at the front of a path: two parts under a scope, else one."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.when(path.startswith("@"), 2).otherwise(1)), "/")


def package_of(specifier: Column) -> Column:
    """The package that an import names; null for relative, absolute, built-in and internal ones."""
    return F.when((specifier != "") & ~specifier.rlike(INTERNAL), _head(specifier))


def _text(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def imports(files: DataFrame) -> DataFrame:
    """Distinct (project, path, package) that sources import; null and empty contents import nothing."""
    named = F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(IMPORT), 1), package_of))
    return files.select("project", "path", F.explode(named).alias("package")).where("package IS NOT NULL").distinct()


def _manifests(files: DataFrame) -> DataFrame:
    body = F.try_parse_json("content")
    rows = files.where((F.substring_index("path", "/", -1) == "package.json") & ~F.col("path").rlike(TOOL_FOLDERS))
    return rows.select("project", "path", body.alias("body")).where(F.schema_of_variant("body").startswith("OBJECT"))


def manifests(files: DataFrame) -> DataFrame:
    """(project, path, folder, name, version) of each manifest that is a JSON object; others are passed over."""
    field = lambda name: _text(F.try_variant_get("body", f"$.{name}", "string")).alias(name)
    return _manifests(files).select("project", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), field("name"), field("version"))


def declarations(files: DataFrame) -> DataFrame:
    """(project, path, package, requirement) of all sections; of a package declared twice the later section holds."""
    section = lambda i, name: F.transform(
        F.map_entries(F.try_variant_get("body", f"$.{name}", "map<string,string>")), lambda e: F.struct(F.lit(i).alias("section"), e["key"].alias("package"), e["value"].alias("requirement"))
    )
    found = F.flatten(F.array_compact(F.array(*[section(i, s) for i, s in enumerate(SECTIONS)])))
    rows = _manifests(files).select("project", "path", F.inline(found))
    return rows.groupBy("project", "path", "package").agg(F.max_by("requirement", "section").alias("requirement"))


def locked(files: DataFrame, declared: DataFrame) -> DataFrame:
    """(project, package, version) that the lock files at a project's top resolve.

    A JSON lock file gives versions; of the others a declared package counts where its name occurs, without one.
    A project's declared names meet its lock file as one array, so the file's text isn't repeated for each.
    """
    entries = F.map_entries(F.try_variant_get(F.try_parse_json("content"), "$.packages", "map<string,variant>"))
    exact = files.where("path = 'package-lock.json'").select("project", F.explode(entries).alias("e"))
    exact = exact.where(F.col("e.key").startswith("node_modules/") & F.schema_of_variant("e.value").startswith("OBJECT"))
    exact = exact.select("project", F.regexp_replace("e.key", "^node_modules/", "").alias("package"), _text(F.try_variant_get("e.value", "$.version", "string")).alias("version"))
    names = declared.groupBy("project").agg(F.collect_set("package").alias("names"))
    loose = files.where(F.col("path").isin("yarn.lock", "pnpm-lock.yaml")).join(names, "project")
    loose = loose.select("project", F.explode(F.filter("names", lambda n: F.contains("content", n))).alias("package"), F.lit(None).cast("string").alias("version"))
    return exact.unionByName(loose).groupBy("project", "package").agg(F.max("version").alias("version"))


def owners(files: DataFrame, found: DataFrame) -> DataFrame:
    """(project, path) with the nearest manifest above it: ``owner, owner_name, owner_version``.

    A file's folders are exploded and joined by equality, the longest stays.
    """
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = files.select("project", "path").distinct().select("project", "path", F.explode(ups).alias("folder"))
    rows = rows.join(found.select("project", "folder", F.col("path").alias("owner"), F.col("name").alias("owner_name"), F.col("version").alias("owner_version")), ["project", "folder"])
    best = rows.groupBy("project", "path").agg(F.max_by(F.struct("owner", "owner_name", "owner_version"), F.struct(F.length("folder"), "owner")).alias("o"))
    return best.select("project", "path", "o.*")


def assess(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows(project, path, package, ...)`` with ``status`` and the evidence for it: ``kind, source, evidence_version``.

    By the first rule that holds: a file in an installed package is that package's or conflicts; one below a
    manifest of the package's name is confirmed; so is one in a vendor folder with the package's name, and a
    package that some manifest declares and a source imports or a lock file resolves.  A declaration alone is
    evidence, but leaves the status unknown, as does none.
    """
    found, declared = manifests(files), declarations(files)
    first = declared.groupBy("project", "package").agg(F.min(F.struct("path", "requirement")).alias("d"))
    first = first.select("project", "package", F.col("d.path").alias("d_path"), F.col("d.requirement").alias("d_requirement"))
    imported = imports(files).select("project", "package").distinct().withColumn("imported", F.lit(True))
    resolved = locked(files, declared).select("project", "package", F.col("version").alias("l_version"), F.lit(True).alias("resolved"))
    joined = rows.join(owners(rows, found), ["project", "path"], "left")
    for side in (first, imported, resolved):
        joined = joined.join(side, ["project", "package"], "left")

    package, path, none = F.col("package"), F.col("path"), F.lit(None).cast("string")
    parts = F.split(path, "/")
    installed = F.array_contains(parts, F.lit("node_modules"))
    inside = _head(F.regexp_extract(path, r"^(?:.*/)?node_modules/(.*)$", 1))
    own = F.coalesce(F.col("owner_name") == package, F.lit(False))
    vendored = F.arrays_overlap(parts, F.array(F.lit("vendor"), F.lit("vendored"))) & F.array_contains(parts, F.regexp_replace(package, "/", "-"))
    used = F.col("d_path").isNotNull() & (F.col("imported").isNotNull() | F.col("resolved").isNotNull())
    rules = [
        (installed, F.when(inside == package, "confirmed").otherwise("conflicting"), "package_ownership", path, none),
        (own, F.lit("confirmed"), "package_ownership", F.col("owner"), F.col("owner_version")),
        (vendored, F.lit("confirmed"), "vendored_path", path, none),
        (used, F.lit("confirmed"), "resolved_dependency", F.col("d_path"), F.coalesce("l_version", "d_requirement")),
        (F.col("d_path").isNotNull(), F.lit("unknown"), "manifest_declaration", F.col("d_path"), F.col("d_requirement")),
    ]
    chosen = F.struct(F.lit("unknown").alias("status"), none.alias("kind"), none.alias("source"), none.alias("evidence_version"))
    for condition, status, kind, source, version in reversed(rules):
        chosen = F.when(condition, F.struct(status.alias("status"), F.lit(kind).alias("kind"), source.alias("source"), version.alias("evidence_version"))).otherwise(chosen)
    return joined.select(*rows.columns, chosen.alias("_r")).select(*rows.columns, "_r.*")
