"""Manifests of projects: name, description and dependencies, by the file's name; each format is a few patterns over its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 40


def _one(text: Column, pattern: str) -> Column:
    found = F.trim(F.regexp_extract(text, pattern, 1))
    return F.when(found != "", found)


def _all(text: Column, pattern: str) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x != "")


def _section(text: Column, name: str) -> Column:
    """The lines of a TOML table, up to the next."""
    return F.regexp_extract(text, rf"(?ms)^\[{name}\][ \t]*$(.*?)(?=^\[|\z)", 1)


def _summary(name: Column, description: Column, dependencies: Column) -> Column:
    return F.struct(name.cast("string").alias("name"), description.cast("string").alias("description"), F.slice(F.array_distinct(dependencies), 1, MOST).alias("dependencies"))


def go_module(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?m)^\s*//.*$", "")
    blocks = F.regexp_extract_all(bare, F.lit(r"(?s)require \((.*?)\n\s*\)"), F.lit(1))
    inside = F.flatten(F.transform(blocks, lambda b: _all(b, r"(?m)^[ \t]*([^\s/]\S*)")))
    return _summary(_one(bare, r"(?m)^\s*module\s+(\S+)"), F.lit(None), F.concat(inside, _all(bare, r"(?m)^\s*require ([^\s(]+)")))


def maven_project(text: Column) -> Column:
    head = F.regexp_replace(F.substring_index(text, "<dependencies>", 1), r"(?s)<parent>.*?</parent>", "")
    tail = F.regexp_extract(text, r"(?s)<dependencies>(.*)$", 1)
    tag = lambda n: _one(head, rf"(?s)<{n}>(.*?)</{n}>")
    return _summary(F.coalesce(tag("name"), tag("artifactId")), tag("description"), F.transform(_all(tail, r"(?s)<artifactId>(.*?)</artifactId>"), lambda x: F.trim(x)))


def cargo_package(text: Column) -> Column:
    own, deps = _section(text, "package"), _section(text, "dependencies")
    field = lambda n: _one(own, rf'(?m)^{n}\s*=\s*"([^"]*)"')
    return _summary(field("name"), field("description"), F.concat(_all(deps, r"(?m)^([A-Za-z0-9_-]+)\s*[=.]"), _all(text, r"(?m)^\[dependencies\.([A-Za-z0-9_-]+)\]")))


def python_project(text: Column) -> Column:
    """Project tables, or those of a tool; the interpreter is no dependency."""
    own, tool = _section(text, "project"), _section(text, r"tool\.poetry")
    field = lambda n: F.coalesce(_one(own, rf'(?m)^{n}\s*=\s*"([^"]*)"'), _one(tool, rf'(?m)^{n}\s*=\s*"([^"]*)"'))
    listed = _all(F.regexp_extract(own, r"(?ms)^dependencies\s*=\s*\[(.*?)^?\]\s*$", 1), r"""["']\s*([A-Za-z0-9._-]+)""")
    keyed = F.filter(_all(_section(text, r"tool\.poetry\.dependencies"), r"(?m)^([A-Za-z0-9._-]+)\s*="), lambda x: x != "python")
    return _summary(field("name"), field("description"), F.concat(listed, keyed))


def requirements(text: Column) -> Column:
    return _summary(F.lit(None), F.lit(None), _all(text, r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)"))


def gem_file(text: Column) -> Column:
    return _summary(F.lit(None), F.lit(None), _all(text, r"""(?m)^\s*gem\s+["']([^"']+)["']"""))


def gradle_script(text: Column) -> Column:
    """Group and artifact of quoted coordinates on configuration lines, those of tests left out."""
    line = r"""(?m)^\s*(?!test|androidTest)(?i:[a-z]*(?:implementation|api|compile|compileonly|runtimeonly|annotationprocessor))\b[^"'\n]*["']([^:"'\n]+:[^:"'\n]+)"""
    return _summary(F.lit(None), F.lit(None), _all(text, line))


def dotnet_project(path: Column, text: Column) -> Column:
    stem = F.regexp_extract(path, r"([^/]+)\.csproj$", 1)
    return _summary(F.coalesce(_one(text, r"<AssemblyName>(.*?)</AssemblyName>"), stem), _one(text, r"(?s)<Description>(.*?)</Description>"), _all(text, r"""<PackageReference\s+Include="([^"]+)\""""))


def package_json(text: Column, keys: tuple[str, ...] = ("dependencies", "devDependencies")) -> Column:
    value = F.from_json(text, "name string, description string, " + ", ".join(f"`{k}` map<string,string>" for k in keys))
    none = F.array().cast("array<string>")
    return _summary(value["name"], value["description"], F.concat(*[F.coalesce(F.map_keys(value[k]), none) for k in keys]))


def manifests(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, name, description, dependencies) of files that are manifests, at most 40 dependencies each."""
    file, text = F.element_at(F.split(path, "/"), -1), F.col(content)
    found = (
        F.when(file == "go.mod", go_module(text))
        .when(file == "pom.xml", maven_project(text))
        .when(file == "Cargo.toml", cargo_package(text))
        .when(file == "pyproject.toml", python_project(text))
        .when(file == "requirements.txt", requirements(text))
        .when(file == "Gemfile", gem_file(text))
        .when(file.rlike(r"^build\.gradle(\.kts)?$"), gradle_script(text))
        .when(file.endswith(".csproj"), dotnet_project(F.col(path), text))
        .when(file == "package.json", package_json(text))
        .when(file == "composer.json", package_json(text, ("require", "require-dev")))
    )
    return files.select(path, found.alias("m")).filter("m is not null").select(path, "m.*")
