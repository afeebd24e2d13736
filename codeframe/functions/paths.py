"""Paths, modules, languages, ranges and edges as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension to language, for search filters.
LANGUAGES = {
    "rust": "rs", "python": "py pyi pyw", "javascript": "cjs js jsx mjs", "typescript": "cts mts ts tsx", "go": "go", "java": "java", "kotlin": "kt kts", "c": "h c", "cpp": "hpp hh hxx cpp cc cxx", "csharp": "cs",
    "ruby": "rb", "php": "php", "swift": "swift", "scala": "sc scala", "shell": "zsh bash sh", "sql": "sql", "html": "htm html", "css": "css", "scss": "sass scss", "json": "json", "yaml": "yml yaml", "toml": "toml",
    "markdown": "markdown md", "vue": "vue", "svelte": "svelte",
}
#: Folders that a listing skips, besides dot names.
SKIP_DIRS = "vendor target node_modules dist coverage build __pycache__".split()
EDGE_KINDS = "call read write readwrite escape_read escape_write escape_readwrite".split()
SOURCE_MARKERS = "src lib app pages assets/scripts assets source content scripts addons packages modules".split()


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; null for names without one and for dot names."""
    e = F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(e != "", F.lower(e))


def stem(path: Column) -> Column:
    name = base_name(path)
    cut = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)
    return F.when(cut != "", cut).otherwise(name)


def language_of(path: Column) -> Column:
    pairs = [F.lit(x) for lang, exts in LANGUAGES.items() for e in exts.split() for x in (e, lang)]
    return F.try_element_at(F.create_map(*pairs), F.coalesce(extension(path), F.lit("")))


def detect_language(path: Column) -> Column:
    """File name first, then extension."""
    name = F.lower(base_name(path))
    return F.when(name.rlike(r"^(dockerfile|containerfile)(\..*)?$"), "dockerfile").otherwise(language_of(path))


def skip_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.exists(parts, lambda p: ((p.startswith(".")) & ~p.isin(".", "..")) | p.isin(SKIP_DIRS))


def glob_regex(pattern: str, deep: bool = False) -> str:
    """An anchored Java regex: * and ? with everything else literal; ``deep``: ** crosses folders, * does not."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if deep and pattern.startswith("**", i):
            out.append(".*")
            i += 1
        elif c == "*":
            out.append("[^/]*" if deep else ".*")
        elif c == "?":
            out.append("[^/]" if deep else ".")
        else:
            out.append("\\" + c if not c.isalnum() and c not in "_/" else c)
        i += 1
    return "^" + "".join(out) + "$"


def name_matches(name: Column, query: str) -> Column:
    """Everything for '' and '*', an anchored glob where there are wildcards, else a substring; case is ignored."""
    q = query.lower()
    if q in ("", "*"):
        return F.lit(True)
    if "*" in q or "?" in q:
        return F.lower(name).rlike(glob_regex(q))
    return F.contains(F.lower(name), F.lit(q))


def normalize_kind(kind: Column) -> Column:
    k = F.lower(kind)
    return F.when(k.isin("fn", "func", "method", "function"), "function").when(k.isin("struct", "record", "class"), "class").when(k.isin("interface", "trait"), "trait").otherwise(k)


def is_test_file(path: Column) -> Column:
    p, name, raw, ext = F.lower(path), F.lower(base_name(path)), base_name(path), extension(path)
    folder = p.rlike(r"(^|/)(tests|__tests__)/") | p.rlike(r"(^|/)test/")
    script = name.rlike(r"\.(test|spec)\.") | name.rlike(r"^test[_.]")
    by_ext = (
        F.when(ext == "rs", name.endswith("_test.rs") | name.startswith("test_"))
        .when(ext.isin("ts", "tsx", "js", "jsx", "mts", "mjs"), script)
        .when(ext == "py", name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py"))
        .when(ext == "go", name.endswith("_test.go"))
        .when(ext.isin("java", "kt", "kts"), raw.rlike(r"Tests?\.(java|kt|kts)$") | name.rlike(r"^test[_.]"))
        .when(ext.isin("c", "cpp", "cc", "cxx"), name.startswith("test_") | name.rlike(r"_test\.(c|cpp|cc|cxx)$"))
        .otherwise(False)
    )
    return F.coalesce(folder | by_ext, F.lit(False))


def is_test_module(module: Column) -> Column:
    return F.lower(module).rlike("test|spec|mock|fixture|e2e")


def hint_matches(path: Column, ext: str | None = None, folder: str | None = None, file: str | None = None, lang: str | None = None) -> Column:
    """All given hints: extension, a folder on the way, a file pattern, a language."""
    out = F.lit(True)
    if ext is not None:
        out &= path.endswith("." + ext)
    if folder is not None:
        out &= F.contains(path, F.lit(f"/{folder}/")) | path.startswith(folder + "/")
    if file is not None:
        name = base_name(path)
        out &= name.endswith(file[1:]) if file.startswith("*") else name.startswith(file[:-1]) if file.endswith("*") else name == file
    if lang is not None:
        out &= F.coalesce(language_of(path) == lang.lower(), F.lit(False))
    return out


def path_matches(path: Column, wanted: str) -> Column:
    """Equal, or either ends with the other."""
    return (path == wanted) | path.endswith(wanted) | F.lit(wanted).endswith(path)


def namespace(path: Column) -> Column:
    """Parent folders without src, lib, app, pages and dots, joined by dots; the stem where none is left."""
    parts = F.filter(F.split(parent_dir(path), "/"), lambda p: ~p.isin("", "src", "lib", ".", "..", "app", "pages"))
    return F.when(F.size(parts) > 0, F.array_join(parts, ".")).otherwise(stem(path))


def module_path(path: Column) -> Column:
    """Parent folders joined by dots; without any the stem, or root for index files."""
    parts = F.filter(F.split(parent_dir(path), "/"), lambda p: ~p.isin("", ".", ".."))
    s = stem(path)
    return F.when(F.size(parts) > 0, F.array_join(parts, ".")).when(s.isin("index", "mod", "lib", "main", "__init__"), "root").otherwise(s)


def module_name(path: Column) -> Column:
    """Folders below the first source marker in the order of the list, joined by dots; root where none is left."""
    low = F.lower(path)
    rest = path
    for m in reversed(SOURCE_MARKERS):
        rest = F.when(low.startswith(m + "/"), F.substring(path, F.lit(len(m) + 2), F.length(path))).otherwise(rest)
    for m in reversed(SOURCE_MARKERS):
        at = F.locate(f"/{m}/", low)
        rest = F.when(at > 0, F.substring(path, at + len(m) + 2, F.length(path))).otherwise(rest)
    parts = F.filter(F.split(parent_dir(rest), "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, ".")).otherwise("root")




def parse_lines(s: Column) -> Column:
    """struct(start, end) of 's-e'; (0, 0) for anything else."""
    a, b = F.regexp_extract(s, r"^([0-9]+)-([0-9]+)$", 1), F.regexp_extract(s, r"^([0-9]+)-([0-9]+)$", 2)
    ok = a != ""
    return F.struct(F.when(ok, a.try_cast("long")).otherwise(0).alias("start"), F.when(ok, b.try_cast("long")).otherwise(0).alias("end"))


def parse_line_range(s: Column) -> Column:
    """struct(start, end) of 's-e' or of a single line; nulls for anything else."""
    a, b = F.regexp_extract(s, r"^([0-9]+)(?:-([0-9]+))?$", 1), F.regexp_extract(s, r"^([0-9]+)-([0-9]+)$", 2)
    return F.struct(F.when(a != "", a).try_cast("long").alias("start"), F.when(b != "", b).when(a != "", a).try_cast("long").alias("end"))


def loc(start: Column, end: Column) -> Column:
    return F.when(end > start, end - start + 1).otherwise(1).cast("long")


def edge_callee(encoded: Column) -> Column:
    """The callee of 'callee' or 'callee:kind'; a suffix that is no kind belongs to the callee."""
    return F.regexp_replace(encoded, r":(" + "|".join(EDGE_KINDS) + r")$", "")


def edge_kind(encoded: Column) -> Column:
    k = F.regexp_extract(encoded, r":(" + "|".join(EDGE_KINDS) + r")$", 1)
    return F.when(k != "", k).otherwise("call")


def edge_encode(callee: Column, kind: Column) -> Column:
    return F.when(kind == "call", callee).otherwise(F.concat_ws(":", callee, kind))


def looks_like_hash(s: Column) -> Column:
    return s.rlike(r"^[0-9a-f]{8}:[0-9a-f]{16}$") | s.rlike(r"^[0-9a-f]{16}$")


def split_quoted(s: Column) -> Column:
    """Values between commas; commas inside double quotes do not count, and quotes go."""
    return F.transform(F.filter(F.regexp_extract_all(s, F.lit(r'("[^"]*"|[^,"])+'), F.lit(0)), lambda p: F.trim(p) != ""), lambda p: F.replace(F.trim(p), F.lit('"'), F.lit("")))
