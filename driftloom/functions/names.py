"""Expressions over identifiers, paths, module names and messages. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms and lists that decide the results.
CAMEL_PART = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|\d+"
LEAST_TOKEN = 2
DOC_TOKENS = 50
NAME_STOPS = ("get", "set", "make", "build", "create", "compute", "calc", "init", "update", "process", "run")
NAME_VERBS = (
    "get", "set", "handle", "compute", "calc", "process", "load", "save", "build", "create", "update", "fetch", "read", "write", "parse", "render",
    "encode", "decode", "train", "predict", "infer", "match", "merge", "map", "reduce", "apply", "validate", "normalize", "extract", "transform",
    "clean", "prep", "init", "dispatch", "route", "sync", "flush", "collect", "aggregate", "score", "rank", "sort", "filter", "split", "join",
    "compare", "similar", "distance", "hash", "minhash", "cluster", "lsh", "sample", "group", "bucket", "index", "search", "query",
)
VERB_GROUPS = (("get", "fetch", "retrieve"), ("set", "update", "save"), ("create", "make", "build"), ("delete", "remove", "destroy"), ("check", "verify", "validate"))
SECRET = r"(?i)(api[_-]?key|token|secret|password|credential)[\"']?\s*[:=]\s*[\"']?([^\"'\s]+)"
# Kinds of leftovers in the order that decides, and the forms of a relative path that make each. Case doesn't count.
JUNK = {
    "temp": (
        r".*\.tmp$",
        r".*\.temp$",
        r".*~$",
        r".*\.orig$",
        r"tmp_.*",
        r"temp_.*",
    ),
    "backup": (
        r".*\.bak$",
        r".*\.backup\d*$",
        r".*\.backup$",
        r".*\.old$",
        r".*\.\d{8}$",
        r".*_backup$",
        r".*_old$",
        r".*\(copy\).*",
        r".*\.save$",
    ),
    "build": (
        r"^dist/?$",
        r"^build/?$",
        r"^target/?$",
        r".*\.egg-info/?$",
        r"^out/?$",
        r"^bin/?$",
        r".*\.exe$",
        r".*\.dll$",
        r".*\.so$",
        r".*\.dylib$",
    ),
    "editor": (
        r".*\.swp$",
        r".*\.swo$",
        r".*\.swn$",
        r"\.\#.*",
        r".*\.sublime-workspace$",
        r".*\.kate-swp$",
        r"\.idea/workspace\.xml$",
        r"\.vscode/.*\.json$",
    ),
    "os": (
        r"^\.DS_Store$",
        r"^Thumbs\.db$",
        r"^desktop\.ini$",
        r"^\$RECYCLE\.BIN/?$",
        r"^\.Spotlight-V100/?$",
        r"^\.Trashes/?$",
        r"^ehthumbs\.db$",
        r"^\.fseventsd/?$",
    ),
    "debug": (
        r".*\.log$",
        r".*\.stackdump$",
        r"^core\.\d+$",
        r"^nohup\.out$",
        r".*\.trace$",
        r".*\.debug$",
        r"^debug\.txt$",
        r"^error\.txt$",
    ),
    "test": (
        r"^\.coverage.*$",
        r"^coverage\.xml$",
        r"^coverage\.json$",
        r"^\.nyc_output/?$",
        r"^test-results/?$",
        r"^test-reports/?$",
        r"^junit\.xml$",
    ),
    "python": (
        r"^__pycache__/?$",
        r".*\.pyc$",
        r".*\.pyo$",
        r".*\.pyd$",
        r"^\.pytest_cache/?$",
        r"^\.mypy_cache/?$",
        r"^\.tox/?$",
        r"^\.nox/?$",
        r"^\.hypothesis/?$",
        r"^htmlcov/?$",
        r".*\.cover$",
    ),
    "package": (
        r"^node_modules/?$",
        r"^vendor/?$",
        r"^bower_components/?$",
        r"^jspm_packages/?$",
        r"^packages/?$",
    ),
}


def identifier_tokens(name: Column, least: int = LEAST_TOKEN) -> Column:
    """Lower-case tokens of a camel or snake name, at least ``least`` long; null and empty give none."""
    name = F.coalesce(name, F.lit(""))
    found = F.regexp_extract_all(name, F.lit(CAMEL_PART), F.lit(0))
    parts = F.when(F.size(found) > 0, found).otherwise(F.split(name, "_"))
    return F.filter(F.transform(parts, lambda p: F.lower(F.trim(p))), lambda p: F.length(p) >= least)


def doc_tokens(text: Column) -> Column:
    """The first lower-case words of a docstring; short ones do not count."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.slice(F.filter(found, lambda w: F.length(w) >= LEAST_TOKEN), 1, DOC_TOKENS)


def name_tokens(name: Column) -> Column:
    """Lower-case parts of a name, split at underscores and before capitals, without common verbs."""
    marked = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?<=[^_])(?=[A-Z])", "_")
    return F.filter(F.split(F.lower(marked), "_"), lambda t: (t != "") & ~t.isin(*NAME_STOPS))


def name_pattern(name: Column) -> Column:
    """``verb_*`` for a known verb, else the first camel or snake part with ``_*``; other without one."""
    verb = F.regexp_extract(name, rf"(?i)^({'|'.join(NAME_VERBS)})_.+$", 1)
    camel = F.when(~name.contains("_") & name.rlike("[A-Z]"), F.regexp_extract(name, r"^(.[^A-Z]*)", 1))
    first = F.lower(F.coalesce(F.nullif(verb, F.lit("")), camel, F.substring_index(name, "_", 1)))
    return F.when(F.coalesce(first, F.lit("")) == "", "other").otherwise(F.concat(first, F.lit("_*")))


def n_grams(tokens: Column, n: int) -> Column:
    """Contiguous runs of ``n`` tokens, joined by spaces; none if there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def redacted(message: Column) -> Column:
    """A message without the values of keys and passwords."""
    return F.regexp_replace(message, SECRET, "$1=***REDACTED***")


def junk_kind(path: Column, kinds: Mapping[str, Sequence[str]] = JUNK) -> Column:
    """The first kind of leftover that a relative path has a form of, from its start on; null for none."""
    out = F.lit(None).cast("string")
    for kind, forms in reversed(list(kinds.items())):
        out = F.when(path.rlike(f"(?i)^(?:{'|'.join(forms)})"), kind).otherwise(out)
    return out


def size_text(size: Column) -> Column:
    """Bytes as a number with one place and a unit from B to TB."""
    shown = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(size / 1024.0**power, 1))
    out = shown(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024.0 ** (power + 1), shown(power, unit)).otherwise(out)
    return out


def prefix_family(name: Column, families: Mapping[str, Sequence[str]], path: Column) -> Column:
    """The first family whose prefix a name has, as family_prefix; else by path: test_code, utilities_general, uncategorized."""
    low = F.lower(name)
    out = F.when(F.lower(path).contains("test"), "test_code").when(F.lower(path).contains("util"), "utilities_general").otherwise("uncategorized")
    for family, prefixes in reversed(list(families.items())):
        for prefix in reversed(prefixes):
            out = F.when(low.startswith(prefix), f"{family}_{prefix}").otherwise(out)
    return out


def module_name(name: Column) -> Column:
    """A module's name, trimmed, without leading dots, dashes as underscores, in lower case."""
    return F.lower(F.replace(F.regexp_replace(F.trim(name), r"^\.+", ""), F.lit("-"), F.lit("_")))


def module_of(path: Column) -> Column:
    """The dotted module of a relative Python path; a package's ``__init__`` is the package."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def relative_import(module: Column, target: Column, level: Column) -> Column:
    """The module that ``level`` dots and ``target`` mean inside ``module``; null if that has too few parts."""
    parts = F.split(module, r"\.")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level, F.lit(0))), ".")
    return F.when(level <= F.size(parts), F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(target, F.lit(""))))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two strings."""
    shorter = F.least(F.length(a), F.length(b))
    # lengths whose prefixes agree are all those up to the longest
    agree = F.filter(F.sequence(F.lit(0), shorter), lambda n: F.left(a, n) == F.left(b, n))
    return F.left(a, F.array_max(agree))


def verb_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.8 if both hold verbs of one group, else 1 - edits / longer length."""
    alike = F.lit(False)
    for group in VERB_GROUPS:
        alike = alike | (a.rlike("|".join(group)) & b.rlike("|".join(group)))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when(alike, 0.8).otherwise(1 - F.levenshtein(a, b) / longer)


def positional_similarity(a: Column, b: Column) -> Column:
    """Share of places of the longer string where both have the same character; 1 for equal strings."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int")), F.lit(0), lambda s, v: s + v)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when(longer == 0, 0.0).otherwise(same / longer)


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two names' tokens; equal names 1, no tokens on either side 0."""
    left, right = F.array_distinct(identifier_tokens(a)), F.array_distinct(identifier_tokens(b))
    union = F.size(F.array_union(left, right))
    return F.when(a == b, 1.0).when(union == 0, 0.0).otherwise(F.size(F.array_intersect(left, right)) / union)


def normalized_code(code: Column) -> Column:
    """Code without comments, each run of white space one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(code, r"#[^\n]*", ""), r"\s+", " "))


def package_distance(a: Column, b: Column) -> Column:
    """Dotted parts of two names that their common first parts leave over."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    shorter = F.least(F.size(x), F.size(y))
    agree = F.filter(F.sequence(F.lit(0), shorter), lambda n: F.slice(x, F.lit(1), n) == F.slice(y, F.lit(1), n))
    return F.size(x) + F.size(y) - 2 * F.array_max(agree)


def pair_key(a: Column, b: Column) -> Column:
    """A digest of an unordered pair."""
    return F.sha2(F.concat_ws("||", F.least(a, b), F.greatest(a, b)), 256)


def shown_path(path: Column, root: str) -> Column:
    """A path for reports: ``./`` before relative ones, relative below the root, else ``~`` and the last three parts; null is empty."""
    below = F.concat(F.lit("./"), F.substr(path, F.lit(len(root.rstrip("/")) + 2)))
    tail = F.concat(F.lit("~/"), F.array_join(F.slice(F.split(path, "/"), F.greatest(-F.size(F.split(path, "/")), F.lit(-3)), F.lit(3)), "/"))
    relative = F.when(path.rlike(r"^\.\.?/"), path).otherwise(F.concat(F.lit("./"), path))
    out = F.when(~path.startswith("/"), relative).when(path.startswith(root.rstrip("/") + "/"), below).otherwise(tail)
    return F.when(F.coalesce(path, F.lit("")) == "", "").otherwise(out)


def abstractness(module: Column) -> Column:
    """0.8 if a name holds more abstract than concrete words, 0.2 if fewer, else 0.5."""
    low = F.lower(module)
    count = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    abstract, concrete = count(("base", "abstract", "interface", "protocol", "abc")), count(("impl", "concrete", "handler", "service", "controller"))
    return F.when(abstract > concrete, 0.8).when(concrete > abstract, 0.2).otherwise(0.5)
