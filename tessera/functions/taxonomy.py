"""The label taxonomy: folding raw ids, descriptions, severities and path rules, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip

# Classes, the ids merged into one class, and what each class is called.
SAFE = "safe"
MERGED = {"CWE-119": "MEMORY-OOB", "CWE-787": "MEMORY-OOB", "CWE-125": "MEMORY-OOB"}
CLASSES = {
    "CWE-89": ("SQL Injection", "A03: Injection", "Untrusted input concatenated into an SQL query."),
    "CWE-79": ("Cross-Site Scripting (XSS)", "A03: Injection", "Untrusted input rendered into a page without escaping."),
    "CWE-94": ("Code Injection", "A03: Injection", "Untrusted input evaluated/executed as code (eval/exec)."),
    "CWE-502": ("Insecure Deserialization", "A08: Data Integrity Failures", "Deserializing untrusted data (pickle, yaml.load, etc.)."),
    "CWE-20": ("Improper Input Validation", "A03: Injection", "External input used without adequate validation."),
    "CWE-200": ("Information Exposure", "A01: Broken Access Control", "Sensitive information disclosed to an unauthorized actor."),
    "CWE-476": ("NULL Pointer Dereference", "A06: Vulnerable Components", "Dereferencing a pointer that may be NULL."),
    "MEMORY-OOB": ("Out-of-bounds Memory Access", "A06: Vulnerable Components", "Reading or writing outside the bounds of a buffer (merges CWE-119, CWE-125, CWE-787)."),
}
C_FAMILY = ("c", "c++", "cpp")

# Severities in order, and those of the classes.
SEVERITIES = ("critical", "major", "minor", "info")
SEVERITY_OF = {"CWE-89": "critical", "CWE-94": "critical", "CWE-502": "critical", "CWE-79": "major", "MEMORY-OOB": "major", "CWE-476": "minor", "CWE-200": "minor", "CWE-20": "minor"}
DEFAULT_SEVERITY = "major"
# Advice for each class; others have none.
REMEDIES = {
    "CWE-89": "Use a parameterised query: pass the value as a bind parameter instead of concatenating or formatting it into the SQL string.",
    "CWE-79": "Escape the value where it is rendered, and do not mark untrusted strings as safe (mark_safe / |safe / innerHTML).",
    "CWE-94": "Do not evaluate untrusted input. Use ast.literal_eval, an explicit dispatch table, or an argument list with shell=False.",
    "CWE-502": "Deserialise untrusted data with a safe loader (yaml.safe_load, json.loads); never unpickle bytes an attacker can influence.",
    "CWE-200": "Do not disable certificate/transport verification, and read secrets from the environment instead of committing them.",
    "CWE-476": "Check the pointer against NULL before dereferencing it.",
    "MEMORY-OOB": "Bound the write to the destination's declared size (snprintf / strncpy with an explicit length) and validate every index against it.",
}

# Source files worth scanning; folders and names that aren't.
SCANNABLE = (".py", ".pyi", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".java", ".kt", ".scala", ".php", ".rb", ".go", ".cs", ".swift", ".pl", ".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hh")
SKIPPED_FOLDER = r"(?i)(^|/)(tests?|testing|fixtures?|testdata|vendor|third_party|node_modules|migrations|__pycache__|site-packages|\.venv)(/|$)"
SKIPPED_NAME = r"(?i)^(conftest\.py|test_.+\.py|.+_test\.[A-Za-z0-9]+|.+\.min\.(js|css)|.+\.lock|.+\.map)$"


def mapping(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*d.items())])


def fold(cwe: Column) -> Column:
    """The class of a raw id; null where it is blank, a word for nothing, or of no class."""
    key = F.upper(strip(cwe))
    folded = F.coalesce(F.try_element_at(mapping(MERGED), key), key)
    return F.when(folded.isin(*CLASSES), folded)


def label(vulnerable: Column, cwe: Column) -> Column:
    """`safe`, or the class of a vulnerable row."""
    return F.when(~vulnerable, F.lit(SAFE)).otherwise(fold(cwe))


def fold_prediction(predicted: Column) -> Column:
    """(label, outside): a prediction on the classes; what lies outside them is safe."""
    merged = F.coalesce(F.try_element_at(mapping(MERGED), predicted), predicted)
    outside = ~F.coalesce(merged.isin(SAFE, *CLASSES), F.lit(False))
    return F.struct(F.when(outside, SAFE).otherwise(merged).alias("label"), outside.alias("outside"))


def language_group(language: Column) -> Column:
    return F.when(F.lower(strip(language)).isin(*C_FAMILY), "c_family").otherwise("non_c")


def has_patch(vulnerable: Column, code: Column, fixed: Column) -> Column:
    """A vulnerable row whose patch isn't blank and changes the code."""
    return vulnerable & (F.length(strip(fixed)) > 0) & (fixed != code)


def severity(cwe: Column) -> Column:
    return F.coalesce(F.try_element_at(mapping(SEVERITY_OF), cwe), F.lit(DEFAULT_SEVERITY))


def remedy(cwe: Column) -> Column:
    return F.coalesce(F.try_element_at(mapping(REMEDIES), cwe), F.lit(""))


def describe(label: Column) -> Column:
    """(cwe, name, owasp, description) of a label, older ids by the class they merged into; null for what is no class."""
    folded = F.coalesce(F.try_element_at(mapping(MERGED), label), label)
    part = lambda i: F.try_element_at(mapping({k: v[i] for k, v in CLASSES.items()}), folded)
    return F.when(folded.isin(*CLASSES), F.struct(folded.alias("cwe"), part(0).alias("name"), part(1).alias("owasp"), part(2).alias("description")))


def severity_rank(s: Column) -> Column:
    """0 for the gravest; 9 for what isn't a severity."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*((v, i) for i, v in enumerate(SEVERITIES)))]), s), F.lit(9))


def dimension(spark: SparkSession) -> DataFrame:
    """A row for each class."""
    return spark.createDataFrame([(k, *v) for k, v in CLASSES.items()], "label string, name string, owasp string, description string")


def normal_path(path: Column) -> Column:
    """A path without a time stamp, quotes, back slashes, the sides' prefixes or leading dots and slashes."""
    p = strip(F.split_part(strip(F.coalesce(path, F.lit(""))), F.lit("\t"), F.lit(1)))
    p = strip(F.regexp_replace(F.regexp_replace(p, "^`+|`+$", ""), '^"+|"+$', ""))
    p = F.replace(p, F.lit("\\"), F.lit("/"))
    p = F.regexp_replace(F.regexp_replace(p, "^[ab]/", ""), r"^(\./)+", "")
    return F.regexp_replace(p, "^/+", "")


def scannable(path: Column) -> Column:
    """Whether a path is source code, and neither a test nor somebody else's."""
    p = normal_path(path)
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))
    return (F.length(p) > 0) & suffix.isin(*SCANNABLE) & ~name.rlike(SKIPPED_NAME) & ~p.rlike(SKIPPED_FOLDER)
