"""The rules over texts, by patterns and by the syntax of what parses as Python: an Arrow function, as masking comments and reading calls go letter by letter.

A text is read once into a `Source`, which keeps what several rules ask for;
each check of the rule table is a function of the source and the hit.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tessera.functions import rule_table as T
from tessera.functions.guards import folded, may_match, needed
from tessera.functions.taxonomy import CLASSES
from tessera.operators import python_rules

FINDING = "seq int, cwe string, name string, confidence double, line int, rule_id string, evidence string"

_compiled = {name: re.compile(value) for name, value in vars(T).items() if name.isupper() and isinstance(value, str)}
_rules = [(rule, cwe, sure, re.compile(pattern), check, syntax) for rule, cwe, sure, pattern, check, syntax in T.RULES]
_sanitizing, _sanitized_name = _compiled["SANITIZED_CALL"], _compiled["SANITIZED_NAME"]
#: Strings, template literals and comments; what begins like one and isn't closed on its line ends there.
_lexed = re.compile(
    r'"""[\s\S]*?(?:"""|\Z)' + r"|'''[\s\S]*?(?:'''|\Z)" + r'|"(?:\\[\s\S]|[^"\\\n])*["\n]?' + r"|'(?:\\[\s\S]|[^'\\\n])*['\n]?"
    rf"|`[^`]{{0,{T.MAX_TEMPLATE - 1}}}`" + r"|/\*[\s\S]*?(?:\*/|\Z)|(?://|\#)[^\n]*"
)
_quoted = re.compile(r"""(["'`])(?:\\[\s\S]|(?!\1)[^\\])*(?:\1|\Z)|[()\[\]{},]""")


def masked(code: str) -> str:
    """The text with its comments blanked, every other character in its place."""
    return _lexed.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][:2] in ("//", "/*") or m[0][0] == "#" else m[0], code)


def dynamic(argument: str) -> bool:
    """Whether an expression has a name outside its literals."""
    a = argument.strip()
    return not _compiled["NUMBER"].fullmatch(a) and bool(re.search(r"[A-Za-z_$]", _compiled["LITERAL"].sub("", a)))


def arguments(region: str) -> list[str]:
    """A call's arguments, parted at commas outside quotes and brackets."""
    cuts, depth = [-1], 0
    for m in _quoted.finditer(region):
        depth += (m[0] in "([{") - (m[0] in ")]}") if len(m[0]) == 1 else 0
        if m[0] == "," and depth == 0:
            cuts.append(m.start())
    return [region[a + 1 : b].strip() for a, b in zip(cuts, [*cuts[1:], len(region)], strict=True)]


def words(identifier: str) -> set[str]:
    return {w.lower() for w in _compiled["IDENTIFIER_WORD"].findall(identifier)}


def secret_name(name: str) -> bool:
    parts = [w.lower() for w in _compiled["IDENTIFIER_WORD"].findall(name)]
    bag = set(parts)
    return bool(parts) and parts[-1] not in T.NON_SECRET_SUFFIXES and bool(bag & T.SECRET_NAME_WORDS or ("key" in bag and bag & T.KEY_QUALIFIERS))


def secret_value(value: str) -> bool:
    v = value.strip()
    if not 6 <= len(v) <= 200 or any(c.isspace() for c in v) or _compiled["PLACEHOLDER"].match(v) or len(set(v)) < 3:
        return False
    if v.lower().startswith(("http://", "https://", "/", "./", "../", "~/")) or set(v) & set("{}%$<>"):
        return False
    if _compiled["NAME_SHAPED"].match(v) and (len(v) < 16 or re.search(r"[-_./]", v)):
        return False
    return len(v) >= 16 or any(c.isdigit() or c.isupper() or not c.isalnum() for c in v)


def security_use(names: list[str]) -> bool:
    bag = set().union(*map(words, names)) if names else set()
    return bool(bag & T.SECURITY_WORDS or ("key" in bag and bag & T.KEY_QUALIFIERS) or (bag & T.WEAK_SECURITY_WORDS and not bag & T.CHECKSUM_WORDS))


class Source:
    """A text and what the checks ask of it."""

    def __init__(self, code: str, prose: set[int] = frozenset()):
        self.lines = code.splitlines()
        self.code = code[: T.MAX_SCAN_CHARS]
        self.masked = masked(self.code)
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.code))]
        if prose:  # lines of docstrings, blanked in place
            self.masked = "\n".join(" " * len(x) if i in prose else x for i, x in enumerate(self.masked.split("\n"), 1))

    @cached_property
    def has_sql(self) -> bool:
        return bool(_compiled["SQL"].search(self.masked))

    @cached_property
    def sanitized_names(self) -> set[str]:
        return set(_sanitized_name.findall(self.masked))

    @cached_property
    def arrays(self) -> set[str]:
        return set(_compiled["FIXED_ARRAY"].findall(self.masked))

    @cached_property
    def own_system(self) -> bool:
        return bool(_compiled["SYSTEM_DEFINED"].search(self.masked))

    def line_at(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def line(self, number: int) -> str:
        return self.lines[number - 1] if 1 <= number <= len(self.lines) else ""

    def region(self, m: re.Match) -> str | None:
        """What stands in the call's parentheses; None without any."""
        at = self.masked.find("(", m.end() - 1)
        if at < 0:
            return None
        depth, text = 0, self.masked[at : at + T.MAX_ARGUMENTS]
        for p in re.finditer(r"[()]", text):
            depth += 1 if p[0] == "(" else -1
            if depth == 0:
                return text[1 : p.start()]
        return text[1:]

    def sanitized(self, expression: str) -> bool:
        plain = expression.strip().rstrip(";").strip()
        return bool(_sanitizing.search(expression) or _compiled["DOM_READ"].match(plain)) or plain in self.sanitized_names


def _to_buffer(s: Source, m: re.Match, n: int) -> list[str] | None:
    """The arguments of a call that writes to a declared array, if it has n of them."""
    args = arguments(s.region(m) or "") if s.arrays else []
    return args if len(args) >= n and args[0] in s.arrays else None


def _dynamic_arg(s: Source, m: re.Match, cwe: str) -> bool:
    region = s.region(m)
    return region is not None and dynamic(region) and not (cwe == "CWE-79" and s.sanitized(region))


def _buffer_length(s: Source, m: re.Match, cwe: str) -> bool:
    args = _to_buffer(s, m, 3)
    return bool(args) and not re.search(r"\bsizeof\b", args[2]) and dynamic(args[2])


def _buffer_format(s: Source, m: re.Match, cwe: str) -> bool:
    args = _to_buffer(s, m, 3)
    return bool(args) and bool(re.search(r'"[^"\n]*%s', args[1])) and any(map(dynamic, args[2:]))


def _jsp(s: Source, m: re.Match, cwe: str) -> bool:
    region = s.region(m) or ""
    return bool(_compiled["REQUEST_PARAMETER"].search(region)) and not s.sanitized(region)


def _shell(s: Source, m: re.Match, cwe: str) -> bool:
    region = s.region(m) or ""
    return bool(re.search(r"\bshell\s*=\s*True\b", region)) and dynamic(region.split(",", 1)[0])


def _on_line(pattern: re.Pattern) -> Callable:
    return lambda s, m, _: bool(pattern.search(s.line(s.line_at(m.start()))))


CHECKS: dict[str, Callable[[Source, re.Match, str], bool]] = {
    "match": lambda s, m, _: True,
    "dynamic-arg": _dynamic_arg,
    "c-system": lambda s, m, _: not s.own_system,
    "xss-line": lambda s, m, _: not _sanitizing.search(s.line(s.line_at(m.start()))),
    "jsp-xss": _jsp,
    "deserialize": lambda s, m, _: not _compiled["LOCAL_SOURCE"].search(s.region(m) or ""),
    "tls-line": _on_line(_compiled["TLS_CONTEXT"]),
    "c-fixed-copy": lambda s, m, _: bool(args := _to_buffer(s, m, 2)) and dynamic(args[1]),
    "c-fixed-format": _buffer_format,
    "c-fixed-length": _buffer_length,
    "dynamic-rhs": lambda s, m, _: dynamic(m[1]) and not s.sanitized(m[1]),
    "shell-true": _shell,
    "unsafe-yaml": lambda s, m, _: not re.search(r"(?:Safe|Base)Loader", s.region(m) or ""),
    "sql-arg": lambda s, m, _: s.has_sql and bool(_compiled["SQL"].search(r := s.region(m) or "") and _compiled["SQL_DYNAMIC"].search(r)),
    "sql-interp": lambda s, m, _: s.has_sql and bool(_compiled["SQL"].search(m[0]) and _compiled["SQL_INTERPOLATED"].search(m[0])),
    "weak-hash-line": lambda s, m, _: security_use(re.findall(r"[A-Za-z_]\w*", s.line(s.line_at(m.start())))),
}


def secrets(s: Source) -> Iterator[tuple[str, str, float, int]]:
    """Names of secrets bound to literals that look like some."""
    for m in _compiled["SECRET_ASSIGNED"].finditer(s.masked):
        if secret_name(m[1]) and secret_value(m[3]) and m[1].lower() != m[3].lower():
            yield "RX-HARDCODED-SECRET", "CWE-200", 0.85, s.line_at(m.start())


def unchecked_pointers(s: Source) -> Iterator[tuple[str, str, float, int]]:
    """Allocations used within the next lines before any test for null.

    The events of a pointer's name, tests and uses, are listed once for each
    name; the first after an allocation decides, a test before a use of its
    line.
    """
    lines = s.masked.splitlines()
    owned = [(i, m[1]) for i, line in enumerate(lines) for m in _compiled["ALLOCATED"].finditer(line)]
    events: dict[str, list[tuple[int, bool]]] = {}
    for name in {n for _, n in owned}:
        marks = [(re.compile(pattern.replace("NAME", re.escape(name))), used) for pattern, used in ((T.NULL_TESTED, False), (T.DEREFERENCED, True))]
        events[name] = sorted((i, used) for i, line in enumerate(lines) if name in line for pattern, used in marks if pattern.search(line))
    for i, name in owned:
        after = [e for e in events[name] if i < e[0] <= i + T.DEREFERENCE_WINDOW]
        if after and after[0][1]:
            yield "RX-C-NULL-DEREF", "CWE-476", 0.6, after[0][0] + 1


def scan(code: str | None, min_confidence: float = 0.0) -> list[dict]:
    """Findings of a text, by line, falling confidence and rule; of the patterns the most confident of a class and line only, and none where the syntax rules have found the class."""
    if not code or not code.strip():
        return []
    tree = python_rules.parsed(code)
    module = None if tree is None else python_rules.Module(tree)
    s = Source(code, module.doc_lines if module else frozenset())
    found: dict[tuple[str, int], tuple] = {}
    for rule, cwe, sure, line, text in python_rules.findings(module, s.lines) if module else ():
        found.setdefault((rule, line), (rule, cwe, sure, line, text))
    covered = {(cwe, line) for _, cwe, _, line, _ in found.values()}
    hits = [(rule, cwe, sure, s.line_at(m.start()), None) for rule, cwe, sure, pattern, check, syntax in _rules if not (module and syntax) and (not check.startswith("sql") or s.has_sql) for m in pattern.finditer(s.masked) if CHECKS[check](s, m, cwe)]
    if not module:
        hits += [(*h, None) for h in (*secrets(s), *unchecked_pointers(s))]
    best: dict[tuple[str, int], tuple] = {}
    for h in hits:
        if h[2] > best.get((h[1], h[3]), (None, None, -1.0))[2]:
            best[h[1], h[3]] = h
    for h in best.values():
        if (h[1], h[3]) not in covered:
            found.setdefault((h[0], h[3]), h)
    ordered = sorted((h for h in found.values() if h[2] >= min_confidence), key=lambda h: (h[3], -h[2], h[0]))

    def shown(line: int, text: str | None) -> str:
        text = " ".join((s.line(line) if text is None else text).split())
        return text if len(text) <= T.MAX_EVIDENCE_CHARS else text[: T.MAX_EVIDENCE_CHARS - 3] + "..."

    return [{"seq": i, "cwe": cwe, "name": CLASSES[cwe][0], "confidence": sure, "line": line, "rule_id": rule, "evidence": shown(line, text)} for i, (rule, cwe, sure, line, text) in enumerate(ordered)]


#: What a finding of the syntax rules, or of secrets, takes at least, in lower case: one of each group.
SYNTAX_NEEDS = (
    (("eval", "exec", "system", "popen", "getoutput", "getstatusoutput", "subprocess", "pickle", "dill", "marshal", "shelve", "yaml"), ("(",)),
    (tuple(sorted(python_rules.T.SQL_SINKS)), ("(",), *needed(T.SQL)[:1]),
    (("verify", "cert_none", "check_hostname", "hashlib", "autoescape", "render_template_string", "mark_safe", "markup", "_create_unverified_context"),),
    (("response", "flask"), ("<",)),
    ((*sorted(T.SECRET_NAME_WORDS), "key"), ('"', "'"), ("=", ":")),
)
#: Letters that Python reads as others in names.
COMPATIBLE = r"[\u00AA\u00BA\u017F\u1D2C-\u1D6A\u2070-\u209F\u2100-\u214F\u2460-\u24FF\uFB00-\uFB06\uFF00-\uFFEF\x{1D400}-\x{1D7FF}]"


def worth_scanning(code: Column) -> Column:
    """Whether a text has the literals that some rule needs; null for a null."""

    def rules(x: Column) -> Column:
        each = [may_match(x["t"], x["low"], pattern) & (may_match(x["t"], x["low"], T.SQL) if check.startswith("sql") else F.lit(True)) for _, _, _, pattern, check, _ in T.RULES]
        each += [may_match(x["t"], x["low"], p) for p in (T.SECRET_ASSIGNED, T.ALLOCATED)]
        group = lambda literals: reduce(lambda a, b: a | b, [x["low"].contains(y) for y in literals])
        # a secret's name decides, not its pattern, which prose may have the signs of
        each[len(T.RULES)] &= group(SYNTAX_NEEDS[-1][0])
        each += [reduce(lambda a, b: a & b, map(group, needs)) for needs in SYNTAX_NEEDS]
        return reduce(lambda a, b: a | b, each) | x["t"].rlike(COMPATIBLE)

    # bound as a variable, so that the text is folded once
    return F.get(F.transform(F.array(F.struct(code.alias("t"), folded(code).alias("low"))), rules), F.lit(0))


def scan_table(df: DataFrame, id_col: str, code: str, min_confidence: float = 0.0) -> DataFrame:
    """id and the findings of every row, a row for each; only texts that may have any go to Python."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("seq", pa.int32()), ("cwe", pa.string()), ("name", pa.string()), ("confidence", pa.float64()), ("line", pa.int32()), ("rule_id", pa.string()), ("evidence", pa.string())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([scan(t, min_confidence) for t in b.column("code").to_pylist()], kind)], ["id", "found"])

    rows = df.where(worth_scanning(F.col(code))).select(F.col(id_col).alias("id"), F.col(code).alias("code")).mapInArrow(work, f"id {df.schema[id_col].dataType.simpleString()}, found array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>")
    return rows.select(F.col("id").alias(id_col), F.inline("found"))


_KINDS = {"int": S.IntegerType(), "string": S.StringType(), "double": S.DoubleType()}


@F.pandas_udf(S.ArrayType(S.StructType([S.StructField(name, _KINDS[kind]) for name, kind in map(str.split, FINDING.split(", "))])))
def findings_of(code: pd.Series) -> pd.Series:
    """Column function: the findings of a text."""
    return code.map(lambda t: scan(t))
