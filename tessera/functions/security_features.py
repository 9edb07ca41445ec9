"""The 45 security features of a code text, as built-in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import security_patterns as P
from tessera.functions.guards import folded, may_match
from tessera.functions.text import count_matches, found_from, match_spans, unicode

#: Characters read, windows before and after a statement, and after a loader call.
MAX_CHARS, BEFORE_SQL, AFTER_SQL, AFTER_LOAD = 4000, 80, 160, 120


def density(count: Column, n: Column) -> Column:
    """Hits in a hundred characters, on a log scale."""
    return F.log1p(100.0 * count / n)


def dynamic_sql(t: Column) -> Column:
    """Statements with dynamic string building near them."""
    near = lambda x: found_from(t, F.greatest(x["s"] - BEFORE_SQL, F.lit(0)), F.least(x["e"] + AFTER_SQL, F.length(t)), unicode(P.DYNAMIC_STRING))
    return F.size(F.filter(match_spans(t, unicode(P.SQL_STATEMENT)), near))


def unsafe_yaml(t: Column) -> Column:
    """Loader calls that no safe loader follows."""
    return F.size(F.filter(match_spans(t, unicode(P.YAML_LOAD)), lambda x: ~F.substring(t, x["e"] + 1, F.lit(AFTER_LOAD)).rlike(unicode(P.SAFE_LOADER))))


def bounds_checks(t: Column) -> Column:
    """Lines that compare a size in a condition."""
    return F.size(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(unicode(P.CONDITION)) & x.rlike(P.COMPARISON) & x.rlike(unicode(P.SIZE_TOKEN))))


def high_entropy_literals(t: Column) -> Column:
    """String literals that look like keys."""
    inner = F.transform(F.regexp_extract_all(t, F.lit(P.STRING_LITERAL), F.lit(0)), lambda m: F.substring(m, F.lit(2), F.length(m) - 2))

    def keyed(x: Column) -> Column:
        kinds = x.rlike(r"\p{javaLowerCase}").cast("int") + x.rlike(r"\p{javaUpperCase}").cast("int") + x.rlike(r"(?U)\d").cast("int")
        return (F.length(x) >= 16) & ~x.contains(" ") & (x.rlike(r"^[0-9a-fA-F]{32,}\z") | ((kinds >= 2) & x.rlike(r"^[\p{L}\p{N}+/=_.-]+\z")))

    return F.size(F.filter(inner, keyed))


def comment_chars(t: Column) -> Column:
    return F.aggregate(F.regexp_extract_all(t, F.lit(f"({unicode(P.COMMENT)})"), F.lit(1)), F.lit(0), lambda a, m: a + F.length(m))


def cut(code: Column) -> Column:
    """What counts of a code: a null is the empty text, and only the first MAX_CHARS characters are read."""
    return F.substring(F.coalesce(code, F.lit("")), 1, MAX_CHARS)


def features(t: Column, low: Column | None = None) -> dict[str, Column]:
    """Column name -> expression, in the features' fixed order, of a text that is cut already; `low` is the folded text, where that is at hand.

    Each count is made only where the text has literals that its pattern needs.
    """
    low = folded(t) if low is None else low
    n = F.greatest(F.length(t), F.lit(1))
    where = lambda count, *patterns: F.when(reduce(lambda a, b: a & b, [may_match(t, low, p) for p in patterns]), count).otherwise(0)
    hits = lambda *patterns: density(reduce(lambda a, b: a + b, [where(count_matches(t, unicode(p)), p) for p in patterns]), n)
    return {
        "mem_unsafe_str_fn": hits(P.UNSAFE_STRING_CALL),
        "mem_safe_str_fn": hits(P.SAFE_STRING_CALL),
        "mem_copy_fn": hits(P.MEMORY_COPY),
        "mem_alloca": hits(P.STACK_ALLOCATION),
        "mem_alloc": hits(P.ALLOCATION),
        "mem_free": hits(P.RELEASE),
        "mem_sizeof": hits(P.SIZEOF),
        "ptr_arrow": hits(P.ARROW),
        "ptr_deref_expr": hits(P.DEREFERENCE),
        "null_literal": hits(P.NULL_LITERAL),
        "null_check": hits(P.NULL_CHECK),
        "idx_arith": hits(P.INDEX_ARITHMETIC),
        "loop_le_bound": hits(P.LOOP_UP_TO),
        "fmt_nonliteral": hits(P.FORMAT_NOT_LITERAL),
        "fmt_pct_n": hits(P.FORMAT_WRITES),
        "inj_eval_exec": hits(P.EVALUATION),
        "inj_os_command": hits(P.OS_COMMAND),
        "inj_shell_true": hits(P.SHELL_TRUE),
        "sql_keyword": hits(P.SQL_STATEMENT),
        "sql_dynamic": density(where(dynamic_sql(t), P.SQL_STATEMENT), n),
        "sql_parameterized": hits(P.SQL_PARAMETERS),
        "deser_unsafe": density(where(count_matches(t, unicode(P.UNSAFE_DESERIALISATION)), P.UNSAFE_DESERIALISATION) + where(unsafe_yaml(t), P.YAML_LOAD), n),
        "deser_safe": hits(P.SAFE_DESERIALISATION),
        "xss_sink": hits(P.XSS_SINK),
        "xss_escape": hits(P.XSS_ESCAPE),
        "taint_source": hits(P.TAINT_SOURCE),
        "path_dotdot": hits(P.PARENT_PATH),
        "val_bounds_check": density(where(bounds_checks(t), P.CONDITION, P.COMPARISON, P.SIZE_TOKEN), n),
        "val_try_catch": hits(P.TRY_CATCH),
        "val_regex": hits(P.REGEX_VALIDATION),
        "val_unchecked_parse": hits(P.UNCHECKED_PARSE),
        "crypto_weak": hits(P.WEAK_HASH, P.WEAK_CIPHER),
        "crypto_strong": hits(P.STRONG_CRYPTO),
        "crypto_tls_off": hits(P.TLS_OFF),
        "secret_hardcoded": hits(P.HARDCODED_SECRET),
        "secret_high_entropy": density(where(high_entropy_literals(t), P.STRING_LITERAL), n),
        "rand_weak": hits(P.WEAK_RANDOM),
        "info_leak_output": hits(P.INFORMATION_LEAK),
        "gen_log_len": F.log1p(n) / 10.0,
        "gen_log_lines": F.log1p(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1) / 10.0,
        "gen_comment_ratio": F.least(where(comment_chars(t), P.COMMENT) / n, F.lit(1.0)),
        "gen_dyn_string": hits(P.DYNAMIC_STRING),
        "syntax_c": hits(P.SYNTAX_C),
        "syntax_script": hits(P.SYNTAX_SCRIPT),
        "syntax_jvm": hits(P.SYNTAX_JVM),
    }


def security_features(df: DataFrame, id_col: str, code: str) -> DataFrame:
    """id and the 45 features of every row."""
    # the cut and the folded text are made once, and read by all columns
    rows = df.select(F.col(id_col), cut(F.col(code)).alias("t")).select(id_col, "t", folded(F.col("t")).alias("low"))
    return rows.select(id_col, *[c.alias(name) for name, c in features(F.col("t"), F.col("low")).items()])
