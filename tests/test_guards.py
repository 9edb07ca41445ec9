import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import rule_table as T
from tessera.functions import security_patterns as P
from tessera.functions.guards import needed
from tessera.functions.security_features import features
from tessera.operators.rules import scan, worth_scanning
from tessera.plans import planted

from .test_features import CODES
from .test_rules import FIRES, SILENT

PATTERNS = sorted({v for v in [*vars(P).values(), *(r[3] for r in T.RULES), T.SQL, T.SECRET_ASSIGNED, T.ALLOCATED] if isinstance(v, str) and len(v) > 1 and not v.startswith("Patterns")})


def holds(pattern, text):
    text = text.lower().replace("ſ", "s").replace("ı", "i") if re.compile(pattern).flags & re.I else text
    return all(any(x in text for x in part) for part in needed(pattern))


def mixed(n):
    """Texts made of pieces of codes in any case and order."""
    rng = random.Random(7)
    codes = [*(c for c in CODES.values() if c), *(c for c, _ in FIRES), *SILENT, *(r[0] for r in planted.RULES), *(c for _, c, _ in planted.FEATURES)]
    pieces = [x for c in codes for x in re.findall(r"\w+|\s+|[^\w\s]+", c)]
    for _ in range(n):
        t = "".join(rng.choice([*codes, rng.choice(pieces)]) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(1, 8)))
        yield rng.choice([t, t, t.upper(), t.lower(), t.swapcase(), t.replace("s", "ſ")])


def test_no_guard_hides_a_match():
    texts = list(mixed(3000))
    for p in PATTERNS:
        seen = [t for t in texts if re.search(p, t)]
        assert all(holds(p, t) for t in seen), p


@pytest.mark.parametrize(("pattern", "parts"), [(r"(?i)\bab(?:c|d)+x?", {("ab",), ("c", "d")}), (r"a|b?", set()), (r"[^a]\s*\d", set()), (r"(?:foo|bar)\s*\(", {("bar", "foo"), ("(",)}), (r"(?:x(?=y)|z)*w", {("w",)})])
def test_needed(pattern, parts):
    assert set(needed(pattern)) == parts


def test_texts_with_findings_are_worth_scanning(spark):
    texts = [*mixed(1500), "ｅval(x)", "𝐞val(x)", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, code string").select("i", worth_scanning(F.col("code")).alias("w")).collect()
    assert all(r.w for r in rows if scan(texts[r.i]))
    prose = spark.createDataFrame([("The river (wide and slow) ran past the mill; nobody spoke.",)], "code string")
    assert not prose.select(worth_scanning(F.col("code"))).first()[0]


def test_features_with_and_without_guards(spark, monkeypatch):
    from tessera.functions import security_features as S

    texts = [t for t in mixed(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    shown = lambda: {r.i: r.asDict() for r in df.select("i", *[c.alias(n) for n, c in features(F.col("t")).items()]).collect()}
    guarded = shown()
    monkeypatch.setattr(S, "may_match", lambda t, low, pattern: F.lit(True))
    assert guarded == shown()
