import re
from collections import Counter

from tessera.llm import quality

PROSE = "The quick brown fox jumps over one lazy dog again today. "


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def words(n, at=0):
    return " ".join(f"tok{i}" for i in range(at, at + n)) + "."


def test_counts(odd_docs, make_docs):
    texts = {r.doc_id: r.text or "" for r in odd_docs.select("doc_id", "text").collect()}
    got = quality.line_quality(odd_docs).collect()
    assert len(got) == 9
    for r in got:
        n, chars, symbols, dup, rep = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
    assert quality.line_quality(make_docs([])).count() == 0


def test_verdicts(make_docs):
    rows = [
        (1, words(60)),
        (2, words(60) + "\n" + "Home | About | Menu | Contact | Help"),
        (3, "\n".join(words(30, i * 30) + " | a | b | c" for i in range(3))),
        (4, " ".join(f"tok{i}$$$" for i in range(80))),
        (5, " ".join(f"TOK{i}!!" for i in range(80))),
        (6, words(10)),
        (7, PROSE * 20),
        (8, words(55) + "\nClick here to subscribe to our newsletter\nhome\n" + words(20, 100)),
        (9, words(20) + "\n" + "\n".join(f"Privacy policy {words(20, i * 50)}" for i in range(1, 5))),
    ]
    got = {r.doc_id: r for r in quality.line_quality(make_docs(rows)).collect()}
    assert {i: r.kept for i, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False, 8: True, 9: False}
    assert got[8].cleaned == words(55) + "\n" + words(20, 100) and got[7].base_failed
