import hashlib
import re

from tessera.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(n) <= 19 and luhn(n), "phone": 8 <= len(n) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    "mail a.b+c@ex-1.example.com, x@y.z_w@q.r and a@b-@c.d @no.where z@",
    "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 and 007.0.0.0255 255.255.255.255.",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 41111111111111111111 4 1",
    "é+1 (017) 555-7713 ++44 20 7946 0958 +1 2 +123456789012345678 + 5",
    "9" * 3000 + "@" + "a" * 3000 + ".b" + "+" + "1 " * 4000,
    "+1.2.3.4.5.6.7.8", "", "none",
]


def test_base_spans(make_docs, odd_docs):
    rows = [*enumerate(TEXTS), (98, None), (99, TEXTS[0]), (99, TEXTS[0])]
    got = pii.digest(pii.find(make_docs(rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(dict(rows)[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]
    assert pii.find(odd_docs).count() == 9 and pii.find(make_docs([])).count() == 0


def test_contexts_discover_unseen_identifiers(make_docs):
    rows = [(i, f"Please call me at +1 555 010 {1000 + i} now") for i in range(8)] + [(20, "Please call me at 555 010 7777 now"), (21, "Order 555 010 7777 of them"), (22, "call me at noon 7")]
    rows += [(30 + i, f"Order 12{i} 345 678 of them") for i in range(9)]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(make_docs(rows))).collect()}
    start = rows[8][1].index("555")
    assert got[20] == f"phone:{start}:{start + 12}" and got[21] == "" and got[22] == "" and not any(got[30 + i] for i in range(9))


def test_masking(make_docs):
    rows = [(1, "a x@y.zz b 1.2.3.4"), (1, "a x@y.zz b 1.2.3.4"), (1, "clean"), (None, "x@y.zz"), (2, None), (3, "+1.2.3.4.5.6.7.8 end")]
    out = pii.masked(make_docs(rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(1, "a <EMAIL> b <IP>"), (1, "a <EMAIL> b <IP>"), (1, "clean"), (0, "<EMAIL>"), (2, ""), (3, "<PHONE> end")])


def found(make_docs, rows):
    out = {r.doc_id: r.spans for r in pii.digest(pii.find(make_docs(rows))).collect()}
    return {i: [t[int(s) : int(e)] for s, e in (x.split(":")[1:] for x in filter(None, out[i].split(",")))] for i, t in rows}


def test_lists_share_the_context_of_their_first(make_docs):
    rows = [(i, f"Please call me at +1 555 010 {1000 + i} now") for i in range(8)] + [(20, "Please call me at 555 010 7777, 555 010 7778 now")]
    assert found(make_docs, rows)[20] == ["555 010 7777", "555 010 7778"]


def test_what_is_found_leads_on_to_more(make_docs):
    rows = [(i, f"Please call me at +1 555 010 {1000 + i} now") for i in range(30)]
    rows += [(100 + i, f"Please call me at 555 010 {2000 + i} now") for i in range(5)]  # found by the first pattern
    rows += [(200 + i, f"her other line is 555 010 {2000 + i} again") for i in range(5)]  # a pattern of found ones only
    rows += [(300, "her other line is 555 010 3000 again")]  # in no other place
    got = found(make_docs, rows)
    assert got[100] == ["555 010 2000"] and got[200] == ["555 010 2000"] and got[300] == ["555 010 3000"]


def test_long_words_are_whole_contexts(make_docs):
    word = "w" * 200
    rows = [(i, f"x {word} +1 555 010 {1000 + i} y") for i in range(8)] + [(20, f"z {word} 555 010 7777 y"), (21, f"z v{word} 555 010 8888 y")]
    got = found(make_docs, rows)
    assert got[20] == ["555 010 7777"] and got[21] == []
