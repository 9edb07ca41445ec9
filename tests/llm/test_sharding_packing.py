import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import _order, packing, sharding

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_positions_are_exact(spark, monkeypatch):
    monkeypatch.setattr(_order, "ROWS", 50)
    rows = [(f"{'hot' if i % 3 else f'{i:05d}'}{i:05d}", i % 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "_key string, _w long")
    got = sorted(_order.positions(df, 8).collect(), key=lambda r: r._key)
    at = 0
    for i, ((key, w), r) in enumerate(zip(sorted(rows), got, strict=True)):
        assert (r._key, r._rank, r._before) == (key, i, at)
        at += w


def check_shards(rows, n, shards, slack):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert len(rows) == n and set(by) <= set(range(shards))
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    sums = [sum(r.size for r in by.get(s, [])) for s in range(shards)]
    assert max(sums) - min(sums) <= slack


def test_shards(make_docs, odd_docs):
    docs = make_docs([(i, "same text " * 50 if i % 3 == 0 else f"text {i} " * (i % 40)) for i in range(2000)])
    rows = sharding.shard_by_bytes(docs, 10).collect()
    check_shards(rows, 2000, 10, 1200)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == 16 + len(texts[r.doc_id].encode()) and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    odd = sharding.shard_by_bytes(odd_docs, 4).collect()
    check_shards(odd, 9, 4, 10**9)
    assert sharding.shard_by_bytes(make_docs([]), 4).count() == 0


def test_levels_fill_to_one_height():
    room = sharding.levels([0, 10, 50, 0], 30)
    assert abs(sum(room) - 30) < 1e-9 and room[2] == 0 and abs(room[0] - (room[1] + 10)) < 1e-9


def test_hilbert_neighbours_touch():
    bits, dims = 3, 2
    cells = np.array([(x, y) for x in range(8) for y in range(8)])
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(64))
    along = cells[np.argsort(keys)]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_pack_round_trip(odd_docs, make_docs):
    tk = Tokenizer.from_file(WORD)
    pieces = packing.pack(odd_docs, WORD, 256).collect()
    want = sorted(tuple([*tk.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in odd_docs.select("text").collect())
    seqs, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.frombuffer(bytes(p.piece_ids), "<u2").astype("<u4").tobytes())
        seqs[p.sequence_id].append(p)
        docs[p.doc_id, p.doc_tokens].append(p)
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 256 or at & (at - 1) == 0
    total = sum(p.length for p in pieces)
    assert total == sum(map(len, want)) and len(seqs) == total // 256 + bin(total % 256).count("1")
    unique = {k: v for k, v in docs.items() if k[0] != 3}
    for (_, n), ps in unique.items():
        ids = b"".join(bytes(p.piece_ids) for p in sorted(ps, key=lambda p: p.start))
        assert len(ids) == 2 * n and tuple(np.frombuffer(ids, "<u2").tolist()) in want
    assert packing.pack(make_docs([]), WORD, 256).count() == 0


def test_equal_documents_are_neighbours(make_docs):
    rows = [(i, f"alpha beta {'gamma' if i % 2 else 'delta omega nu'} " * 5) for i in range(40)]
    order = sorted(packing.pack(make_docs(rows), WORD, 64).collect(), key=lambda p: (p.sequence_id, p.offset))
    kinds = [p.doc_id % 2 for p in order]
    assert sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) == 1


def test_equal_rows_are_cut_like_others(make_docs, monkeypatch):
    from tessera.llm import _order

    monkeypatch.setattr(_order, "ROWS", 20)
    out = sharding.shard_by_bytes(make_docs([(None, "same text")] * 400), 4).collect()
    assert sorted(sum(r.shard == s for r in out) for s in range(4)) == [100] * 4
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(100)) for s in range(4))
    # heavy rows of one id and one text
    out = sharding.shard_by_bytes(make_docs([(1, "x" * 5000)] * 6 + [(i, "y") for i in range(40)]), 3).collect()
    assert len(out) == 46 and sorted(sum(r["size"] > 5000 for r in out if r.shard == s) for s in range(3)) == [2, 2, 2]


def test_ids_that_are_texts(spark):
    docs = spark.createDataFrame([(f"id{i}", f"text {i}") for i in range(20)] + [(None, "n")], "doc_id string, text string")
    assert sorted(r.doc_id or "" for r in sharding.shard_by_bytes(docs, 3).collect()) == sorted([""] + [f"id{i}" for i in range(20)])
