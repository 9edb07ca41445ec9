import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_counts
from tessera.llm._tokens import ByteUnits, WordUnits

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = ["a  b", "a \n b", "\tfoo bar", "x <|endoftext|> y", " lead", "trail ", "a\n\nb", "it's we'll", "Á b́ ́c", "x\x1cy z", "<|endoftext|>", "foo<|endoftext|> bar", "", " ", "\n", "a\x00b c", "\x02 x", " ́a", "don't 12 345", "İx ΑΣ ΑΣ.", "end?! (quote) 'S", "日本語 の 文。", "a b c", "naïve Æther ﬁne"]


def test_units_equal_the_library():
    for path, got in ((BYTE, ByteUnits(BYTE).counts(HARD)), (WORD, [list(memoryview(x).cast("H")) for x in WordUnits(WORD).ids(HARD)])):
        want = [x.ids for x in Tokenizer.from_file(path).encode_batch(HARD, add_special_tokens=False)]
        assert got == ([len(x) for x in want] if path == BYTE else want)


def test_cache_encodes_only_misses(spark, make_docs, tmp_path, odd_docs):
    cache = f"file://{tmp_path}/cache"
    first = make_docs([(1, "one two"), (2, "one two"), (3, None)])
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(first, BYTE, cache).collect()} == {1: 2, 2: 2, 3: 0}
    assert spark.read.parquet(cache).count() == 2
    token_counts.count_tokens(make_docs([(9, "one two"), (8, "three")]), BYTE, cache).collect()
    assert spark.read.parquet(cache).count() == 3
    # equal rows appended twice do no harm
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert token_counts.count_tokens(first, BYTE, cache).count() == 3
    out = token_counts.count_tokens(odd_docs, BYTE, cache).collect()
    tk = Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text or "" for r in odd_docs.select("doc_id", "text").collect()}
    assert len(out) == 9 and all(r.n_tokens == len(tk.encode(texts[r.doc_id]).ids) and r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 1024) for r in out)


@pytest.mark.parametrize("n", [0])
def test_empty(make_docs, tmp_path, n):
    assert token_counts.count_tokens(make_docs([]), BYTE, f"file://{tmp_path}/c").count() == n
