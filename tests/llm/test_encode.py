import base64
import random
from pathlib import Path

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelode.llm import encode

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
VOCAB = Path("/opt/tokenizers/byte_bpe_50k.tiktoken")
ALPHABET = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "B", "é", "1", "½", "\xa0", "!", "?", "''", "’", "​", "́", "漢", "\r\n", "_", "-", "\x85", "\x1c", "　", "🙂"]


def words(texts):
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    begins = np.cumsum([0] + [len(t) for t in texts])[:-1]
    at = encode.word_starts(cp, begins)
    whole = "".join(texts)
    return [whole[a:b] for a, b in zip(at, [*at[1:], len(whole)])]


@given(st.lists(st.lists(st.sampled_from(ALPHABET), min_size=1, max_size=12).map("".join), min_size=1, max_size=5))
@settings(max_examples=400, deadline=None)
def test_boundaries(texts):
    assert words(texts) == [w for t in texts for w in PATTERN.findall(t)]


def test_collisions_are_found(monkeypatch):
    zero = np.zeros(0x110000, np.uint64)
    monkeypatch.setattr(encode, "_salts", lambda: (zero, np.uint64(3), np.uint64(pow(3, -1, 2**64))))
    cp = np.frombuffer("ab cd ab ef x cd".encode("utf-32-le"), np.uint32)
    starts = np.array([0, 3, 6, 9, 12, 14])
    ends = np.array([2, 5, 8, 11, 13, 16])
    kind, order = encode._distinct(cp, starts, ends)
    names = ["ab", "cd", "ab", "ef", "x", "cd"]
    assert [names[order[k]] for k in kind] == names


@pytest.fixture(scope="module")
def vocab():
    if not VOCAB.exists():
        pytest.skip("no vocabulary here")
    return encode.vocabulary(str(VOCAB))


def test_ids_and_round_trip(vocab):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN.pattern, mergeable_ranks=vocab.ranks, special_tokens={})
    rnd = random.Random(4)
    texts = ["".join(rnd.choices(ALPHABET, k=rnd.randrange(0, 40))) for _ in range(400)] + [None, "", "<|endoftext|>", "word " * 50_000, "x" * 20_000]
    ids, stop, places = encode.encode(texts, vocab, offsets=True)
    at = 0
    for t, end in zip(texts, stop):
        mine = ids[at:end].tolist()
        assert mine == (own.encode_ordinary(t) if t else []) and encode.decode_ids(mine, vocab) == (t or "")
        assert all(0 <= p < len(t) for p in places[at:end])
        at = end


def test_own_merging(vocab):
    for w in ("hello", " Doriholt", "Gärtner", "zzzqqq", " 3985", "🙂"):
        assert vocab.merge(w.encode()) == vocab.word(w).tolist()


def test_table(spark, tmp_path):
    path = tmp_path / "v"
    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b" a"]
    path.write_text("\n".join(f"{base64.b64encode(r).decode()} {i}" for i, r in enumerate(ranks)))
    df = spark.createDataFrame([(1, "abc ab", "k"), (1, "abc ab", "k"), (2, None, "k"), (3, "", "k"), (None, "é", "k")], "id bigint, text string, key string")
    out = encode.encode_table(df, "id", "text", str(path))
    assert out.columns == ["id", "ids"]
    assert sorted(((r.id or 0), r.ids) for r in out.collect()) == [(0, [0xC3, 0xA9]), (1, [257, 32, 256]), (1, [257, 32, 256]), (2, []), (3, [])]
    assert encode.encode_table(df, "id", "text", str(path), offsets=True).where("id = 1").first().places == [0, 3, 3]
    assert encode.encode_table(df.limit(0), "id", "text", str(path)).count() == 0
