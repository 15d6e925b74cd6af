import random

import tiktoken

from lexiflow.llm import bpe_tokens
from lexiflow.llm.queries import tokenizer


def reference():
    path, pattern = tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe_tokens.load_ranks(path), special_tokens={})


def test_same_ids_as_tiktoken():
    path, pattern = tokenizer()
    rng, ours, theirs = random.Random(3), bpe_tokens.encoder(path, pattern), reference()
    letters = "abcdeéßñ你\U0001f600 \n\t'.0123456789ABC"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(300)]
    texts += ["a" * 5000, "ab" * 3000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "don't we'll \x85 \u2003x"]
    assert ours.encode_many(texts) == [theirs.encode_ordinary(x) for x in texts]


def test_scalar_and_batched_merges_agree():
    path, _ = tokenizer()
    ranks, rng = bpe_tokens.load_ranks(path), random.Random(5)
    pieces = [bytes(rng.choice(b"the andingxyz\xc3\xa9") for _ in range(rng.randrange(1, 65))) for _ in range(500)]
    assert bpe_tokens.Merger(ranks).many(pieces) == [tuple(bpe_tokens.merge_ranks(p, ranks)) for p in pieces]


def test_small_memory_gives_the_same_ids():
    path, pattern = tokenizer()
    small = bpe_tokens.Encoder(bpe_tokens.load_ranks(path), pattern, most=20)
    texts = [" ".join(f"tok{i * j}" for i in range(30)) for j in range(20)]
    assert [small.encode(x) for x in texts] == [reference().encode_ordinary(x) for x in texts]


def test_round_trip(spark):
    texts = [(1, "Grüße, 你好 \U0001f600\n\n x"), (2, None), (3, "")]
    path, pattern = tokenizer()
    ids = bpe_tokens.encode(spark.createDataFrame(texts, "doc_id long, text string"), path, pattern)
    back = {r["id"]: bytes(r["decoded"]).decode() for r in bpe_tokens.decode(ids, path).collect()}
    assert back == {1: texts[0][1], 2: "", 3: ""}
