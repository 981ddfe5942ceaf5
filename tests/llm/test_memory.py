"""What Python workers keep between tasks stays small."""

import itertools
import random
import tracemalloc

from zonalis.llm import packing
from zonalis.llm.queries import vocabulary

SIGNS = ["", "", ",", ".", "!?", "-", "'s", "…", "1"]


def drawn(n, seed):
    """Texts of 4,000 different words each, with some that come again."""
    rng = random.Random(seed)
    words = map("".join, itertools.product("aeioustrnéß", repeat=6))
    often = ["The", "the", "and", "Und", "", "été", "a.b", "x" * 100]
    return [
        " ".join(rng.choice(often) + "\n" + w.title() * rng.randint(0, 1) + w + rng.choice(SIGNS) for w in itertools.islice(words, 4_000))
        for _ in range(n)
    ]


def test_tokenizer_store_is_bounded_and_forgets_no_id():
    texts = drawn(40, 1)
    tokens = packing.WordTokenizer(vocabulary())
    tracemalloc.start()
    for t in texts:
        tokens.encode([t])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 40e6, held
    # Chunks known, forgotten and learned anew, in any order, have the library's ids.
    for t in [texts[-1], texts[0], *texts[-4:], texts[0][:-1] + "\tThe  the"]:
        assert tokens.encode([t])[0].tolist() == tokens.tokenizer.encode(t, add_special_tokens=False).ids


def test_tokenizer_keeps_no_long_chunk():
    tokens = packing.WordTokenizer(vocabulary())
    tracemalloc.start()
    for k in range(200):
        tokens.encode([f"{k:06d}-" * 2_000 + " end"])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 2e6, held
