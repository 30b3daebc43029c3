"""Words are cut into parts before they are tokenised; blocks, caches and groups of any size give the tokenizer's ids."""

import random

import public_tokenizers

from sedimill.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = [*"abcdeszßÀÉéñÿÞþÐð×÷ªµ'’.,:!?&#<|>\x00\x1c\x7f\x85\xa0　 \t\n\r\x0b\x0c019²½Ⅷ字क़İıΣςσ😀", "́", "̣", "'s", "'LL", "x's", "<|endoftext|>", "<|ENDOFTEXT|>", "</w>", "The", "12.5", "A-b", "  "]


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.asked += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_decorated_words_are_not_tokenised_one_by_one():
    ids = packing.WordIds(PATH)
    plain, ids.tokenizer = ids.tokenizer, Counting(ids.tokenizer)
    rng = random.Random(3)
    words = ["".join(rng.choices(["er", "on", "the", "ción", "ré", "über", "an"], k=5)) for _ in range(2000)]
    text = " ".join(f"{w}{mark} {w.title()}" for w in words for mark in (".", ",", "&&&", "###", "7"))
    assert ids([text.encode()])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert ids.tokenizer.asked <= len(words) / 100


def test_ids_of_odd_texts_in_blocks_of_any_size(monkeypatch):
    ids, rng = packing.WordIds(PATH), random.Random(4)
    for _ in range(600):
        for name, sizes in (("CHUNK", (1, 3, 17, 100, 2_000_000)), ("CACHE", (0, 5, 1_000_000)), ("CACHED", (1, 8, 64)), ("JOINED", (1, 7, 256))):
            monkeypatch.setattr(packing, name, rng.choice(sizes))
        texts = ["".join(rng.choices(SIGNS, k=rng.choice((0, 1, 2, 8, 200)))) for _ in range(rng.choice((1, 5, 40)))]
        want = [e.ids for e in ids.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [x.tolist() for x in ids([t.encode() for t in texts])] == want
    assert [len(x) for x in ids([b"", "\xa0".encode(), b" \n"])] == [0, 0, 0] and ids([]) == [] and ids(["　".encode()])[0].tolist() == []
