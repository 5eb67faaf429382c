"""Words are merged by the parts that the tokenizer cuts them into."""

import random

import public_tokenizers

from seqprep.llm import encode

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["'s", "'LL", "'d", "'", "don't", "Éa", "ßÿ", "µª", "7", "1234", "***", "<|", "|>", "<|endoftext|>", "x", "Word",
         "×", "÷", "²", "\x7f", "\t", "\x85", "\xa0", "é", "中", "İ", "ſ", "_", "@", "`", "\\", "[", "~", ",", "."]


def test_any_mix_of_parts_has_the_ids_of_the_whole():
    draw = random.Random(7)
    made = encode.WordEncoder(PATH)
    texts = ["".join(draw.choices(PARTS + [" "], k=draw.randint(1, 9))) for _ in range(4000)]
    for text, ids in zip(texts, made.encode(texts)):
        assert list(memoryview(ids).cast("I")) == made.whole(text), repr(text)


def test_every_latin_character_next_to_letters():
    made = encode.WordEncoder(PATH)
    texts = [t for c in map(chr, range(256)) for t in (f"a{c}b", c, f"A{c}", f"{c}{c}B1", f"{c}S'{c}")]
    for text, ids in zip(texts, made.encode(texts)):
        assert list(memoryview(ids).cast("I")) == made.whole(text), repr(text)


def test_words_with_marks_and_digits_are_not_encoded_whole():
    made = encode.WordEncoder(PATH)
    whole = []

    class Counted:
        model = made._tokenizer.model

        def encode(self, word, **how):
            whole.append(word)
            return made._tokenizer.encode(word, **how)

    words = encode._Words(Counted(), {})
    assert words["chheitein***"] and words["(Été"] and words["x-1:2.5"] and words['"word"?!']
    assert whole == []
    assert words["<|x|>"] and words["中"] and whole == ["<|x|>", "中"]
