"""Ids of words that the encoder meets for the first time."""
import numpy as np

from vigil.llm import packing

ODD = ["Straße", "ÀÉÎÕÜ", "µªº", "don't", "x²y", "ÿ", "a1b2", "&&&", "naïve,", "<|endoftext|>", "x<|startoftext|>y", "<|endoftext|", "日本", "ét",
       "Ωmega", "İstanbul", "\x1cword", "soft\xadhyphen", "ABCdef", "'s", "O'LL", "longer" * 30]


def test_equal_the_tokenizers_own():
    enc = packing.Encoder(packing.default_tokenizer())
    for text in [*ODD, " ".join(ODD), "  \n".join(ODD[::-1]) + "\t"]:
        want = enc.tokenizer.encode(text, add_special_tokens=False).ids
        for _ in range(2):                                 # learned, then known
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == want


def test_a_word_of_letters_is_one_part():
    """Such a word goes to the merge model as it is: it is neither searched for added tokens nor split."""
    class Never:
        def search(self, text):
            raise AssertionError(text)

        findall = search

    enc = packing.Encoder(packing.default_tokenizer())
    enc.special, enc._PARTS = Never(), Never()
    want = enc.tokenizer.encode("Kühlschrank keeps COLD", add_special_tokens=False).ids
    assert np.frombuffer(enc.encode("Kühlschrank keeps COLD"), "<u4").tolist() == want
