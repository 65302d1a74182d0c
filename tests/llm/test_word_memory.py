"""Words that come again are encoded once, as far as the memory of words goes."""

import string

import numpy as np

from featlab.llm import tokens


def test_a_hundred_thousand_words_are_encoded_once():
    import public_tokenizers

    own = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    learn, sizes = own._parts, []
    own._parts = lambda new: (sizes.append(len(new)), learn(new))
    letters = string.ascii_lowercase
    words = [a + b + c + d + "q" for a in letters for b in letters for c in letters for d in letters[:6]]
    texts = [" ".join(words[k : k + 5000]) for k in range(0, len(words), 5000)]
    first = [own.encode_batch([t])[0] for t in texts]
    assert [own.encode_batch([t])[0] for t in texts] == first and sum(sizes) == len(words) > 100_000
    assert first[0] == np.array(own.whole.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()
