"""Words and their parts are looked up once, and ids of many texts are gathered together."""

import numpy as np

from assaylake.llm import tokens


def test_a_part_that_words_share_is_looked_up_once():
    enc = tokens.Encoder(tokens.tokenizer_path())
    inner, asked = enc.parts, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(p for t in texts for p in t.split(" "))
            return inner.encode_batch_fast(texts, **options)

    enc.parts = Counted()
    texts = ["this this;## ##this 1234 4321", "THIS's this<|endoftext|> <|x this's", "", " \n\t", "é;é É;"]
    wanted = [enc.packed(x.ids) for x in enc.whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert enc.encode(texts) == wanted
    assert "this" in asked and len(asked) == len(set(asked))
    ids, lengths = enc.joined(texts, b"\x02\x00")
    assert ids.tobytes() == b"".join(x + b"\x02\x00" for x in wanted)
    assert lengths.tolist() == [len(x) // enc.width + 1 for x in wanted]
    assert np.array_equal(enc.joined([])[1], [])


def test_long_parts_are_not_kept():
    enc = tokens.Encoder(tokens.tokenizer_path())
    enc.encode(["a" * 65 + " " + "b" * 65 + ";c"])
    assert max(map(len, enc.words.young)) <= tokens.LONG
