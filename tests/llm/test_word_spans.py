import re

import numpy as np

from lakewatch.llm.common import span_hashes, word_spans


def test_words_end_at_the_six_separators_only_and_equal_words_have_equal_hashes():
    text = b"".join(bytes([65, c, 66]) for c in range(256)) + b" " + b" ".join(b"abcdefghijkl"[:n] for n in range(1, 13)) * 2
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(data, np.array([0, len(data)]))
    assert list(zip(starts.tolist(), ends.tolist())) == [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    words = [text[a:b] for a, b in zip(starts, ends)]
    assert len(set(span_hashes(data, starts, ends).tolist())) == len(set(words))
