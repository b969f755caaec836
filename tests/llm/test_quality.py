"""The most frequent word of a text."""

import math

from voxledger.llm import quality


def test_top_word_counts_the_whole_text():
    top = lambda text: quality.statistics(text)[quality.STATISTICS.index("top_word")]
    words = [f"x{i}" for i in range(300)]
    words[10:100] = ["again"] * 90
    words[0] = words[100] = words[200] = "a"
    assert math.isclose(top(" ".join(words)), 90 / 300)
    assert top("a banana") == 0.5 and top("") == top(None) == 0
