"""Statistics of one whole text."""

from __future__ import annotations

import numpy as np

from pactspark.llm.words import WordHashes, mix64

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
NAMES = (
    "log_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "top_word_share", "same_neighbour_share",
    "upper_share", "digit_share", "bang_per_word", "bar_per_word", "stop_per_word", "comma_per_word", "other_punctuation_per_word", "non_ascii_share", "words_per_line", "upper_words_share",
)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_PUNCTUATION = np.isin(np.arange(256), list(b"\"'()-/:;?@[\\]^_`{}~+="))


def repeated(ids: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which the text holds twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    code = np.zeros(n, np.uint64)
    for j in range(width):
        code = mix64(code + ids[j : j + n] + np.uint64(j + 1))
    _, where, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[where] > 1)
    hit = np.zeros(len(ids), bool)
    for j in range(width):
        hit[twice + j] = True
    return int(hit.sum())


def describe(text: str | None, cache: WordHashes) -> tuple[list[int], list[float]]:
    """The BASE counts and the NAMES features of a text (null: empty)."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = int(h.sum() - h[_CONTINUES].sum())
    n = len(words)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    ids = cache.of(words)
    again = repeated(ids)
    base = [n, points - int(h[_SPACE].sum()), int(h[_SYMBOL].sum()), dup, again]
    per, size = max(n, 1), max(len(raw), 1)
    counts = np.unique(ids, return_counts=True)[1]
    upper, lower = int(h[65:91].sum()), int(h[97:123].sum())
    shouted = sum(map(bytes.isupper, words))
    features = [
        np.log1p(n), base[1] / per, base[2] / per, dup / max(lines, 1), again / per, len(counts) / per, (int(counts.max()) if n else 0) / per, float((ids[1:] == ids[:-1]).sum()) / per,
        upper / max(upper + lower, 1), int(h[48:58].sum()) / size, int(h[33]) / per, int(h[124]) / per, int(h[46]) / per, int(h[44]) / per, int(h[_PUNCTUATION].sum()) / per, int(h[128:].sum()) / size, np.log1p(n / max(lines, 1)), shouted / per,
    ]
    return base, features
