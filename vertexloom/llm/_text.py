"""Statistics of one text, over words and lines, for the quality operators."""

from __future__ import annotations

import numpy as np

SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_KIND = np.zeros(256, np.uint8)  # 1 space, 2 upper, 3 lower or beyond ASCII, 4 digit, 5 symbol, 6 other punctuation, 7 continuation
_KIND[:128] = 6
_KIND[128:] = 3
_KIND[0x80:0xC0] = 7
_KIND[list(b" \t\n\x0b\x0c\r")] = 1
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 2, 3, 4
_KIND[SYMBOLS] = 5
#: What ``measure`` gives, in its order. The shares are of word characters, words or lines as they say.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("mean_word", "upper_share", "digit_share", "symbol_share", "punct_share", "dup_line_share", "repeat_share", "distinct_share", "top_word_share", "same_next_share", "loud_word_share", "symbol_word_share", "words_per_line", "max_run_share")


def repeated(ids: np.ndarray, width: int = 5) -> int:
    """How many words lie in windows of ``width`` words that are found twice or more; exact, by packing ids."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = np.unique(ids, return_inverse=True)[1].astype(np.uint64)
    base = int(key.max()) + 1
    held = base
    code = key[:n].copy()
    for k in range(1, width):
        if held * base >= 1 << 63:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
            held = int(code.max()) + 1
        code = code * np.uint64(base) + key[k : k + n]
        held *= base
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[list[int], list[float], list[bytes]]:
    """The counts, the shares and the words of a text; an empty one has zeros."""
    words = text.split()
    if not words:
        n_symbols = 0
        return [0, 0, n_symbols, 0, 0], [0.0] * len(SHARES), words
    n = len(words)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=8)
    chars = int(kinds[2:7].sum())
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    local: dict[bytes, int] = {}
    ids = np.fromiter((local.setdefault(w, len(local)) for w in words), np.int64, n)
    repeats = repeated(ids)
    often = np.bincount(ids)
    change = np.flatnonzero(ids[1:] != ids[:-1]) + 1
    runs = np.diff(np.concatenate([[0], change, [n]]))
    loud = sym = 0
    for w, k in local.items():
        c = often[k]
        if len(w) > 2 and w.isupper():
            loud += c
        if w[-1] in b"#*$%&|<>!":
            sym += c
    shares = [chars / n, kinds[2] / chars, kinds[4] / chars, kinds[5] / chars, kinds[6] / chars, dup / lines, repeats / n, len(local) / n, often.max() / n, float((ids[1:] == ids[:-1]).sum()) / n, loud / n, sym / n, n / lines, runs.max() / n]
    return [n, chars, int(kinds[5]), dup, repeats], [float(s) for s in shares], words
