"""Words of many texts at once, as codes of the different words, so that Python looks at each different word only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken apart at a time (a longer text comes alone).
AT_ONCE = 2 << 20


def portions(texts: pa.Array, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Runs of texts, as begin and end, of so many bytes at most."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    begin = 0
    while begin < len(size):
        done = int(size[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + most, side="right")))
        yield begin, end
        begin = end


def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The code of every word in order, the number of words of each text, and the different words by code.

    Words are what ASCII white space separates; null counts as empty. Give the texts in the case that is wanted.
    """
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten().dictionary_encode()
    codes, sizes = np.asarray(flat.indices, np.int64), np.diff(np.asarray(lists.offsets)).astype(np.int64)
    sizes[np.asarray(pc.binary_length(texts)) == 0] = 0  # an empty text is split to one empty word
    blank = pc.index(flat.dictionary, pa.scalar("", flat.dictionary.type)).as_py()
    return codes[codes != blank] if blank >= 0 else codes, sizes, flat.dictionary


def spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[i]: starts[i] + sizes[i]] of every i, one after another."""
    total = int(sizes.sum())
    return values[np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of so many values; of an empty run 0."""
    out, some = np.zeros(len(sizes)), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out
